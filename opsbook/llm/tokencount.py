"""Token counts: a byte-pair vocabulary compiled to a deterministic transducer that emits counts.

A token sequence is the tokenizer's own if and only if each adjacent pair is what it makes of the pair's
text. So a prefix of a text has one last token, and the set of open tokens (a trie node, the token before
it, the count there) decides all that follows. These sets are the states; a transition on a character
emits the change in the number of tokens. States are made when first reached, as in a lazy automaton.

Texts are cut into chunks that run side by side. A chunk's map from entry to exit state is known only for the
entry states tried. After a space mark that follows another character, or after an unknown character, the state
does not depend on what came before; a chunk without either is first tried from the start state. A scan over the
chunks composes the maps: an entry whose exit is known is followed, and all chunks whose entry is new run again
side by side, each until it falls in with the run before it, mostly after a few characters. Rounds end when
every chunk's entry is the exit of the chunk before it; there are as many as entry states occur, not as chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # what a space becomes
LANE = 128  # characters in a chunk
SLOTS = 1 << 21  # room for transitions in a worker
FULL = SLOTS // 2  # when so many are used, the automaton starts anew from the state it is in
SECTION = 4096  # chunks that run side by side
BATCH_CHARS = 500_000
PAD, NEW = 0, 6  # classes: text boundary; 1-4 unknown characters by UTF-8 length; 5 the space mark; single characters


class Vocabulary:
    """Trie and merge order of a model's pieces: plain dictionaries of a size the vocabulary bounds."""

    def __init__(self, pieces: dict[str, float]) -> None:
        order = sorted((p for p in pieces if len(p) > 1), key=lambda p: -pieces[p])
        self.rank = {p: 0 for p in pieces if len(p) == 1} | {p: k + 1 for k, p in enumerate(order)}
        self.halves: dict[str, tuple[str, str]] = {}
        usable = [p for p in self.rank if len(p) == 1 or self._derive(p)]
        self.tokens = usable
        self.number = {p: k for k, p in enumerate(usable)}
        self.child: dict[tuple[int, str], int] = {}
        self.token_at: list[int] = [-1]
        self.inner: set[int] = {0}
        for k, p in enumerate(usable):
            node = 0
            for c in p:
                self.inner.add(node)
                if (node, c) not in self.child:
                    self.child[node, c] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[node, c]
            self.token_at[node] = k
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("a token crosses from another character to a space mark")

    def _derive(self, piece: str) -> bool:
        """Whether merging gives the piece itself; its last merge is kept."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            k = ranks.index(min(ranks))
            if ranks[k] == 1 << 30:
                return False
            if len(parts) == 2:
                self.halves[piece] = (parts[0], parts[1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def follows(self, a: int, b: int) -> bool:
        """Whether token b stays whole after token a: no merge across the border comes before theirs."""
        if a < 0:
            return True
        x, y, limit = self.tokens[a], self.tokens[b], 1 << 30
        while True:
            if self.rank.get(x + y, 1 << 30) < limit:
                return False
            rx, ry = self.rank[x], self.rank[y]
            if rx > ry:
                limit, x = rx, self.halves[x][1]
            elif ry:
                limit, y = ry + 1, self.halves[y][0]
            else:
                return True


def vocabulary(path: str) -> Vocabulary:
    """The ordinary pieces of a sentencepiece BPE model; control, unknown and byte pieces never match text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(sp.vocab_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    return Vocabulary({sp.id_to_piece(k): sp.get_score(k) for k in ids})


class TableFull(Exception):
    """The transitions reached no longer fit."""


class Transducer:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        singles = sorted(p for p in vocab.rank if len(p) == 1 and p != MARK)
        self.classes = NEW + len(singles)
        self.chars = ["", "", "", "", "", MARK, *singles]
        self.cls = np.full(0x110000, 4, np.uint16)
        self.cls[:0x10000], self.cls[:0x800], self.cls[:0x80] = 3, 2, 1
        self.cls[[ord(c) for c in singles]] = np.arange(NEW, self.classes)
        self.cls[[ord(MARK), 32]] = 5
        self.clear()

    def clear(self) -> None:
        self.states: list[bytes] = [struct.pack("3i", 0, -1, 0)]  # (trie node, token before, count) of each open token
        self.number = {self.states[0]: 0}
        self.key = np.full(SLOTS, -1, np.int64)
        self.next, self.emit = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int8)
        self.used = 0

    def transition(self, state: int, cls: int) -> tuple[int, int]:
        """(next state, change of the token count) for one character class."""
        if cls < 5:
            return 0, cls  # a boundary, or a character that becomes one token for each byte
        v, c, opened, taken = self.vocab, self.chars[cls], [], None
        for node, before, count in struct.iter_unpack("3i", self.states[state]):
            to = v.child.get((node, c))
            if to is None:
                continue
            if not node and before >= 0 and c == MARK and not v.tokens[before].endswith(MARK):
                before = -1
            if to in v.inner:
                opened.append((to, before, count))
            if v.token_at[to] >= 0 and v.follows(before, v.token_at[to]):
                taken = (v.token_at[to], count + 1)
        token, count = taken
        return self.state(b"".join(struct.pack("3i", n, b, k - count) for n, b, k in sorted(opened)) + struct.pack("3i", 0, token, 0)), count

    def state(self, packed: bytes) -> int:
        if packed not in self.number:
            self.number[packed] = len(self.states)
            self.states.append(packed)
        return self.number[packed]

    def step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character for every lane, through the hash table of known transitions."""
        key = state * self.classes + cls
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        have = self.key[slot]
        todo = np.flatnonzero(have != key)
        while len(todo):
            free = self.key[slot[todo]] < 0
            if free.any():
                for k in np.unique(key[todo[free]]).tolist():
                    if self.used >= FULL:
                        raise TableFull
                    self._insert(k)
            todo = todo[self.key[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            todo = todo[self.key[slot[todo]] != key[todo]]
        return self.next[slot].astype(np.int64), self.emit[slot]

    def _insert(self, key: int) -> None:
        at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 43
        while self.key[at] >= 0:
            if self.key[at] == key:
                return
            at = (at + 1) & (SLOTS - 1)
        self.next[at], self.emit[at] = self.transition(*divmod(key, self.classes))
        self.key[at] = key
        self.used += 1

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. All texts are one row of characters, run in sections of chunks."""
        full = [t for t in texts if t]
        out = np.zeros(len(texts), np.int64)
        if not full:
            return out
        # each text follows a boundary and a space mark; chr(0x10FFFF) marks the place of the boundary
        row = "".join("\U0010ffff" + MARK + t for t in full)
        chars = np.frombuffer(row.encode("utf-32-le"), np.uint32)
        heads = np.cumsum([0, *(len(t) + 2 for t in full)])[:-1]
        emit, state = np.zeros(len(chars), np.int8), 0
        for at in range(0, len(chars), SECTION * LANE):
            part = chars[at : at + SECTION * LANE]
            cls = self.cls[part].astype(np.int64)
            cls[heads[np.searchsorted(heads, at) : np.searchsorted(heads, at + len(part))] - at] = PAD
            emit[at : at + len(part)], state = self.section(cls, state)
        out[[k for k, t in enumerate(texts) if t]] = np.add.reduceat(emit, heads, dtype=np.int64)
        return out

    def section(self, cls: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """(emitted counts, last state) of these characters; halved if even an empty table is too small for all of them."""
        try:
            return self.scan(cls, state)
        except TableFull:
            open_ = self.states[state]
            self.clear()
            state = self.state(open_)
        try:
            return self.scan(cls, state)
        except TableFull:
            half = len(cls) // 2 // LANE * LANE
            first, state = self.section(cls[:half], state)
            second, state = self.section(cls[half:], state)
            return np.concatenate([first, second]), state

    def scan(self, cls: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        size, n = len(cls), -(-len(cls) // LANE)
        cls = np.pad(cls, (0, n * LANE - size))
        fixed = cls <= 5
        fixed[1:] &= (cls[1:] < 5) | (cls[:-1] != 5)
        fixed[0] = cls[0] < 5
        lanes = np.ascontiguousarray(cls.reshape(-1, LANE).T)
        known = fixed.reshape(-1, LANE)
        sure = known.any(1)
        first = np.where(sure, known.argmax(1), 0)
        emit, path = np.zeros((LANE, n), np.int8), np.full((LANE, n), -1, np.int32)
        now = np.zeros(n, np.int64)
        for t in range(LANE):  # from each chunk's first fixed character, or from its start as if a text began there
            go = first <= t
            now, emitted = self.step(now, np.where(go, lanes[t], PAD))
            emit[t], path[t] = np.where(go, emitted, 0), np.where(go, now, -1)
        leave = now  # exit states
        entry = np.where(sure, -1, 0)  # of the run that emit and path show
        tried: dict[tuple[bytes, int], int] = {}  # the partial maps of chunks whose exit depends on the entry; equal chunks have one
        todo = np.flatnonzero(np.concatenate([[state], leave[:-1]]) != entry)
        while len(todo):
            before = np.concatenate([[state], leave[:-1]])
            live, now = todo, before[todo]
            entry[todo] = now
            for t in range(LANE):
                now, emit[t, live] = self.step(now, lanes[t, live])
                away = path[t, live] != now
                path[t, live] = now
                live, now = live[away], now[away]
                if not len(live):
                    break
            for k, s in zip(live.tolist(), now.tolist()):  # these took another path to their end
                tried[lanes[:, k].tobytes(), int(entry[k])] = s
                leave[k] = s
            again: list[int] = []
            for k in (live + 1).tolist():  # follow the maps as far as they are known
                while k < n and leave[k - 1] != entry[k]:
                    s = tried.get((lanes[:, k].tobytes(), int(leave[k - 1])))
                    again.append(k)
                    if s is None:
                        break
                    entry[k], leave[k] = leave[k - 1], s
                    path[:, k] = -1  # no run has shown it as yet
                    k += 1
            todo = np.unique(np.array(again, np.int64))
        return emit.T.reshape(-1)[:size], int(leave[(size - 1) // LANE])


_transducers: dict[str, Transducer] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; a null text counts as empty.

    A null doc_id stays null, repeated rows return as often as they come, and an empty table gives no rows.

    The vocabulary is compiled once and sent to the executors (32,000 pieces); a Python worker keeps the
    states it has reached for its later tasks.
    """
    from .tokens import text_batches

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _transducers:
            _transducers[path] = Transducer(shared.value)
        fst = _transducers[path]
        for b in batches:
            texts = [t or "" for t in b["text"]]
            n = [fst.counts(texts[x:y]) for x, y in text_batches(texts, BATCH_CHARS)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": np.concatenate([*n, np.zeros(0, np.int64)])})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
