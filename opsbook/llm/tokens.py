"""Token ids of many texts at once: words are divided in numpy, each distinct word is encoded by the library's model once.

For byte-level vocabularies. Texts with characters whose division is not certain here go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from dataclasses import dataclass

import numpy as np

LETTER, DIGIT, SPACE, OTHER, UNSURE = 1, 2, 3, 4, 9
LIMIT = 0x2100  # texts with characters from here on go to the library whole
MEMO = 1_000_000  # distinct words kept by a Python worker
BASE = 0x9E3779B97F4A7C15  # of the hash under which a word is looked up
LONGEST = 256  # characters of a word that is kept; a longer one goes to the library each time
SPAN = 1 << 18  # characters whose hashes are summed in one go
SLOTS = 1 << 21  # of the table in which kept words are looked up by their hash
MIX, SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(43)


def _classes() -> np.ndarray:
    out = np.full(LIMIT, OTHER, np.uint8)
    for c in range(LIMIT):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else UNSURE if kind == "Cn" else OTHER
    # the characters with the Unicode property White_Space (fixed values)
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]] = SPACE
    return out


CLASS = _classes()


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones of Latin-1 for themselves, the
    others by those from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


BYTE_CHARS = _byte_chars()


@dataclass(frozen=True)
class Kind:
    """A tokenizer file of the tokenizers library, and how it divides words."""

    path: str
    keeps_space: bool  # one space belongs to the next word, and white space gives tokens
    lower: bool  # NFC and lower case first; each digit is a word


def word_starts(chars: np.ndarray, heads: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """First and last position + 1 of each word in concatenated texts; heads: where texts begin."""
    n = len(chars)
    c = CLASS[chars]
    head = np.zeros(n + 1, bool)
    head[heads[heads < n]] = True
    head[n] = True
    run = head.copy()
    run[1:n] |= c[1:] != c[:-1]
    start = run.copy()
    solid = c != SPACE
    if kind.keeps_space:
        lead = ~solid[:-1] & solid[1:] & ~head[1:n]  # white space just before a word of the same text
        at = np.flatnonzero(lead)
        start[at] = True
        start[at[chars[at] == 32] + 1] = False
    else:
        start[:n] |= c == DIGIT
    quote = np.flatnonzero((chars == 39) & start[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[run[quote + 1] & ~head[quote + 1] & (c[quote + 1] == LETTER)]
    one, two = chars[quote + 1], chars[np.minimum(quote + 2, n - 1)]
    inside = (quote + 2 < n) & ~run[np.minimum(quote + 2, n)]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    cut = quote[short | long]
    start[cut + 1] = False
    start[np.minimum(cut + np.where(short[short | long], 2, 3), n)] = True
    first = np.flatnonzero(start[:n])
    last = np.append(first[1:], n)
    if not kind.keeps_space:
        keep = solid[first]
        first, last = first[keep], last[keep]
    return first, last


class Encoder:
    """encode(texts) gives all ids in one array and the number of ids of each text, equal to the library's."""

    def __init__(self, kind: Kind) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.kind, self.library = kind, Tokenizer.from_file(kind.path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        powers = [np.full(SPAN + LONGEST, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
        for p in powers:
            p[0] = 1
        self.power, self.inverse = (np.multiply.accumulate(p) for p in powers)
        self.clear()

    def clear(self) -> None:
        self.slot_key, self.slot_word = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.word_at, self.word_size = np.empty(0, np.int32), np.empty(0, np.int64)
        self.flat, self.chars = np.empty(0, np.uint32), np.empty(0, np.uint16)

    def _keys(self, chars: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash, never 0, of each word of at most LONGEST characters: a polynomial from sums over all characters."""
        key = np.empty(len(first), np.uint64)
        for s in range(0, len(chars), SPAN):
            x, y = np.searchsorted(first, [s, s + SPAN])
            part = chars[s : s + SPAN + LONGEST].astype(np.uint64)
            part += np.uint64(1)
            part *= self.power[: len(part)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
            at = first[x:y] - s
            key[x:y] = (sums[np.minimum(last[x:y] - s, len(part))] - sums[at]) * self.inverse[at]
        return np.maximum(key, np.uint64(1))

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The kept word with this hash, or -1."""
        slot = (key * MIX >> SHIFT).astype(np.int64)
        word, todo = self.slot_word[slot], np.flatnonzero(self.slot_key[slot] != key)
        while len(todo):
            taken = self.slot_key[slot[todo]] != 0
            word[todo[~taken]] = -1
            todo = todo[taken]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            word[todo] = self.slot_word[slot[todo]]
            todo = todo[self.slot_key[slot[todo]] != key[todo]]
        return word

    def _place(self, key: np.ndarray, word: np.ndarray) -> None:
        """Enter new, distinct hashes into the table."""
        slot, todo = (key * MIX >> SHIFT).astype(np.int64), np.arange(len(key))
        while len(todo):
            todo = todo[np.argsort(slot[todo], kind="stable")]
            own = slot[todo]
            free = self.slot_key[own] == 0
            free[1:] &= own[1:] != own[:-1]
            self.slot_key[own[free]], self.slot_word[own[free]] = key[todo[free]], word[todo[free]]
            todo = todo[~free]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)

    def _plain(self, text: str) -> str | None:
        """The text as words are divided in it; None if only the library may divide it."""
        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return text.lower() if self.kind.lower else text
        if self.kind.lower:
            if "Σ" in text or not unicodedata.is_normalized("NFC", text):
                return None
            text = text.lower()
        return text

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of these words in one array, and how many each has: its model on the words' bytes."""
        ids: list[int] = []
        size = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            found = self.model.tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))
            ids += [t.id for t in found]
            size[k] = len(found)
        return np.array(ids, np.uint32), size

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids, size = self._ids(words)
        long = np.array([len(w) for w in words], np.int64)
        self._place(keys, np.arange(len(self.at), len(self.at) + len(keys)))
        self.at = np.concatenate([self.at, np.cumsum(size) - size + len(self.flat)])
        self.word_at = np.concatenate([self.word_at, np.cumsum(long) - long + len(self.chars)]).astype(np.int32)
        self.size, self.word_size = np.concatenate([self.size, size]), np.concatenate([self.word_size, long])
        self.flat = np.concatenate([self.flat, ids])
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self._plain(t) for t in texts]
        slow = [k for k, t in enumerate(plain) if t is None]
        big = "".join(t for t in plain if t is not None)
        chars = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        if len(chars) and (chars.max() >= LIMIT or (CLASS[np.minimum(chars, LIMIT - 1)] == UNSURE).any()):
            for k, t in enumerate(plain):
                if t is not None and not t.isascii():
                    x = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                    if x.max() >= LIMIT or (CLASS[x] == UNSURE).any():
                        plain[k] = None
                        slow.append(k)
            big = "".join(t for t in plain if t is not None)
            chars = np.frombuffer(big.encode("utf-32-le"), np.uint32)
        length = np.array([0 if t is None else len(t) for t in plain], np.int64)
        heads = np.cumsum(length) - length
        ids, counts = np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(chars):
            ids, words = self._encode_words(big, chars, *word_starts(chars, heads, self.kind))
            edges = np.concatenate([[0], np.cumsum(words[1])])
            where = np.searchsorted(words[0], np.append(heads, len(chars)), "left")
            counts = np.diff(edges[where])
        if slow:
            parts, at = [], np.concatenate([[0], np.cumsum(counts)])
            for k in range(len(texts)):
                parts.append(ids[at[k] : at[k + 1]])
                if plain[k] is None:
                    parts[-1] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                    counts[k] = len(parts[-1])
            ids = np.concatenate(parts)
        return ids, counts

    def _encode_words(self, big: str, chars: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
        if not len(first):
            return np.empty(0, np.uint32), (first, first)
        size = last - first
        plain = size <= LONGEST
        key = self._keys(chars, first, last)
        entry = np.where(plain, self._find(key), -1)
        new = np.flatnonzero(plain & (entry < 0))
        if len(new):
            fresh, lead = np.unique(key[new], return_index=True)
            if len(self.at) + len(fresh) > MEMO:
                self.clear()
                new = np.flatnonzero(plain)
                fresh, lead = np.unique(key[new], return_index=True)
            fresh, lead = fresh[:MEMO], new[lead[:MEMO]]  # what one long text has beyond that stays with the library
            self._learn(fresh, [big[s:e] for s, e in zip(first[lead].tolist(), last[lead].tolist())])
            entry[new] = self._find(key[new])
        # a hash is not proof: every word is compared with the word that is kept under its hash
        same = entry >= 0
        entry = np.maximum(entry, 0)
        if len(self.at):
            same &= self.word_size[entry] == size
        each = np.where(same, size, 0)
        edges = np.cumsum(each) - each
        step = np.arange(int(each.sum()), dtype=np.int32)
        if len(step) == len(chars):
            own = chars
        else:
            own = chars[np.repeat((first - edges).astype(np.int32), each) + step]
        alike = own == self.chars[np.repeat(self.word_at[entry] - edges.astype(np.int32), each) + step] if len(step) else np.ones(0, bool)
        if not alike.all():
            same[np.repeat(np.arange(len(first)), each)[~alike]] = False
        place, n, flat = self.at[entry] if len(self.at) else entry, self.size[entry] if len(self.at) else entry, self.flat
        if not same.all():  # long words, and words whose key another word has
            odd = np.flatnonzero(~same)
            ids, many = self._ids([big[s:e] for s, e in zip(first[odd].tolist(), last[odd].tolist())])
            place, n = place.copy(), n.copy()
            place[odd], n[odd] = np.cumsum(many) - many + len(flat), many
            flat = np.concatenate([flat, ids])
        ids = flat[np.repeat(place - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return ids, (first, n)


_encoders: dict[Kind, Encoder] = {}


def encoder(kind: Kind) -> Encoder:
    """This Python worker's encoder; its distinct words serve later tasks as well."""
    if kind not in _encoders:
        _encoders[kind] = Encoder(kind)
    return _encoders[kind]


def text_batches(texts: list[str], chars: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is alone."""
    out, a, n = [], 0, 0
    for k, t in enumerate(texts):
        if n and n + len(t) > chars:
            out.append((a, k))
            a, n = k, 0
        n += len(t)
    return [*out, (a, len(texts))] if len(texts) else out
