"""Language ID: a bidirectional gated recurrent network over bytes, trained here in numpy.

The network labels every byte of a text; a document's probabilities are the means over its bytes. Texts
are cut into windows, which the network reads side by side. Gates are piecewise linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 400  # training documents of each language at most
SAMPLE_WINDOWS = 12  # windows from each of them at most
WIDTH, HIDDEN = 64, 16  # bytes in a window, units in each direction
ROUNDS, BATCH, RATE = 160, 256, 0.01
LANES = 2048  # windows read side by side


@dataclass
class Direction:
    """Weights of one direction: a row for each byte, the recurrent matrix."""

    look: np.ndarray  # 256 x 3H: keep gate, reset gate, candidate
    back: np.ndarray  # H x 3H

    def run(self, text: np.ndarray, mask: np.ndarray | None, tape: list | None = None) -> np.ndarray:
        """States after each byte of text (steps x lanes)."""
        n = self.back.shape[0]
        h = np.zeros((text.shape[1], n), np.float32)
        out = np.empty((*text.shape, n), np.float32)
        for t in range(len(text)):
            x, u = self.look[text[t]], h @ self.back
            gate = x[:, : 2 * n] + u[:, : 2 * n]
            gate *= 0.25
            gate += 0.5
            np.clip(gate, 0, 1, out=gate)
            z, r = gate[:, :n], gate[:, n:]
            new = r * u[:, 2 * n :]
            new += x[:, 2 * n :]
            np.clip(new, -1, 1, out=new)
            step = h - new
            step *= z
            step += new
            if mask is not None:
                step *= mask[t][:, None]
            if tape is not None:
                tape.append((h, z, r, new, u[:, 2 * n :]))
            h = step
            out[t] = h
        return out

    def grads(self, text: np.ndarray, mask: np.ndarray, tape: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back-propagation through time."""
        n = self.back.shape[0]
        d_back, d_in = np.zeros_like(self.back), np.empty((*text.shape, 3 * n), np.float32)
        dh = np.zeros((text.shape[1], n), np.float32)
        for t in range(len(text) - 1, -1, -1):
            h, z, r, new, u = tape[t]
            dh = (dh + d_out[t]) * mask[t][:, None]
            d_new = dh * (1 - z) * (np.abs(new) < 1)
            d_z = dh * (h - new) * 0.25 * ((z > 0) & (z < 1))
            d_r = d_new * u * 0.25 * ((r > 0) & (r < 1))
            d_in[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_back += h.T @ d_u
            dh = dh * z + d_u @ self.back.T
        one = np.zeros((text.size, 256), np.float32)
        one[np.arange(text.size), text.reshape(-1)] = 1
        return one.T @ d_in.reshape(-1, 3 * n), d_back


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray  # 2H x languages
    bias: np.ndarray

    def probabilities(self, text: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """For each byte of each lane (steps x lanes), the probability of each language."""
        n = self.ahead.back.shape[0]
        back = None if mask is None else mask[::-1]
        logits = self.ahead.run(text, mask) @ self.out[:n] + self.behind.run(text[::-1], back)[::-1] @ self.out[n:] + self.bias
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text's bytes, whole texts; an empty text has zeros."""
        total = np.zeros((len(texts), len(self.languages)))
        rows, owner = [], []
        for k, t in enumerate(texts):
            n = -(-len(t) // WIDTH)
            rows.append(t.ljust(n * WIDTH, b"\0"))
            owner.append(np.full(n, k))
        grid, who = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH), np.concatenate(owner)
        size = np.array([len(t) for t in texts])
        last = np.ones(len(who), bool)
        last[:-1] = who[1:] != who[:-1]
        fill = np.where(last, (size[who] - 1) % WIDTH + 1, WIDTH)
        order = np.argsort(fill != WIDTH, kind="stable")  # full windows first: these need no mask
        for k in range(0, len(who), LANES):
            part = order[k : k + LANES]
            mask = None
            if (fill[part] != WIDTH).any():
                mask = (np.arange(WIDTH)[:, None] < fill[part]).astype(np.float32)
            p = self.probabilities(np.ascontiguousarray(grid[part].T), mask)
            if mask is not None:
                p *= mask[:, :, None]
            np.add.at(total, who[part], p.sum(0))
        return total / np.maximum(size, 1)[:, None]


def train(windows: list[bytes], labels: list[str], seed: int = 5) -> Network:
    """Adam on the cross-entropy of every byte's label; languages weigh alike."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)

    def weights(a: int, b: int, scale: float) -> np.ndarray:
        return (rng.standard_normal((a, b)) * scale).astype(np.float32)

    parts = [weights(256, 3 * HIDDEN, 0.3), weights(HIDDEN, 3 * HIDDEN, HIDDEN**-0.5), weights(256, 3 * HIDDEN, 0.3), weights(HIDDEN, 3 * HIDDEN, HIDDEN**-0.5), weights(2 * HIDDEN, len(languages), HIDDEN**-0.5), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    grid = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in windows), np.uint8).reshape(-1, WIDTH)
    fill = np.array([len(w) for w in windows])
    y = np.array([languages.index(x) for x in labels])
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    net = Network(languages, Direction(*parts[:2]), Direction(*parts[2:4]), parts[4], parts[5])
    for step in range(1, ROUNDS + 1):
        pick = np.array([rng.choice(by[k]) for k in rng.integers(len(languages), size=BATCH)])
        text, want = np.ascontiguousarray(grid[pick].T), y[pick]
        mask = (np.arange(WIDTH)[:, None] < fill[pick]).astype(np.float32)
        ahead, behind = [], []
        f = net.ahead.run(text, mask, ahead)
        b = net.behind.run(text[::-1], mask[::-1], behind)[::-1]
        both = np.concatenate([f, b], axis=2)
        logits = both @ net.out + net.bias
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        p[:, np.arange(BATCH), want] -= 1
        p *= (mask / max(mask.sum(), 1))[:, :, None]
        d_both = p @ net.out.T
        grads = [
            *net.ahead.grads(text, mask, ahead, d_both[:, :, :HIDDEN]),
            *net.behind.grads(text[::-1], mask[::-1], behind, d_both[::-1, :, HIDDEN:]),
            both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, len(languages)),
            p.sum((0, 1)),
        ]
        rate = RATE * min(1, 2 * (1 - (step - 1) / ROUNDS))
        for w, g, m, v in zip(parts, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """Windows spread over the whole texts of at most SAMPLE labelled documents of each language.

    The documents are chosen by a hash of their ids; held-out ones and those without id, text or language are
    never among them.
    """
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    size = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language, as the network's outputs
    if not size:
        return [], []
    # of a language's documents about 2 * SAMPLE have a hash that small, whatever their number, and are ranked
    part = F.create_map(*(F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, 2 * SAMPLE / n))))
    small = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53) <= part[F.col("lang")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = fit.where(small).select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("doc_id", "lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, t in zip(b["lang"], b["text"]):
                data = t.encode()
                starts = range(0, len(data), WIDTH)
                step = -(-len(starts) // SAMPLE_WINDOWS)
                out += [(lang, data[s : s + WIDTH]) for s in starts[:: max(step, 1)]]
            yield pd.DataFrame(out, columns=["lang", "window"])

    chosen = fit.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    rows = chosen.mapInPandas(run, "lang string, window binary").distinct().orderBy("lang", "window").collect()
    return [bytes(r["window"]) for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    A null text or one without a letter is `und` with score 1; so is every text, with score 0, if there is
    nothing to learn from. Repeated rows are predicted alike. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    windows, labels = training_windows(docs)
    net = docs.sparkSession.sparkContext.broadcast(train(windows, labels) if labels else None)  # a few thousand weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            lang, score = np.full(len(texts), "und", object), np.ones(len(texts))
            real = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))]
            if net.value is None:
                score[real], real = 0.0, []
            at = 0
            while at < len(real):  # about 2 MB at a time
                end, n = at, 0
                while end < len(real) and (end == at or n < 2_000_000):
                    n += len(texts[real[end]])
                    end += 1
                p = net.value.documents([texts[k].encode() for k in real[at:end]])
                best = p.argmax(1)
                lang[real[at:end]] = np.array(net.value.languages, object)[best]
                score[real[at:end]] = np.clip(p[np.arange(len(best)), best], 0, 1)
                at = end
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score})

    return docs.withColumn("held_out", held_out()).select("doc_id", "text", "held_out").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
