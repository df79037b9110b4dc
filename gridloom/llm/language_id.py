"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in both directions, across blanks, labels every position with a distribution over languages,
and a document's probabilities are the mean over all its positions.  So that long texts run in parallel and in bounded memory,
a text is cut into windows of ``WINDOW`` bytes, each read with up to ``CONTEXT`` more bytes on either side that are
not labelled in it: every position is labelled once, with at least that context or the text's edge.

Trained in numpy by backpropagation through time on at most ``sample`` labelled documents, of each of which at most ``PIECES``
pieces from all over the text go to the driver (documented bounds).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Labelled documents a network is trained on, at most, pieces of each, and bytes of a piece.
SAMPLE, PIECES, PIECE = 3000, 12, 64
HIDDEN = 16
#: Positions a window labels, and bytes that are read before and after them.
WINDOW, CONTEXT = 512, 32
#: Windows that run at once.
ROWS = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """x: gate inputs by direction and byte; u: recurrent weights by direction; o, b: of the labels."""

    languages: list[str]
    x: np.ndarray  # 2, 256, 3 * HIDDEN
    u: np.ndarray  # 2, HIDDEN, 3 * HIDDEN
    o: np.ndarray  # 2 * HIDDEN, languages
    b: np.ndarray

    def run(self, side: int, data: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction: steps, rows, HIDDEN.  ``data``: steps, rows, longest row first; of step t the first active[t] rows have a byte."""
        H, u, x = HIDDEN, self.u[side], self.x[side]
        steps, rows = data.shape
        state = np.zeros((rows, H), self.x.dtype)
        out = np.zeros((steps, rows, H), self.x.dtype)
        for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
            n_on = active[t]
            h = state[:n_on]
            xg, hu = x[data[t, :n_on]], h @ u
            zr = _sigmoid(xg[:, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(xg[:, 2 * H :] + r * hu[:, 2 * H :])
            if keep is not None:
                keep.append((t, h.copy(), z, r, n, hu[:, 2 * H :]))
            state[:n_on] = n + z * (h - n)
            out[t, :n_on] = state[:n_on]
        return out

    def label(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.o + self.b
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=-1, keepdims=True)

    def positions(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distributions of all positions of all windows (steps, languages, windows), longest first, and the order.

        The same as ``label`` of ``run`` in both directions, in one array a step: features by rows, no state kept, and
        sigmoid(a) = (1 + tanh(a / 2)) / 2 with the halves in the weights.
        """
        H = HIDDEN
        data, active, order = _padded(windows)
        steps, rows = data.shape
        logits = np.zeros((steps, len(self.b), rows), np.float32)
        half = np.repeat(np.array([0.5, 1.0], np.float32), [2 * H, H])[:, None]
        for side in (0, 1):
            x, u, o = np.ascontiguousarray(self.x[side].T) * half, np.ascontiguousarray(self.u[side].T) * 0.5, np.ascontiguousarray(self.o[side * H : (side + 1) * H].T)
            state = np.zeros((H, rows), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                n_on = active[t]
                h = state[:, :n_on]
                xg, hu = x.take(data[t, :n_on], axis=1), u @ h
                gates = np.tanh(xg[: 2 * H] + hu[: 2 * H])
                n = gates[H:] * hu[2 * H :]
                n += hu[2 * H :]
                n += xg[2 * H :]
                np.tanh(n, out=n)
                new = h - n
                new *= gates[:H]
                new += n
                new += h
                new *= 0.5
                state[:, :n_on] = new
                logits[t, :, :n_on] += o @ new
        logits += self.b[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits, order

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its positions' distributions (zeros for an empty one); any lengths."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, int, int, bytes]] = []  # text, first and last labelled byte, bytes

        def flush() -> None:
            p, order = self.positions([w for *_, w in held])
            for row, k in enumerate(order):
                i, lo, hi, _ = held[k]
                out[i] += p[lo:hi, :, row].sum(axis=0, dtype=np.float64)
            held.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), WINDOW):
                first, end = max(0, at - CONTEXT), min(len(text), at + WINDOW)
                held.append((i, at - first, end - first, text[first : end + CONTEXT]))
                if len(held) == ROWS:
                    flush()
        if held:
            flush()
        return out / np.maximum(1, [len(t) for t in texts])[:, None]


def _padded(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by step and row, longest row first; how many rows have each step; the order of the rows."""
    n = np.array([len(w) for w in rows])
    order = np.argsort(-n, kind="stable")
    steps = int(n.max())
    data = np.frombuffer(b"".join(rows[k].ljust(steps, b"\0") for k in order), np.uint8).reshape(len(rows), steps).T
    return np.ascontiguousarray(data).astype(np.intp), np.searchsorted(-n[order], -np.arange(steps), side="left"), order


def gradients(net: Network, rows: list[bytes], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of ``rows`` with labels ``y``, and its gradients by x, u, o and b: backpropagation through time."""
    H = HIDDEN
    data, active, order = _padded(rows)
    y = np.asarray(y)[order]
    on = np.arange(len(rows)) < active[:, None]
    keeps: list[list] = [[], []]
    states = np.concatenate([net.run(0, data, active, keeps[0]), net.run(1, data, active, keeps[1])], axis=2)
    p = net.label(states)
    total = on.sum()
    loss = -float((np.log(np.maximum(p[:, np.arange(len(y)), y], 1e-30)) * on).sum() / total)
    d = p
    d[:, np.arange(len(y)), y] -= 1
    d *= (on / total).astype(p.dtype)[:, :, None]
    grads = [np.zeros_like(net.x), np.zeros_like(net.u), np.einsum("tbh,tbk->hk", states, d), d.sum(axis=(0, 1))]
    back = d @ net.o.T
    for side in (0, 1):
        dh = np.zeros((len(y), H), net.x.dtype)
        inputs, seen = [], []
        for t, h, z, r, n, hn in reversed(keeps[side]):
            k = len(h)
            new = dh[:k] + back[t, :k, side * H : (side + 1) * H]
            dn = new * (1 - z) * (1 - n * n)
            dz = new * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            gate_h = np.concatenate([dz, dr, dn * r], axis=1)
            inputs.append(np.concatenate([dz, dr, dn], axis=1))
            seen.append(data[t, :k])
            grads[1][side] += h.T @ gate_h
            dh[:k] = new * z + gate_h @ net.u[side].T
        seen = np.concatenate(seen)
        by = np.argsort(seen, kind="stable")
        starts = c.runs(seen[by])
        grads[0][side][seen[by][starts]] = np.add.reduceat(np.concatenate(inputs)[by], starts, axis=0)
    return loss, grads


def start(languages: list[str], seed: int = 7, dtype=np.float32) -> Network:
    rng, k, H = np.random.default_rng(seed), len(languages), HIDDEN
    return Network(
        languages, rng.normal(0, 0.3, (2, 256, 3 * H)).astype(dtype), rng.normal(0, H**-0.5, (2, H, 3 * H)).astype(dtype),
        rng.normal(0, 0.2, (2 * H, max(k, 1))).astype(dtype), np.zeros(max(k, 1), dtype),
    )


def fit(pieces: dict[str, list[bytes]], batches: int = 350, rows: int = 256, rate: float = 0.012, seed: int = 7) -> Network:
    """``pieces``: of each language.  Each batch has as many of each language, one in four cut short so that short texts count too."""
    languages = sorted(k for k, v in pieces.items() if v)
    net, k = start(languages, seed), len(languages)
    if k < 2:
        return net
    rng = np.random.default_rng(seed)
    params = [net.x, net.u, net.o, net.b]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    each = max(1, rows // k)
    for step in range(1, batches + 1):
        words, y = [], np.repeat(np.arange(k), each)
        for name in languages:
            own = pieces[name]
            for i in rng.integers(0, len(own), each):
                words.append(own[i] if rng.random() < 0.75 else own[i][: rng.integers(4, 33)])
        _, grads = gradients(net, words, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * (1 - step / (batches + 1))
        for i, g in enumerate(grads):
            g *= min(1.0, 5 / (norm + 1e-9))
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            params[i] -= (lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pieces_of(text: str, n: int = PIECES, size: int = PIECE) -> list[bytes]:
    """At most ``n`` pieces of a text, spread evenly over all of it; without a letter, none.  Pieces begin with a character."""
    data = text.encode()
    count = min(n, -(-len(data) // size))
    out = []
    for k in range(count):
        at = (len(data) - size) * k // max(1, count - 1) if len(data) > size else 0
        while at and data[at] & 0xC0 == 0x80:
            at -= 1
        piece = data[at : at + size]
        if any(map(str.isalpha, piece.decode(errors="ignore"))):
            out.append(piece)
    return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, **how) -> Network:
    """Fits on at most ``sample`` rows that have a text and a language, those of the least hashes of id, language and text.

    Ids may be null or repeat.  A text of any length gives at most ``PIECES`` pieces, which executors cut.
    """
    rows = labelled.select(c.quoted(id_col).alias("key"), c.quoted(lang_col).cast("string").alias("lang"), c.quoted(text_col).alias("text")).filter("text is not null and lang is not null")
    chosen = c.hash_sample(rows, F.xxhash64("key", "lang", "text"), sample, ["lang", "text"])

    def cut(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"lang": [lang], "pieces": [pieces_of(text)]}, schema=c.arrow_schema(lang=pa.string(), pieces=pa.list_(pa.binary())))

    found: dict[str, list[bytes]] = {}
    for lang, pieces in chosen.select("lang", "text").mapInArrow(cut, "lang string, pieces array<binary>").collect():  # sample * PIECES * PIECE bytes at most
        found.setdefault(lang, []).extend(map(bytes, pieces))
    return fit({k: sorted(x) for k, x in found.items()}, **how)


def identify(docs: DataFrame, network: Network, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the pooled probability (0 to 1); columns of those names are replaced, others stay.

    ``und`` with score 0 if a text is null or has no letter, or if nothing was learned.  A text of any length is read whole.
    Ties go to the first language by name; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(network)  # of a fixed size

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = held.value
        for texts in batches:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None and net.languages and any(map(str.isalpha, t))]
            for at in range(0, len(known), 500):
                part = known[at : at + 500]
                for i, p in zip(part, net.pooled([texts.iloc[i].encode() for i in part]), strict=True):
                    best = int(p.argmax())
                    langs[i], scores[i] = net.languages[best], float(min(1.0, p[best]))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(predict, "lang_pred string, score double")
    out = docs.withColumn("__gl_pred", udf(c.quoted(text_col)))
    return out.select(*[c.quoted(x) for x in docs.columns if x not in ("lang_pred", "score")], "__gl_pred.lang_pred", "__gl_pred.score")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), net)
    return out.select("doc_id", "held_out", "lang_pred", "score")
