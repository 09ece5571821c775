"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of
the features at a cost linear in their number. Features come from the text alone: distinct words, hashed into WORDS
weights of 1 / sqrt(their number); shares of character classes, repeated words and lines, line shapes; and the
sizes of text and lines. The model is fitted on a bounded sample of labelled rows, held-out rows never among them.

Nulls count as empty texts, which have only structure features. Repeated rows score alike; an empty table gives
none. Labels that repeat a doc_id count once, the highest wins; null labels are left out. With labels of a single
value, scores come near that value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import held_out, slices

#: Labelled rows the model is fitted on, at most; the first by a hash of the id.
TRAIN_ROWS = 6000
WORDS = 1 << 12
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.02, 1e-5

# classes of bytes: other symbol, lower, upper, digit, space, sentence mark, pipe, beyond ASCII, line end
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b".,;:?'\"-", b"|", bytes(range(128, 256)), b"\n")):
    _CLASS[list(_bytes)] = _k
N_CLASSES = 9
STATS = N_CLASSES + 10
SIZE = WORDS + STATS


def structure(text: bytes, words: list[bytes]) -> list[float]:
    """STATS numbers between about 0 and 1."""
    n, w = max(1, len(text)), max(1, len(words))
    shares = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=N_CLASSES) / n if text else np.zeros(N_CLASSES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    odd = sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in (b".", b","))
    again = sum(1 for a, b in zip(words, words[1:]) if a == b)
    return [
        *shares.tolist(), odd / w, again / w, 1 - len(set(words)) / w, 1 - len(set(lines)) / k,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines) / k, sum(x.count(b"|") > 1 for x in lines) / k,
        min(2.0, n / w / 10), np.log1p(len(words)) / 10, np.log1p(len(text)) / 12, np.log1p(len(lines)) / 6,
    ]


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of all texts: (starts, with the end of the last; feature numbers; values)."""
    lists = [(t or b"").split() for t in texts]
    flat = np.empty(sum(map(len, lists)), dtype=object)
    flat[:] = [w for x in lists for w in x]
    codes, uniques = pd.factorize(flat)
    hashed = (pd.util.hash_array(uniques, categorize=False) % np.uint64(WORDS)).astype(np.int64)[codes] if len(flat) else codes
    starts, ids, values, at = [0], [], [], 0
    stats = np.arange(WORDS, SIZE)
    for t, x in zip(texts, lists):
        own = np.unique(hashed[at : at + len(x)])
        at += len(x)
        ids += [own, stats]
        values += [np.full(len(own), 1 / np.sqrt(max(1, len(own)))), np.array(structure(t or b"", x))]
        starts.append(starts[-1] + len(own) + STATS)
    return np.array(starts), np.concatenate(ids) if ids else np.empty(0, np.int64), np.concatenate(values) if values else np.empty(0)


class Machine:
    """Weights of the factorisation machine, (SIZE, RANK + 1) numbers."""

    def __init__(self, seed: int = 1):
        self.bias, self.w = 0.0, np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (SIZE, RANK))

    def raw(self, starts, ids, x):
        """Scores before the sigmoid, and each row's factor sums."""
        rows = starts[:-1]
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, rows, axis=0)
        squares = np.add.reduceat((vx**2).sum(axis=1), rows)
        return self.bias + np.add.reduceat(self.w[ids] * x, rows) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, starts, ids, x):
        if len(starts) < 2:
            return np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, ids, x)[0], -500, 500)))

    def fit(self, starts, ids, x, y, seed: int = 1):
        """Adam on the log-loss, both classes at their own weight."""
        rng, n = np.random.default_rng(seed), len(y)
        share = (y.sum() + 1) / (n + 2)
        self.bias = float(np.log(share / (1 - share)))
        moments = [np.zeros(SIZE), np.zeros(SIZE), np.zeros((SIZE, RANK)), np.zeros((SIZE, RANK))]
        b1, b2, step = 0.9, 0.999, 0
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, BATCH):
                rows = order[i : i + BATCH]
                lens = starts[rows + 1] - starts[rows]
                own = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
                s, k, v = np.concatenate([[0], np.cumsum(lens)]), ids[own], x[own]
                raw, sums = self.raw(s, k, v)
                err = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y[rows]) / len(rows)
                e = np.repeat(err, lens)
                step += 1
                self.bias -= RATE * err.sum()
                used, back = np.unique(k, return_inverse=True)
                gw = np.bincount(back, e * v) + DECAY * self.w[used]
                each = (e * v)[:, None] * (np.repeat(sums, lens, axis=0) - self.v[k] * v[:, None])
                gv = np.stack([np.bincount(back, each[:, f]) for f in range(RANK)], axis=1) + DECAY * self.v[used]
                for g, par, m, q in ((gw, self.w, moments[0], moments[1]), (gv, self.v, moments[2], moments[3])):
                    m[used] = b1 * m[used] + (1 - b1) * g
                    q[used] = b2 * q[used] + (1 - b2) * g**2
                    par[used] -= RATE * (m[used] / (1 - b1**step)) / (np.sqrt(q[used] / (1 - b2**step)) + 1e-8)
        return self


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """Broadcast ``Machine`` fitted on at most TRAIN_ROWS labelled rows that aren't held out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)

    def run(batches):
        for b in slices(batches, 0):
            starts, ids, x = features(b.column(0).cast(pa.binary()).to_pylist())
            rows = [(ids[a:z].astype("<i4").tobytes(), x[a:z].astype("<f4").tobytes()) for a, z in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["doc_id", "y", "ids", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    # TRAIN_ROWS rows of two numbers at most: the broadcast is bounded, and so is what the driver fits on
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "doc_id", "y").mapInArrow(run, f"doc_id {kind}, y int, ids binary, x binary")
    rows = sorted(own.dropDuplicates(["doc_id"]).collect(), key=lambda r: str(r.doc_id))
    machine = Machine()
    if rows:
        ids = [np.frombuffer(r.ids, "<i4") for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        machine.fit(starts, np.concatenate(ids).astype(np.int64), np.concatenate([np.frombuffer(r.x, "<f4") for r in rows]).astype(float), np.array([r.y for r in rows], dtype=float))
    return docs.sparkSession.sparkContext.broadcast(machine)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``threshold``)."""
    model = fit(docs, labels)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for b in slices(batches, 1):
            scores = model.value.score(*features(b.column(1).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
