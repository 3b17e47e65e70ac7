"""Quality classifier on supervised subword embeddings.

Words, pairs of equal words and character n-grams are hashed into a table of vectors; a text is the average of its vectors, and a softmax over
two outputs scores it. Vectors and outputs are learned together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows. As averaging and output are linear, scoring needs one number for each hashed feature: the
vector's part in the difference of the two outputs. The model's size is fixed, so it is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.labelled import sample_of

#: Labelled rows that the model is fitted on: those of least hash.
SAMPLE = 3000
BUCKETS, DIM = 1 << 16, 16
#: Lengths in bytes of the character n-grams.
GRAMS = (3, 5)
#: A pair of equal words so far apart counts as one feature, whatever the word (the pair itself is too rare to learn).
AGAIN = (1, 2, 3, 4, 6, 8)
EPOCHS, RATE, SEED = 8, 0.5, 11
#: A row is labelled 1 from this score on.
CUT = 0.3

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PIECE = 1 << 20
_UP, _DOWN = np.full(_PIECE + 1, _BASE), np.full(_PIECE + 1, _BACK)
_UP[0] = _DOWN[0] = 1
_UP, _DOWN = np.multiply.accumulate(_UP), np.multiply.accumulate(_DOWN)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).astype(np.int64) & (BUCKETS - 1)


def features(text: bytes) -> np.ndarray:
    """Buckets of a text's words and n-grams, repeats included; bucket 0 is always one of them.

    Very long texts go by pieces, which end at white space where there is any; no byte is left out.
    """
    found = [np.zeros(1, dtype=np.int64)]
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + _PIECE)
        if hi < len(text) and (at := max(text.rfind(b" ", lo + 1, hi), text.rfind(b"\n", lo + 1, hi))) > 0:
            hi = at
        data = np.frombuffer(text, dtype=np.uint8, count=hi - lo, offset=lo)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=total[1:])
        for g in GRAMS:
            if len(data) >= g:
                found.append(_bucket((total[g:] - total[:-g]) * _DOWN[: len(data) - g + 1], g))
        gap = np.concatenate([[True], _SPACE[data], [True]])
        begin, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
        words = (total[end] - total[begin]) * _DOWN[begin]
        found.append(_bucket(words, 1))
        for apart in AGAIN:
            same = int((words[apart:] == words[:-apart]).sum())
            found.append(np.repeat(_bucket(np.array([apart], dtype=np.uint64), 2), same))
        lo = hi
    return np.concatenate(found)


@dataclass
class Model:
    #: What one occurrence of a feature adds to the logit of label 1, before averaging.
    weight: np.ndarray

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[features(text)].mean(), -60, 60))))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Without rows of both labels, the score is the share of label 1 (one half without rows)."""
    rng = np.random.default_rng(seed)
    if len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model(np.full(BUCKETS, np.log(share / (1 - share)), dtype=np.float32))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), dtype=np.float32)
    rows = []
    for t in texts:
        where, count = np.unique(features(t), return_counts=True)
        rows.append((where.astype(np.int32), (count / count.sum()).astype(np.float32)))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            where, share = rows[i]
            now = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[where]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= now * np.outer(hidden, p)
            # features of a text are many and rare, so their own share is scaled up by the root of their number
            vectors[where] -= (now * np.sqrt(len(where)) * share)[:, None] * back
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a null text is empty, and an empty text gets the score of no words."""
    weight = docs.sparkSession.sparkContext.broadcast(model.weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weight.value)
        for b in batches:
            score = np.fromiter((own.score(t.as_py() or b"") for t in b.column(1)), dtype=np.float64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a row without doc_id is not held out."""
    rows = sample_of(docs, labels, "quality", SAMPLE, lambda d: ~held_out(d))
    model = train([r[1] for r in rows], [r[2] for r in rows])
    return scored(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
