"""Toxicity by the nearest labelled examples.

A bounded sample of labelled rows gives the examples. Their terms, all words that any of them holds, are the space of
the vectors: examples and texts are TF-IDF vectors over it, with document frequencies counted over all documents. Since
most words of a text say nothing about toxicity, a term's inverse document frequency is scaled by a relevance learned
from the labels (by a likelihood ratio); no term's relevance is zero. A text's nearest examples by cosine are found
exactly in an inverted index whose postings lie in blocks of examples: the blocks' greatest weights bound what a block
can reach, and only blocks that can still hold one of the nearest examples are looked into. Votes of the nearest,
weighted by distance, are calibrated by isotonic regression on votes that the examples get from a model of the other
folds. A text without any word of the examples gets the share of toxic examples.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.labelled import sample_of

#: Labelled rows that serve as examples: those of least hash.
SAMPLE = 3000
NEIGHBOURS = 15
#: Examples of a block.
BLOCK = 64
#: Terms, those that most examples hold, whose weights lie apart; only where more than one example in 16 holds them.
COMMON = 256
#: More than twice what a cosine loses when its common terms are summed up in single precision (257 terms: 2e-5).
SLACK = 1e-4
#: Relevance of a term that the labels say nothing about; terms that mark toxic examples surely have 0.5 and more.
FLOOR = 0.01
#: Parts of the examples that are scored by the others for the calibration.
FOLDS = 4
#: Nearest examples that are returned as evidence.
EVIDENCE = 3
#: A text counts as toxic from this score on.
CUT = 0.3
#: Distinct words that a task counts before it looks them up among the terms.
COUNTED = 50_000
#: Scores of equal texts that a worker remembers.
REMEMBERED = 20_000

#: Bytes of words as they are, A-Z in lower case; all others, digits among them, as white space.
_LETTERS = bytes(c if c >= 0x80 or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Words, ASCII letters in lower case; digits are no part of them."""
    return text.translate(_LETTERS).split()


def _g(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
    """A share's part of the G statistic: k of n seen where p is expected."""
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = np.where(k > 0, k * np.log(k / (n * p)), 0.0)
        miss = np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - p))), 0.0)
    return 2 * (hit + miss)


def relevance(counts: list[np.ndarray], labels: np.ndarray, size: int, floor: float = FLOOR) -> np.ndarray:
    """Of each of ``size`` terms: floor, and more for those that toxic examples hold more often than others.

    counts: the distinct term numbers of each example. Copies and near copies count once: examples of one label that
    share their three rarest terms are taken for such.
    """
    often = np.bincount(np.concatenate([*counts, np.zeros(0, dtype=np.int64)]), minlength=size)
    seen: set[tuple] = set()
    held, n = np.zeros((2, size), dtype=np.int64), [0, 0]
    for own, y in zip(counts, labels.tolist(), strict=True):
        rarest = (y, *own[np.lexsort((own, often[own]))[:3]].tolist())
        if rarest not in seen:
            seen.add(rarest)
            n[y] += 1
            held[y, own] += 1
    if not all(n):
        return np.full(size, floor)
    p = (held[0] + held[1]) / (n[0] + n[1])
    g = np.where(held[1] * n[0] > held[0] * n[1], _g(held[1], n[1], p) + _g(held[0], n[0], p), 0.0)
    return floor + np.sqrt(g) / 10


def _ranges(begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and for each number its range's value."""
    n = end.astype(np.int64) - begin
    last = np.cumsum(n)
    numbers = np.repeat(begin + n - last, n)
    numbers += np.arange(len(numbers))
    return numbers, np.repeat(values, n)


class Index:
    """Block-max inverted index of vectors (term numbers, weights), none of them empty.

    Terms that many examples hold have most of the postings. Up to ``common`` of them lie apart, as a row of weights for
    each term, and are first summed up for all examples, roughly; then blocks are looked into for the postings of the
    others. What can be among the nearest then gets its exact cosine.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK, common: int = COMMON):
        # examples with the same heaviest term lie together, so that a block's greatest weights say more
        heaviest = np.array([t[np.argmax(w)] for t, w in vectors], dtype=np.int64)
        self.order = np.lexsort((np.arange(len(vectors)), heaviest))
        self.n, self.block, self.blocks = len(vectors), block, -(-len(vectors) // block)
        sizes = np.array([len(vectors[i][0]) for i in self.order], dtype=np.int64)
        key = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        key *= max(1, self.n)
        key += np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        by = np.argsort(key)
        key = key[by]
        self.weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])[by]
        del by
        self.place = (key % max(1, self.n)).astype(np.int32)
        key //= max(1, self.n)
        held = np.bincount(key, minlength=terms)
        often = np.argsort(-held, kind="stable")[:common]
        often = often[held[often] * 16 > self.n]
        #: of each term, its row among the common ones, or -1
        self.row = np.full(terms, -1, dtype=np.int32)
        self.row[often] = np.arange(len(often))
        self.common = np.zeros((len(often), self.n))
        apart = self.row[key] >= 0
        self.common[self.row[key[apart]], self.place[apart]] = self.weight[apart]
        self.rough = self.common.astype(np.float32)
        key, self.place, self.weight = key[~apart], self.place[~apart], self.weight[~apart]
        # one row for each block that a term occurs in: the block, its postings and their greatest weight
        start = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(self.place // block, prepend=-1) != 0))
        self.begin = np.append(start, len(key)).astype(np.int32)
        self.at = self.place[start] // block
        self.highest = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.of_term = np.searchsorted(key[start], np.arange(terms + 1)).astype(np.int32)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine above 0, ties by number, and the cosines. without: an example left out."""
        row = self.row[terms]
        apart = row >= 0
        row, level, terms, weights = row[apart], weights[apart], terms[~apart], weights[~apart]
        start, end = self.of_term[terms], self.of_term[terms + 1]
        rows, own = _ranges(start, end, weights)
        blocks = self.at[rows]
        shared = np.einsum("i,ij->j", level.astype(np.float32), self.rough[row]).astype(np.float64)
        bound = np.bincount(blocks, own * self.highest[rows], self.blocks)
        if self.n:
            bound = bound + np.maximum.reduceat(shared, np.arange(0, self.n, self.block))
        reach = np.zeros(self.n)
        # first the most promising blocks, then all others that can still hold one of the k nearest
        first = np.zeros(self.blocks, dtype=bool)
        first[np.argsort(-bound, kind="stable")[: 1 + k // self.block]] = True
        found = first[blocks]
        self._add(reach, self.begin[rows[found]], self.begin[rows[found] + 1], own[found])
        kth = _least(reach + shared, k + 1)  # one more, as one may be left out
        rest = ~first & (bound > 0) & (bound + SLACK >= kth)
        if 2 * rest.sum() > self.blocks:
            # most blocks: all postings of a term at once cost less than those of single blocks
            reach[:] = 0
            self._add(reach, self.begin[start], self.begin[end], weights)
        elif rest.any():
            found = rest[blocks]
            self._add(reach, self.begin[rows[found]], self.begin[rows[found] + 1], own[found])
        shared += reach
        if without >= 0:
            shared[np.flatnonzero(self.order == without)] = 0
        found = np.flatnonzero((shared + SLACK >= _least(shared, k)) & (shared > 0))
        # the common terms again, in double precision and one after the other, so that equal examples have equal sums
        near = reach[found] + (self.common[row[:, None], found] * level[:, None]).sum(axis=0)
        ids, near = self.order[found], np.minimum(1.0, near)
        best = np.lexsort((ids, -near))[:k]
        return ids[best], near[best]

    def _add(self, reach: np.ndarray, begin: np.ndarray, end: np.ndarray, weights: np.ndarray) -> None:
        """Adds what ranges of postings give to their examples."""
        posts, own = _ranges(begin, end, weights)
        own *= self.weight[posts]
        reach += np.bincount(self.place[posts], own, self.n)


def _least(values: np.ndarray, k: int) -> float:
    """The k-th greatest of the values, 0 if there are no more."""
    return np.partition(values, -k)[-k] if len(values) > k else 0.0


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, value) of the nondecreasing step function nearest to y, by pooling adjacent violators."""
    pools: list[list[float]] = []
    at, first = np.unique(x, return_inverse=True)
    size = np.bincount(first)
    for v, s, n in zip(at, np.bincount(first, weights=y), size, strict=True):
        pools.append([v, s, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _unit(numbers: np.ndarray, times: np.ndarray, scale: np.ndarray, other: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights over the length of the whole vector. other: the squares of those weights that meet no example's."""
    weights = (1 + np.log(times)) * scale[numbers]
    return numbers, weights / (np.sqrt((weights * weights).sum() + other) or 1.0)


class _Part:
    """Examples (terms, times) and labels with the relevance that these labels teach, and their index."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray, k: int):
        self.scale = idf * relevance([t for t, _ in counts], labels, len(idf))
        self.labels, self.k = labels, k
        self.index = Index([_unit(*c, self.scale) for c in counts], len(idf))

    def vote(self, counts: tuple[np.ndarray, np.ndarray], other: float = 0.0) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The share of toxic ones among the nearest, by the squares of their cosines; who they are, and the cosines.

        other: the squared weight of the text's words that no example holds."""
        if not len(counts[0]):
            return None, counts[0], counts[1]
        ids, near = self.index.nearest(*_unit(*counts, self.scale, other), self.k)
        power = near * near
        return float((power * self.labels[ids]).sum() / power.sum()) if len(ids) else None, ids, near


class Model:
    """examples: (doc_id, text, label). frequency: in how many of ``documents`` documents each of ``terms`` occurs."""

    def __init__(self, examples: list[tuple[int, bytes, int]], terms: list[bytes], frequency: np.ndarray, documents: int, k: int = NEIGHBOURS):
        # the frequent ones lie together, which makes looking up words faster
        self.number = {terms[i]: i for i in np.argsort(-frequency, kind="stable").tolist()}
        self.memory: dict[bytes, tuple] = {}
        idf = np.log((documents + 1) / (frequency + 1)) + 1e-3
        #: the weight of a word that no example holds, for each of 1 + log(times)
        self.unseen = (np.log(documents + 1.0) + 1e-3) * FLOOR
        counts = [self.counts(text)[:2] for _, text, _ in examples]
        y = np.array([x[2] for x in examples], dtype=np.int64)
        # without examples nothing is known, and nothing counts as toxic
        self.blank = (float(y.sum()) + 0.1) / (len(y) + 1)
        has = [j for j, (t, _) in enumerate(counts) if len(t)]
        self.ids = [examples[j][0] for j in has]
        counts, y = [counts[j] for j in has], y[has]
        # one further case on each side keeps the ends off 0 and 1
        votes, truth = [0.0, 1.0], [0.0, 1.0]
        fold = np.arange(len(y)) % FOLDS
        for f in range(FOLDS):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own) and len(rest):
                part = _Part([counts[j] for j in rest], y[rest], idf, k)
                for j in own:
                    if (vote := part.vote(counts[j])[0]) is not None:
                        votes.append(vote)
                        truth.append(float(y[j]))
                del part  # before the next one is made, so that the driver holds one index at a time
        self.knots = isotonic(np.array(votes), np.array(truth))
        self.part = _Part(counts, y, idf, k)

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray, float]:
        """Numbers of the text's terms, in order, and how often each occurs; the squared weight of all its other words."""
        words = Counter(terms_of(text))
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        times = np.fromiter(words.values(), np.int32, len(words))
        other = 1 + np.log(times[numbers < 0].astype(np.float64))
        by = np.argsort(numbers)[len(other) :]
        return numbers[by], times[by], float(other @ other) * self.unseen**2

    def score(self, text: bytes) -> tuple[float, list[tuple[int, float, int]]]:
        """The calibrated score and, as evidence, the nearest examples: (doc_id, cosine, label)."""
        key = xxhash.xxh3_128_digest(text)
        if key not in self.memory:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            self.memory[key] = self._score(text)
        return self.memory[key]

    def _score(self, text: bytes) -> tuple[float, list[tuple[int, float, int]]]:
        *own, other = self.counts(text)
        vote, ids, near = self.part.vote(own, other)
        if vote is None:
            return self.blank, []
        at, value = self.knots
        level = float(value[max(0, np.searchsorted(at, vote, side="right") - 1)])
        labels = self.part.labels
        # within a step of the calibration the vote itself decides the order
        return 0.98 * level + 0.02 * vote, [(self.ids[i], float(s), int(labels[i])) for i, s in zip(ids[:EVIDENCE].tolist(), near[:EVIDENCE], strict=True)]


def _frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many documents each of the terms occurs, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def add(count: np.ndarray, held: Counter) -> None:
        at = np.fromiter(map(sent.value.get, held, repeat(-1)), np.int64, len(held))
        count[at[at >= 0]] += np.fromiter(held.values(), np.int64, len(held))[at >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, words = 0, Counter()
        count = np.zeros(len(sent.value), dtype=np.int64)
        for b in batches:
            rows += b.num_rows
            for t in b.column(0):
                words.update(set(terms_of(t.as_py() or b"")))
                if len(words) >= COUNTED:
                    add(count, words)
                    words.clear()
        add(count, words)
        held = np.flatnonzero(count)
        # one row for each term, not for each text; -1 counts the documents
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(count[held], rows))], names=["term", "n"])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    frequency = np.zeros(len(terms), dtype=np.int64)
    frequency[term[term >= 0]] = n[term >= 0]
    return frequency, int(n[term < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", size: int = SAMPLE) -> Model:
    """learn: a condition on doc_id for the rows whose labels may be learned.

    What the driver holds is bounded by ``size`` examples: their terms, and a count of each over all documents.
    """
    examples = sample_of(docs, labels, label, size, learn)
    terms = sorted({t for _, text, _ in examples for t in terms_of(text)})
    return Model(examples, terms, *_frequencies(docs, terms))


def _scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` as c0, c1, ... (names with dots or clashes do no harm), _score and _evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # a text that is kept anyway goes to Python once
    at = keep.index("text") if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else len(keep)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*columns, *([F.col("text").cast("string").alias("c_text")] if at == len(keep) else []))
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    kept = rows.columns[: len(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            found = [own.score((t.as_py() or "").encode()) for t in b.column(at)]
            proof = [[{"doc_id": i, "cosine": s, "toxic": y} for i, s, y in e] for _, e in found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([s for s, _ in found], pa.float64()), pa.array(proof, evidence)], names=[*kept, "_score", "_evidence"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{fields}_score double, _evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of every row; evidence is an array of (doc_id, cosine, toxic).

    A null text is empty. The model has a bounded number of examples and terms, so it is sent to every task.
    """
    return _scored(docs, model, ["doc_id"]).toDF("doc_id", "score", "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, learn, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is under the cut, with all their columns."""
    rows = _scored(docs, fit(docs, labels, learn), docs.columns).where(F.col("_score") < cut)
    return rows.drop("_score", "_evidence").toDF(*docs.columns)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row; a row without doc_id is not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, fit(docs, labels, lambda d: ~held_out(d))).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "evidence",
    )
