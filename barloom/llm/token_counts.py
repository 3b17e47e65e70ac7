"""Token counts of whole texts, with huge ones cut into overlapping chunks that are spliced where both agree.

A byte-level tokenizer splits a text into pre-tokens and each of these into tokens. Its pattern looks back at nothing, so
two neighbouring chunks that have one pre-token boundary in common have all later ones in common, as far as the first
chunk sees what follows. The tokens up to that boundary are the first chunk's, those behind it the second's. A text where
some overlap has no common boundary (a run of letters or white space longer than the overlap) is cut anew with chunks and
overlaps twice as wide, until all splices hold or one chunk is the whole text.

Tokenizers of other kinds (word ends, sentence pieces) have no such boundaries; they get their texts whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed

#: Characters of a chunk before its overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 512
#: The pattern looks at most so far ahead of a boundary; special tokens add their length.
AHEAD = 4
LIMIT = 1024
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000


class ByteLevel:
    """Counts by pre-token, each encoded once by the library. ``pattern`` is that of the library's byte-level split.

    Where the pattern's engine here and the library's disagree on a character's class (they know different versions of
    Unicode), the library takes the whole text.
    """

    def __init__(self, tokenizer, pattern: str, special: list[str]):
        self.tokenizer, self.find = tokenizer, regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.margin = AHEAD + max(map(len, special), default=0)
        self.memory: dict[str, int] = {}
        self.same: set[str] = set()
        self.other: set[str] = set()

    def _look_at(self, texts: list[str]) -> None:
        """Sort new characters into those that both engines class alike and the others."""
        new = sorted(set().union(*texts) - self.same - self.other)
        if not new:
            return
        probe = "".join(f"a{c}1{c}a " for c in new)
        theirs = {at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)}
        apart = theirs ^ {m.span() for m in self.find.finditer(probe)}
        odd = {new[i // 6] for i, _ in apart}
        self.other |= odd
        self.same.update(c for c in new if c not in odd)

    def _pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.find.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.find.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.find.findall(text[at:])

    def _learn(self, pieces: list[list[str]]) -> None:
        new = list(set().union(*pieces) - self.memory.keys())
        if new:
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
                new = list(set().union(*pieces))
            self.memory.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        self._look_at(texts)
        known = [not self.other or self.other.isdisjoint(t) for t in texts]
        pieces = [self._pieces(t) if k else [] for t, k in zip(texts, known, strict=True)]
        self._learn(pieces)
        count = self.memory.__getitem__
        return [sum(map(count, p)) if k else len(self.tokenizer.encode(t, add_special_tokens=False)) for p, t, k in zip(pieces, texts, known, strict=True)]

    def boundaries(self, text: str) -> tuple[list[int], list[int]]:
        """Where each pre-token ends, and how many tokens there are up to there."""
        self._look_at([text])
        ends, sums, at, n = [], [], 0, 0
        if not self.other.isdisjoint(text):
            found = self.tokenizer.encode(text, add_special_tokens=False)
            words = found.word_ids
            for i, (_, end) in enumerate(found.offsets):
                # tokens of special strings are words of their own; several tokens can be bytes of one character
                if i + 1 == len(words) or words[i + 1] != words[i] or words[i] is None:
                    ends.append(end)
                    sums.append(i + 1)
            return ends, sums
        pieces = self._pieces(text)
        self._learn([pieces])
        for p in pieces:
            at += len(p)
            n += self.memory[p]
            ends.append(at)
            sums.append(n)
        return ends, sums


class Whole:
    """Counts by a library that takes texts whole."""

    margin = None

    def __init__(self, encode):
        self.encode = encode

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts)]


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> ByteLevel | Whole:
    """The counter for a tokenizer's file: .json of the tokenizers library, .model of sentencepiece."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Whole(lambda texts: model.encode(texts, num_threads=1))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    parts = json.loads(tokenizer.to_str())
    split, added = parts["pre_tokenizer"] or {}, parts["added_tokens"]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
    if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and parts["normalizer"] is None and plain:
        return ByteLevel(tokenizer, pattern, [t["content"] for t in added])
    return Whole(lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False))


def _counted(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                own = b.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(c.counts(own.column(2).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _slices(chunk: int, overlap: int):
    """A row for each chunk of a text: its number, how many there are, and its text with the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                n = max(1, -(-len(text) // chunk))
                for lo in range(0, n, 64):
                    rows = range(lo, min(n, lo + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(rows)), pa.array(rows, pa.int32()), pa.array([n] * len(rows), pa.int32()), pa.array([text[j * chunk : (j + 1) * chunk + overlap] for j in rows], pa.string())],
                        names=["k", "part", "parts", "text"],
                    )

    return run


def _spliced(path: str, pattern: str, chunk: int, overlap: int):
    """Boundaries in the overlaps at both ends of a chunk with the tokens up to each; all of the chunk's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        ints = pa.list_(pa.int64())
        for b in batches:
            columns: list[list] = [[], [], [], [], []]
            for text in b.column(3):
                text = text.as_py()
                ends, sums = c.boundaries(text)
                head = [(e, s) for e, s in zip(ends, sums, strict=True) if e <= overlap]
                tail = [(e - chunk, s) for e, s in zip(ends, sums, strict=True) if chunk < e <= len(text) - c.margin]
                for to, x in zip(columns, ([e for e, _ in head], [s for _, s in head], [e for e, _ in tail], [s for _, s in tail], sums[-1] if sums else 0), strict=True):
                    to.append(x)
            arrays = [pa.array(x, ints) for x in columns[:4]] + [pa.array(columns[4], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *arrays], names=["k", "part", "parts", "head", "head_n", "tail", "tail_n", "n"])

    return run


def _long_counts(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(k, n_tokens) of rows (k, text), cut into chunks. An action for each width of the overlaps that is needed."""
    done = None
    while True:
        parts = rows.mapInArrow(_slices(chunk, overlap), "k long, part int, parts int, text string").repartition("k", "part")
        ends = parts.mapInArrow(_spliced(path, pattern, chunk, overlap), "k long, part int, parts int, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>, n long")
        by_part = Window.partitionBy("k").orderBy("part")
        common = ends.withColumn("lo", F.array_min(F.array_intersect("head", F.lag("tail").over(by_part)))).withColumn("hi", F.array_min(F.array_intersect("tail", F.lead("head").over(by_part))))
        up_to = lambda where, at, n: F.element_at(n, F.array_position(where, at).cast("int"))
        before = F.when(F.col("part") == 0, 0).otherwise(up_to(F.col("head"), F.col("lo"), F.col("head_n")))
        behind = F.when(F.col("part") == F.col("parts") - 1, F.col("n")).otherwise(up_to(F.col("tail"), F.col("hi"), F.col("tail_n")))
        own = F.when((F.col("part") > 0) & F.col("lo").isNull() | (F.col("part") < F.col("parts") - 1) & F.col("hi").isNull(), None).otherwise(behind - before)
        sums = checkpointed(common.select("k", own.alias("own")).groupBy("k").agg(F.sum("own").alias("n_tokens"), F.count_if(F.col("own").isNull()).alias("lost")))
        good = sums.where("lost = 0").select("k", "n_tokens")
        done = good if done is None else done.unionByName(good)
        lost = sums.where("lost > 0").select("k")
        if lost.isEmpty():
            return done
        rows, chunk, overlap = rows.join(lost, "k", "left_semi"), 2 * chunk, 2 * overlap


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text, as the library for the file at ``path`` counts.

    No begin, end or other tokens are added; strings of special tokens inside a text are what the library takes them for
    by default. Nothing is truncated or padded. A null text is empty: 0 bytes, 0 tokens. Rows that repeat a doc_id are
    counted each on its own, and a null doc_id stays null; rows are numbered by their place in the input, which must come
    out the same when read again (a scan or a checkpoint). Other columns are left aside, whatever their names. An empty
    table gives an empty result. Runs actions where texts are longer than a chunk.
    """
    if overlap > chunk:
        raise ValueError("an overlap is no longer than a chunk")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    encode = _counted(path, pattern)
    kind = counter(path, pattern)
    is_long = (F.length("text") > chunk) & F.lit(kind.margin is not None)
    out = rows.where(~is_long).select("doc_id", "n_bytes", "text").mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long")
    if kind.margin is not None:
        if overlap <= 2 * kind.margin:
            raise ValueError(f"an overlap must be longer than {2 * kind.margin} characters")
        long_rows = rows.where(is_long)
        counts = _long_counts(long_rows.select("k", "text"), path, pattern, chunk, overlap)
        out = out.unionByName(long_rows.select("k", "doc_id", "n_bytes").join(counts, "k").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return token_counts(docs, path, pattern)
