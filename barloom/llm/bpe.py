"""Byte-level BPE encoding and decoding over overlapping chunks.

A long text is cut into chunks that overlap, and each chunk is split into pre-tokens on its own. A chunk may begin in
the middle of a pre-token, so its first boundaries can be wrong; but the pattern looks back at nothing, so once two
neighbours have a boundary in common, all later ones are common as well. There the texts are stitched, and each piece
between two stitches is encoded. Where an overlap has no common boundary (a run of letters or white space longer than
the overlap), the whole text is encoded at once. Texts of one chunk are encoded where they are, without a shuffle.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a chunk before its overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 512
#: A boundary this close to a chunk's end may depend on what follows the chunk.
MARGIN = 4
#: Encoded pre-tokens that a worker remembers.
REMEMBERED = 300_000


class Codec:
    """Ranks of byte strings and what follows from them. ``ranks_path`` is a file of base64 strings and ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.strings = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.memory: dict[str, bytes] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of least rank, leftmost first, until no pair has a rank."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        none = 1 << 60
        pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap, for pre-tokens of any length."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged into an earlier one
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := ranks.get(data[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str, ahead: int = 0) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. ahead: so many characters at the end begin with a new
        pre-token and are there for the pattern to look at; they aren't encoded."""
        memory, out = self.memory, []
        pieces = self.find.findall(text)
        while ahead > 0:
            ahead -= len(pieces.pop())
        for piece in pieces:
            ids = memory.get(piece)
            if ids is None:
                found = self._merge(piece.encode())
                ids = struct.pack(f"<{len(found)}I", *found)
                if len(piece) <= 64:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))

    def boundaries(self, text: str, begin: int, end: int) -> list[int]:
        """Ends of pre-tokens from begin to end."""
        return [x for m in self.find.finditer(text) if begin <= (x := m.end()) <= end]


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _slices(chunk: int, overlap: int):
    """A row for each chunk of a text: its number, how many there are, and its text with the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                k, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                n = -(-len(text) // chunk)
                for lo in range(0, n, 64):
                    rows = range(lo, min(n, lo + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(rows)), pa.array(rows, pa.int32()), pa.array([n] * len(rows), pa.int32()), pa.array([text[j * chunk : (j + 1) * chunk + overlap] for j in rows], pa.string())],
                        names=["k", "part", "parts", "text"],
                    )

    return run


def _bounds(ranks_path: str, pattern: str, chunk: int, overlap: int):
    """Boundaries in the overlaps at both ends of a chunk, counted from where each overlap begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            head, tail = [], []
            for text in b.column(3).to_pylist():
                found = c.boundaries(text, 1, len(text))
                head.append([x for x in found if x <= overlap])
                tail.append([x - chunk for x in found if chunk < x <= len(text) - MARGIN])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["k", "part", "parts", "text", "head", "tail"])

    return run


def _encoded(ranks_path: str, pattern: str):
    """The last two columns, text and ahead, become ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                own = b.slice(lo, 256)
                texts, ahead = (own.column(own.num_columns - x).to_pylist() for x in (2, 1))
                ids = [c.encode(t, a) for t, a in zip(texts, ahead, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.binary())], names=[*own.schema.names[:-2], "ids", "decoded"])

    return run


def encoded(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids binary, decoded binary) of every row: ids are little-endian unsigned 32-bit integers.

    A null text is empty and gives no ids. Special tokens are ordinary text. Rows that repeat a doc_id are encoded each
    on its own; they are numbered by their place in the input, which must come out the same when read again.
    """
    k = F.monotonically_increasing_id().alias("k")
    rows = docs.select(k, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > chunk
    encode = _encoded(ranks_path, pattern)
    short = rows.where(~is_long).select("doc_id", "text", F.lit(0).alias("ahead")).mapInArrow(encode, "doc_id long, ids binary, decoded binary")

    long_rows = rows.where(is_long)
    slices = long_rows.select("k", "text").mapInArrow(_slices(chunk, overlap), "k long, part int, parts int, text string")
    bounded = slices.repartition("k", "part").mapInArrow(
        _bounds(ranks_path, pattern, chunk, overlap), "k long, part int, parts int, text string, head array<int>, tail array<int>"
    )
    by_part = Window.partitionBy("k").orderBy("part")
    meets = bounded.select("k", "part", "head", "tail").select(
        "k",
        "part",
        F.array_min(F.array_intersect("head", F.lag("tail").over(by_part))).alias("lo"),
        F.array_min(F.array_intersect("tail", F.lead("head").over(by_part))).alias("hi"),
    )
    cut = bounded.select("k", "part", "parts", "text").join(meets, ["k", "part"])
    lost = ((F.col("part") > 0) & F.col("lo").isNull()) | ((F.col("part") < F.col("parts") - 1) & F.col("hi").isNull())
    pieces = cut.where(~lost).select(
        "k", "part", "parts", F.expr("substring(text, coalesce(lo, 0) + 1)").alias("text"), F.expr(f"coalesce(length(text) - {chunk} - hi, 0)").alias("ahead")
    )
    joined = (
        pieces.mapInArrow(encode, "k long, part int, parts int, ids binary, decoded binary")
        .groupBy("k")
        .agg(F.array_sort(F.collect_list(F.struct("part", "ids", "decoded"))).alias("p"), F.max("parts").alias("parts"))
        .where(F.size("p") == F.col("parts"))
    )
    binary = lambda c: F.aggregate(F.col("p"), F.lit(b""), lambda x, y: F.concat(x, y[c])).alias(c)
    stitched = long_rows.select("k", "doc_id").join(joined.select("k", binary("ids"), binary("decoded")), "k").select("doc_id", "ids", "decoded")
    whole = long_rows.join(cut.where(lost).select("k").distinct(), "k", "left_semi").select("doc_id", "text", F.lit(0).alias("ahead")).mapInArrow(encode, "doc_id long, ids binary, decoded binary")
    return short.unionByName(stitched).unionByName(whole)


def query(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    return encoded(docs, ranks_path, pattern).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
