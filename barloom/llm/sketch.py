"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. It needs no common size: sketches of a long
and a short text can be compared, and the union of two sketches, again cut at the threshold, is the sketch of both texts
together. Of a text with few shingles that fraction would leave next to nothing, so its sketch has a finer cut, by halves
as its shingles are fewer; it holds all that the fixed fraction would, and two sketches are compared or merged at the
coarser of their cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WORD, checkpointed

WORDS = 5
#: A hash is kept if it is below 2**64 / SCALE; texts whose sketches would expect fewer than ENOUGH hashes halve the scale.
SCALE, ENOUGH = 8, 64
#: Documents are dealt by doc_id div SPAN, so that neighbours share a bucket of bounded size.
SPAN = 128
#: Buckets whose first doc_id is sent to every task to find its text; with more, texts are shuffled once more for that.
SENT = 500_000


def shingle_hashes(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Hashes of the shingles; fewer words than the width make one shingle, none make none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hash_, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return np.array([hash_(join(words))], dtype=np.uint64)
    return np.array([hash_(join(x)) for x in zip(*(words[i:] for i in range(width)), strict=False)], dtype=np.uint64)


class Sketch(NamedTuple):
    """All distinct hashes below 2**64 / scale, in ascending order."""

    scale: int
    hashes: np.ndarray

    def cut(self, scale: int) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(2**64 // scale))] if scale > self.scale else self.hashes

    def __str__(self) -> str:
        return f"{self.scale}:{self.hashes.astype('>u8').tobytes().hex()}"


def sketch(hashes: np.ndarray, scale: int = SCALE) -> Sketch:
    """Of a text with these shingles; scale: the coarsest cut, a power of two."""
    hashes = np.unique(hashes)
    while scale > 1 and len(hashes) < ENOUGH * scale:
        scale //= 2
    return Sketch(scale, Sketch(1, hashes).cut(scale))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two texts together."""
    scale = max(a.scale, b.scale)
    return Sketch(scale, np.union1d(a.cut(scale), b.cut(scale)))


def _shared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    scale = max(a.scale, b.scale)
    x, y = a.cut(scale), b.cut(scale)
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: Sketch, b: Sketch) -> float:
    """Shared hashes over all hashes of both; 1 for two texts without words, 0 if the common cut leaves nothing of either."""
    both, x, y = _shared(a, b)
    return both / (x + y - both) if x or y else float(not len(a.hashes) and not len(b.hashes))


def containment(a: Sketch, b: Sketch) -> float:
    """Share of a's hashes that b has; 1 for a text without words, 0 if the common cut leaves nothing of a."""
    both, x, _ = _shared(a, b)
    return both / x if x else float(not len(a.hashes))


def _words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


def edited_text(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by the first as many, or all, of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut] if cut else text


def _edited_sketch(text: str, hashes: np.ndarray, following: str, scale: int, width: int) -> tuple[str, Sketch]:
    """The edited text and its sketch, which takes the hashes of untouched shingles from the text's own."""
    edited = edited_text(text, following)
    keep = len(text) - len(text) // 3
    # words that end before the kept part's last white space are whole in both texts
    stem = edited[:keep]
    while stem and stem[-1] not in " \t\n\v\f\r":
        at = max(stem.rfind(c) for c in " \t\n\v\f\r")
        stem = stem[: at + 1]
    same = len(WORD.findall(stem.encode())) - width + 1
    if same <= 0 or len(hashes) < same:
        return edited, sketch(shingle_hashes(_words(edited), width), scale)
    tail = WORD.findall(stem.encode().lower())[same:] + _words(edited[len(stem) :])
    return edited, sketch(np.concatenate([hashes[:same], shingle_hashes(tail, width) if len(tail) >= width else hashes[:0]]), scale)


@dataclass
class _Last:
    bucket: int
    ident: int | None
    text: str
    hashes: np.ndarray
    own: Sketch


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_contained double, next_contained double"


def _run(scale: int, width: int):
    """Rows come by bucket and descending order; a bucket ends in its successor's first row, marked as a guest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Last | None = None
        for b in batches:
            for part in range(0, b.num_rows, 512):
                own = b.slice(part, 512)
                rows = []
                for bucket, guest, ident, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(2).to_pylist(), own.column(3), strict=True):
                    text = text.as_py()
                    hashes = shingle_hashes(_words(text), width)
                    here = _Last(bucket, ident, text, hashes, sketch(hashes, scale))
                    if last is not None and last.bucket == bucket:
                        edited, new = _edited_sketch(last.text, last.hashes, text, scale, width)
                        rows.append(
                            (last.ident, len(last.text), hashlib.sha256(edited.encode()).hexdigest(), str(last.own), str(new))
                            + (likeness(last.own, new), likeness(last.own, here.own), containment(last.own, new), containment(last.own, here.own))
                        )
                    last = None if guest else here
                columns = list(zip(*rows, strict=True)) or [[]] * 9
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return run


def _successors(keys: DataFrame, lowest: int, highest: int, span: int) -> DataFrame:
    """(g, next): for each distinct g the next smaller one; none for the smallest. No window holds more than span rows."""
    from pyspark.sql import Window

    if highest - lowest < span:
        return keys.select("g", F.lag("g").over(Window.orderBy("g").partitionBy(F.lit(0))).alias("next"))
    within = keys.withColumn("up", F.expr(f"g div {span} - if(g % {span} < 0, 1, 0)"))
    near = within.select("g", "up", F.lag("g").over(Window.partitionBy("up").orderBy("g")).alias("next"))
    tops = within.groupBy("up").agg(F.max("g").alias("top"))
    above = _successors(tops.select(F.col("up").alias("g")), lowest // span, highest // span, span).select(F.col("g").alias("up"), F.col("next").alias("down"))
    far = above.join(tops.select(F.col("up").alias("down"), "top"), "down").select("up", "top")
    return near.join(far, "up", "left").select("g", F.coalesce("next", "top").alias("next"))


def fingerprints(docs: DataFrame, scale: int = SCALE, width: int = WORDS, span: int = SPAN) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; one row for each row of docs.

    The next document is the one of the next smaller doc_id (after the smallest: the largest); rows of one doc_id follow
    each other by text, and rows without doc_id come after all others. A null text is empty; two empty sketches are
    alike (1). A single document is its own next. An empty table gives an empty result. Documents are dealt by
    doc_id div span and each bucket also gets the first row of the bucket that follows, so no sort spans the table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ends = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.count("*")).first()
    lowest, highest = (ends[0], ends[1]) if ends[0] is not None else (0, 0)
    nulls_below = lowest // span - 1  # the bucket of rows without doc_id
    bucket = F.coalesce(F.expr(f"cast(doc_id as bigint) div {span} - if(cast(doc_id as bigint) % {span} < 0, 1, 0)"), F.lit(nulls_below)).cast("long")
    rows = docs.select(bucket.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), text)
    firsts = rows.groupBy("g").agg(F.max("doc_id").alias("doc_id"))
    follows = _successors(firsts.select("g"), nulls_below, highest // span, span)
    top = highest // span if ends[0] is not None else nulls_below
    guests_of = follows.select("g", F.coalesce("next", F.lit(top)).alias("next"))
    # the first row of each bucket, by largest doc_id and then smallest text
    wanted = checkpointed(firsts.select(F.col("g").alias("fg"), F.col("doc_id").alias("fd")))
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    heads = rows.join(wanted, (F.col("g") == F.col("fg")) & F.col("doc_id").eqNullSafe(F.col("fd")), "left_semi")
    head = heads.groupBy("g", "doc_id").agg(F.min("text").alias("text"))
    guests = guests_of.join(head.select(F.col("g").alias("next"), "doc_id", "text"), "next").select("g", F.lit(True).alias("guest"), "doc_id", "text")
    return (
        rows.select("g", F.lit(False).alias("guest"), "doc_id", "text")
        .unionByName(guests)
        .repartition("g")
        .sortWithinPartitions("g", "guest", F.desc_nulls_last("doc_id"), "text")
        .mapInArrow(_run(scale, width), _FIELDS)
    )


def query(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
