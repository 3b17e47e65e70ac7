"""What several operators share: tables, checkpoints, bounded cells of hot groups, streams of whole groups."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than white space.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one if all runs in this process, else an error:
    other machines wouldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_cells(df: DataFrame, n: str, member: str, block: int) -> DataFrame:
    """Deal the n rows of a group into cells of about 2 * block rows, so that any two of them share a cell.

    A row falls into a block by a hash of ``member`` and goes to the cell of each pair of blocks that holds its own;
    groups up to ``block`` rows have one block. Adds ``cell``, ``block`` (longs) and ``cross``: whether the cell is one
    of two blocks, where only pairs from both are new.
    """
    parts = F.ceil(F.col(n) / F.lit(block)).cast("long")
    own = F.pmod(F.xxhash64(F.lit("cell"), F.col(member)), parts)
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), parts - 1),
        lambda other: F.struct((F.least(own, other) * parts + F.greatest(own, other)).alias("cell"), (own != other).alias("cross")),
    )
    return df.withColumn("_c", F.explode(cells)).select("*", "_c.cell", "_c.cross", own.alias("block")).drop("_c")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys`` (integers), with the row where each group starts.

    Holds about ``rows`` rows and one group at a time.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, int(at[-1])), at[:-1]
                rest = t.slice(int(at[-1]))
                held, n = rest.to_batches(), rest.num_rows
            else:
                held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def pairs_in_groups(starts: np.ndarray, n: int, first: np.ndarray | None = None, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), j before i in the same group, in portions of about ``most``.

    first: how many leading rows of each group may be j (all, if not given).
    """
    sizes = np.diff(np.append(starts, n))
    group = np.repeat(np.arange(len(starts)), sizes)
    begin = starts[group]
    count = np.arange(n) - begin
    if first is not None:
        count = np.minimum(count, first[group])
    total = np.cumsum(count)
    lo = 0
    while lo < n:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[lo:hi], c)
        if len(i):
            yield i, j
        lo = hi


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links (a, b): as few of them as join the same nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def stars(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """The same by other links: each node with the smallest that it reaches, so that groups found twice have equal links."""
    left, right = forest(a, b)
    least: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := least.get(x, x)) != x:
            least[x] = x = least.get(p, p)
        return x

    for x, y in zip(left, right, strict=True):
        p, q = root(x), root(y)
        least[max(p, q)] = min(p, q)
    nodes = sorted({*left, *right})
    pairs = [(x, r) for x in nodes if (r := root(x)) != x]
    return [x for x, _ in pairs], [r for _, r in pairs]
