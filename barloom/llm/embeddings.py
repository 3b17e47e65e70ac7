"""Near-duplicate embeddings by Euclidean p-stable hashing.

Each table has K projections onto normal vectors; a normalised vector's bucket is its K projections plus random offsets,
divided by the width and rounded down. Vectors that share a bucket in some table are compared exactly, by cosine in
double precision. On unit vectors a cosine of 0.98 is a distance of 0.2; with the parameters below a pair at that
distance is found with probability 0.99, and closer ones more surely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, forest, in_cells, pairs_in_groups, whole_groups
from barloom.llm.components import connected_components

COSINE = 0.98
TABLES = 24
PROJECTIONS = 8
WIDTH = 0.8
SEED = 7
#: Vectors of a bucket that one task takes whole; larger buckets go to cells.
BLOCK = 1024

_FIELDS = "vec_id long, label long, dim int, unit array<double>, buckets array<long>"


def _hashed(tables: int, projections: int, width: float, seed: int):
    """Valid vectors only: unit vectors in double precision and their bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(seed).integers(1, 2**63, size=projections, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for b in batches:
            ids, labels, vectors = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if ids[i] is not None and labels[i] is not None and v and None not in v:
                    by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                x = np.array([vectors[i] for i in rows], dtype=np.float64)
                # scaled by the largest component first, so that squares neither overflow nor vanish
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(axis=1)
                    good = np.isfinite(top) & (top > 0)
                    x = x[good] / top[good, None]
                    x /= np.linalg.norm(x, axis=1)[:, None]
                rows = [i for i, g in zip(rows, good, strict=True) if g]
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    planes[dim] = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
                normal, offset = planes[dim]
                cell = np.floor((x @ normal + offset) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, projections)
                key = (cell * mix).sum(axis=2, dtype=np.uint64)
                key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in rows], pa.int64()),
                        pa.array([labels[i] for i in rows], pa.int64()),
                        pa.array([dim] * len(rows), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dim, pa.int32()), pa.array(x.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * tables, pa.int32()), pa.array(key.view(np.int64).ravel())),
                    ],
                    names=["vec_id", "label", "dim", "unit", "buckets"],
                )

    return run


def _compare(cosine: float):
    """Rows (a, b, n): a has n further links (b is null), or a and b are linked (n is 0; a forest of each portion)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["label", "dim", "place", "bucket", "cell"], rows=4096):
            ids, weight, place, dim, block, cross = (t[c].to_numpy() for c in ("vec_id", "copies", "place", "dim", "block", "cross"))
            edges = np.append(starts, len(ids))
            for d in np.unique(dim):
                own = np.flatnonzero(dim == d)
                x = np.full((len(ids), d), 0.0)
                x[own] = t["unit"].combine_chunks().take(pa.array(own)).flatten().to_numpy().reshape(len(own), d)
                keys = t["buckets"].combine_chunks().take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1)
                table = np.zeros((len(ids), keys.shape[1]), dtype=np.int64)
                table[own] = keys
                in_dim = dim[starts] == d
                n_links: dict[int, int] = {}
                left, right = [], []
                # groups of other dimensions get no pairs
                for i, j in pairs_in_groups(starts, len(ids), np.where(in_dim, np.diff(edges), 0), most=50_000):
                    # a pair counts in the first table where it meets and, of a hot bucket's cells, in that of its blocks
                    new = ~cross[i] | (block[i] != block[j])
                    i, j = i[new], j[new]
                    new = (table[i] == table[j]).argmax(axis=1) == place[i]
                    i, j = i[new], j[new]
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                    i, j = i[near], j[near]
                    for p, q in ((i, j), (j, i)):
                        who, at = np.unique(ids[p], return_inverse=True)
                        for k, v in zip(who.tolist(), np.bincount(at, weights=weight[q]).astype(np.int64).tolist(), strict=True) if len(who) else ():
                            n_links[k] = n_links.get(k, 0) + v
                    left.append(ids[i])
                    right.append(ids[j])
                a, b = forest(np.concatenate(left), np.concatenate(right)) if left else ([], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*n_links, *a], pa.int64()), pa.array([None] * len(n_links) + b, pa.int64()), pa.array([*n_links.values(), *[0] * len(a)], pa.int64())],
                    names=["a", "b", "n"],
                )

    return run


def embedding_groups(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; see the module's text.

    Vectors are compared only when their labels are equal and not null. A vector that is null, empty or zero, or holds
    null or non-finite components, links with nothing, and so does one of another length. Rows that repeat a vec_id are
    one vector, that of the smallest (label, embedding). Equal vectors are collapsed to one row with a count before the
    search, so a vector that fills a third of the table costs one probe. A null vec_id links with nothing and is not
    kept. An empty table gives an empty result.
    """
    one = checkpointed(
        vectors.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("v")).select(F.col("vec_id").cast("long"), "v.label", "v.embedding")
    )
    classes = one.where("vec_id is not null and label is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    hashed = checkpointed(classes.select(F.col("rep").alias("vec_id"), "label", "embedding").mapInArrow(_hashed(tables, projections, width, seed), _FIELDS))
    place = ["label", "dim", "place", "bucket"]
    keys = hashed.select("vec_id", "label", "dim", F.posexplode("buckets").alias("place", "bucket"))
    shared = keys.groupBy(place).agg(F.count("*").alias("n")).where("n > 1")
    met = in_cells(keys.join(shared, place), "n", "vec_id", BLOCK)
    weights = classes.select(F.col("rep").alias("vec_id"), "copies")
    dealt = met.join(hashed.select("vec_id", "unit", "buckets").join(weights, "vec_id"), "vec_id")
    found = checkpointed(
        dealt.select(*place, "cell", "cross", "block", "vec_id", "copies", "unit", "buckets")
        .repartition(*place, "cell")
        .sortWithinPartitions(*place, "cell", "vec_id")
        .mapInArrow(_compare(cosine), "a long, b long, n long")
    )
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    groups = connected_components(found.where("b is not null")).select(F.col("node").alias("rep"), F.col("component"))
    valid = hashed.select(F.col("vec_id").alias("rep"), F.lit(True).alias("valid"))
    named = one.join(classes, ["label", "embedding"], "left").join(valid, "rep", "left").join(linked, "rep", "left").join(groups, "rep", "left")
    own = F.when(F.col("valid"), F.coalesce("component", "rep")).otherwise(F.col("vec_id"))
    links = F.when(F.col("valid"), F.col("copies") - 1 + F.coalesce("others", F.lit(0))).otherwise(0)
    return named.select("vec_id", links.cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


#: The same by comparing all pairs; rows of one vec_id are taken to be one.
ORACLE = """
with recursive v as (
  select vec_id, label, [x::double for x in embedding] e from embeddings
), n as (
  select *, sqrt(list_sum([x * x for x in e])) norm from v where label is not null
), link as (
  select a.vec_id a, b.vec_id b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach as (
  select vec_id node, vec_id other from v union select r.node, l.b from reach r join link l on r.other = l.a
), comp as (select node, min(other) c from reach group by node),
deg as (select a, count(*) n from link group by a)
select v.vec_id, coalesce(deg.n, 0)::bigint n_links, comp.c component_id, v.vec_id = comp.c kept
from v join comp on comp.node = v.vec_id left join deg on deg.a = v.vec_id
"""


def query(vectors: DataFrame) -> DataFrame:
    return embedding_groups(vectors)
