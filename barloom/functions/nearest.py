"""Nearest centroid: bounded search for each Arrow batch, or array functions where the centroids are too many to send."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers in the centroids that are sent to every task (32 MB).
SENT = 4_000_000


#: With fewer centers than this, all are measured.
FEW = 16


class Centers:
    """Centers (k, d) of one model, with what tells that most of them need not be measured.

    A point is measured against a few pivots among the centers first. With the nearest pivot at distance r, a center that
    is nearer than the best one found so far lies within r + best of the pivot (triangle inequality); centers are looked
    at in the order of their distance from the pivot, up to there. Distances are made in the direct form, as x*x - 2xy +
    y*y would lose the last digits and with them ties, so the result equals that of measuring all, ties included.
    """

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        k = len(centers)
        apart = np.sqrt(((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)) if k >= FEW else np.zeros((0, 0))
        if k < FEW or not np.isfinite(apart).all():
            self.pivots = np.zeros(0, dtype=np.int64)
            return
        pivots = [0]
        while len(pivots) < int(np.sqrt(k)):  # each the farthest from those before
            pivots.append(int(apart[pivots].min(axis=0).argmax()))
        self.pivots = np.unique(pivots)
        self.order = np.argsort(apart[self.pivots], axis=1, kind="stable")
        self.apart = np.take_along_axis(apart[self.pivots], self.order, axis=1)

    def _measured(self, x: np.ndarray, which: np.ndarray | int) -> np.ndarray:
        apart = x - self.centers[which]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x the nearest center, the first of a tie, and its squared distance; how many were measured."""
        n, k = len(x), len(self.centers)
        if not len(self.pivots) or not np.isfinite(x).all():
            d = np.column_stack([self._measured(x, j) for j in range(k)])
            best = d.argmin(axis=1)
            return best, d[np.arange(n), best], n * k
        d = np.column_stack([self._measured(x, j) for j in self.pivots])
        own = d.argmin(axis=1)
        best, least = self.pivots[own], d[np.arange(n), own]
        r = np.sqrt(least)
        reach, made, going = 2 * r, d.size, np.arange(n)
        is_pivot = np.isin(np.arange(k), self.pivots)
        for place in range(k):
            # a little slack, as roots and sums differ in their last digits
            going = going[self.apart[own[going], place] <= reach[going] * (1 + 1e-9) + 1e-12]
            if not len(going):
                break
            c = self.order[own[going], place]
            at, c = going[~is_pivot[c]], c[~is_pivot[c]]
            new = self._measured(x[at], c)
            made += len(at)
            nearer = (new < least[at]) | ((new == least[at]) & (c < best[at]))
            at = at[nearer]
            best[at], least[at] = c[nearer], new[nearer]
            reach[at] = r[at] + np.sqrt(least[at])
        return best, least, made


def squared_distance(a: Column, b: Column) -> Column:
    """Over the dimensions that both have."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _by_arrays(points: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    models = centroids.groupBy(*keys).agg(F.collect_list(F.struct("cluster", "center")).alias("_centers"))
    best = F.array_min(F.transform("_centers", lambda c: F.struct(squared_distance(F.col("features"), c["center"]).alias("d"), c["cluster"].alias("cluster"))))
    return points.join(models, keys).withColumn("_best", best).select(*points.columns, F.col("_best.cluster").alias("cluster"), F.sqrt("_best.d").alias("distance"))


def nearest_centroid(points: DataFrame, centroids: DataFrame, keys: tuple[str, ...] = ("ticker",), most: int = SENT) -> DataFrame:
    """points (keys, features, ...) with ``cluster`` and ``distance`` of the nearest centroid of the same keys.

    The first cluster wins a tie. Only the dimensions that features and centroids both have count, so a model with the
    category as last dimension scores rows without one. Points without a model are dropped. One action: centroids are
    counted, and sent to the tasks if they are few.
    """
    keys = list(keys)
    if (centroids.agg(F.sum(F.size("center"))).first()[0] or 0) > most:
        return _by_arrays(points, centroids, keys)
    models: dict[tuple, list] = {}
    for r in centroids.select(*keys, "cluster", "center").collect():
        models.setdefault(tuple(r[k] for k in keys), []).append((r["cluster"], r["center"]))
    tables = {k: (np.array([c for c, _ in sorted(v)]), np.array([x for _, x in sorted(v)], dtype=float)) for k, v in models.items()}
    sent = points.sparkSession.sparkContext.broadcast(tables)
    at = [points.columns.index(c) for c in (*keys, "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple, Centers] = {}
        for b in batches:
            owners = list(zip(*(b.column(i).to_pylist() for i in at[:-1]), strict=True))
            vectors = b.column(at[-1]).to_pylist()
            rows: dict[tuple, list[int]] = {}
            for i, k in enumerate(owners):
                if k in sent.value and vectors[i] is not None:
                    rows.setdefault(k, []).append(i)
            cluster, distance = np.zeros(b.num_rows, dtype=np.int64), np.full(b.num_rows, -1.0)
            for k, own in rows.items():
                names, centers = sent.value[k]
                x = np.array([vectors[i] for i in own], dtype=float)
                n = min(x.shape[1], centers.shape[1])
                if (*k, n) not in ready:
                    ready[*k, n] = Centers(centers[:, :n])
                best, d, _ = ready[*k, n].nearest(x[:, :n])
                cluster[own], distance[own] = names[best], np.sqrt(d)
            keep = pa.array(np.flatnonzero(distance >= 0))
            out = pa.Table.from_batches([b]).take(keep)
            out = out.append_column("cluster", pa.array(cluster).take(keep)).append_column("distance", pa.array(distance).take(keep))
            yield from out.to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}, cluster long, distance double")
