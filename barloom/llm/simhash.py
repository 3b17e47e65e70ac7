"""SimHash near-duplicates by a generalised pigeonhole search over correlated bits.

The 64 bits of a fingerprint are split into m partitions, bits that tend to agree together. Two fingerprints within
tau bits agree within T_i bits in some partition i whenever the thresholds T sum to tau - m + 1 (T_i = -1 leaves a
partition out). Dynamic programming picks m and T from candidate counts estimated on a bounded sample; the thresholds
change the work only, never the result. A fingerprint is stored under its own value of each partition and probes the
values within T_i bits; what meets is verified on all 64 bits. A wide search would shuffle hundreds of probes for each
fingerprint, more with more rows; it deals blocks of fingerprints to cells of two and probes within a cell's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WORD, checkpointed, in_cells, pairs_in_groups, stars, unused, whole_groups
from barloom.llm.components import connected_components
from barloom.llm.labelled import least_hashed

SHINGLE = 4
SEED = 42
TAU = 4
#: What a stage that drops near copies takes: wider shingles, a wider search, and exact similarity.
STAGE_SHINGLE, STAGE_TAU, STAGE_SIMILARITY = 5, 12, 0.8
#: Its second source of candidates: texts that share a band, the least of the shingles under each of a few permutations.
BANDS, BAND = 12, 4
#: The first part of the buckets of bands, after those of the fingerprint's partitions.
BAND_PART = 64
#: Texts whose names (some 60 bytes each) are sent to every task to find them; with more, only hashes of the names are, and what
#: may be among them is shuffled; with more than that, all texts are.
SENT, HASHES_SENT = 100_000, 1 << 23
#: Fingerprints that the partitions and thresholds are fitted on.
SAMPLE = 2048
#: Rows of a bucket that one task takes whole; larger buckets go to cells.
BLOCK = 8192
#: Costs of a probe that is shuffled and of a pair that is verified.
PROBE_COST, PAIR_COST = 1.0, 0.005
#: Within a cell: costs of a bucket and of a row that is looked up for it.
BUCKET_COST, ROW_COST = 100.0, 0.025
#: Blocks that fingerprints are dealt to (any two of them meet in a cell), and bounds of a block's rows.
GRID, LEAST_BLOCK, MOST_BLOCK = 8, 1024, 1 << 20
#: Pairs of a cell that are compared at once, and links that it holds before dense groups among them are thinned.
CHUNK, HELD = 1 << 16, 300_000


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """Hashes of the word shingles, repeats included; fewer words than the width make one, none make none."""
    words, hash_ = WORD.findall(text.lower()), xxhash.xxh64_intdigest
    if len(words) < width:
        return [hash_(b" ".join(words), SEED)] if words else []
    return [hash_(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 majority bits over the shingles' hashes; 0 without words."""
    return _majority(shingle_hashes(text, width))


def _majority(hashes: list[int]) -> int:
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


_ODD = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hash_bands(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """A hash of each band; none without words. Sets of similarity s share one with probability 1 - (1 - s**BAND)**BANDS."""
    return _bands(np.array(shingle_hashes(text, width), dtype=np.uint64))


def _bands(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return hashes.view(np.int64)
    least = np.full(BANDS * BAND, 2**64 - 1, dtype=np.uint64)
    for lo in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[lo : lo + 1024, None] * _ODD[0]).min(axis=0))
    return (least * _ODD[1]).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64).view(np.int64)


def counts_sketch(distinct: np.ndarray) -> np.ndarray:
    """How many of the distinct hashes fall into each of some equal spans, about one for eight hashes; 255 are 255 or more."""
    spans = max(4, min(11, len(distinct).bit_length() - 3))
    return np.minimum(np.bincount((distinct >> np.uint64(64 - spans)).astype(np.int64), minlength=1 << spans), 255).astype(np.uint8)


def may_be_similar(n: int, a: bytes, m: int, b: bytes, similarity: float) -> bool:
    """Whether sets of n and m hashes with these sketches can have this Jaccard similarity; never False for sets that have it."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (a, b))
    if len(x) != len(y):
        if max(x.max(), y.max()) == 255:
            return True  # full counts can't be summed up
        k = min(len(x), len(y))
        x, y = (v.reshape(k, -1).sum(axis=1) for v in (x, y))
    most = (n + m - int(np.abs(x - y).sum())) / 2
    return most >= similarity * (n + m - most)


def _same(docs: DataFrame) -> Column:
    """What equal texts share and others don't; a null text is like an empty one."""
    return F.md5(F.coalesce(docs["text"].cast("binary"), F.lit(b"")))


def with_fingerprint(docs: DataFrame, width: int = SHINGLE, bands: bool = False) -> DataFrame:
    """(id, fp long, same string) of every row: its doc_id, fingerprint and a hash of the text; a null text has no words.

    If asked for, ``bands`` (array of longs), ``size`` (long; of distinct shingles) and their ``sketch`` (binary) too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, more = np.zeros(b.num_rows, dtype=np.uint64), {"bands": [], "size": [], "sketch": []}
            for i, t in enumerate(b.column(2)):
                hashes = shingle_hashes(t.as_py() or b"", width)
                found[i] = _majority(hashes)
                if bands:
                    distinct = np.unique(np.array(hashes, dtype=np.uint64))
                    more["bands"].append(_bands(distinct))
                    more["size"].append(len(distinct))
                    more["sketch"].append(counts_sketch(distinct).tobytes())
            made = [pa.array(v, kind) for v, kind in zip(more.values(), (pa.list_(pa.int64()), pa.int64(), pa.binary()), strict=True)] if bands else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64)), b.column(1), *made], names=["id", "fp", "same", *(more if bands else ())])

    own = docs.select(F.col("doc_id").cast("long").alias("id"), _same(docs).alias("same"), F.col("text").cast("binary").alias("t"))
    return own.mapInArrow(run, "id long, fp long, same string" + ", bands array<long>, size long, sketch binary" * bands)


def group_bits(sample: np.ndarray, m: int) -> list[int]:
    """m masks of 64 bits; each gathers the bits most correlated with its first one."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits**2).sum(axis=0))
    tie = np.abs(bits.T @ bits) / np.maximum(np.outer(scale, scale), 1e-12)
    free, masks = list(range(64)), []
    for i in range(m):
        width = len(free) // (m - i)
        first = max(free, key=lambda x: (tie[x, free].sum(), -x))
        own = sorted(free, key=lambda x: (x != first, -tie[first, x], x))[:width]
        free = [x for x in free if x not in own]
        masks.append(sum(1 << x for x in own))
    return masks


def allocate(sample: np.ndarray, n: int, tau: int = TAU, in_cell: bool = False) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is probed, at the least estimated cost for n fingerprints, shuffled or in a cell."""
    n = max(n, 1)  # without rows every choice would cost the same
    best: tuple[float, list[tuple[int, int]]] | None = None

    def apart(mask: int) -> np.ndarray:
        """How many pairs of the sample differ in 0, 1, ... bits of the mask; a row of pairs at a time."""
        count = np.zeros(65, dtype=np.int64)
        for x in range(len(sample) - 1):
            count += np.bincount(np.bitwise_count((sample[x + 1 :] ^ sample[x]) & np.uint64(mask)), minlength=65)
        return count

    for m in range(2, tau + 2):
        masks = group_bits(sample, m) if len(sample) > 1 else group_bits(np.arange(2, dtype=np.uint64), m)
        costs = []
        for mask in masks:
            width = mask.bit_count()
            if len(sample) > 1:
                count = apart(mask)
                seen = np.cumsum(count) / count.sum()
            else:
                seen = np.zeros(width + 1)
            ball = np.cumsum([comb(width, t) for t in range(width + 1)]).astype(float)
            near = np.maximum(seen[: width + 1], ball / 2.0**width)
            probes = BUCKET_COST * 2.0**width + ROW_COST * n * ball if in_cell else PROBE_COST * n * ball
            costs.append([0.0] + [probes[t] + PAIR_COST * n * n / 2 * near[t] for t in range(min(tau, width) + 1)])
        # reach[s]: the least cost of the partitions so far with thresholds that sum to s
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in reach.items():
                for t, x in enumerate(cost, start=-1):
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, [*chosen, t])
            reach = step
        cost, chosen = reach[tau - m + 1]
        if best is None or cost < best[0]:
            best = (cost, [(mask, t) for mask, t in zip(masks, chosen, strict=True) if t >= 0])
    return best[1]


def _near_in_group(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) that join all fingerprints within tau bits in one large group, found breadth first."""
    left, right = [], []
    rest, front = np.arange(len(fp)), []
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
        x = front.pop()
        close = np.bitwise_count(fp[rest] ^ fp[x]) <= tau
        for y in rest[close]:
            left.append(x)
            right.append(y)
        front.extend(rest[close])
        rest = rest[~close]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


#: Pairs of a bucket that are compared at once, and links of one portion above which it is searched breadth first.
PORTION, MANY = 4_000_000, 200_000


def _links_in_group(fp: np.ndarray, stored: int, tau: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Links between the stored fingerprints of a bucket, which come first, and all of it; whether they only join it."""
    left, right = [], []
    step = max(1, PORTION // stored)
    for lo in range(0, len(fp), step):
        i, j = np.nonzero(np.bitwise_count(fp[lo : lo + step, None] ^ fp[None, :stored]) <= tau)
        if len(i) > MANY:
            return *_near_in_group(fp, tau), True
        new = i + lo > j
        left.append(i[new] + lo)
        right.append(j[new])
    return np.concatenate(left), np.concatenate(right), False


#: A bucket with more links than this for each linked row is dense: its links are thinned, and its groups searched anew.
DENSE = 4
#: Shingles (and a few for each text) of a dense group that one task takes whole; larger groups go to cells.
SETS, SETS_ROW = 1 << 18, 32


def _dense(i: np.ndarray, j: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which links (i, j) lie in a dense group of rows."""
    groups = int(group[-1]) + 1
    links = np.bincount(group[i], minlength=groups)
    members = np.bincount(group[np.unique(np.concatenate((i, j)))], minlength=groups)
    return (links > DENSE * members)[group[i]]


def _verify(tau: int, whole: bool):
    """Links of each bucket: a forest of all; or, if whole, all links of sparse buckets and a forest of the dense ones'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["part", "value", "cell"]):
            fp, rep, probe = t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy(), t["probe"].to_numpy()
            n = len(fp)
            sizes = np.diff(np.append(starts, n))
            stored = np.add.reduceat((~probe).astype(np.int64), starts)
            large = stored * sizes > 10_000
            a, b, joined = [], [], []
            reach = np.where(t["part"].to_numpy() < BAND_PART, tau, 64)  # who shares a band is near at any distance
            for s, size, own in zip(starts[large].tolist(), sizes[large].tolist(), stored[large].tolist(), strict=True):
                i, j, many = _links_in_group(fp[s : s + size], own, int(reach[s]))
                joined.append(np.full(len(i), many))
                a.append(s + i)
                b.append(s + j)
            for i, j in pairs_in_groups(starts, n, np.where(large, 0, stored)):
                close = np.bitwise_count(fp[i] ^ fp[j]) <= reach[i]
                a.append(i[close])
                b.append(j[close])
            i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
            thin = np.ones(len(i), dtype=bool)
            if whole:
                thin = _dense(i, j, np.repeat(np.arange(len(starts)), sizes))
                # what was found breadth first says nothing of the other pairs
                searched = np.concatenate([*joined, np.zeros(0, dtype=bool)])
                thin[: len(searched)] |= searched
            x, y = stars(rep[i[thin]], rep[j[thin]])
            a, b = (np.concatenate((np.array(u, dtype=np.int64), rep[v[~thin]])) for u, v in ((x, i), (y, j)))
            dense = np.arange(len(a)) < len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(dense)], names=["a", "b", "dense"])

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (part, value, rep, ...) with ``cell``: crowded buckets are dealt by rep, as texts may share a fingerprint."""
    crowded = checkpointed(rows.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    if crowded.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    return in_cells(rows.join(crowded, ["part", "value"], "left").na.fill(1, ["n"]), "n", "rep", BLOCK)


def _verified(rows: DataFrame, tau: int, whole: bool) -> DataFrame:
    """(a, b, dense): the links of rows (part, value, probe, fp, rep) that share a bucket."""
    return (
        _dealt(rows).select("part", "value", "cell", "probe", "fp", "rep")
        .repartition("part", "value", "cell")
        .sortWithinPartitions("part", "value", "cell", "probe", "fp")
        .mapInArrow(_verify(tau, whole), "a long, b long, dense boolean")
    )


def _sample(fps: DataFrame) -> np.ndarray:
    picked = least_hashed(fps.select("fp"), F.xxhash64(F.lit("fit"), "fp"), SAMPLE)
    return np.array([r.fp for r in picked.collect()], dtype=np.int64).view(np.uint64)


def fingerprint_links(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b, dense): links that join the same ``rep`` as all pairs of fps (fp, rep) within tau bits do."""
    probes = []
    for part, (mask, most) in enumerate(allocate(_sample(fps), fps.count(), tau)):
        bits = [x for x in range(64) if mask >> x & 1]
        for k in range(most + 1):
            for flip in combinations(bits, k):
                signed = [int(np.uint64(v).astype(np.int64)) for v in (mask, sum(1 << x for x in flip))]
                probes.append(F.struct(F.lit(part).alias("part"), *(F.lit(v).cast("long").alias(c) for v, c in zip(signed, ("mask", "flip"), strict=True)), F.lit(k > 0).alias("probe")))
    rows = fps.select("fp", "rep", F.explode(F.array(*probes)).alias("p")).select(
        "fp", "rep", "p.part", F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("value"), "p.probe"
    )
    return _verified(rows, tau, False)


def band_links(fps: DataFrame) -> DataFrame:
    """(a, b, dense): each pair of fps (fp, rep, bands) that share a band is a link, or both are joined by dense links."""
    rows = fps.select("fp", "rep", F.posexplode("bands").alias("part", "value"))
    return _verified(rows.select("fp", "rep", (F.col("part") + BAND_PART).alias("part"), "value", F.lit(False).alias("probe")), 64, True)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each of them reaches over the links (i, j)."""
    label = np.arange(n)
    while not np.array_equal(a := label[i], b := label[j]):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


class _Links:
    """Links between n rows: single ones, and stars that join dense groups, within which no more links are taken."""

    def __init__(self, n: int):
        self.n, self.codes, self.held, self.most = n, [np.zeros(0, dtype=np.int64)], 0, HELD
        self.stars: list[np.ndarray] = [np.zeros((2, 0), dtype=np.int64)]
        #: of each row, -1 in none; how often groups have changed
        self.group, self.version = np.full(n, -1), 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if self.version:
            new = (self.group[i] < 0) | (self.group[i] != self.group[j])
            i, j = i[new], j[new]
        self.codes.append(np.minimum(i, j) * self.n + np.maximum(i, j))
        self.held += len(i)
        if self.held > self.most:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray]:
        """The single links, each once, after those of groups with many links for each row have become stars."""
        i, j = np.divmod(np.unique(np.concatenate(self.codes)), self.n)
        label, rows = _labels(self.n, i, j), np.unique(np.concatenate((i, j)))
        dense = np.bincount(label[i], minlength=self.n) > DENSE * np.bincount(label[rows], minlength=self.n)
        if dense.any():
            own = rows[dense[label[rows]]]
            self.stars.append(np.stack((own, label[own]))[:, own != label[own]])
            x, y = np.concatenate(self.stars, axis=1)
            self.group[:] = -1
            joined = np.concatenate((x, y))
            self.group[joined] = _labels(self.n, x, y)[joined]
            self.version += 1
            single = (self.group[i] < 0) | (self.group[i] != self.group[j])
            i, j = i[single], j[single]
        self.codes, self.held = [i * self.n + j], len(i)
        self.most = max(HELD, 2 * self.held)
        return i, j


def _near_in_cell(fp: np.ndarray, size: np.ndarray, cut: int, plan: list[tuple[int, int]], tau: int, similarity: float) -> _Links:
    """Links within tau bits, of sets whose sizes allow the similarity, between the first ``cut`` rows and the others, or among
    all if there are no others. plan: masks and thresholds of ``allocate``."""
    links, alone = _Links(len(fp)), cut == len(fp)

    def meet(own: np.ndarray, others: np.ndarray) -> None:
        todo = [(own, others)]
        while todo:
            a, b = todo.pop()
            version, parts = links.version, [(a, b)]
            if version and (g := links.group[a]).max() >= 0:  # rows of one dense group need not meet
                parts = [(a[g == x], b if x < 0 else b[links.group[b] != x]) for x in np.unique(g)]
            for a, b in parts:
                step = max(1, CHUNK // max(1, len(b)))
                for lo in range(0, len(a) if len(b) else 0, step):
                    if links.version != version:
                        todo.append((a[lo:], b))
                        break
                    found = np.flatnonzero(np.bitwise_count(fp[a[lo : lo + step], None] ^ fp[None, b]) <= tau)
                    if len(found):
                        i, j = a[lo + found // len(b)], b[found % len(b)]
                        fit = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])) & (i != j)
                        links.add(i[fit], j[fit])

    for mask, most in plan:
        bits = [x for x in range(64) if mask >> x & 1]
        key = np.zeros(len(fp), dtype=np.int64)
        for k, x in enumerate(bits):
            key |= ((fp >> np.uint64(x)) & np.uint64(1)).astype(np.int64) << k
        flips = np.array([sum(1 << x for x in flip) for k in range(most + 1) for flip in combinations(range(len(bits)), k)], dtype=np.int64)
        sides = []
        for rows in [np.arange(cut)] if alone else [np.arange(cut), np.arange(cut, len(fp))]:
            rows = rows[np.argsort(key[rows], kind="stable")]
            sides.append((rows, np.searchsorted(key[rows], np.arange((1 << len(bits)) + 1))))
        (left, left_at), (right, right_at) = sides[0], sides[-1]
        for v in np.flatnonzero(np.diff(left_at)).tolist():
            values = flips ^ v
            if alone:
                values = values[values >= v]  # two buckets meet once
            start, n = right_at[values], right_at[values + 1] - right_at[values]
            others = right[np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)]
            if len(others):
                meet(left[left_at[v] : left_at[v + 1]], others)
    return links


def cell_links(fps: DataFrame, tau: int, similarity: float) -> DataFrame:
    """(a, b, dense): each pair of fps (fp, rep, size) within tau bits whose sizes allow this Jaccard similarity of their sets is
    a link, or both are joined by links that are marked dense.

    Rows are shuffled once for each block; all probes are made in the memory of a cell of two blocks.
    """
    n = fps.count()
    block = max(LEAST_BLOCK, min(MOST_BLOCK, -(-n // GRID)))
    plan = allocate(_sample(fps), min(n, block), tau, in_cell=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["cell"]):
            fp, rep, size, own = t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy(), t["size"].to_numpy(), t["block"].to_numpy()
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(fp)], strict=True):
                links = _near_in_cell(fp[lo:hi], size[lo:hi], int(np.searchsorted(own[lo:hi], own[lo], side="right")), plan, tau, similarity)
                single, stars_ = np.stack(links.thin()), np.concatenate(links.stars, axis=1)
                a, b = rep[lo:hi][np.concatenate((single, stars_), axis=1)]
                dense = np.arange(len(a)) >= single.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(dense)], names=["a", "b", "dense"])

    parts = -(-n // block)
    dealt = in_cells(fps.select("fp", "rep", "size", F.lit(n).alias("n")), "n", "rep", block).select("cell", "block", "fp", "rep", "size")
    # cells hold few bytes for their work: their tasks must not be merged, and few cells should share one
    return dealt.repartition(max(1, 2 * parts * (parts + 1)), "cell").sortWithinPartitions("cell", "block").mapInArrow(run, "a long, b long, dense boolean")


def possible_links(links: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes (rep, size, sketch) whose sketches allow this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            own = [may_be_similar(*x, similarity) for x in zip(*(t[c].to_pylist() for c in ("n", "x", "m", "y")), strict=True)]
            yield t.filter(pa.array(own, pa.bool_())).select(["a", "b"])

    a, b = (nodes.select(F.col("rep").alias(c), F.col("size").alias(n), F.col("sketch").alias(s)) for c, n, s in (("a", "n", "x"), ("b", "m", "y")))
    return links.join(a, "a").join(b, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over fingerprints within tau bits.

    Equal fingerprints are collapsed to one row before the search, so groups of copies cost one probe. Null and empty
    texts share fingerprint zero. Repeated rows keep one result row each; a row without doc_id gets its class, and
    that class's name if no other row has one is null. An empty table gives an empty result.
    """
    marked = checkpointed(with_fingerprint(docs))
    distinct = checkpointed(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    classes = connected_components(fingerprint_links(distinct, tau))
    named = distinct.join(classes, distinct.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select(F.col("id").alias("doc_id"), "fp", "component_id")


def _may_be_among(names: DataFrame) -> Callable[[Column, Column], Column]:
    """Of columns first and same: whether they may be a row of names; every task gets the hashes of all names."""
    sent = names.sparkSession.sparkContext.broadcast(np.unique(names.select(F.xxhash64("first", "same").alias("h")).toArrow()["h"].to_numpy()))

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        at = np.searchsorted(sent.value, h.to_numpy())
        return pd.Series(sent.value[np.minimum(at, len(sent.value) - 1)] == h.to_numpy())

    return lambda first, same: among(F.xxhash64(first, same))


def _shingled(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """members (first, same, id, component, n) with s (array<long>): the distinct shingles, in order, of the text of that name.

    Texts are not shuffled, but where there are more than ``SENT`` members, and then only theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                own = b.slice(lo, 512)
                sets = [np.unique(np.array(shingle_hashes((t.as_py() or b""), width), dtype=np.uint64)).view(np.int64) for t in own.column(3)]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["id", "component", "n", "s"])

    own = docs.select(F.col("doc_id").cast("long").alias("first"), _same(docs).alias("same"), F.col("text").cast("binary").alias("t")).where("first is not null")
    count = members.count()
    if SENT < count <= HASHES_SENT:
        own = own.where(_may_be_among(members)(F.col("first"), F.col("same")))
    found = own.join(F.broadcast(members) if count <= SENT else members, ["first", "same"])
    return found.select("id", "component", "n", "t").mapInArrow(run, "id long, component long, n long, s array<long>")


def _similar_in_group(at: np.ndarray, items: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links that join the sets as all pairs of at least this similarity do, found breadth first.

    Set i has the items from at[i] to at[i + 1], numbers from 0. Only sets not yet reached are compared.
    """
    sizes = np.diff(at)
    held = np.zeros(int(items.max(initial=-1)) + 1, dtype=bool)
    left, right = [], []
    rest, front = np.arange(len(sizes)), []
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
        x = front.pop()
        near = np.flatnonzero(np.minimum(sizes[rest], sizes[x]) >= similarity * np.maximum(sizes[rest], sizes[x]))
        own = rest[near]
        n = sizes[own]
        ends = np.cumsum(n)
        held[items[at[x] : at[x + 1]]] = True
        seen = held[items[np.arange(n.sum()) + np.repeat(at[own] - (ends - n), n)]]
        held[items[at[x] : at[x + 1]]] = False
        total = np.concatenate(([0], np.cumsum(seen)))
        shared = total[ends] - total[ends - n]
        hit = shared >= similarity * (sizes[x] + n - shared)
        left += [x] * int(hit.sum())
        right += own[hit].tolist()
        front += own[hit].tolist()
        rest = np.delete(rest, near[hit])
    return left, right


def _similar_members(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the members (component, n, id, s) of each group as all its pairs of this similarity do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["component", "cell"], 4096):
            ids, s = t["id"].to_numpy(), t["s"].combine_chunks()
            s = s.chunk(0) if isinstance(s, pa.ChunkedArray) else s
            at, items = s.offsets.to_numpy().astype(np.int64), s.values.to_numpy()
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                own = np.unique(items[at[lo] : at[hi]], return_inverse=True)[1]
                x, y = _similar_in_group(at[lo : hi + 1] - at[lo], own, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][np.array(v, dtype=np.int64)], pa.int64()) for v in (x, y)], names=["a", "b"])

    dealt = in_cells(members, "n", "id", SETS)
    rows = dealt.select("component", "cell", "id", "s").repartition("component", "cell").sortWithinPartitions("component", "cell")
    return rows.mapInArrow(run, "a long, b long")


def _sized(members: DataFrame) -> DataFrame:
    """members (component, size, ...) with n, what a group that goes to cells holds; 1 for others."""
    total = members.groupBy("component").agg(F.sum(F.col("size") + SETS_ROW).alias("n")).where(F.col("n") > SETS)
    return members.join(checkpointed(total), "component", "left").na.fill(1, ["n"])


def jaccard_groups(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the members of each group (node, component) as all its pairs of this similarity do."""
    members = groups.select(F.col("node").alias("id"), "component").join(sets, "id").withColumn("size", F.size("s"))
    return _similar_members(_sized(members), similarity)


def keep_first(docs: DataFrame, tau: int = STAGE_TAU, width: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """The rows of docs that stay when of each group of near copies only the smallest doc_id does.

    Texts are linked if their fingerprints are within tau bits or they share a band of least shingles, and their sets of
    shingles have at least this Jaccard similarity; equal texts always are, and so are texts without words. Pairs whose sets
    cannot be that similar, by their sizes and sketches, are left out first; then all pairs of the groups that the others form
    are checked for it. Rows without doc_id stay. Rows that repeat a doc_id with another text are texts of their own; of rows
    that repeat both, the one that comes first by the other columns stays (by their JSON, if one of them is of a kind without
    an order). Texts are not shuffled but those of the groups, as sets, and, if they are many, those that may go.
    """
    marked = with_fingerprint(docs, width, bands=True).where("id is not null")
    # one node for each text; numbered by its place in the checkpoint, which is the same whenever it is read again
    texts = checkpointed(marked.groupBy("fp", "same", "bands", "size", "sketch").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    nodes = texts.withColumn("rep", F.monotonically_increasing_id())
    links = checkpointed(cell_links(nodes.select("fp", "rep", "size"), tau, similarity).unionByName(band_links(nodes.select("fp", "rep", "bands"))).distinct())
    possible = possible_links(links.where("not dense").select("a", "b"), nodes.select("rep", "size", "sketch"), similarity)
    groups = connected_components(possible.unionByName(links.where("dense").select("a", "b")))
    names = nodes.select(F.col("rep").alias("id"), "first", "same", "size")
    members = checkpointed(_sized(groups.withColumnRenamed("node", "id").join(names, "id")).drop("size"))
    classes = connected_components(_similar_members(_shingled(docs, members, width), similarity))
    near = checkpointed(classes.withColumnRenamed("node", "id").join(members.select("id", "first", "same"), "id"))
    stays = near.groupBy("component").agg(F.min(F.struct("first", "same", "id")).alias("stays"))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), _same(docs).alias("same")).where("id is not null")
    copies = checkpointed(own.join(texts.where("rows > 1").select("same", "first"), "same").groupBy("id", "same", "first").agg(F.count("*").alias("rows")))
    gone = checkpointed(near.join(stays, "component").where("id <> stays.id").select("first", "same").unionByName(copies.where("id <> first").select(F.col("id").alias("first"), "same")))
    names = unused(docs, "first_id", "first_text", "own_text")
    left = gone.select(F.col("first").alias(names[0]), F.col("same").alias(names[1]))
    own = docs.withColumn(names[2], _same(docs)).where(F.col("doc_id").cast("long").isNotNull())
    without = lambda rows, left: rows.join(left, (F.col("doc_id").cast("long") == F.col(names[0])) & (F.col(names[2]) == F.col(names[1])), "left_anti")
    count = gone.count()
    if SENT < count <= HASHES_SENT:
        among = _may_be_among(gone)(F.col("doc_id").cast("long"), F.col(names[2]))
        found = own.where(~among).unionByName(without(own.where(among), left))
    else:
        found = without(own, F.broadcast(left) if count <= SENT else left)
    if not copies.where("rows > 1").isEmpty():
        others = [c for c in docs.columns if c != "doc_id"]
        own = F.struct(*[F.col(f"`{c}`") for c in others])
        unordered = any(kind in f.dataType.simpleString() for f in docs.schema.fields for kind in ("map<", "variant"))
        least = (F.min_by(own, F.to_json(own)) if unordered else F.min(own)).alias(names[0])
        found = found.groupBy("doc_id", names[2]).agg(least).select("doc_id", *[F.col(f"{names[0]}.`{c}`").alias(c) for c in others])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return found.select(*columns).unionByName(docs.where("doc_id is null"))


def query(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
