"""Vectors as short codes: each of several parts by the number of its nearest codebook entry, found by Orchard's search.

Every entry has a list of all entries by their distance from it. A search that stands at an entry walks that entry's list;
whatever it finds nearer to the part becomes the place to stand, with a list of its own, and entries looked at once are
marked and never measured again. An entry farther from where the search stands than twice the part's distance from there
can't be nearer to the part (triangle inequality), nor can any behind it in the list, so there the search ends.

Components are whole numbers, so distances, ties and means are exact in every partitioning. Codebooks are fitted in a few
rounds over all vectors: tasks hand on sums of parts by entry, a table of fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Labels whose sums are sent to every task; with more, they are joined by a shuffle.
BROADCAST = 100_000
#: Vectors that are searched for side by side.
TOGETHER = 8192


def bound(dim: int) -> int:
    """Whole components are kept within plus and minus this, so that a vector's error fits a long."""
    return int(np.sqrt(2.0**61 / max(1, dim)) / 2)


class Codebook:
    """Entries (k, d) of one part, with each one's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k = len(entries)
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        order = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), apart), axis=1)
        self.near = np.array([[j for j in row if j != i] for i, row in enumerate(order)], dtype=np.int64).reshape(k, k - 1)
        self.apart = np.take_along_axis(apart, self.near, axis=1)
        #: where a search starts: by the first component, between whose middles a part's own lies
        self.by_first = np.argsort(entries[:, 0], kind="stable")
        first = entries[self.by_first, 0]
        self.middles = (first[1:] + first[:-1]) // 2

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x the nearest entry, the lower one of a tie, its squared distance; how many distances were made."""
        n, k = len(x), len(self.entries)
        best = self.by_first[np.searchsorted(self.middles, x[:, 0])]
        d = ((x - self.entries[best]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), dtype=bool)
        seen[np.arange(n), best] = True
        place = np.zeros(n, dtype=np.int64)
        going, made = np.arange(n) if k > 1 else np.zeros(0, dtype=np.int64), n
        while len(going):
            b, p = best[going], place[going]
            # beyond twice the distance, in squares; at just twice it an entry may still tie
            open_ = self.apart[b, p] <= 4 * d[going]
            going, b, p = going[open_], b[open_], p[open_]
            e = self.near[b, p]
            fresh = ~seen[going, e]
            place[going] += 1
            at, e = going[fresh], e[fresh]
            seen[at, e] = True
            made += len(at)
            new = ((x[at] - self.entries[e]) ** 2).sum(axis=1)
            nearer = (new < d[at]) | ((new == d[at]) & (e < best[at]))
            at = at[nearer]
            best[at], d[at], place[at] = e[nearer], new[nearer], 0
            going = going[place[going] < k - 1]
        return best, d, made


def _whole_numbers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    most = bound(dim)
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, TOGETHER):
            yield b.slice(lo, TOGETHER)


def _sums(books: list[np.ndarray], dim: int, scale: int):
    """Of a task's parts by nearest entry: how many, and their sum in each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(e) for e in books]
        k, size = len(books[0]), dim // len(books)
        count, total = np.zeros((len(books), k), dtype=np.int64), np.zeros((len(books), k, size), dtype=np.int64)
        for b in _portions(batches):
            x = _whole_numbers(b.column(0), dim, scale)
            for p, book in enumerate(codebooks):
                own = x[:, p * size : (p + 1) * size]
                code = book.search(own)[0]
                count[p] += np.bincount(code, minlength=k)
                np.add.at(total[p], code, own)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    return run


def _codes(books: list[np.ndarray], dim: int, scale: int):
    """Codes and errors; the other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(e) for e in books]
        size = dim // len(books)
        for b in _portions(batches):
            x = _whole_numbers(b.column(b.num_columns - 1), dim, scale)
            code, error = np.zeros((len(x), len(books)), dtype=np.uint8), np.zeros(len(x), dtype=np.int64)
            for p, book in enumerate(codebooks):
                code[:, p], d, _ = book.search(x[:, p * size : (p + 1) * size])
                error += d
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([c.tobytes().hex() for c in code]), pa.array(error)], names=[*b.schema.names[:-1], "code", "error"])

    return run


def kept(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is there and holds finite numbers only."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vectors.where(F.coalesce(F.forall(x, finite), F.lit(False)))


def fitted(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """A codebook (entries, components) for each part, fitted to all of vectors (vec_id, embedding), which are valid and
    of one length. An action for the first entries and one a round; what comes back is as large as the codebooks."""
    first = vectors.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    dim = len(first[0].embedding)
    start = _whole_numbers(pa.array([r.embedding for r in first]), dim, scale)
    books = [start[:, i * (dim // parts) : (i + 1) * (dim // parts)].copy() for i in range(parts)]
    for _ in range(rounds):
        own = vectors.select(F.col("embedding").cast("array<double>")).mapInArrow(_sums(books, dim, scale), "part long, entry long, n long, total array<long>")
        size = dim // parts
        found = own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)])
        for r in found.collect():
            # down, also below zero
            books[r.part][r.entry] = [r[f"t{i}"] // r.n for i in range(size)]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def encoded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors (vec_id, label, embedding).

    A component x counts as floor(scale * x). code: for each part the 0-based number of its nearest entry, as two hex
    digits; of equal distances the lower number. error: squared distances summed over the parts; label_error: the errors
    of all rows of the label, null being a label.

    Rows whose embedding is null or holds null or non-finite components are left out. The embedding's length is that of
    the smallest vec_id (a positive multiple of ``parts``, else no row counts); rows of other lengths are left out too.
    Rows that repeat a vec_id are vectors of their own, taken in the order of their embeddings where that matters; a null
    vec_id comes last. Components beyond ``bound`` count as the bound. With fewer vectors than ``entries`` the codebooks
    have as many entries as there are vectors. Other columns are left aside. An empty table gives an empty result. Runs
    actions: the first rows, one a round, the codes' checkpoint.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    rows = kept(vectors.select("vec_id", "label", "embedding"))
    rows = rows.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    schema = "vec_id long, label long, code string, error long"
    smallest = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).first()
    if smallest is None:
        return vectors.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string").drop("label")
    rows = rows.where(F.size("embedding") == smallest.n)
    books = fitted(rows, parts, entries, rounds, scale)
    numbers = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>"))
    codes = checkpointed(numbers.mapInArrow(_codes(books, smallest.n, scale), schema))
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    if sums.count() <= BROADCAST:
        sums = F.broadcast(sums)
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(vectors: DataFrame) -> DataFrame:
    return encoded(vectors)


def _oracle() -> str:
    """Both rounds and the last assignment as steps of one another, each comparing every part with every entry."""
    k, parts = ENTRIES, PARTS
    steps = [
        f"""k as (select row_number() over (order by vec_id nulls last, embedding) r, vec_id, label, [floor({SCALE} * x::double)::bigint for x in embedding] v
      from embeddings where embedding is not null and list_bool_and([coalesce(isfinite(x), false) for x in embedding])),
    p as (select r, vec_id, label, i part, v[i * len(v) // {parts} + 1 : (i + 1) * len(v) // {parts}] x from k, range({parts}) t(i)),
    c0 as (select part, r - 1 entry, x c from p where r <= {k})"""
    ]
    near = lambda n: f"""a{n} as (select r, part, min({{'d': list_sum([(x[j] - c[j]) * (x[j] - c[j]) for j in range(1, len(x) + 1)])::bigint, 'e': entry}}) m
      from p join c{n} using (part) group by r, part)"""  # noqa: E731
    for n in range(ROUNDS):
        steps.append(near(n))
        steps.append(
            f"""s{n} as (select part, entry, j, sum(x)::bigint s, count(*) n from (select part, a{n}.m.e entry, unnest(range(1, len(x) + 1)) j, unnest(x) x from a{n} join p using (r, part)) group by 1, 2, 3),
    n{n} as (select part, entry, list((s - ((s % n) + n) % n) // n order by j) c from s{n} group by 1, 2),
    c{n + 1} as (select part, entry, coalesce(n{n}.c, c{n}.c) c from c{n} left join n{n} using (part, entry))"""
        )
    steps.append(near(ROUNDS))
    steps.append(
        f"""o as (select r, string_agg(lpad(to_hex(m.e), 2, '0'), '' order by part) code, sum(m.d)::bigint error from a{ROUNDS} group by r),
    h as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) codebooks_sha256 from c{ROUNDS})"""
    )
    return f"""with {", ".join(steps)}
    select vec_id, lower(code) code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256 from k join o using (r), h"""


ORACLE = _oracle()
