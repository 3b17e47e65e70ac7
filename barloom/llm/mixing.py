"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target number of rows over its own number. Each document is repeated by a Poisson
number of that mean, found by inverting the distribution at a uniform number made from a hash of seed and doc_id: the
same document always gets the same number, wherever it is processed. The copies are then shuffled globally, by a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, unused

#: Without given weights, a source's share goes with its number of rows to this power.
TEMPERATURE = 0.5
SEED = "mix-1"
#: Rates above this are drawn as a sum of several numbers, so that the distribution never underflows.
PIECE = 32.0
#: Sources whose rates are sent to every task; with more, documents and rates are joined by a shuffle.
BROADCAST = 10_000


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of an md5 over the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _cumulative(rate: Column) -> Column:
    """The distribution function of a Poisson number at 0, 1, 2, ..., until nothing is left in double precision."""
    first = F.exp(-rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    state = F.struct(first.alias("p"), F.array(first).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), last),
        state,
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.array_append(s["sums"], F.element_at(s["sums"], -1) + s["p"] * rate / k).alias("sums")),
    )["sums"]


def rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, draws, cumulative): how often to draw for a document, and the distribution of one draw.

    weights: (source, weight); a source without a weight, or with none above 0, gets no rows. total: expected rows of
    the mixture, by default as many as docs has. A null source is a source.
    """
    sizes = checkpointed(docs.groupBy(F.col("source").alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        shares = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        shares = sizes.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    rows, mass = shares.agg(F.sum("n"), F.sum("weight")).first()
    goal = float(rows or 0) if total is None else float(total)
    rate = F.lit(goal) * F.col("weight") / F.lit(mass or 1.0) / F.col("n")
    drawn = shares.select("source", rate.alias("rate")).where("rate > 0").withColumn("draws", F.ceil(F.col("rate") / PIECE).cast("int"))
    return drawn.select("source", "draws", _cumulative(F.col("rate") / F.col("draws")).alias("cumulative"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """All columns of docs and, last, the number of the copy (1, 2, ...), in globally shuffled order.

    That column is called copy, with underscores behind it if docs has one of that name. Rows that share a doc_id are
    repeated alike; rows without one are numbered by their text. Sources of any size cost the same for each row: a source
    decides a row's rate, never its place.
    """
    copy, own, draws, cumulative, times, order = unused(docs, "copy", "own_source", "draws", "cumulative", "times", "place")
    table = checkpointed(rates(docs, weights, total, temperature)).select(F.col("source").alias(own), F.col("draws").alias(draws), F.col("cumulative").alias(cumulative))
    if table.count() <= BROADCAST:
        table = F.broadcast(table)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    draw = lambda i: F.size(F.filter(F.col(cumulative), lambda c: c <= uniform(F.lit(seed), name, i.cast("string"))))
    number = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda n, i: n + draw(i))
    copies = docs.join(table, F.col("source").eqNullSafe(F.col(own))).withColumn(times, number).where(F.col(times) > 0)
    dealt = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    placed = dealt.withColumn(order, F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), name, F.col(copy))))
    return placed.repartition(order).sortWithinPartitions(order).select(*[F.col(f"`{c}`") for c in docs.columns], copy)


ORACLE = f"""
with sized as (select source, count(*) n from documents group by source),
rate as (
  select source, (select sum(n) from sized) * pow(n::double, {TEMPERATURE}) / (select sum(pow(n::double, {TEMPERATURE})) from sized) / n rate from sized
), drawn as (select source, ceil(rate / {PIECE})::int draws, rate / ceil(rate / {PIECE}) r from rate),
point as (
  select source, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) over (partition by source order by k rows unbounded preceding) c
  from (select source, r, unnest(range(0, 400)) k from drawn)
), draw as (
  select d.doc_id, d.source, (('0x' || substr(md5('{SEED}|' || d.doc_id || '|' || i), 1, 13))::bigint + 0.5) / pow(2, 52) u
  from (select d.doc_id, d.source, unnest(range(1, draws + 1)) i from documents d join drawn using (source)) d
), number as (
  select w.doc_id, sum(least(w.k, 400)) times from (
    select draw.doc_id, (select count(*) from point p where p.source = draw.source and p.c <= draw.u) k from draw
  ) w group by w.doc_id
)
select d.doc_id, d.source, d.lang, d.text, d.n_chars, c.copy from documents d
join (select doc_id, unnest(range(1, times::bigint + 1))::int copy from number where times > 0) c using (doc_id)
"""


def query(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "source", "lang", "text", "n_chars", "copy")
