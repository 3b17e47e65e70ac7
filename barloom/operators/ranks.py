"""Exact ranks, and values at given ranks, within keys of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.shared import checkpointed

#: Pieces that a key's rows are cut into.
PIECES = 128


def with_rank(rows: DataFrame, key: str, order: str, rank: str = "_i", count: str = "_n", pieces: int = PIECES, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their 0-based rank by ``order`` (and, where that is equal, by the columns ``ties``) among those of the
    same key, and how many these are.

    No task sorts a key's rows as a whole: an approximate quantile sketch cuts them into pieces, which are sorted apart;
    the pieces' sizes give what to add. Where the cuts fall changes no rank. Equal values share a piece; without
    ``ties`` they are ranked in any order, which another run may not repeat. Null values come first.
    """
    cuts = rows.groupBy(key).agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("_cuts"))
    piece = F.coalesce(F.size(F.filter(F.array_distinct(F.coalesce("_cuts", F.array())), lambda c: c < F.col(order))), F.lit(0))
    dealt = rows.join(cuts, key, "left").withColumn("_piece", piece).drop("_cuts")
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "_piece").agg(F.count("*").alias("_own"))
    sums = sizes.select(key, "_piece", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy(key)).alias(count))
    within = F.row_number().over(Window.partitionBy(key, "_piece").orderBy(order, *ties)) - 1
    return dealt.withColumn("_within", within).join(sums, [key, "_piece"]).withColumn(rank, F.col("_before") + F.col("_within")).drop("_piece", "_within", "_before")


#: Values of a key that one task may sort, and keys whose brackets are sent to every task.
FEW, SENT = 10_000, 200_000
#: Parts into which a bracket is cut in each round.
GRID = 64


def values_at(rows: DataFrame, key: str, value: str, ranks: Callable[[Column], list[Column]], few: int = FEW) -> DataFrame:
    """(key, n, values): the values at the 0-based ranks ``ranks(n)`` among a key's n values, in that order; nulls don't
    count. Exact, and no row moves: tasks hand on counts.

    Each rank has a bracket of values around it. A round counts how many values lie below, at and between the bracket's
    ends, and a quantile sketch of those between gives narrower ends, one part in twenty. When few values are left between
    the ends they are gathered; a value at an end is only counted, however often it occurs. An action for each round, of
    which a key of 10**10 values takes five. Ranks from 0 to n - 1 only.
    """
    own = rows.select(key, F.col(value).alias("_v")).where("_v is not null")
    first = own.groupBy(key).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = ranks(F.col("n"))
    places = range(len(wanted))
    bracket = lambda rank, lo, hi, between, found: F.struct(rank.cast("long").alias("rank"), lo.alias("lo"), hi.alias("hi"), between.cast("long").alias("between"), found.alias("found"))
    kind = rows.schema[value].dataType
    state = checkpointed(first.select(key, "n", F.array(*[bracket(w, F.col("lo"), F.col("hi"), F.col("n"), F.lit(None).cast(kind)) for w in wanted]).alias("q")))
    is_open = F.exists("q", lambda x: x["found"].isNull() & (x["between"] > few))

    def counted(brackets: DataFrame, last: bool) -> DataFrame:
        few_keys = brackets.count() <= SENT
        joined = own.join(F.broadcast(brackets) if few_keys else brackets, key)
        each, v = [], F.col("_v")
        for j in places:
            x = F.col("q")[j]
            between = F.when((v > x["lo"]) & (v < x["hi"]) & x["found"].isNull(), v)
            inner = F.sort_array(F.collect_list(between)) if last else F.percentile_approx(between, [i / GRID for i in range(GRID + 1)], 20 * GRID)
            each += [F.count_if(v < x["lo"]).alias(f"below{j}"), F.count_if(v == x["lo"]).alias(f"at{j}"), F.count(between).alias(f"in{j}"), inner.alias(f"cut{j}")]
        made = joined.groupBy(key, "n", "q").agg(*each)

        def narrowed(j: int) -> Column:
            x, cuts, inside = F.col("q")[j], F.col(f"cut{j}"), F.col(f"in{j}")
            after = x["rank"] - F.col(f"below{j}") - F.col(f"at{j}")  # among those between the ends
            found = F.coalesce(x["found"], F.when(after < 0, x["lo"]).when(after >= inside, x["hi"]))
            if last:
                return bracket(x["rank"], x["lo"], x["hi"], inside, F.coalesce(found, F.get(cuts, after.cast("int"))))
            part = F.floor(after * GRID / inside).cast("int")
            lo, hi = F.coalesce(F.get(cuts, part - 1), x["lo"]), F.coalesce(F.get(cuts, part + 2), x["hi"])
            return bracket(x["rank"], F.when(found.isNull(), lo).otherwise(x["lo"]), F.when(found.isNull(), hi).otherwise(x["hi"]), F.when(found.isNull(), F.ceil(inside * 4 / GRID)).otherwise(0), found)

        return checkpointed(made.select(key, "n", F.array(*map(narrowed, places)).alias("q")))

    done = state.where(~is_open)
    while not (rest := state.where(is_open)).isEmpty():
        state = counted(rest, last=False)
        done = done.unionByName(state.where(~is_open))
    return counted(done, last=True).select(key, "n", F.transform("q", lambda x: x["found"]).alias("values"))
