"""Exact quantiles of groups of any size, and broadcasts of a counted size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import work_folder

#: Values of a group that one task sorts at the end, at most.
BUCKETS = 4096
#: Splitters are within this part of a rank of a group's values.
ACCURACY = 10_000
#: Splitters of a group.
GRID = 1000
#: Rows of a table that is broadcast at most; its rows are some hundred bytes.
SMALL_ROWS = 100_000


def counted(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, written once, to be broadcast in a join if it has few rows; else an ordinary table, joined by shuffle."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(back) if back.count() <= rows else back


def exact_quantile(values: DataFrame, by: list[str], q: float, name: str) -> DataFrame:
    """by and the q-quantile, linear between neighbours, of the column value in each group; nulls don't count.

    Selection by sampled splitters: a sketch of each group gives two of its values that should enclose the wanted rank,
    and counts below, at and above them tell where it is. The values between them, which are a few thousandths of the
    group however it is distributed, are searched in the same way, until BUCKETS are left. No more than these, and a
    sketch, are ever held together; values that occur many times are only counted.
    """
    values = values.select(*by, F.col("value").cast("double").alias("value")).filter("value is not null")
    place = F.lit(q) * (F.col("n") - 1)
    groups = counted(values.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    first = F.floor(place)
    start = groups.select(
        *by, first.alias("rank"), (place - first).alias("share"), F.least(first + 1, F.col("n") - 1).alias("next"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit(0).cast("long").alias("below"), F.col("n").alias("left"), F.lit(None).cast("double").alias("found"),
    )
    state = counted(start)
    kept = [*by, "rank", "share", "next"]
    while state.filter(F.col("found").isNull() & (F.col("left") > BUCKETS)).limit(1).count():
        state = counted(_narrowed(values, state, by))
    # what is left of each group fits a task; so do the values at and next to the wanted rank
    inside = _inside(values, state.filter("found is null"), by)
    last = inside.groupBy(*by, "rank", "share", "next", "below").agg(F.sort_array(F.collect_list("value")).alias("all"))
    at = F.get("all", (F.col("rank") - F.col("below")).cast("int"))
    found = state.filter("found is not null").select(*kept, F.col("found").alias("a")).unionByName(last.select(*kept, at.alias("a")))
    found = counted(found)
    # the value of the next rank: the same if there are enough of it, else the least above it
    near = values.join(found, by).filter("value >= a or rank = next")
    upto = F.col("n") - F.count_if(F.col("value") > F.col("a"))
    near = near.join(groups, by).groupBy(*by, "a", "share", "next", "n").agg(upto.alias("upto"), F.min(F.when(F.col("value") > F.col("a"), F.col("value"))).alias("above"))
    second = F.when(F.col("upto") > F.col("next"), F.col("a")).otherwise(F.col("above"))
    return near.select(*by, (F.col("a") + (second - F.col("a")) * F.col("share")).alias(name))


def _inside(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """The values of groups strictly between their bounds."""
    above = F.col("lo").isNull() | (F.col("value") > F.col("lo"))
    return values.join(state, by).filter(above & (F.col("hi").isNull() | (F.col("value") < F.col("hi"))))


def _narrowed(values: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """state after one round of splitters: the wanted rank found, or its bounds closer together."""
    wide = F.col("found").isNull() & (F.col("left") > BUCKETS)
    inside = _inside(values, state.filter(wide), by)
    # a sketch has all of its answers for one list of probabilities, so the splitters are picked from an even grid
    target = F.col("rank") - F.col("below")
    keys = [*by, "rank", "share", "next", "lo", "hi", "below", "left"]
    wanted = (target + 0.5) / F.col("left")
    grid = [i / GRID for i in range(GRID + 1)]
    marks = inside.groupBy(*keys).agg(F.percentile_approx("value", grid, ACCURACY).alias("marks"))
    low = F.greatest(F.lit(0), F.floor(wanted * GRID - 0.01)).cast("int")
    high = F.least(F.lit(GRID), F.ceil(wanted * GRID + 0.01)).cast("int")
    marks = counted(marks.select(*keys, F.get("marks", low).alias("s1"), F.get("marks", high).alias("s2")))
    v = F.col("value")
    counts = [F.count_if(v < F.col("s1")).alias("c1"), F.count_if(v == F.col("s1")).alias("e1"), F.count_if(v < F.col("s2")).alias("c2"), F.count_if(v == F.col("s2")).alias("e2")]
    told = _inside(values, marks, by).groupBy(*keys, "s1", "s2").agg(*counts)
    c1, e1, c2, e2 = (F.col(c) for c in ("c1", "e1", "c2", "e2"))
    where = F.when(target < c1, 0).when(target < c1 + e1, 1).when(target < c2, 2).when(target < c2 + e2, 3).otherwise(4)
    told = told.withColumn("where", where)
    pick = lambda *cases: F.when(F.col("where") == 0, cases[0]).when(F.col("where") == 2, cases[1]).when(F.col("where") == 4, cases[2])
    lo, hi, below, left = (F.col(c) for c in ("lo", "hi", "below", "left"))
    new = told.select(
        *by, "rank", "share", "next", pick(lo, F.col("s1"), F.col("s2")).alias("lo"), pick(F.col("s1"), F.col("s2"), hi).alias("hi"), F.coalesce(pick(below, below + c1 + e1, below + c2 + e2), below).alias("below"),
        F.coalesce(pick(c1, c2 - c1 - e1, left - c2 - e2), F.lit(0)).cast("long").alias("left"), F.when(F.col("where") == 1, F.col("s1")).when(F.col("where") == 3, F.col("s2")).alias("found"),
    )
    return state.filter(~wide).unionByName(new)
