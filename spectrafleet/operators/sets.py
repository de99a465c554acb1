"""Label lists, registries and exclusions as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def sensor_registry(rows: DataFrame) -> DataFrame:
    return rows.select("sensor_id").distinct()


def workflow_union(train: DataFrame, test: DataFrame) -> DataFrame:
    """label, pos: training then test labels (label, pos), the first occurrence of each."""
    both = train.select("label", F.lit(0).alias("part"), "pos").unionByName(test.select("label", F.lit(1).alias("part"), "pos"))
    first = both.groupBy("label").agg(F.min(F.struct("part", "pos")).alias("k"))
    # A window over a handful of labels.
    return first.select("label", F.row_number().over(Window.orderBy("k")).alias("pos"))


def parse_list(lines: DataFrame) -> DataFrame:
    """label, pos from lines (line, pos): what stands before '#', trimmed; blank lines go."""
    return lines.select(F.trim(F.split("line", "#")[0]).alias("label"), "pos").filter("label <> ''")


def split_violations(train: DataFrame, test: DataFrame) -> DataFrame:
    """label, problem: labels in both lists, and labels repeated within one."""
    both = train.select("label").intersect(test.select("label")).withColumn("problem", F.lit("overlap"))
    out = [both]
    for name, part in (("train", train), ("test", test)):
        out.append(part.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label", F.lit(f"repeated in {name}").alias("problem")))
    return out[0].unionByName(out[1]).unionByName(out[2])


def missing_campaigns(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.select("campaign").subtract(present.select("campaign"))


def unknown_sensors(rows: DataFrame, registry: DataFrame) -> DataFrame:
    return rows.select("sensor_id").distinct().join(registry, "sensor_id", "left_anti")


def exclude_sensors(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """rows without the excluded (campaign, sensor_id)."""
    return rows.join(exclusions.select("campaign", "sensor_id").distinct(), ["campaign", "sensor_id"], "left_anti")


def exclusion_problems(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """campaign, problem: exclusions that name no sensor of their campaign, and campaigns left with fewer than two sensors."""
    roster = rows.select("campaign", "sensor_id").distinct()
    unknown = exclusions.select("campaign", "sensor_id").distinct().join(roster, ["campaign", "sensor_id"], "left_anti").select("campaign", F.concat(F.lit("unknown sensor "), "sensor_id").alias("problem"))
    left = exclude_sensors(roster, exclusions).groupBy("campaign").agg(F.count(F.lit(1)).alias("n"))
    few = roster.select("campaign").distinct().join(left, "campaign", "left").filter("coalesce(n, 0) < 2").select("campaign", F.lit("fewer than two sensors").alias("problem"))
    return unknown.unionByName(few)


def resolve_global_exclusions(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((campaign, sensor_id) that a global list excludes, ids of the list that no campaign has); ids are trimmed and deduplicated."""
    wanted = ids.select(F.trim("sensor_id").alias("sensor_id")).filter("sensor_id <> ''").distinct()
    roster = rows.select("campaign", "sensor_id").distinct()
    return roster.join(wanted, "sensor_id").select("campaign", "sensor_id"), wanted.join(roster, "sensor_id", "left_anti")


def reference_weights(registry: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """sensor_id, weight: uniform, or the given positive weights divided by their sum; unknown ids or weights of 0 or less are errors."""
    total = Window.partitionBy(F.lit(1))  # the registry is a list of sensors, not of measurements
    if weights is None:
        return registry.select("sensor_id", (F.lit(1.0) / F.count(F.lit(1)).over(total)).alias("weight"))
    known = registry.withColumn("known", F.lit(True))
    checked = weights.join(known, "sensor_id", "left")
    ok = F.when(F.coalesce("known", F.lit(False)) & (F.col("weight") > 0), F.col("weight")).otherwise(F.raise_error(F.concat(F.lit("bad weight for "), "sensor_id")).cast("double"))
    return checked.select("sensor_id", (ok / F.sum(ok).over(total)).alias("weight"))


def resolve_sensors(registry: DataFrame, selection: DataFrame) -> DataFrame:
    """label, pos, mac, problem for a selection (label, pos) in caller order; problem names unknown, repeated or blank entries."""
    chosen = selection.select(F.trim("label").alias("label"), "pos").join(registry.select("label", "mac").distinct(), "label", "left")
    repeated = F.count(F.lit(1)).over(Window.partitionBy("label")) > 1
    problem = F.when(F.col("label") == "", "blank label").when(repeated, "repeated").when(F.col("mac").isNull(), "unknown").when(F.trim("mac") == "", "blank mac")
    return chosen.select("label", "pos", "mac", problem.alias("problem"))


def registry_problems(rows: DataFrame) -> DataFrame:
    """label, problem of a campaign registry (label, id as text): blank, not a positive number, or repeated."""
    clean = rows.select(F.trim("label").alias("label"), F.expr("try_cast(trim(id) as bigint)").alias("id"))
    same_label, same_id = (F.count(F.lit(1)).over(Window.partitionBy(c)) > 1 for c in ("label", "id"))
    problem = F.when(F.col("label") == "", "blank label").when(F.coalesce(F.col("id") <= 0, F.lit(True)), "bad id").when(same_label, "repeated label").when(same_id, "repeated id")
    return clean.select("label", problem.alias("problem")).filter("problem is not null")


#: Fixed value: a header as a registry file in use misspells it, and what it means.
MISSPELLED_HEADER = ("capaign_label", "campaign_label")


def load_registry(raw: DataFrame, strict: bool = True) -> DataFrame:
    """campaign_label, campaign_id (long) from a registry file's text columns, whatever stands around its headers.

    The misspelled header is renamed before headers are trimmed. A missing column is an error; so are no rows and, if
    strict, registry_problems(). If not, rows with an id that is no number have none.
    """
    wrong, right = MISSPELLED_HEADER
    raw = raw.toDF(*[(right if c == wrong else c).strip() for c in raw.columns])
    if missing := [c for c in (right, "campaign_id") if c not in raw.columns]:
        raise ValueError(f"the registry has no column {', '.join(missing)}")
    rows = raw.select(F.trim(right).alias("label"), F.col("campaign_id").cast("string").alias("id"))
    if strict:
        if rows.isEmpty():
            raise ValueError("the registry names no campaign")
        require_none(registry_problems(rows), "registry")
    return rows.select(F.col("label").alias(right), F.expr("try_cast(trim(id) as bigint)").alias("campaign_id"))


def row_position(by: list[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def stack_row_aligned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with record_idx by position in each sensor, campaigns whose sensors differ in row count or grid)."""
    placed = rows.withColumn("record_idx", row_position(["campaign", "sensor_id"], "ts_ms", "src_row"))
    counts = rows.groupBy("campaign", "sensor_id").agg(F.count(F.lit(1)).alias("n"))
    grids = rows.groupBy("campaign").agg(F.count_distinct(F.struct("start_freq_hz", "end_freq_hz", "n_bins")).alias("grids"))
    bad = counts.groupBy("campaign").agg(F.count_distinct("n").alias("counts")).join(grids, "campaign").filter("counts > 1 or grids > 1")
    return placed, bad


def require_none(problems: DataFrame, what: str, shown: int = 20) -> None:
    """Fail if a table of problems has rows, naming some of them: the strict form of every check here."""
    some = problems.limit(shown).collect()
    if some:
        raise ValueError(f"{what}: " + "; ".join(", ".join(str(v) for v in r) for r in some))
