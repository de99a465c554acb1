"""Helpers the operators share: the shared work folder, materialised tables, components, ordered ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def work_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spectrafleet-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables that materialize() wrote in the innermost own_tables() of this thread.
_OWN: ContextVar[list[str] | None] = ContextVar("own_tables", default=None)


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that materialize() writes inside, at the end; what other threads and outer blocks write stays."""
    made: list[str] = []
    before = _OWN.set(made)
    try:
        yield
    finally:
        _OWN.reset(before)
        for path in made:
            delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and read them back."""
    path = new_path(df.sparkSession, name)
    if (made := _OWN.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and no later step reads."""
    if path := getattr(df, "_written_to", None):
        if path in (made := _OWN.get() or []):
            made.remove(path)
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from clashing with a column of df (case ignored)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the filter that spares rows without a verdict a shuffle: 8 MB, whatever the number of rows.
ROW_FILTER_BITS = 1 << 26


def bit_filter(keys: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bitmap (bits // 8 bytes) with the bit of each key (one long column) modulo bits set; what reaches the driver is at most bits // 64 rows."""
    bits = bits or ROW_FILTER_BITS
    key = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    words = keys.select(key.alias("k")).groupBy(F.expr("cast(k div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("v")).toArrow()
    mask = np.zeros(bits // 64, np.int64)
    mask[words["w"].to_numpy()] = words["v"].to_numpy()
    return mask.view(np.uint8)


def in_mask(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which long keys have their bit set in a bitmap of bit_filter(): all that it was made from, and some others."""
    at = keys % (len(mask) * 8)
    return (mask[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def may_be_in(spark: SparkSession, mask: np.ndarray, key: Column) -> Column:
    """in_mask() of a long column."""
    shared = spark.sparkContext.broadcast(mask)
    return F.pandas_udf(lambda k: pd.Series(in_mask(shared.value, k.to_numpy(np.int64))), "boolean")(key)


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def settle_rows(docs: DataFrame, verdicts: DataFrame, bits: int | None = None) -> DataFrame:
    """docs (doc_id, text, others) after verdicts (doc_id long, digest, keep) on rows, named by doc_id and text_digest(text).

    Rows whose key has keep = false go, of rows whose key has keep = true one stays, all others stay. Null ids are
    keys like others. Verdicts hold each key once. Only rows that may have a verdict, by a bit filter of fixed size,
    are shuffled; when the filter fills up, more rows are, and the result stays the same.
    """
    spark = docs.sparkSession
    doc_id, digest, keep, may, key = spare(docs, "_its_id", "_its_digest", "_its_keep", "_its_may", "_its_key")
    mask = bit_filter(verdicts.select(F.xxhash64("doc_id", "digest")), bits)
    rows = docs.withColumns({doc_id: F.col("doc_id").cast("long"), digest: text_digest(F.col("text"))})
    rows = rows.withColumn(may, may_be_in(spark, mask, F.xxhash64(doc_id, digest)))
    named = verdicts.select(F.col("doc_id").alias(f"{doc_id}v"), F.col("digest").alias(f"{digest}v"), F.col("keep").alias(keep))
    judged = rows.filter(may).join(named, F.col(doc_id).eqNullSafe(F.col(f"{doc_id}v")) & (F.col(digest) == F.col(f"{digest}v")), "left")
    once = judged.filter(keep).withColumn(key, F.col(digest)).dropDuplicates([doc_id, key])
    return rows.filter(~F.col(may)).select(*docs.columns).unionByName(judged.filter(F.col(keep).isNull()).select(*docs.columns)).unionByName(once.select(*docs.columns))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star passes: each is one aggregation (pre-aggregated map-side, so a
    hub's neighbours are never gathered) and one equi-join, which adaptive execution splits where a hub is hot.
    Every pass is written to the shared folder, so a lost executor costs one pass at most.
    Nulls in an edge and self-links are ignored; repeated edges count once; no edges give no rows.
    """

    def star(now: DataFrame, large: bool) -> DataFrame:
        # now holds (hi, lo) with hi > lo
        if large:
            both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            linked = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        else:
            least = now.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
            linked = now.withColumnRenamed("hi", "u").join(least, "u").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            linked = linked.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        return linked.filter("hi > lo").distinct()

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    digest = None
    while True:
        after = materialize(star(star(now, True), False), name)
        seen = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = after
        if seen == digest:
            break
        digest = seen
    roots = now.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small, so that a batch of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
