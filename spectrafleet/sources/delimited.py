"""Records of comma-separated files of any size and width, whose quoted cells may hold line ends.

Spark cuts files into blocks at line ends, some of which lie inside quotes. A first pass tells for each block, for
either state at its start, whether quotes are open at its end and whether a record ends in it; the blocks of a file in
order then settle the states. A second pass reads the records of each block, and joins the few that lie in several.
"""

from __future__ import annotations

import csv
import itertools
import re
import sys
from collections.abc import Callable, Container, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.calibration import work_folder

#: Blocks whose states are kept with each task; with more, they are joined to the lines.
BROADCAST_BLOCKS = 100_000
#: Lines that are looked at together.
LINES = 1000
#: A line that leaves closed quotes closed, as open_after() has it.
CLOSED_LINE = r'^(?:(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*)?(?:,|$))*$'


def open_after(line: str, inside: bool) -> bool:
    """Whether quotes are open at the end of a line. Only a quote at the start of a cell opens them."""
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            at += 0 if inside else 1
            inside = False
            while True:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] != '"':
                    break
                at += 2
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array, bool | None]]:
    """(file, block, lines, whether quotes are open at the block's start) in order, some lines of one block at a time; the last is None where it isn't known."""
    for batch in batches:
        for at in range(0, batch.num_rows, LINES):
            part = batch.slice(at, LINES)
            new = np.zeros(part.num_rows - 1, bool)
            for column in part.columns[:2]:
                new |= pc.not_equal(column.slice(1), column.slice(0, part.num_rows - 1)).to_numpy(zero_copy_only=False)
            for begin, end in itertools.pairwise([0, *(np.flatnonzero(new) + 1).tolist(), part.num_rows]):
                file, block, *known = (c[begin].as_py() for c in part.columns[:2] + part.columns[3:])
                yield file, block, part.column(2).slice(begin, end - begin), known[0] if known else None


def _unchanged(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line, whether it leaves closed quotes closed, and open ones open."""
    return pc.match_substring_regex(lines, CLOSED_LINE).to_numpy(zero_copy_only=False), ~pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)


def _how_many(these: np.ndarray) -> int:
    """Of the first ones in a row."""
    return len(these) if these.all() else int(np.argmin(these))


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, line) to (file, block, open0, open1, ends0, ends1): by the state at the start, that at the end, and whether a record ends in the block."""
    done: list[list] = []
    for file, block, lines, _ in _runs(batches):
        if not done or done[-1][:2] != [file, block]:
            done.append([file, block, False, True, False, False])
        now, same, at = done[-1], _unchanged(lines), 0
        while at < len(lines):
            many = _how_many(same[now[2]][at:] & same[now[3]][at:])
            line = None if many else lines[at].as_py()
            for k in (0, 1):
                now[2 + k] = now[2 + k] if many else open_after(line, now[2 + k])
                now[4 + k] |= not now[2 + k]
            at += many or 1
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), *[pa.bool_()] * 4))], ["file", "block", "open0", "open1", "ends0", "ends1"])


def _cells(text: str) -> list[str] | None:
    text = text.removesuffix("\r")
    csv.field_size_limit(sys.maxsize)
    return next(csv.reader([text]), None) if text.strip() else None


def _records(batches: Iterator[pa.RecordBatch], opened: Container[tuple[str, int]] | None = None, having: str | None = None) -> Iterator[pa.RecordBatch]:
    """(file, block, line, open) to (file, block, place, cells, part): whole records have cells, pieces of others their text as part.

    opened has the blocks that begin inside quotes, where there is no column open. Of whole records, those in whose text
    having occurs.
    """
    csv.field_size_limit(sys.maxsize)
    out: list[tuple] = []
    names, kinds = ["file", "block", "place", "cells", "part"], [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]

    def given() -> pa.RecordBatch:
        rows = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, names)

    now, lines, first, number, whole, inside = None, [], 0, 0, True, False

    def end(complete: bool) -> None:
        # a record that began in an earlier block, or goes on in a later one, is a piece
        if lines:
            text = "\n".join(lines)
            if not (whole and complete):
                out.append((now[0], now[1], first, None, text))
            elif (having is None or re.search(having, text)) and (cells := _cells(text)) is not None:
                out.append((now[0], now[1], first, cells, None))
            lines.clear()

    def each(texts: pa.Array, first: int) -> None:
        # lines that are records
        at = range(first, first + len(texts))
        if having is not None:
            found = pc.match_substring_regex(texts, having)
            texts, at = texts.filter(found), (first + np.flatnonzero(found.to_numpy(zero_copy_only=False))).tolist()
        some = [(k, t.removesuffix("\r")) for k, t in zip(at, texts.to_pylist(), strict=True) if t.strip()]
        out.extend((*now, k, cells, None) for (k, _), cells in zip(some, csv.reader([t for _, t in some]), strict=True))

    for file, block, texts, at_start in _runs(batches):
        if now != (file, block):
            if now is not None:
                end(not inside)
            now, number, inside = (file, block), 0, (file, block) in opened if opened is not None else bool(at_start)
            first, whole = block, not inside
        closed, at = _unchanged(texts)[0], 0
        while at < len(texts):
            if not inside and (many := _how_many(closed[at:])):
                each(texts.slice(at, many), block + number)
                number, at = number + many, at + many
                continue
            if not lines:
                first = block + number
            lines.append(texts[at].as_py())
            number, at = number + 1, at + 1
            inside = open_after(lines[-1], inside)
            if not inside:
                end(True)
                whole = True
        if len(out) >= LINES:
            yield given()
    if now is not None:
        end(not inside)
    yield given()


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, place, cells (strings) of all records of the files at paths; blank ones are left out.

    place grows along a file. Doubled quotes inside quoted cells are one quote. A large file is read by many tasks; what
    one task holds is a batch of lines and one record.
    """
    return record_reader(spark, paths)(None)


def record_reader(spark: SparkSession, paths: list[str], but: str | None = None) -> Callable[[str | None], DataFrame]:
    """read_records() as often as wanted after one first pass, of files whose path but doesn't occur in; given a pattern, of records in whose text it occurs."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = lines if but is None else lines.filter(~F.col("file").rlike(but))
    schema = "file string, block long, open0 boolean, open1 boolean, ends0 boolean, ends1 boolean"
    states = lines.mapInArrow(_states, schema).groupBy("file", "block").agg(*[F.first(c).alias(c) for c in ("open0", "open1", "ends0", "ends1")])
    in_order = Window.partitionBy("file").orderBy("block")
    # the state at a block's start: blocks of a file are some for each 128 MB
    so_far = F.collect_list(F.struct("open0", "open1")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    at_start = F.aggregate(so_far, F.lit(False), lambda now, b: F.when(now, b["open1"]).otherwise(b["open0"]))
    states = states.withColumn("open", at_start).withColumn("ends", F.when(F.col("open"), F.col("ends1")).otherwise(F.col("ends0")))
    # the block in which a record began that is still open at a block's start
    owner = F.last(F.when(~F.col("open") | F.col("ends"), F.col("block")), True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    at_end = F.when(F.col("open"), F.col("open1")).otherwise(F.col("open0"))
    states = states.select(F.col("file").alias("in_file"), F.col("block").alias("in_block"), "open", owner.alias("owner"), at_end.alias("open_after"))
    # blocks that begin or end inside quotes: those that have pieces of records
    path = work_folder(spark)
    states.filter("open or open_after").write.parquet(path)
    torn = spark.read.schema(states.schema).parquet(path)
    n_torn = torn.count()
    few = n_torn <= BROADCAST_BLOCKS
    opened = spark.sparkContext.broadcast({(r["in_file"], r["in_block"]) for r in torn.filter("open").collect()}) if few else None
    at_block = (F.col("file") == F.col("in_file")) & (F.col("block") == F.col("in_block"))

    def read(having: str | None) -> DataFrame:
        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _records(batches, opened.value if opened is not None else None, having)

        def made(source: DataFrame, how: str) -> DataFrame:
            # how: the lines of torn blocks alone (inner), or all (left)
            if few:
                source = source.join(F.broadcast(torn.select("in_file", "in_block")), at_block, "left_semi") if how == "inner" else source
            else:
                # lines of a block come together again, in order, by their place among those of the task that read them
                source = source.withColumn("n", F.monotonically_increasing_id()).join(torn.select("in_file", "in_block", "open"), at_block, how).select("file", "block", "line", F.coalesce("open", F.lit(False)).alias("open"), "n")
                source = source.repartition("file", "block").sortWithinPartitions("file", "block", "n").drop("n")
            return source.mapInArrow(records, "file string, block long, place long, cells array<string>, part string")

        whole = made(lines, "left").filter("part is null").select("file", "place", "cells")
        if not n_torn:
            return whole
        pieces = made(lines, "inner").filter("part is not null").join(torn.select("in_file", "in_block", "open", "owner"), at_block, "left")
        # the first piece of a block that begins inside quotes belongs to its owner; a last one, or one that begins outside, to its own block
        heads = F.col("owner").isNotNull() & F.col("open") & (F.col("place") == F.col("block"))
        joined = pieces.withColumn("begins", F.when(heads, F.col("owner")).otherwise(F.col("block")))
        joined = joined.groupBy("file", "begins").agg(F.array_sort(F.collect_list(F.struct("block", "place", "part"))).alias("parts"))
        text = F.array_join("parts.part", "\n")
        cells = F.pandas_udf(lambda t: t.map(_cells), "array<string>")(text)
        joined = joined.select("file", F.col("parts")[0]["place"].alias("place"), cells.alias("cells")).filter("cells is not null")
        return whole.unionByName(joined)

    return read
