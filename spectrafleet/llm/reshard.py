"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes.

Nodes are old and new shards; keeping a byte costs nothing, moving it costs one. The flow says how many bytes go from
each old shard to each new one. An old shard's files stand in the order of their names, and the flow's bytes are
consecutive blocks of that order, what stays first. A file that lies in one block moves or stays whole; only a file
that a block's end falls into is cut, at the nearer document. Files that stay whole are not rewritten: the new shards
are those files and the new ones together.

What reaches the driver is one number for each shard; files and their places stay in tables.
"""

from __future__ import annotations

from collections import deque
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ._shared import materialize, spare

BYTES_PER_FILE = 128 << 20
#: Files that a task writes at most, on average.
TASK_FILES = 4
#: Up to so many files, some 20 MB, their table is broadcast; beyond that it is joined by shuffle.
BROADCAST_FILES = 100_000
#: Columns that are added to documents; columns of those names come back with this before their names.
ADDED, THEIRS = ("shard", "file", "size", "text_crc32", "slot"), "doc_"


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """{(old, new): bytes}, moving the fewest bytes; shard i keeps its number. The capacities must hold the supply.

    Bytes that stay go along an arc of their own; all others pass one hub, since where they go costs the same. So there
    are some four arcs for each shard. Each round sends a blocking flow along the shortest ways, of which there are as
    many lengths as costs; what passes the hub is dealt out to the new shards in order.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones' bytes")
    n, m = len(supply), len(capacity)
    hub, source, sink = n + m, n + m + 1, n + m + 2
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(n + m + 3)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)
        return len(to) - 2

    stays, leaves, comes = {}, {}, {}
    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        leaves[i] = arc(i, hub, s, 1)
        if i < m:
            stays[i] = arc(i, n + i, s, 0)
    for j, c in enumerate(capacity):
        comes[j] = arc(hub, n + j, c, 0)
        arc(n + j, sink, c, 0)
    while True:
        far, queue, queued = {source: 0}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in arcs[a]:
                if room[e] and far[a] + cost[e] < far.get(to[e], 1 << 60):
                    far[to[e]] = far[a] + cost[e]
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if sink not in far:
            break
        tried, path, on_path = [0] * len(arcs), [], {source}
        while True:
            a = to[path[-1]] if path else source
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, on_path = [], {source}
                continue
            while tried[a] < len(arcs[a]):
                e = arcs[a][tried[a]]
                if room[e] and to[e] not in on_path and far.get(to[e]) == far[a] + cost[e]:
                    break
                tried[a] += 1
            if tried[a] < len(arcs[a]):
                path.append(e)
                on_path.add(to[e])
            elif path:
                on_path.discard(a)
                tried[to[path.pop() ^ 1]] += 1
            else:
                break
    out = {(i, i): room[e ^ 1] for i, e in stays.items() if room[e ^ 1]}
    wanting = deque([j, room[e ^ 1]] for j, e in comes.items() if room[e ^ 1])
    for i, e in leaves.items():
        left = room[e ^ 1]
        while left:
            j, open_bytes = wanting[0]
            moved = min(left, open_bytes)
            out[i, j] = out.get((i, j), 0) + moved
            left -= moved
            wanting[0][1] -= moved
            if not wanting[0][1]:
                wanting.popleft()
    return out


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def blocks(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, lo, hi, new): bytes lo to hi of an old shard, in the order of its files, go to a new one."""
    out = []
    for old in sorted({i for i, _ in flow}):
        targets = sorted((j for i, j in flow if i == old), key=lambda j: (j != old, j))
        ends = list(accumulate(flow[old, j] for j in targets))
        out += [(old, lo, hi, j) for lo, hi, j in zip([0, *ends], ends, targets)]
    return out


def lay_out(docs: DataFrame, shard: Column, uri: str) -> T.StructType:
    """Write docs as uri/shard=N/*.parquet without a shuffle, each task the shards it meets; the written columns but shard.

    A null shard is shard 0. Columns named like ADDED ones are written with THEIRS before their names.
    """
    (number,) = spare(docs, "_shard")
    rows = docs.withColumn(number, F.coalesce(shard.cast("int"), F.lit(0)))
    for c in docs.columns:
        if c.lower() in ADDED:
            rows = rows.withColumnRenamed(c, *spare(rows, THEIRS + c))
    rows = rows.withColumnRenamed(number, "shard")
    rows.write.partitionBy("shard").parquet(uri)
    return T.StructType([f for f in rows.schema.fields if f.name != "shard"])


def read_shards(spark: SparkSession, columns: T.StructType, uri: str) -> DataFrame:
    """The documents of uri/shard=N with shard, file (its name), size and text_crc32."""
    rows = spark.read.schema(T.StructType([*columns.fields, T.StructField("shard", T.IntegerType())])).parquet(uri)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return rows.select("*", F.col("_metadata.file_name").alias("file"), size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))


def rewrite_shards(spark: SparkSession, columns: T.StructType, old_uri: str, new_uri: str, n_new: int, capacities: list[int] | None = None, file_bytes: int = BYTES_PER_FILE) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Give the shards at old_uri n_new shards' capacities (bytes; near equal ones by default); the rows and the flow.

    Writes only documents of files that change their shard or are cut, under new_uri; the rows returned are those
    files' and the untouched old ones'.
    """
    rows = read_shards(spark, columns, old_uri)
    files = materialize(rows.groupBy("shard", "file").agg(F.sum("size").alias("bytes")), "shard-files")
    per_shard = {r["shard"]: (r["s"], r["n"]) for r in files.groupBy("shard").agg(F.sum("bytes").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    supply = [per_shard.get(i, (0, 0))[0] for i in range(max(per_shard, default=-1) + 1)]
    flow = min_cost_flow(supply, capacities or even_capacities(sum(supply), n_new))
    # Each block's new files have consecutive numbers, each for the old files that begin in one stretch of file_bytes.
    moved = blocks(flow)
    counts = [(hi - 1) // file_bytes - lo // file_bytes + 2 for _, lo, hi, _ in moved]
    numbers = [0, *accumulate(counts)]
    cuts = spark.createDataFrame([(*b, n) for b, n in zip(moved, numbers)], "shard int, lo long, hi long, new int, number int")  # at most one row for each shard, old or new, and one more for each old one
    place = F.sum("bytes").over(Window.partitionBy("shard").orderBy("file"))
    placed = files.withColumn("stop", place).withColumn("start", F.col("stop") - F.col("bytes"))
    met = placed.join(F.broadcast(cuts), "shard").filter("start < hi and stop > lo")
    pieces = F.sort_array(F.collect_list(F.struct("lo", "hi", "new", "number"))).alias("pieces")  # at most one for each new shard
    fates = materialize(met.groupBy("shard", "file").agg(F.first("start").alias("start"), pieces).filter((F.size("pieces") > 1) | (F.col("pieces")[0]["new"] != F.col("shard"))), "shard-fates")
    few = sum(n for _, n in per_shard.values()) <= BROADCAST_FILES
    small = F.broadcast if few else lambda df: df
    changed = rows.join(small(fates), ["shard", "file"])
    whole = changed.filter(F.size("pieces") == 1).withColumn("piece", F.col("pieces")[0])
    cut = changed.filter(F.size("pieces") > 1)
    # A cut file is at most one for each end of a block, and no longer than files are.
    before = F.sum("size").over(Window.partitionBy("shard", "file").orderBy("doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    middle = (F.col("start") + F.col("before")) * 2 + F.col("size")
    nearer = F.get(F.filter("pieces", lambda p: middle < p["hi"] * 2), 0)
    cut = cut.withColumn("before", before).withColumn("piece", F.coalesce(nearer, F.element_at("pieces", -1)))
    keep = [f.name for f in columns.fields]
    stretch = F.floor(F.col("start") / file_bytes) - F.floor(F.col("piece.lo") / file_bytes) + 1
    number = F.col("piece.number") + F.greatest(stretch, F.lit(0))
    both = whole.select(*keep, F.col("piece.new").alias("shard"), number.alias("file")).unionByName(cut.select(*keep, F.col("piece.new").alias("shard"), number.alias("file")))
    tasks = max(1, min(numbers[-1], max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), numbers[-1] // TASK_FILES)))
    dealt = both.repartitionById(tasks, F.floor(F.col("file") * tasks / max(1, numbers[-1])).cast("int"))
    dealt.drop("file").write.partitionBy("shard").parquet(new_uri)
    stayed = rows.join(small(fates.select("shard", "file")), ["shard", "file"], "left_anti").select(*rows.columns)
    return stayed.unionByName(read_shards(spark, columns, new_uri)), flow


def reshard(docs: DataFrame, old: Column, n_new: int, out_uri: str, capacities: list[int] | None = None, file_bytes: int = BYTES_PER_FILE) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Lay docs (doc_id, text, others) out in old shards and rewrite those into n_new shards; the rows and the flow.

    old is each row's present shard number (null: 0). A document's size is its UTF-8 bytes (null text: none) plus 1;
    one of any length goes to one shard. Repeated rows and null ids are kept and may go to different shards. An empty
    table gives no rows. The rows have all columns of docs (those named like ADDED ones with THEIRS before their
    names) and shard, file, size and text_crc32, read back from the files.
    """
    columns = lay_out(docs, old, f"{out_uri}/old")
    return rewrite_shards(docs.sparkSession, columns, f"{out_uri}/old", f"{out_uri}/new", n_new, capacities, file_bytes)


def with_slots(written: DataFrame) -> DataFrame:
    """Add slot: each row's place in its shard, gapless from 0, by file, then doc_id and text_crc32."""
    counts = written.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n"))
    bases = counts.select("shard", "file", (F.sum("n").over(Window.partitionBy("shard").orderBy("file")) - F.col("n")).alias("base"))
    w = Window.partitionBy("shard", "file").orderBy("doc_id", "text_crc32")
    numbered = written.select("*", F.struct((F.row_number().over(w) - 1).alias("row")).alias("slot"))
    bases = bases.select("shard", "file", F.struct("base").alias("_base"))
    return numbered.join(bases, ["shard", "file"]).select(*written.columns, (F.col("_base.base") + F.col("slot.row")).cast("long").alias("slot"))
