import random
import time
import zlib

from pyspark.sql import functions as F

from spectrafleet.llm import reshard
from spectrafleet.llm._shared import new_path


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(1)
    for _ in range(60):
        supply = [rng.randrange(0, 200) for _ in range(rng.randrange(1, 7))]
        n = rng.randrange(1, 8)
        capacity = reshard.even_capacities(sum(supply), n)
        flow = reshard.min_cost_flow(supply, capacity)
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(supply))] == supply
        assert [sum(v for (_, j), v in flow.items() if j == k) for k in range(n)] == capacity
        moved = sum(v for (i, j), v in flow.items() if i != j)
        assert moved == sum(s - min(s, capacity[i] if i < n else 0) for i, s in enumerate(supply))


def test_flow_of_thousands_of_shards():
    rng = random.Random(3)
    supply = [rng.choice([0, rng.randrange(10**12), rng.randrange(10**9)]) for _ in range(2000)]
    capacity = reshard.even_capacities(sum(supply), 2100)
    began = time.process_time()
    flow = reshard.min_cost_flow(supply, capacity)
    assert time.process_time() - began < 5 and len(flow) <= 3 * 2100
    out, into = [0] * 2000, [0] * 2100
    for (i, j), v in flow.items():
        assert v > 0
        out[i] += v
        into[j] += v
    assert out == supply and into == capacity
    assert sum(v for (i, j), v in flow.items() if i != j) == sum(s - min(s, capacity[i]) for i, s in enumerate(supply))


def test_shards_are_even_and_whole(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(0, 400), rng.choice([0, 0, 0, 1, 2, 9])) for i in range(3000)]
    rows += [(3001, None, 0), (3002, "", 1), (None, "none", 2), (7, "again", 0), (7, "again", 0)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source int, size string, key int")
    written, flow = reshard.reshard(docs, F.col("source"), 4, new_path(spark, "shards"))
    assert {"doc_size", "key", "shard", "file", "size", "text_crc32"} <= set(written.columns)
    got = reshard.with_slots(written).collect()
    assert all(r["doc_size"] == "x" and r["key"] == 1 for r in got)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((i or -1 if i is not None else -1, t or "") if i is not None else (-1, t) for i, t, _ in rows)
    sizes, slots = {}, {}
    for r in got:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) - min(sizes.values()) <= 2 * 801
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    stayed = sum(r["size"] for r in got if r["shard"] == r["source"])
    total = sum(sizes.values())
    assert abs((total - stayed) - sum(v for (i, j), v in flow.items() if i != j)) <= 4 * 801


def test_empty_and_equal_rows(spark):
    docs = spark.createDataFrame([(1, "same")] * 6, "doc_id long, text string")
    written, _ = reshard.reshard(docs, F.lit(0), 3, new_path(spark, "shards"))
    assert sorted(r["shard"] for r in written.collect()) == [0, 0, 1, 1, 2, 2]  # near equal bytes, even of one row's copies
    none, flow = reshard.reshard(docs.limit(0), F.lit(0), 3, new_path(spark, "shards"))
    assert none.count() == 0 and flow == {} and reshard.with_slots(none).count() == 0


def plain_placement(old, flow):
    """{(old shard, file): [(doc_id, crc, new shard)]}, document by document, from the old files' rows."""
    out = {}
    for shard in sorted({s for s, _ in old}):
        ends, at = [], 0
        for j in sorted((j for i, j in flow if i == shard), key=lambda j: (j != shard, j)):
            at += flow[shard, j]
            ends.append((at, j))
        at = 0
        for name in sorted(f for s, f in old if s == shard):
            rows = sorted(old[shard, name], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            total, first = sum(r[2] for r in rows), at
            last = first + total
            begin = next((k for k, (end, _) in enumerate(ends) if end > first), len(ends) - 1)
            whole = ends[begin][0] >= last
            placed = []
            for doc_id, crc, size in rows:
                middle = at + size / 2
                new = ends[begin][1] if whole else next((j for end, j in ends if middle < end), ends[-1][1])
                placed.append((doc_id, crc, new))
                at += size
            out[shard, name] = placed
    return out


def test_placement_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "é", ""]) * rng.randrange(0, 300), rng.choice([0, 0, 0, 0, 1, 2, 5, None])) for i in range(900)] + [(None, "none", 2), (None, None, 0)]
    docs = spark.createDataFrame([(i, t, s, "a", 1, 2, 3, 4.0) for i, t, s in rows], "doc_id long, text string, source int, shard string, doc_shard int, file int, slot int, _shard double").repartition(6)
    uri = new_path(spark, "shards")
    written, flow = reshard.reshard(docs, F.col("source"), 3, uri, file_bytes=5_000)
    got = written.collect()
    assert len(got) == len(rows) and all((r["_doc_shard"] if "_doc_shard" in written.columns else r["doc_shard"]) in (1, "a") for r in got)
    old = {}
    for r in spark.read.parquet(f"{uri}/old").select("doc_id", "text", "shard", "_metadata.file_name").collect():
        data = (r["text"] or "").encode()
        old.setdefault((r["shard"], r["file_name"]), []).append((r["doc_id"], zlib.crc32(data), len(data) + 1))
    want = plain_placement(old, flow)
    assert sorted(((r["doc_id"], r["text_crc32"], r["shard"]) for r in got), key=str) == sorted((x for v in want.values() for x in v), key=str)
    # Old files whose rows all stay are read where they were; no other is, and nothing else was written anew.
    stay = {k for k, v in want.items() if all(j == k[0] for _, _, j in v)}
    assert stay and {(r["shard"], r["file"]) for r in got} & set(old) == stay
    assert spark.read.parquet(f"{uri}/new").count() == len(rows) - sum(len(old[k]) for k in stay)


def test_given_capacities(spark):
    docs = spark.createDataFrame([(i, "y" * 9) for i in range(100)], "doc_id long, text string")
    written, flow = reshard.reshard(docs, F.col("doc_id") % 2, 2, new_path(spark, "shards"), capacities=[300, 900])
    assert flow == {(0, 0): 300, (0, 1): 200, (1, 1): 500}
    assert {r["shard"]: r["n"] for r in written.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {0: 30, 1: 70}
