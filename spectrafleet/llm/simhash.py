"""SimHash near-duplicates by segment-popcount embedding.

Links within a few bits (near_duplicates). A 64-bit fingerprint is mapped to the 32 bit counts of its 2-bit segments.
The Manhattan distance of two such points is at most the fingerprints' Hamming distance, so fingerprints at distance
2 or less differ in at most two counts. The counts lie in 7 groups, of which 5 at least agree: each fingerprint lies
in 21 grid cells, one for each choice of 5 groups, and the range join is an equi-join on cells. Pairs of one cell are
held to the Manhattan bound and then verified exactly. A cell with more than DENSE members doesn't list its pairs: two
words differ in at most two bits if and only if some word differs from each in at most one, so its members are linked
to the smallest fingerprint at each such word, which keeps every component.

Links at a likeness (deduplicate). At a Jaccard likeness of 0.8, fingerprints differ in some 10 of 64 bits and now and
then in 20; cells of that radius would hold a large part of all rows. There, a cell is made of the least shingle
hashes under a fixed mixing, several cells a text, which texts alike enough share almost surely. Candidates of a cell
are then held to the Manhattan bound, to the Hamming distance, and last to the exact likeness of their shingle sets. A
cell of more than CROWD texts doesn't list its pairs: its texts meet a few of their number first, and where that leaves
several components, those of different components meet at rare shingles, of which alike sets always share one; how many
shingles of a set count as rare depends on the other's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, bit_filter, connected_components, drop_written, in_mask, materialize, settle_rows, text_digest
from .hashing import NON_SPACE, gram_hashes, mix, slices, span_hashes, word_spans

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
#: Groups of 2-bit segments as bit masks; a cell leaves out MAX_BITS of them.
_EDGES = (0, 5, 10, 15, 20, 24, 28, 32)
_GROUPS = [sum(3 << 2 * j for j in range(a, b)) for a, b in zip(_EDGES, _EDGES[1:])]
DENSE = 16
#: Links at a likeness: words of a shingle, the least likeness, and bits that fingerprints of such texts may differ in
#: (half of those at 0.8 exactly differ in 10 or fewer; more than 24 is far rarer than a miss of all cells for long texts,
#: but sets of 4 and 5 shingles come to it once in some 8,000 times).
ALIKE_WORDS, ALIKE, ALIKE_BITS = 5, 0.8, 24
#: Cells of a text, and hashes that make up one: texts at 0.8 share none of them twice in 10,000 times.
CELLS, CELL_HASHES = 12, 3
#: A cell of up to so many texts lists its pairs. In larger groups, texts outside the largest component are cut into blocks.
CROWD, BLOCK = 16, 128
#: Sets are told apart by size in steps of so much.
SIZE_STEP = 1.02
#: Slots in which shingles of crowds are counted, to take rare ones first.
RARE_SLOTS = 1 << 20
#: Parts in which two sets' shingles are counted, to bound how many they have in common.
PARTS = 64
_SLICE = 1 << 15


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text as an unsigned 64-bit integer; 0 for a text without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(found)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fp long")


def _long(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def segment_counts(fp: Column) -> Column:
    """32 bit counts (0 to 2) of 2-bit segments, one in each two bits of a long."""
    a, b = (F.shiftrightunsigned(fp, j).bitwiseAND(_long(0x5555555555555555)) for j in (0, 1))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def manhattan(a: Column, b: Column) -> Column:
    """The Manhattan distance of two segment_counts() words."""
    # 0, 1, 2 become the unary codes 00, 01, 11: they differ in as many bits as the counts differ.
    unary = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(_long(0x5555555555555555)).bitwiseOR(x.bitwiseAND(_long(0xAAAAAAAAAAAAAAAA)))
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def grid_cells(counts: Column) -> Column:
    """The cells of a segment_counts() word: for each choice of two groups, a hash of the counts of all others."""
    pairs = [(g, h) for g in range(len(_GROUPS)) for h in range(g)]
    return F.array(*[F.xxhash64(counts.bitwiseAND(_long((1 << 64) - 1 ^ _GROUPS[g] ^ _GROUPS[h])), F.lit(i)) for i, (g, h) in enumerate(pairs)])


def near_duplicate_links(fps: DataFrame) -> DataFrame:
    """(a, b) links over distinct fingerprints fps (fp) whose components are those of all pairs within MAX_BITS bits."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes become many rows here, so they are dealt to all tasks first.
    cells = fps.repartition(parts, "fp").select("fp", F.explode(grid_cells(segment_counts(F.col("fp")))).alias("cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(cells.join(shared, "cell"), "simhash-cells")
    sparse = members.filter(F.col("n") <= DENSE)
    left, right = sparse.select("cell", F.col("fp").alias("a")), sparse.select("cell", F.col("fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    pairs = left.join(right, "cell").filter((a < b) & (manhattan(segment_counts(a), segment_counts(b)) <= MAX_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)).select("a", "b")
    crowd = members.filter(F.col("n") > DENSE).select("fp").distinct().repartition(parts, "fp")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_long(1 << j)) for j in range(64)])
    near = crowd.select("fp", F.explode(flips).alias("word"))
    least = near.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).filter("a <> last").select("word", "a")
    return pairs.unionByName(near.join(least, "word").filter("fp <> a").select("a", F.col("fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs (doc_id, text; others are ignored).

    Fingerprints link at MAX_BITS or fewer differing bits; component_id is the smallest doc_id reachable, itself
    included. Null and empty texts have fingerprint zero, which links like any other. Repeated rows stay; a null
    doc_id gets its group's smallest doc_id, or null if the group has none. An empty table gives no rows.
    A text of any length is read whole, its shingles hashed a slice at a time.
    """
    printed = materialize(fingerprints(docs), "simhash")
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(near_duplicate_links(distinct.select("fp")), "simhash-components")
    grouped = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    groups = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "component").join(groups, "component").select("fp", "component_id")
    return printed.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_sets(texts: list[str], words: int = ALIKE_WORDS) -> Iterator[tuple[np.ndarray, int, int]]:
    """(distinct shingle hashes, sorted; two digests of the word sequence) of each text. Fewer words: one shingle of all; none: no shingle."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    for lo, hi in slices([len(d) for d in data]):
        blob = b"\n".join(data[lo:hi])
        starts, ends = word_spans(blob, NON_SPACE)
        first = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data[lo:hi])])).tolist()
        hashes = span_hashes(blob, starts, ends)
        grams = gram_hashes(hashes, words)
        for i, (a, b) in enumerate(zip(first, first[1:]), lo):
            own = hashes[a:b]
            found = np.unique(grams[a : b - words + 1]) if b - a >= words else gram_hashes(own, b - a) if b > a else np.empty(0, np.uint64)
            yield found, xxhash.xxh3_64_intdigest(own.tobytes(), 1), xxhash.xxh3_64_intdigest(b" ".join(data[i].split()), 2)


_CELL_SEEDS = mix(np.arange(1, CELLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def likeness_cells(shingles: np.ndarray) -> np.ndarray:
    """For each of CELLS orders, a hash of the least CELL_HASHES shingles."""
    mixed = mix(shingles[None, :] ^ _CELL_SEEDS[:, None])
    if mixed.shape[1] > CELL_HASHES:
        mixed = np.partition(mixed, CELL_HASHES - 1, axis=1)[:, :CELL_HASHES]
    mixed.sort(axis=1)
    out = _CELL_SEEDS.copy()
    for column in mixed.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of distinct shingle hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _SLICE):
        ones += np.unpackbits(mix(shingles[at : at + _SLICE]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")[0])


def shingle_table(nodes: DataFrame, texts: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, s (its sorted shingle hashes) for the given distinct nodes; only rows of docs that may be theirs are cut into shingles again."""
    named = texts.join(nodes, "node", "left_semi").select(F.xxhash64("doc_id", "digest"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(named))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text_digest(F.col("text"))).alias("key"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = list(shingle_sets(pdf["text"][in_mask(shared.value, pdf["key"].to_numpy())].tolist(), words))
            if got:  # an empty column of arrays has no type
                yield pd.DataFrame({"node": np.array([g[1] for g in got], np.uint64).view(np.int64), "s": [g[0].view(np.int64) for g in got]})

    return materialize(rows.mapInPandas(read, "node long, s array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "simhash-sets")


def may_be_alike(fa: Column, fb: Column, na: Column, nb: Column, scale: int) -> Column:
    """The bounds that fingerprints and shingle counts of two alike texts keep."""
    bits = (manhattan(segment_counts(fa), segment_counts(fb)) <= ALIKE_BITS) & (F.bit_count(fa.bitwiseXOR(fb)) <= ALIKE_BITS)
    return bits & (F.least(na, nb) * 10_000 >= F.greatest(na, nb) * scale)


def alike_pairs(pairs: DataFrame, sets: DataFrame, scale: int) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have the likeness scale / 10,000 or more."""
    a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(a, "a").join(b, "b").filter(common * 10_000 >= (F.size("s_a") + F.size("s_b") - common) * scale).select("a", "b")


def rare_shingles(sets: DataFrame, scale: int) -> DataFrame:
    """node, gram, reach, parts: the first shingles of each set in one order of all shingles, so many that any two sets at the likeness share one.

    Sets of sizes p and q at the likeness t have t / (1 + t) * (p + q) shingles in common or more, so whatever the order,
    one of them is among the first p - t / (1 + t) * (p + q) + 1 of the one and the first q - t / (1 + t) * (p + q) + 1
    of the other. reach is the largest q for which a shingle is among the former. Rare ones come first: the order is by
    counts in RARE_SLOTS slots, a table of fixed size, then by hash. Those of one set alone are left out then; parts has
    the numbers of all its other shingles in PARTS parts.
    """
    slot = F.pmod(F.col("gram"), F.lit(RARE_SLOTS))
    counted = sets.select(F.explode("s").alias("gram")).groupBy(slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(RARE_SLOTS, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def first(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = shared.value[s % RARE_SLOTS]
        order = np.lexsort((s, count))[: len(s) - -(-len(s) * scale // 10_000) + 1]
        reach = (len(s) * 10_000 - np.arange(len(order)) * (10_000 + scale)) // scale
        held = count[order] > 1
        return s[order][held], reach[held], np.bincount(mix(s[count > 1].view(np.uint64)).astype(np.int64) % PARTS, minlength=PARTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [first(s) for s in pdf["s"]]
            if got:
                yield pd.DataFrame({"node": pdf["node"], "grams": [g[0] for g in got], "reaches": [g[1] for g in got], "parts": [g[2].astype(np.int32) for g in got]})

    rows = sets.mapInPandas(run, "node long, grams array<long>, reaches array<long>, parts array<int>")
    return rows.select("node", F.explode(F.arrays_zip("grams", "reaches")).alias("at"), "parts").select("node", F.col("at.grams").alias("gram"), F.col("at.reaches").alias("reach"), "parts")


def size_step(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


def crowd_meetings(members: DataFrame, sets: DataFrame, scale: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of members, all that may be alike in both under one (gram, step, block): what crowd_pairs() compares.

    Members meet at shared rare shingles. Where those of a shingle are of several components, all but its most frequent
    component's are set against all of them: two of one component need no link. Of those, a member meets sizes that its
    shingle reaches, and only members whose shingle reaches the least of the sizes they meet.
    """
    rows = materialize(rare_shingles(sets, scale).join(members, "node"), "simhash-rare")
    parts = rows.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("own"))
    met = parts.groupBy("gram").agg(F.max(F.struct("own", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    rows = rows.join(met.select("gram", F.col("main.component").alias("main")), "gram").withColumn("step", size_step(F.col("n")))
    sizes = rows.groupBy("gram", "step").agg(F.min("n").alias("least_n"), F.max("reach").alias("reached"))
    # Few sizes hold a shingle, so a member is set against those there are, not against all steps within its reach.
    few = rows.filter("component <> main").drop("step").join(sizes, "gram").filter("reach >= least_n and reached >= n").drop("least_n", "reached")
    blocks = few.groupBy("gram", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("n").alias("least_n"))
    few = few.join(blocks, ["gram", "step"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = rows.join(blocks, ["gram", "step"]).filter("reach >= least_n").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["gram", "step", "block"]
    columns = ("node", "fp", "n", "component", "reach", "parts")
    return few.select(*key, *[F.col(c).alias(f"{c}_a") for c in columns]), every.select(*key, *columns)


def crowd_pairs(members: DataFrame, sets: DataFrame, scale: int) -> DataFrame:
    """(a, b) that may be alike, among members (node, fp, n, component) of different components; none at the likeness is left out.

    Two sets have at most the sum of the lesser of their numbers in each part in common, so of the members that meet
    only pairs where that is enough come out.
    """
    few, every = crowd_meetings(members, sets, scale)
    x, y = F.col("node_a"), F.col("node")
    reached = (F.col("reach_a") >= F.col("n")) & (F.col("reach") >= F.col("n_a"))
    differ = (F.col("component_a") != F.col("component")) & may_be_alike(F.col("fp_a"), F.col("fp"), F.col("n_a"), F.col("n"), scale)
    most = F.aggregate(F.zip_with("parts_a", "parts", lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda t, v: t + v)
    enough = most * (10_000 + scale) >= (F.col("n_a") + F.col("n")).cast("long") * scale
    return few.join(every, ["gram", "step", "block"]).filter(reached & differ & enough).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def alike_components(texts: DataFrame, docs: DataFrame, likeness: float, words: int) -> DataFrame:
    """(node, component) of the distinct texts that links at the likeness or more join. texts: node, fp, n, cells, doc_id, digest of a row that has it."""
    cells = texts.select("node", F.explode("cells").alias("cell"))
    own = F.col("node").bitwiseXOR(F.col("cell"))
    met = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(own).alias("near"), F.max(own).alias("far")).filter("n > 1")
    members = materialize(cells.join(met, "cell"), "simhash-members")
    few = members.filter(F.col("n") <= CROWD).select("cell", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "cell").filter("a < b").select("a", "b")
    # In a crowded cell no pairs are listed: each member first meets four, the least and greatest in two orders, one of
    # them the cell's own, so that texts of one group meet many different ones over their cells.
    others = F.array("lo", "hi", F.col("near").bitwiseXOR(F.col("cell")), F.col("far").bitwiseXOR(F.col("cell")))
    crowded = members.filter(F.col("n") > CROWD)
    hubs = crowded.select("node", F.explode(others).alias("other")).filter("node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    pairs = pairs.unionByName(hubs).distinct()
    small, scale = texts.select("node", "fp", "n"), round(likeness * 10_000)
    both = pairs.join(small.toDF("a", "fp_a", "n_a"), "a").join(small.toDF("b", "fp_b", "n_b"), "b")
    pairs = materialize(both.filter(may_be_alike(F.col("fp_a"), F.col("fp_b"), F.col("n_a"), F.col("n_b"), scale)).select("a", "b"), "simhash-pairs")
    # Only texts that are still in a pair are read again for their shingles.
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    links = materialize(alike_pairs(pairs, shingle_table(asked, texts, docs, words), scale), "simhash-links")
    parts = connected_components(links, "simhash-components")
    # Then crowds that are not yet one component: links between components may be missing there.
    placed = crowded.select("cell", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    torn = materialize(placed.join(split, "cell", "left_semi").select("node", "component").distinct().join(small, "node"), "simhash-crowds")
    if torn.isEmpty():
        return parts
    sets = shingle_table(torn.select("node"), texts, docs, words)
    more = materialize(alike_pairs(materialize(crowd_pairs(torn, sets, scale), "simhash-pairs"), sets, scale), "simhash-links")
    return connected_components(links.unionByName(more), "simhash-components")


def alike_verdicts(docs: DataFrame, likeness: float = ALIKE, words: int = ALIKE_WORDS) -> DataFrame:
    """doc_id, digest (of the text), keep for the rows of docs that are alike another; others have no verdict.

    Texts of equal word sequences are one text; different texts link at the likeness of their sets of word shingles or
    more. Of all rows that links join, that with the smallest doc_id stays (nulls last, ties by digest).
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = list(shingle_sets(pdf["text"].tolist(), words))
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "digest": pdf["digest"], "node": signed([g[1] for g in got]), "again": signed([g[2] for g in got]), "fp": [set_fingerprint(g[0]) for g in got], "n": [len(g[0]) for g in got], "cells": [likeness_cells(g[0]).view(np.int64) for g in got]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
    printed = materialize(rows.mapInPandas(run, "doc_id long, digest long, node long, again long, fp long, n int, cells array<long>"), "simhash-shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    texts = printed.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("cells").alias("cells"), first, F.count(F.lit(1)).alias("rows"), (F.min("again") == F.max("again")).alias("sure"))
    # A node that two different texts share by chance is left alone: its rows stay.
    texts = materialize(texts.filter("sure").select("node", "fp", "n", "cells", "first", "rows", "first.doc_id", "first.digest"), "simhash-texts")
    parts = alike_components(texts, docs, likeness, words)
    classed = texts.select("node", "first", "rows").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = classed.groupBy("component").agg(F.min("first").alias("best"), F.sum("rows").alias("total")).filter("total > 1")
    chosen = classed.join(best, "component").select("node", "best")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    out = materialize(printed.select("doc_id", "digest", "node").join(chosen, "node").select("doc_id", "digest", kept.alias("keep")).distinct(), "simhash-verdicts")
    drop_written(printed)
    return out


def deduplicate(docs: DataFrame, likeness: float = ALIKE, words: int = ALIKE_WORDS) -> DataFrame:
    """docs without near-duplicates: of each group of rows that alike_verdicts() joins, one stays; all columns are kept.

    Null texts are empty, and texts without words are copies of each other; a null doc_id is no reason to stay.
    Repeated rows become one. A text of any length is read whole. An empty table gives no rows.
    """
    return settle_rows(docs, alike_verdicts(docs.select("doc_id", "text"), likeness, words))
