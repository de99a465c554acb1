"""Benchmark decontamination by winnowing.

Of the hashes of K-word grams, the least in each window of W consecutive ones is kept. A shared span of
K + W - 1 = 10 words holds one whole window, so both sides keep the same gram of it: every shared span of ten words
or more is found. Training and benchmark fingerprints meet in a filter of the benchmark's; each hit is extended to
every ten-word span around it, and these are joined as words with the spans around the benchmark's fingerprints. A
gram that stands in many items, or often in documents, is thus never paired with each of its other places. Items of
fewer than ten words are one gram of their own length, kept without winnowing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bit_filter, bounded_batches, materialize, settle_rows, text_digest
from .hashing import ALNUM, gram_hashes, slices, span_hashes, word_spans

SPAN, K = 10, 5
W = SPAN - K + 1
SIDE = SPAN - K
BROADCAST_SPANS = 50_000
_GRAM = "array<struct<fp:long,pos:int,gram:string,before:array<string>,after:array<string>,short:boolean>>"


def winnow(hashes: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Positions kept: the least hash of each allowed window of W; windows[i] is hashes[i : i + W]."""
    if len(hashes) < W:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, W)
    at = np.flatnonzero(allowed[: len(windows)])
    return np.unique(at + windows[at].argmin(axis=1))


def _grams(texts: list[str], lengths: list[int], keep) -> Iterator[tuple[int, list[tuple]]]:
    """(number of words, fingerprints that keep() admits) of each text."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    for lo, hi in slices([len(d) for d in data]):
        blob = b"\n".join(data[lo:hi])
        starts, ends = word_spans(blob, ALNUM)
        edges = np.cumsum([0, *(len(d) + 1 for d in data[lo:hi])])
        first = np.searchsorted(starts, edges)  # each text's words are first[i] : first[i + 1]
        owner = np.repeat(np.arange(hi - lo), np.diff(first))
        words = span_hashes(blob, starts, ends)
        found: list[list[tuple]] = [[] for _ in range(lo, hi)]

        def word(i: int, blob=blob, starts=starts, ends=ends) -> str:
            return blob[starts[i] : ends[i]].decode("utf-8", "surrogatepass")

        same = lambda n, owner=owner: owner[: len(owner) - n + 1] == owner[n - 1 :]
        grams = gram_hashes(words, K)
        kept = winnow(grams, same(SPAN)) if len(words) >= SPAN else np.empty(0, np.int64)
        for p in kept[keep(grams[kept])].tolist():
            o = owner[p]
            before = [word(i) for i in range(p - 1, max(first[o], p - SIDE) - 1, -1)]
            after = [word(i) for i in range(p + K, min(first[o + 1], p + K + SIDE))]
            found[o].append((int(grams[p].view(np.int64)), int(p - first[o]), " ".join(word(i) for i in range(p, p + K)), before, after, False))
        for n in lengths:
            if len(words) < n:
                continue
            grams = gram_hashes(words, n) ^ np.uint64(n)
            for p in np.flatnonzero(same(n) & keep(grams)).tolist():
                o = owner[p]
                found[o].append((int(grams[p].view(np.int64)), int(p - first[o]), " ".join(word(i) for i in range(p, p + n)), [], [], True))
        yield from zip(np.diff(first).tolist(), found, strict=True)


def _all(hashes: np.ndarray) -> np.ndarray:
    return np.ones(len(hashes), bool)


def spans_around(grams: Column) -> Column:
    """An array of start, words (joined by spaces) and n for each span of SPAN words around each gram, or for a short item's gram itself."""
    def around(g: Column) -> Column:
        found = []
        for left in range(SIDE + 1):
            words = F.concat(F.reverse(F.slice(g["before"], 1, left)) if left else F.array().cast("array<string>"), F.array(g["gram"]), F.slice(g["after"], 1, SIDE - left) if left < SIDE else F.array().cast("array<string>"))
            whole = ~g["short"] & (F.size(g["before"]) >= left) & (F.size(g["after"]) >= SIDE - left)
            found.append(F.when(whole, F.struct((g["pos"] - left).alias("start"), F.array_join(words, " ").alias("words"), F.lit(SPAN).alias("n"))))
        found.append(F.when(g["short"], F.struct(g["pos"].alias("start"), g["gram"].alias("words"), F.size(F.split(g["gram"], " ")).alias("n"))))
        return F.array_compact(F.array(*found))

    return F.array_distinct(F.flatten(F.transform(grams, around)))


def benchmark_grams(items: DataFrame) -> DataFrame:
    """item_id, g: the fingerprints of every item, with the words on both sides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [len(word_spans(t.encode("utf-8", "surrogatepass").lower(), ALNUM)[0]) for t in pdf["text"]]
            rows = []
            for item_id, text, n in zip(pdf["item_id"], pdf["text"], counts, strict=True):
                (_, found), *_ = _grams([text], [n] if 0 < n < SPAN else [], _all)
                rows.append((item_id, found))
            yield pd.DataFrame(rows, columns=["item_id", "g"])

    rows = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"item_id string, g {_GRAM}").filter("size(g) > 0")


def contamination(docs: DataFrame, items: DataFrame, filter_bits: int = 1 << 23) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans for docs (doc_id, text) against items (item_id, text).

    spans are the merged word ranges hit, as array<struct<start, stop>> with stop exclusive. Every row gives one row,
    repeated ones too; null ids are kept. Null texts have no words; a text of any length is read whole. Items with a
    null id are ignored, repeated item ids count once; items of equal texts are all listed. An empty docs table gives
    no rows, and an empty items table no hits. Other columns are ignored. filter_bits bounds what is broadcast: a bit
    filter of the benchmark's fingerprints that spares the join most of the others. When it fills up, more
    fingerprints reach the join and the result stays the same.
    """
    return _contamination(docs, items, filter_bits).drop("digest")


def _contamination(docs: DataFrame, items: DataFrame, filter_bits: int) -> DataFrame:
    """contamination() with the digest of each row's text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    grams = materialize(benchmark_grams(items), "benchmark-grams")
    spans = materialize(grams.select("item_id", F.explode(spans_around(F.col("g"))).alias("s")).select("item_id", "s.words", "s.n").distinct(), "benchmark-spans")
    # Each distinct span has a number, fixed by being written; which items hold it stays a table of pairs.
    numbered = materialize(spans.select("words").distinct().withColumn("span_id", F.monotonically_increasing_id()), "benchmark-span-ids")
    holders = spans.join(numbered, "words").select("span_id", "item_id")
    if numbered.count() <= BROADCAST_SPANS:  # at most some 10 MB; beyond that, a shuffled join
        numbered = F.broadcast(numbered)
    lengths = [r["n"] for r in spans.filter(F.col("n") < SPAN).select("n").distinct().collect()]  # 1 to 9
    mask_b = spark.sparkContext.broadcast(bit_filter(grams.select(F.explode("g.fp")), filter_bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = mask_b.value

        def keep(h: np.ndarray) -> np.ndarray:
            at = h & np.uint64(filter_bits - 1)
            return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        for pdf in batches:
            got = list(_grams(pdf["text"].tolist(), lengths, keep))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "digest": pdf["digest"], "n_words": [n for n, _ in got], "g": [g for _, g in got]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
    # Each row has a number of its own, fixed by being written, so that repeated rows stay apart.
    printed = materialize(rows.mapInPandas(run, f"doc_id long, digest long, n_words long, g {_GRAM}").withColumn("row", F.monotonically_increasing_id()), "document-grams")
    some = printed.filter("size(g) > 0").select("row", "doc_id", "digest", "n_words", F.explode(spans_around(F.col("g"))).alias("s"))
    hits = some.select("row", "doc_id", "digest", "n_words", "s.*").join(numbered, "words").select("row", "doc_id", "digest", "n_words", F.struct("start", (F.col("start") + F.col("n")).alias("stop")).alias("span"), "span_id")
    by_doc = hits.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "digest", "n_words")], F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("span_id")).alias("span_ids"))
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    found = materialize(by_doc.select("row", "doc_id", "digest", "n_words", merged.alias("spans"), "span_ids", F.sha2(F.array_join(F.col("span_ids").cast("array<string>"), ","), 256).alias("set")), "contamination")
    # Documents hit by the same spans share one list of items, made once.
    sets = found.select("set", "span_ids").dropDuplicates(["set"]).select("set", F.explode("span_ids").alias("span_id"))
    listed = sets.join(holders, "span_id").groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    listed = listed.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    hit = found.join(listed, "set").select("doc_id", "digest", "n_words", n_hit.alias("n_hit"), "n_items", "items_sha256", F.lit(True).alias("contaminated"), "spans")
    # Rows that kept a fingerprint but met no span are few; the others never leave their task.
    suspects = printed.filter("size(g) > 0").select("row", "doc_id", "digest", "n_words").join(found.select("row"), "row", "left_anti").drop("row")
    clean = printed.filter("size(g) = 0").select("doc_id", "digest", "n_words").unionByName(suspects)
    none = F.array().cast("array<struct<start:int,stop:int>>").alias("spans")
    return clean.select("doc_id", "digest", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit("").cast("binary"), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), none).unionByName(hit)


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that share a window with an item; all columns are kept. A null doc_id is no reason to stay."""
    found = _contamination(docs.select("doc_id", "text"), items, 1 << 23).filter("contaminated").select("doc_id", "digest", F.lit(False).alias("keep")).distinct()
    return settle_rows(docs, materialize(found, "contaminated"))
