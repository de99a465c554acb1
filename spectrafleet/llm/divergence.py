"""Source divergence audit by joint count histograms.

Terms are counted for each (lang, source) group; a language keeps the terms of at least MIN_DOCS of its documents.
For a pair of groups the distance of their smoothed shares, summed over all kept terms, depends on a term only through
its two counts. So each pair tallies how often each (count, count) combination occurs, and evaluates the distance once
for a combination, times its multiplicity. Combinations with a zero are implied: how many terms a group has with count
a is one histogram for each group, and what of it meets a positive count of the other group is taken off again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 30
#: Added to each count, for shares of unseen terms.
SMOOTHING = 5
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: Terms listed for each group.
TOP_TERMS = 50

#: Distinct (group, term) entries that a task holds before it hands them on.
HELD_ENTRIES = 250_000
#: Bytes of a text that are split at a time.
PIECE_BYTES = 1 << 20
#: Pairs of counts that a task tallies at a time.
HELD_PAIRS = 2_000_000
#: Groups that are broadcast at most; with more, tables are joined by a shuffle.
BROADCAST_GROUPS = 20_000

#: A-Z to a-z, letters and bytes from 0x80 as they are, all others to a space.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, PIECE_BYTES at a time and cut between terms."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            # behind the next byte that is in no term
            while end < len(text) and _TERM_BYTES[text[end]] != 0x20:
                end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to partial (lang, source, term, n, docs): occurrences, and documents that have the term."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            if n:
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                same = lambda x, k=len(n): pa.repeat(pa.scalar(x, pa.string()), k)
                yield pa.RecordBatch.from_arrays(
                    [same(lang), same(source), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        counts.clear()

    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            key = (lang, source)
            if key not in counts:
                counts[key] = (Counter(), Counter())
            n, docs = counts[key]
            before, seen = len(n), set()
            for terms in pieces_of(text.as_py()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - before
            if held > HELD_ENTRIES:
                yield from handed_on()
                held = 0
    yield from handed_on()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents whose lang, source and text are strings without nulls."""
    schema = "lang string, source string, term string, n long, docs long"
    parts = docs.select("lang", "source", "text").mapInArrow(_count_terms, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, cells): the terms of at least min_docs documents of a language, with their (source, n) in order of source."""
    cells = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), cells).filter(F.col("docs") >= min_docs).select("lang", "term", "cells")


def _tallied(group: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (group, other, a, b) and how often each occurs."""
    order = np.lexsort((b, a, other, group))
    group, other, a, b = group[order], other[order], a[order], b[order]
    new = np.ones(len(group), bool)
    new[1:] = (np.diff(group) != 0) | (np.diff(other) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
    first = np.flatnonzero(new)
    return group[first], other[first], a[first], b[first], np.diff(np.append(first, len(group)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cells) to partial (lang, source, other, a, b, times): how often source has a term a times, and other, after it in order, b times."""
    names = ["lang", "source", "other", "a", "b", "times"]
    for batch in batches:
        cells = batch.column("cells")
        lengths = np.diff(cells.offsets.to_numpy()).astype(np.int64)
        flat = cells.flatten()
        langs, sources = batch.column("lang").dictionary_encode(), flat.field("source").dictionary_encode()
        term = np.repeat(np.arange(len(lengths)), lengths)
        lang = langs.indices.to_numpy().astype(np.int64)[term]
        wide = max(1, len(sources.dictionary))
        group = lang * wide + sources.indices.to_numpy()
        n = flat.field("n").to_numpy(zero_copy_only=False)

        def rows(parts, langs=langs, sources=sources, wide=wide):
            g, h, a, b, times = _tallied(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(g // wide)), sources.dictionary.take(pa.array(g % wide)), sources.dictionary.take(pa.array(h % wide)), pa.array(a), pa.array(b), pa.array(times.astype(np.int64))], names
            )

        parts, held = [], 0
        for apart in range(1, int(lengths.max(initial=0))):
            i = np.flatnonzero(term[:-apart] == term[apart:])
            parts.append((group[i], group[i + apart], n[i], n[i + apart]))
            held += len(i)
            if held > HELD_PAIRS:
                yield rows(parts)
                parts, held = [], 0
        if held:
            yield rows(parts)


def joint_histograms(kept: DataFrame) -> DataFrame:
    """(lang, source, other, a, b, times) for sources in order, and positive counts a and b only; the rest is implied."""
    schema = "lang string, source string, other string, a long, b long, times long"
    return kept.select("lang", "cells").mapInArrow(_tally, schema).groupBy("lang", "source", "other", "a", "b").agg(F.sum("times").alias("times"))


def share(count: Column, den: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / den), exact."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    return F.call_function("div", scaled, den.cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each (lang, source) group of documents (lang, source, text, others).

    part pair: item is each other source of the lang, value the summed distance of the shares of all kept terms.
    part term: item is each kept term that the group has and uses more than its lang, value by how much; top_terms of them.
    Nulls are ''. Repeated rows count each time, whatever their other columns; long texts are split piece by piece. A
    group without terms has all counts 0, and pairs of a lang that keeps no term have value 0. Equal values come in
    order of item. No rows give no rows. Columns besides the three are not read.

    Each task sums its terms by group before the shuffle, and a pair's combinations before theirs. The one thing held
    together is the list of sources of a term.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")}
    docs = docs.select(*text.values())
    kept = materialize(kept_terms(term_counts(docs), min_docs), "kept-terms")
    cells = kept.select("lang", "term", F.inline("cells").alias("source", "n"))
    hist = materialize(cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")), "count-histograms")
    by_group = hist.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.sum("times").alias("present"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = {"total": 0, "present": 0, "v": 0}
    groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(zero)
    den = F.col("total") + SMOOTHING * F.col("v")
    groups = materialize(groups.withColumn("den", F.greatest(den, F.lit(1))).withColumn("p0", share(F.lit(0), F.col("den"))), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    small = F.broadcast if few else (lambda df: df)
    return _pairs(kept, hist, groups, small).unionByName(_terms(kept, groups, small, top_terms))


def _pairs(kept: DataFrame, hist: DataFrame, groups: DataFrame, small) -> DataFrame:
    one = groups.select("lang", "source", F.col("den").alias("den1"), F.col("p0").alias("z1"), F.col("present").alias("present1"), "v")
    two = groups.select("lang", F.col("source").alias("other"), F.col("den").alias("den2"), F.col("p0").alias("z2"), F.col("present").alias("present2"))
    both = one.join(small(two), "lang").filter("source < other")
    base = both.select("lang", "source", "other", ((F.col("v") - F.col("present1") - F.col("present2")) * F.abs(F.col("z1") - F.col("z2"))).alias("value"))
    # terms of one group as if the other had none of them
    alone = hist.join(small(groups.select("lang", "source", "den")), ["lang", "source"]).select("lang", "source", "times", share(F.col("n"), F.col("den")).alias("p"))
    against = two.select("lang", F.col("other"), "z2")
    alone = alone.join(small(against), "lang").filter("source <> other")
    alone = alone.groupBy(F.col("lang"), F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other")).agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("z2"))).alias("value"))
    # combinations of two positive counts, and the two halves and the empty cell that they were counted as
    joint = joint_histograms(kept).join(small(one), ["lang", "source"]).join(small(two), ["lang", "other"])
    p, q, z1, z2 = share(F.col("a"), F.col("den1")), share(F.col("b"), F.col("den2")), F.col("z1"), F.col("z2")
    joint = joint.select("lang", "source", "other", "times", "z1", "z2", p.alias("p"), q.alias("q"))
    p, q = F.col("p"), F.col("q")
    f = F.abs(p - q) - F.abs(p - z2) - F.abs(q - z1) + F.abs(z1 - z2)
    joint = joint.groupBy("lang", "source", "other").agg(F.sum(F.col("times") * f).alias("value"))
    value = base.unionByName(alone).unionByName(joint).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    flipped = value.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value")
    value = value.withColumnRenamed("other", "item").unionByName(flipped)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, small, top_terms: int) -> DataFrame:
    """Terms with a share above their lang's; only the first of each group in a partition are shuffled for the ranks."""
    by_term = kept.withColumn("in_lang", F.aggregate("cells", F.lit(0).cast("long"), lambda total, cell: total + cell["n"]))
    lang = groups.groupBy("lang").agg(F.greatest(F.sum("total") + SMOOTHING * F.max("v"), F.lit(1)).alias("lang_den"))
    by_term = by_term.join(small(lang), "lang").withColumn("q", share(F.col("in_lang"), F.col("lang_den")))
    each = by_term.select("lang", "term", "q", F.inline("cells").alias("source", "n"))
    each = each.join(small(groups.select("lang", "source", "den")), ["lang", "source"])
    each = each.select("lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("den")) - F.col("q")).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
