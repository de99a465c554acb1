"""Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

Each 5-word shingle is hashed once; the hash's top bits name one of BINS bins and a bin keeps its least hash. Empty
bins are filled by optimal densification: each probes other bins in a random order of its own, the same for every
document, and copies the first filled one. A fingerprint is the low BITS bits of every bin. Unrelated bins agree by
chance once in 2**BITS times; likeness() corrects for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import materialize

SHINGLE_WORDS, BINS, BITS = 5, 256, 8
_TOP = 64 - (BINS.bit_length() - 1)


def _bins() -> Column:
    return F.sequence(F.lit(0), F.lit(BINS - 1))


def _draw(b: int, i: int) -> int:
    """A fixed random number below 2**16 for bin b."""
    x = ((2 * b + i + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    return (x ^ x >> 27) >> 48


_START = [_draw(b, 0) % BINS for b in range(BINS)]
_STEP = [_draw(b, 1) % BINS | 1 for b in range(BINS)]


def _probe(b: Column, t: Column) -> Column:
    """The t-th bin that empty bin b looks at: a full cycle with a random start and an odd random step."""
    return (F.get(F.lit(_START), b) + t * F.get(F.lit(_STEP), b)).bitwiseAND(F.lit(BINS - 1))


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add out: the BINS values of a text column's fingerprint as array<tinyint>, empty for a text without words.

    A text of fewer words than a shingle is one shingle. Equal word sequences have equal fingerprints.
    """
    spaced = F.lower(text)
    for space in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    df = df.withColumn("_words", F.array_remove(F.split(spaced, " "), ""))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - SHINGLE_WORDS + 1, F.lit(1)))
    shingles = F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, SHINGLE_WORDS)))
    # Sorting makes bins contiguous, each with its least hash first.
    df = df.withColumn("_hashes", F.sort_array(shingles)).withColumn("_n", F.size("_words")).drop("_words")
    least = F.filter("_hashes", lambda h, i: (i == 0) | (F.shiftrightunsigned(F.get("_hashes", i - 1).bitwiseXOR(h), _TOP) != 0))
    df = df.withColumn("_least", least).drop("_hashes")
    df = df.withColumn("_filled", F.transform("_least", lambda h: (F.shiftright(h, _TOP) + F.lit(BINS // 2)).cast("int")))
    sparse = F.transform(_bins(), lambda b: F.get("_least", F.array_position("_filled", b).cast("int") - 1).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    # Naming _filled twice keeps the optimizer from computing it anew for every bin, inside the lambda.
    df = df.withColumn("_sparse", F.when(F.size("_filled") > 0, sparse)).drop("_least", "_filled")

    def borrowed(b: Column, first: int, last: int) -> Column:
        held = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: F.get("_sparse", _probe(b, t)))
        return F.get(F.array_compact(held), 0)

    # Most empty bins end at the first looks; longer searches are begun only for the others.
    looks = [[(_START[b] + t * _STEP[b]) % BINS for b in range(BINS)] for t in range(3)]
    dense = F.transform("_sparse", lambda v, b: F.coalesce(v, *[F.get("_sparse", F.get(F.lit(x), b)) for x in looks], borrowed(b, 3, 15), borrowed(b, 16, BINS - 1)))
    packed = F.transform(dense, lambda v: (v - F.lit(1 << BITS - 1)).cast("tinyint"))
    return df.withColumn(out, F.when(F.col("_n") > 0, packed).otherwise(F.array().cast("array<tinyint>"))).drop("_sparse", "_n")


def as_hex(fingerprint: Column) -> Column:
    """The packed low-order bits as hex digits; empty for a text without words."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + F.lit(1 << BITS - 1))), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1, corrected for chance agreement; texts without words are like each other only."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def _identified(docs: DataFrame) -> DataFrame:
    """_no, _k: the order of rows by descending doc_id, null last; _a, _b: a digest of the text; text."""
    key, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    # The complement turns the order of longs around, without an overflow.
    return docs.select(key.isNull().alias("_no"), F.coalesce(F.bitwise_not(key), F.lit(0)).alias("_k"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"), text.alias("text"))


_ORDER, _ID = ("_no", "_k", "_head", "_a", "_b"), ("_a", "_b", "_k", "_no")
#: Characters of a text that order documents of one doc_id.
HEAD_CHARS = 64


def before_each(texts: DataFrame) -> DataFrame:
    """Of distinct documents: _a, _b, _k, _no, fp, copies, and prev, the same of the document before (before the first: the last).

    These rows hold no texts. Ranges of the whole order cut them up, so many documents of one doc_id are several
    ranges; a range's last row is what its successor's first one looks for.
    """
    slim = add_fingerprint(texts.withColumn("_head", F.substring("text", 1, HEAD_CHARS)).withColumn("_len", F.length("text")), "text", "fp").drop("text")
    distinct = slim.groupBy(*_ORDER, "_len", "fp").agg(F.count(F.lit(1)).alias("copies"))
    ranged = materialize(distinct.repartitionByRange(*_ORDER).withColumn("_range", F.spark_partition_id()), "document-order")
    whole = F.struct(*_ORDER, "_len", "fp")
    ranges = Window.orderBy("_range")  # one row for each range
    every = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = ranged.groupBy("_range").agg(F.max(whole).alias("last"))
    edges = last.select("_range", F.coalesce(F.lag("last").over(ranges), F.last("last").over(every)).alias("edge"))
    within = Window.partitionBy("_range").orderBy(*_ORDER)
    out = ranged.select("*", F.lag(whole).over(within).alias("prev")).join(F.broadcast(edges), "_range")
    return out.select(*_ID, "fp", "copies", F.coalesce("prev", "edge").alias("prev"))


def with_next_start(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, third, next_start, near_next of docs: a third of the text's code points, and as many of the next document's first.

    Each document sends its successor in reverse order, the one before, the piece that is asked for: no more of a text
    than that goes to another row, and no two documents share a key.
    """
    texts = _identified(docs)
    told = before_each(texts)
    asked = [F.col(f"prev.{c}").alias(f"_to{c}") for c in _ID]
    asks = told.select(*_ID, "copies", *asked, F.floor(F.col("prev._len") / 3).cast("int").alias("third"), F.col("prev.fp").alias("fp"), likeness(F.col("prev.fp"), F.col("fp")).alias("near_next"))
    to = [f"_to{c}" for c in _ID]
    starts = texts.join(asks, list(_ID)).select(*to, "copies", "third", "fp", "near_next", F.substring("text", F.lit(1), F.col("third")).alias("next_start"))
    if not told.filter("copies > 1").isEmpty():  # copies all give the same piece
        starts = starts.filter("copies = 1").unionByName(starts.filter("copies > 1").dropDuplicates(to))
    found = texts.join(starts.withColumnsRenamed(dict(zip(to, _ID, strict=True))), list(_ID))
    return found.select(F.when(~F.col("_no"), F.bitwise_not("_k")).alias("doc_id"), "text", "fp", "third", "next_start", "near_next")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for docs (doc_id, text).

    A document's edited text has its last third (floor of its code points by 3) replaced by the first as many code
    points, or all, of the next document by descending doc_id; the last is followed by the first. Null text: empty.
    Documents of one doc_id are ordered by their first HEAD_CHARS characters, then by a digest; those without a doc_id
    come last, in the same order. Repeated rows (of equal doc_id and text) are one document, whose result each of them
    gets. A text of any length is one row of its task. An empty table gives no rows; a lone document is its own next.
    Other columns are ignored.
    """
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("third")), "next_start")
    edited_rows = add_fingerprint(with_next_start(docs).withColumn("edited", edited), "edited", "edited_fp")
    return edited_rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        "near_next",
    )
