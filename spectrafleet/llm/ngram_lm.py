"""Language-model scoring by deleted interpolation.

P(w | v) = L2(b) c(v w) / c(v) + L1(b) c(w) / N + L0(b) / (V + 1), where b is the size class of the context's count
c(v) and a text's first context is the end mark. The weights are learned by expectation-maximisation on held-out
counts: every training token is scored with its own occurrence deleted from the counts.

Counting and lookup are one exchange. Each task reads its texts in blocks of BLOCK_BYTES, and asks for the counts of
a block's distinct words and word pairs; the requests, which carry the block's own counts, are dealt to buckets by
hash. A bucket sums each key's counts over all blocks and answers every block in the order of its request. However
common a word is, it reaches its bucket once for each block, and there are as many buckets as the text's bytes ask
for, so that one fits a task. Answers lie in the shared folder, those of some SHELF_BLOCKS blocks in one file, sorted
by a digest of the block's rows, which its row groups are found by; the scoring passes make the same blocks from the
same rows and read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, new_path
from .hashing import NON_SPACE, mix, slices, span_hashes, word_spans

BLOCK_BYTES, BUCKET_BYTES, SHELF_BLOCKS = 6 << 20, 8 << 20, 8
END = np.uint64(0x6A09E667F3BCC909)
CLASSES, STEPS = 48, 4
_ZERO = -400


@dataclass
class Block:
    digest: int
    doc_ids: list
    train: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    context_at: np.ndarray
    pairs: np.ndarray
    pair_at: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        """1 for each token of a training document."""
        return np.repeat(self.train, np.diff(self.starts)).astype(np.float64)


@dataclass
class Layout:
    """How texts are cut into blocks, and where blocks' answers lie."""

    uri: str
    block_bytes: int
    buckets: int
    shelves: int


def blocks(batches: Iterator[pd.DataFrame], block_bytes: int) -> Iterator[Block]:
    """Blocks of (doc_id, train, text) rows; what a block holds depends on the rows and their order alone."""
    ids, train, data, size = [], [], [], 0
    for pdf in batches:
        for i, t, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["train"], pdf["text"], strict=True):
            ids.append(i)
            train.append(bool(t))
            data.append(text.encode("utf-8", "surrogatepass").lower())
            size += len(data[-1]) + 8
            if size >= block_bytes:
                whole = _block(ids, train, data)
                ids, train, data, size = [], [], [], 0
                yield whole
                del whole
    if ids:
        yield _block(ids, train, data)


def _block(ids: list, train: list[bool], data: list[bytes]) -> Block:
    digest = xxhash.xxh3_64()
    for i, t, d in zip(ids, train, data, strict=True):
        digest.update(f"{i} {t} {len(d)} ".encode())
        digest.update(d)
    hashes, counts = [], []
    for lo, hi in slices([len(d) for d in data]):
        blob = b"\n".join(data[lo:hi])
        starts, ends = word_spans(blob, NON_SPACE)
        hashes.append(span_hashes(blob, starts, ends))
        edges = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data[lo:hi])]))
        counts.append(np.diff(edges))
    n_words = np.concatenate(counts)
    offsets = np.concatenate([[0], np.cumsum(n_words + 1)])
    tokens = np.full(offsets[-1], END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[offsets[1:] - 1] = False
    tokens[inside] = np.concatenate(hashes)
    words, word_at = np.unique(tokens, return_inverse=True)
    word_at = word_at.astype(np.int32)
    context = np.empty_like(word_at)
    context[1:] = word_at[:-1]
    context[offsets[:-1]] = np.searchsorted(words, END)
    pairs, pair_at = np.unique(mix(words[context] * np.uint64(0x9E3779B97F4A7C15) + tokens), return_inverse=True)
    pair_at = pair_at.astype(np.int32)
    return Block(digest.intdigest() - (1 << 63), ids, np.array(train), offsets, words, word_at, context, pairs, pair_at)


def pack(counts: np.ndarray) -> bytes:
    """Non-negative integers, mostly small: one byte each, 255 for those listed behind with eight."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys by bucket, and where each bucket begins in it."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(n + 1))


def plan_layout(rows: DataFrame, uri: str, block_bytes: int, bucket_bytes: int) -> Layout:
    sums = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = (sums["b"] or 0) + 8 * sums["n"]
    return Layout(uri, block_bytes, max(8, -(-total // bucket_bytes)), max(1, -(-total // (block_bytes * SHELF_BLOCKS))))


def gather_counts(rows: DataFrame, layout: Layout) -> tuple[int, int]:
    """Answer every block's request; N and V of the training rows (doc_id, train, text)."""
    spark = rows.sparkSession
    n = layout.buckets

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, layout.block_bytes):
            weight = b.weight
            for kind, keys, at in ((1, b.words, b.word_at), (2, b.pairs, b.pair_at)):
                counts = np.bincount(at, weights=weight, minlength=len(keys)).astype(np.int64)
                order, begin = _by_bucket(keys, n)
                some = np.flatnonzero(np.diff(begin)).tolist()
                cut = [order[begin[i] : begin[i + 1]] for i in some]
                yield pd.DataFrame({"block": b.digest, "kind": kind, "bucket": some, "keys": [keys[c].tobytes() for c in cut], "counts": [pack(counts[c]) for c in cut]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [pdf for pdf in batches if len(pdf)]  # one bucket
        for kind in (1, 2):
            parts = [p for p in (pdf[pdf["kind"] == kind] for pdf in asked) if len(p)]
            if not parts:
                continue
            keys = [np.frombuffer(k, np.uint64) for p in parts for k in p["keys"]]
            sizes = [len(k) for k in keys]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            counts = np.concatenate([unpack(c, m) for c, m in zip((c for p in parts for c in p["counts"]), sizes, strict=True)])
            # A sum of float64 is exact up to 2**53.
            totals = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
            tokens, types, done = int(totals.sum()), int((totals > 0).sum()), 0
            for p in parts:
                m = sizes[: len(p)]
                sizes = sizes[len(p) :]
                ends = done + np.cumsum([0, *m])
                out = pd.DataFrame({"block": p["block"], "kind": kind, "bucket": p["bucket"], "counts": [pack(totals[at[a:b]]) for a, b in zip(ends, ends[1:])], "n": m, "tokens": 0, "types": 0})
                if not done:
                    out.iloc[0, [5, 6]] = tokens, types
                done = int(ends[-1])
                yield out

    asked = rows.mapInPandas(ask, "block long, kind int, bucket int, keys binary, counts binary")
    answered = asked.repartitionById(n, "bucket").mapInPandas(answer, "block long, kind int, bucket int, counts binary, n long, tokens long, types long")
    shelved = answered.withColumn("shelf", F.pmod("block", F.lit(layout.shelves)).cast("int")).repartitionById(layout.shelves, "shelf").sortWithinPartitions("shelf", "block")
    shelved.write.option("parquet.block.size", str(2 << 20)).partitionBy("shelf").parquet(layout.uri)
    schema = "block long, kind int, bucket int, counts binary, n long, tokens long, types long, shelf int"
    sums = spark.read.schema(schema).parquet(layout.uri).filter("kind = 1").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    return sums["n"] or 0, sums["v"] or 0


def _answers(block: Block, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of a block's words and pairs."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(layout.uri)
    found: dict[tuple[int, int], np.ndarray] = {}
    for info in store.get_file_info(fs.FileSelector(f"{root}/shelf={block.digest % layout.shelves}", allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                table = pq.read_table(f, columns=["kind", "bucket", "counts", "n"], filters=[("block", "=", block.digest)]).to_pydict()
            for kind, bucket, counts, m in zip(table["kind"], table["bucket"], table["counts"], table["n"], strict=True):
                found[kind, bucket] = unpack(counts, m)
    out = []
    for kind, keys in ((1, block.words), (2, block.pairs)):
        order, begin = _by_bucket(keys, layout.buckets)
        totals = np.empty(len(keys), np.int64)
        for i in np.flatnonzero(np.diff(begin)).tolist():
            if (kind, i) not in found:
                raise RuntimeError("the documents were not read again in the same order; write them as a table first")
            totals[order[begin[i] : begin[i + 1]]] = found[kind, i]
        out.append(totals)
    return out[0], out[1]


def size_class(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole part of its count's binary logarithm."""
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)


def learn_weights(bins: pd.DataFrame, v: int, rounds: int = 60) -> np.ndarray:
    """(CLASSES, 3) weights of pair, word and uniform estimates by expectation-maximisation over binned tokens.

    bins has size_class, p2, p1 (log2 of the estimates in STEPS-ths, _ZERO for none) and weight. A class without bins
    gets the weights of the nearest class with some (of two, the smaller); class 0, contexts never seen, gives the
    share of the pairs to the words. Without any bins all mass is uniform.
    """
    weights = np.tile([0.0, 0.0, 1.0], (CLASSES, 1))
    value = lambda x: np.where(x > _ZERO, 2.0 ** (x / STEPS), 0.0)
    for c, part in bins.groupby("size_class"):
        p = np.stack([value(part["p2"].to_numpy(float)), value(part["p1"].to_numpy(float)), np.full(len(part), 1 / (v + 1))], axis=1)
        w = part["weight"].to_numpy(float)
        lam = np.array([0.4, 0.5, 0.1]) if c else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            share = p * lam
            share /= share.sum(axis=1, keepdims=True)
            lam = (share * w[:, None]).sum(axis=0) / w.sum()
        weights[int(c)] = lam * (1 - 1e-9) + np.array([0, 0, 1e-9])
    seen = np.unique(bins["size_class"].to_numpy(np.int64))
    for c in np.setdiff1d(np.arange(CLASSES), seen) if len(seen) else ():
        weights[c] = weights[seen[np.argmin(np.abs(seen - c))]]
        if not c:
            weights[c] = 0, weights[c, 0] + weights[c, 1], weights[c, 2]
    return weights


def score_documents(docs: DataFrame, train: Column, block_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text), learning from rows where train holds.

    score is the log10 probability of the text with its end mark; base_score that of add-one word counts. A null text
    is empty and has its end mark alone; repeated rows count and are scored each time; null ids are kept; an empty
    table gives no rows, and with no training rows all mass is uniform. A text longer than block_bytes is a block of
    its own. Other columns are ignored. docs must give the same rows in the same order when read again, as a table
    does: else a block finds no answer and the job says so.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    layout = plan_layout(rows, new_path(spark, "ngram-counts"), block_bytes or BLOCK_BYTES, bucket_bytes or BUCKET_BYTES)
    tokens, types = gather_counts(rows, layout)

    def logs(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1.0)) * STEPS), _ZERO).astype(np.int64)

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, layout.block_bytes):
            word, pair = _answers(b, layout)
            times = np.bincount(b.pair_at, weights=b.weight, minlength=len(b.pairs))
            first = np.full(len(b.pairs), -1)
            first[b.pair_at[::-1]] = np.arange(len(b.pair_at))[::-1]
            used = times > 0
            at = first[used]
            c1, c2, c12 = (x - 1 for x in (word[b.context_at[at]], word[b.word_at[at]], pair[used]))
            p2, p1 = logs(c12 / np.maximum(c1, 1)), logs(c2 / max(tokens - 1, 1))
            frame = pd.DataFrame({"size_class": size_class(c1), "p2": p2, "p1": p1, "weight": times[used]})
            yield frame.groupby(["size_class", "p2", "p1"], as_index=False)["weight"].sum()

    binned = rows.mapInPandas(held_out, "size_class long, p2 long, p1 long, weight double")
    # Bins, not tokens: at most CLASSES times the steps that log2 of two estimates can take.
    bins = binned.groupBy("size_class", "p2", "p1").agg(F.sum("weight").alias("weight")).orderBy("size_class", "p2", "p1").toPandas()
    weights = learn_weights(bins, types)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, layout.block_bytes):
            word, pair = _answers(b, layout)
            c1, c2 = word[b.context_at], word[b.word_at]
            lam = weights[size_class(c1)]
            p = lam[:, 0] * pair[b.pair_at] / np.maximum(c1, 1) + lam[:, 1] * c2 / max(tokens, 1) + lam[:, 2] / (types + 1)
            base = np.log10((word + 1) / (tokens + types + 1))[b.word_at]
            total = lambda x, b=b: np.add.reduceat(x, b.starts[:-1])
            yield pd.DataFrame({"doc_id": pd.array(b.doc_ids, dtype="Int64"), "n_tokens": np.diff(b.starts), "n_known": total((c2 > 0).astype(np.int64)), "train_tokens": tokens, "base_score": total(base), "score": total(np.log10(p))})

    return rows.mapInPandas(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
