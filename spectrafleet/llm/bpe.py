"""BPE encoding with reuse of content-defined chunks, and decoding.

1. A rolling hash over 32 bytes cuts every text into chunks, at places that depend on the nearby bytes alone, so a
   passage that many documents share gives the same chunks in each. Chunks are counted by their 128-bit digest.
2. A chunk that occurs more than once is encoded once, wherever it stands; what lies between such chunks is encoded
   in its own document's task.
3. Joins are repaired. The tokenizer cuts at white space before any merge, so ids can differ from the whole text's
   only in the word that straddles a join. That word, from the last white space before the join to the first after
   it (over as many chunks as that takes), is encoded again and replaces the chunks' own ids for it. The ids on both
   sides then agree with the whole text's by construction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bit_filter, bounded_batches, materialize
from .encoding import Encoder

#: Mean chunk length is about 2**CUT_BITS bytes past MIN_CHUNK.
CUT_BITS, MIN_CHUNK = 9, 128
_MULTIPLIER = 0x9E3779B1
_SPACE = re.compile(r"[ \t\n\r]")


def _mixed(n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(16)).astype(np.uint32)


_BYTE = _mixed(256)


def chunk(data: bytes) -> list[bytes]:
    """Content-defined chunks of UTF-8 text; each is valid UTF-8."""
    if len(data) <= MIN_CHUNK:
        return [data] if data else []
    raw = np.frombuffer(data, np.uint8)
    h, power = _BYTE[raw], _MULTIPLIER
    for w in (1, 2, 4, 8, 16):  # a window of 2w from two of w
        wider = h.copy()
        wider[w:] += h[:-w] * np.uint32(power)
        h, power = wider, power * power & 0xFFFFFFFF
    ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at, n = [], 0, len(data)
    for e in ends.tolist():
        if e - at < MIN_CHUNK:
            continue
        while e < n and raw[e] & 0xC0 == 0x80:
            e += 1
        if e >= n:
            break
        out.append(data[at:e])
        at = e
    out.append(data[at:])
    return out


def _keys(c: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(c)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def encoded_pieces(encoder: Encoder, texts: list[str], ids: list[bytes] | None = None) -> list[tuple]:
    """(ids, head, head_n, tail, tail_n, solid) of each text: the word parts at both ends, with how many ids are theirs."""
    ids = encoder.encode_many(texts) if ids is None else ids
    cuts = []
    for text in texts:
        first = _SPACE.search(text)
        cuts.append((text[: first.start()], text[max(text.rfind(x) for x in " \t\n\r") + 1 :]) if first else None)
    ends = [x for c in cuts if c for x in c]
    sizes = iter([len(x) // encoder.dtype.itemsize for x in encoder.encode_many(ends)])
    return [(i, c[0], next(sizes), c[1], next(sizes), False) if c else (i, t, 0, "", 0, True) for i, t, c in zip(ids, texts, cuts, strict=True)]


def encoded_piece(encoder: Encoder, text: str) -> tuple:
    return encoded_pieces(encoder, [text])[0]


def join_many(encoder: Encoder, documents: list[list[tuple]]) -> list[bytes]:
    """The ids of each text, from the pieces that make it up; the words that straddle joins are encoded again, all together."""
    width, straddling, parts = encoder.dtype.itemsize, [], []
    for pieces in documents:
        word, out = "", []
        for ids, head, head_n, tail, tail_n, solid in pieces:
            if solid:
                word += head
                continue
            if word:
                out.append(len(straddling))
                straddling.append(word + head)
            out.append(ids[head_n * width if word else 0 : len(ids) - tail_n * width])
            word = tail
        if word:
            out.append(len(straddling))
            straddling.append(word)
        parts.append(out)
    repaired = encoder.encode_many(straddling)
    return [b"".join([repaired[x] if isinstance(x, int) else x for x in out]) for out in parts]


def join_pieces(encoder: Encoder, pieces: list[tuple]) -> bytes:
    return join_many(encoder, [pieces])[0]


def ids_of(encoder: Encoder, documents: list[bytes]) -> list[tuple]:
    return [(np.frombuffer(ids, encoder.dtype).astype("<u4").tobytes(),) for ids in documents]


def encode_documents(docs: DataFrame, tokenizer_path: str, finish: Callable[[Encoder, list[bytes]], list[tuple]] = ids_of, finish_schema: str = "ids binary", filter_bits: int = 1 << 23) -> DataFrame:
    """doc_id and finish_schema's columns for every row of docs (doc_id, text; other columns are ignored).

    finish(encoder, [ids of a document, ...]) runs where documents' ids are complete; the default returns them as
    little-endian unsigned 32-bit integers. A text of any length is one row of its task. filter_bits bounds what is broadcast: a bit filter of the shared chunks' digests. When
    it fills up, more chunks take the shared path and the ids stay the same. A null text is empty and gives no ids;
    null and repeated doc_ids give one row for each input row; an empty table gives no rows.
    """
    if Encoder.load(tokenizer_path).keeps_space:
        raise ValueError("chunk joins are repaired for tokenizers that drop white space only")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = [x.strip().split(" ")[0] for x in finish_schema.split(",")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = Counter(_keys(c) for t in pdf["text"] for c in chunk(t.encode()))
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["h1", "h2", "n"]).astype({"h1": "int64", "h2": "int64", "n": "int64"})

    shared = texts.select("text").mapInPandas(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1")
    mask_b = spark.sparkContext.broadcast(bit_filter(shared.select(F.explode(F.array("h1", "h2"))), filter_bits))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, bitmap, task = Encoder.load(tokenizer_path), mask_b.value, TaskContext.get()
        has = lambda h: bitmap[(h % filter_bits) >> 3] >> (h % filter_bits & 7) & 1
        sent: set[tuple[int, int]] = set()
        at = task.taskAttemptId() << 32
        for pdf in batches:
            rows, spans = [], []
            for doc_id, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"], strict=True):
                at += 1
                seq, own = 0, []
                parts = []
                for c in chunk(text.encode()):
                    k = _keys(c)
                    if has(k[0]) and has(k[1]):
                        if own:
                            parts.append((None, b"".join(own)))
                            own = []
                        parts.append((k, c))
                    else:
                        own.append(c)
                if not parts:
                    spans.append((doc_id, at, -1, text))
                    continue
                if own:
                    parts.append((None, b"".join(own)))
                for seq, (k, c) in enumerate(parts):
                    if k is None:
                        spans.append((doc_id, at, seq, c.decode()))
                    else:
                        new = k not in sent
                        if new:
                            if len(sent) > 500_000:
                                sent.clear()
                            sent.add(k)
                        rows.append((doc_id, at, seq, *k, c.decode() if new else None, *[None] * 6, *[None] * len(names)))
            encoded = encoder.encode_many([s[3] for s in spans])
            done = iter(finish(encoder, [i for s, i in zip(spans, encoded, strict=True) if s[2] < 0]))
            between = iter(encoded_pieces(encoder, [s[3] for s in spans if s[2] >= 0], [i for s, i in zip(spans, encoded, strict=True) if s[2] >= 0]))
            for doc_id, n, seq, _ in spans:
                rows.append((doc_id, n, seq, *[None] * 9, *next(done)) if seq < 0 else (doc_id, n, seq, None, None, None, *next(between), *[None] * len(names)))
            yield _frame(rows, ["doc_id", "row", "seq", "h1", "h2", "text", "ids_", "head", "head_n", "tail", "tail_n", "solid", *names])

    schema = f"doc_id long, row long, seq int, h1 long, h2 long, text string, ids_ binary, head string, head_n int, tail string, tail_n int, solid boolean, {finish_schema}"
    table = materialize(texts.mapInPandas(split, schema), "bpe-pieces")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.load(tokenizer_path)
        for pdf in batches:
            got = encoded_pieces(encoder, pdf["text"].tolist())
            yield _frame([(h1, h2, *p) for h1, h2, p in zip(pdf["h1"], pdf["h2"], got, strict=True)], ["h1", "h2", "ids_", "head", "head_n", "tail", "tail_n", "solid"])

    once = table.filter("text is not null").select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    encoded = once.mapInPandas(encode, "h1 long, h2 long, ids_ binary, head string, head_n int, tail string, tail_n int, solid boolean")
    part = ["seq", "ids_", "head", "head_n", "tail", "tail_n", "solid"]
    refs = table.filter("h1 is not null").select("doc_id", "row", "seq", "h1", "h2").join(encoded, ["h1", "h2"]).select("doc_id", "row", F.struct(*part).alias("p"))
    own = table.filter("h1 is null and seq >= 0").select("doc_id", "row", F.struct(*part).alias("p"))
    gathered = refs.unionByName(own).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("p")).alias("pieces"))

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.load(tokenizer_path)
        for pdf in batches:
            got = join_many(encoder, [[(p["ids_"], p["head"], p["head_n"], p["tail"], p["tail_n"], p["solid"]) for p in pieces] for pieces in pdf["pieces"]])
            ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
            rows = [(i, *x) for i, x in zip(ids, finish(encoder, got), strict=True)]
            yield _frame(rows, ["doc_id", *names])

    done = table.filter("seq < 0").select("doc_id", *names)
    return done.unionByName(gathered.select("doc_id", "pieces").mapInPandas(assemble, f"doc_id long, {finish_schema}"))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text: what the tokenizer's decode(ids, skip_special_tokens=False) gives for ids (little-endian uint32)."""
    bounded_batches(encoded.sparkSession)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Encoder.load(tokenizer_path).tokenizer
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [tokenizer.decode(np.frombuffer(b, "<u4").tolist(), skip_special_tokens=False) for b in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(decode, "doc_id long, text string")
