"""Token-id output: flat unsigned integer files with 64-bit document offsets, read back by memory map.

A directory holds, for each partition P in ascending doc_id order:
  part-P.bin  the documents' ids one after another, little-endian unsigned, 2 bytes if the vocabulary fits, else 4
  part-P.idx  b"FLATIDS1", then little-endian int64: bytes per id, documents n, base; doc_id[n]; offset[n + 1]
Offsets count ids from the start of the whole collection: a partition's base is the prefix sum of the partitions
before it. A missing doc_id is stored as the least int64.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches
from .encoding import Encoder

MAGIC, NO_ID = b"FLATIDS1", np.iinfo(np.int64).min


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(store, path: str, temporary: str) -> None:
    """Give a finished file its name; an earlier attempt's file with the same content may be there."""
    from pyarrow import fs

    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_file(path)
    store.move(temporary, path)


def write_token_files(docs: DataFrame, tokenizer_path: str, out_uri: str, end_id: int) -> DataFrame:
    """Write docs (doc_id, text) and return the manifest: part, n_docs, n_ids, base (one row per partition written).

    Documents come in ascending doc_id order (null first, ties by a digest of the text); repeated rows are written
    again each time. A null text is empty: its ids are end_id alone. A text of any length is one row of its task. Rows
    without a doc_id, or with the same one, are dealt to as many partitions as they fill. An empty table writes no file. A task writes under a name of its
    own attempt and renames at the end, so a retried or speculative task leaves the same files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    store, root = _store(out_uri)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(out_uri)
        task = TaskContext.get()
        part, mark = task.partitionId(), f"{task.partitionId():06d}.{task.taskAttemptId()}"
        encoder = Encoder.load(tokenizer_path)
        ids, lengths, out = [], [], None
        for pdf in batches:
            out = out or store.open_output_stream(f"{root}/{mark}.bin")
            tokens, sizes = encoder.encode_flat(pdf["text"].tolist(), end_id)
            out.write(tokens.tobytes())
            lengths.append(sizes)
            ids.append(pdf["doc_id"].to_numpy(np.int64))
        if out is None:
            return
        out.close()
        lengths, ids = np.concatenate(lengths), np.concatenate(ids)
        _put(store, f"{root}/part-{part:06d}.bin", f"{root}/{mark}.bin")
        with store.open_output_stream(f"{root}/{mark}.len") as f:
            f.write(np.array([encoder.dtype.itemsize, len(ids)], "<i8").tobytes() + ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes())
        _put(store, f"{root}/part-{part:06d}.len", f"{root}/{mark}.len")
        yield pd.DataFrame({"part": [part], "n_docs": [len(ids)], "n_ids": [int(lengths.sum())]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # What is equal in doc_id and text is told apart by where it was read, so that no key fills a partition alone.
    keyed = rows.withColumn("digest", F.xxhash64("text")).withColumn("read_in", F.spark_partition_id())
    written = keyed.repartitionByRange("doc_id", "digest", "read_in").sortWithinPartitions("doc_id", "digest").select("doc_id", "text").mapInPandas(write, "part int, n_docs long, n_ids long")
    parts = sorted(written.collect())  # one small row for each partition
    bases = [0, *accumulate(p["n_ids"] for p in parts)]
    manifest = spark.createDataFrame([(p["part"], p["n_docs"], p["n_ids"], b) for p, b in zip(parts, bases, strict=False)], "part int, n_docs long, n_ids long, base long")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(out_uri)
        for pdf in batches:
            for part, base in zip(pdf["part"], pdf["base"], strict=True):
                with store.open_input_file(f"{root}/part-{part:06d}.len") as f:
                    width, n, *rest = np.frombuffer(f.read(), "<i8").tolist()
                offsets = base + np.concatenate([[0], np.cumsum(rest[n:], dtype=np.int64)])
                mark = f"{root}/{part:06d}.{TaskContext.get().taskAttemptId()}.idx"
                with store.open_output_stream(mark) as f:
                    f.write(MAGIC + np.array([width, n, base, *rest[:n]], "<i8").tobytes() + offsets.astype("<i8").tobytes())
                _put(store, f"{root}/part-{part:06d}.idx", mark)
            yield pdf[["part"]]

    def clear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(out_uri)
        for pdf in batches:
            for part in pdf["part"]:
                if store.get_file_info(path := f"{root}/part-{part:06d}.len").type != FileType.NotFound:
                    store.delete_file(path)
            yield pdf[["part"]]

    if parts:
        from pyarrow.fs import FileType

        dealt = manifest.repartition(min(len(parts), 4096), "part")
        for step in (index, clear):  # lengths go when all offsets are written, as a lost task may need them again
            dealt.mapInPandas(step, "part int").agg(F.count(F.lit(1))).collect()
    return manifest


def read_token_files(manifest: DataFrame, out_uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the memory-mapped files of a manifest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf["part"]:
                doc_ids, offsets, ids = open_part(out_uri, part)
                base = int(offsets[0])
                for lo in range(0, len(doc_ids), 4096):
                    hi = min(lo + 4096, len(doc_ids))
                    cuts = offsets[lo : hi + 1]
                    crcs = [zlib.crc32(ids[a - base : b - base].astype("<u4").tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    found = pd.array(doc_ids[lo:hi], dtype="Int64")
                    found[doc_ids[lo:hi] == NO_ID] = pd.NA
                    yield pd.DataFrame({"doc_id": found, "start": cuts[:-1], "n_tokens": np.diff(cuts), "ids_crc32": np.array(crcs, np.int64)})

    return manifest.select("part").repartition("part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def open_part(out_uri: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, offsets, ids) of a partition; ids are a memory map where the files are local, else read."""
    import pyarrow as pa
    from pyarrow import fs

    store, root = _store(out_uri)
    is_local = isinstance(store, fs.LocalFileSystem)

    def load(name: str):
        path = f"{root}/part-{part:06d}.{name}"
        if not is_local:
            with store.open_input_file(path) as f:
                return f.read_buffer()
        with pa.memory_map(path) as f:
            return f.read_buffer()

    head = load("idx")
    if head[:8].to_pybytes() != MAGIC:
        raise ValueError(f"part {part} of {out_uri} isn't a token index")
    width, n, _, *_ = np.frombuffer(head[8:32], "<i8")
    numbers = np.frombuffer(head[32:], "<i8")
    return numbers[:n], numbers[n : 2 * n + 1], np.frombuffer(load("bin"), f"<u{width}")
