"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE_WORDS words, all of them. Each passage is described by counts over its bytes
and words and encoded as h = tanh(W x + b); gated attention weighs the passages, a = softmax(w . (tanh(V h) *
sigmoid(U h))), and the score is the logistic of the weighted passage sum. All weights are learned together from
document labels alone. Fitting takes a bounded sample of labelled documents; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, spare
from .hashing import NON_SPACE, slices, span_hashes, word_spans

PASSAGE_WORDS, BUCKETS, CLASSES, HIDDEN, GATE = 64, 256, 9, 24, 12
EXTRA = 6
WIDTH = BUCKETS + CLASSES * CLASSES + EXTRA
THRESHOLD = 0.7
#: The default bound of the labelled sample that is fitted on the driver, about 60 MB of passage features.
MAX_FIT_DOCS = 4000
#: A fitted document gives so many passages at most, evenly spread over its length; scoring reads all of them.
MAX_FIT_PASSAGES = 64


def _byte_classes() -> np.ndarray:
    out = np.full(256, 8, np.int64)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c.isspace() else 5 if c in ".,;:'\"-()" else 6 if c in "!?" else 7
    return out


_CLASS = _byte_classes()


#: What follows a text's last byte, for its last grams: the same for all.
_PAD = b"\n\n"
#: A longer text's passages are described so many bytes at a time: features take some hundred times a text's memory.
LONG_BYTES = 1 << 19


def _features(blob: bytes, edges: np.ndarray, whole_words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """passage_features() of texts that end at edges of blob, each followed by two bytes; whole_words if there is one, a piece of a text of so many words."""
    raw = np.frombuffer(blob, np.uint8).astype(np.int64)
    starts, ends = word_spans(blob, NON_SPACE)
    if whole_words is not None:
        inside = starts < edges[-1] - len(_PAD)  # a word may begin in what follows
        starts, ends = starts[inside], ends[inside]
    first = np.searchsorted(starts, edges)
    words = np.diff(first)
    texts = len(words)
    n = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(texts), words)
    passage = base[owner] + (np.arange(len(owner)) - first[owner]) // PASSAGE_WORDS
    total = int(base[-1])
    # A byte belongs to the passage of the word it is in or after, bytes before the first word to the first passage.
    at = np.repeat(np.arange(texts), np.diff(edges))
    own = np.ones(len(raw), bool)
    own[edges[1:] - 1] = own[edges[1:] - 2] = False
    last = np.searchsorted(starts, np.arange(len(raw)), side="right") - 1
    known = (last >= 0) & (last >= first[at])
    byte_passage = np.where(known, passage[np.maximum(last, 0)] if len(passage) else 0, base[at])
    byte_passage = byte_passage[own]
    size = np.bincount(byte_passage, minlength=total).astype(float)
    kind = _CLASS[raw]
    gram = (raw * 65599 + np.roll(raw, -1) * 31 + np.roll(raw, -2) * 7919) * 40503 >> 7 & BUCKETS - 1
    gram, change = gram[own], (kind * CLASSES + np.roll(kind, -1))[own]
    grams = np.bincount(byte_passage * BUCKETS + gram, minlength=total * BUCKETS).reshape(total, BUCKETS)
    steps = np.bincount(byte_passage * CLASSES**2 + change, minlength=total * CLASSES**2).reshape(total, CLASSES**2)
    hashes = span_hashes(blob, starts, ends)
    n_words = np.bincount(passage, minlength=total).astype(float)
    pairs = passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ hashes
    distinct, where = np.unique(pairs, return_index=True)
    kinds = np.bincount(passage[where], minlength=total).astype(float)
    same = np.zeros(total)
    if len(passage) > 1:
        again = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        same = np.bincount(passage[1:][again], minlength=total).astype(float)
    lengths = np.bincount(passage, weights=ends - starts, minlength=total)
    some = np.maximum(n_words, 1)
    extra = np.stack([kinds / some, same / some, lengths / some / 10, np.log1p(n_words), np.log1p(words if whole_words is None else np.array([whole_words]))[np.repeat(np.arange(texts), n)], (n_words == 0).astype(float)], axis=1)
    share = np.maximum(size, 1)[:, None]
    return np.concatenate([np.sqrt(grams / share), np.sqrt(steps / share), extra], axis=1).astype(np.float32), n


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage of every text, number of passages of each text); an empty text is one blank passage."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    out, counts = [], []
    for lo, hi in slices([len(d) for d in data]):
        x, n = _features(_PAD.join(data[lo:hi]) + _PAD, np.cumsum([0, *(len(d) + len(_PAD) for d in data[lo:hi])]))
        out.append(x)
        counts.append(n)
    if not out:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(counts)


def feature_pieces(text: str) -> Iterator[np.ndarray]:
    """The features of a text's passages, those of about LONG_BYTES at a time and cut at passages: the same as of the whole."""
    data = text.encode("utf-8", "surrogatepass")
    starts, _ = word_spans(data, NON_SPACE)
    words, firsts = len(starts), starts[::PASSAGE_WORDS][1:]  # where passages but the first begin
    del starts
    at = 0
    while True:
        k = np.searchsorted(firsts, at + LONG_BYTES)
        end = int(firsts[k]) if k < len(firsts) else len(data)
        follows = data[end : end + len(_PAD)]
        piece = data[at:end] + follows + _PAD[len(follows) :]
        yield _features(piece, np.array([0, len(piece)]), words)[0]
        if end == len(data):
            return
        at = end


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        starts = np.cumsum(counts) - counts
        z, h, t, s, e = self.encode(x)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        bag = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-(bag @ p["c"] + p["d"])))
        return {"z": z, "h": h, "t": t, "s": s, "a": a, "bag": bag, "y": y, "starts": starts}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """z, h, t, s and e of passages: standardised features, codes, the two halves of the gate, and its logits."""
        p = self.weights
        z = np.clip((x - p["mean"]) / p["scale"], -6, 6)
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return z, h, t, s, (t * s) @ p["w"]

    def score_long(self, text: str) -> tuple[float, int]:
        """(score, number of passages) of one text, of which codes and logits are held, but not features."""
        p = self.weights
        held = [(h, e) for x in feature_pieces(text) for _, h, _, _, e in [self.encode(x)]]
        h, e = (np.concatenate(k).astype(np.float64) for k in zip(*held, strict=True))
        a = np.exp(e - e.max())
        bag = (a / a.sum()) @ h
        return float(1 / (1 + np.exp(-(bag @ p["c"] + p["d"])))), len(e)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of passages) of each text."""
        out = [(np.zeros(0), np.zeros(0, np.int64))]
        for lo, hi in slices([len(t) for t in texts], 1 << 18):  # features take many times the text's memory
            if hi == lo + 1 and len(texts[lo]) > LONG_BYTES:
                y, n = self.score_long(texts[lo])
                out.append((np.array([y]), np.array([n], np.int64)))
                continue
            x, counts = passage_features(texts[lo:hi])
            out.append((self.forward(x, counts)["y"].astype(np.float64), counts))
        return np.concatenate([y for y, _ in out]), np.concatenate([n for _, n in out])


def gradients(p: dict[str, np.ndarray], f: dict[str, np.ndarray], n: np.ndarray, dy: np.ndarray) -> dict[str, np.ndarray]:
    """Of a loss whose derivatives by the bags' logits are dy, by every weight; f is forward() of bags of n passages."""
    g = {"c": f["bag"].T @ dy, "d": dy.sum()}
    dbag = np.repeat(dy[:, None] * p["c"], n, axis=0)
    da = (dbag * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), n))
    dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
    g |= {"w": (f["t"] * f["s"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ ds}
    dh = (f["a"][:, None] * dbag + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
    return g | {"W": f["z"].T @ dh, "b": dh.sum(axis=0)}


def fit_bags(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, epochs: int = 16, batch: int = 64, rate: float = 0.004, decay: float = 3e-3, seed: int = 7) -> Model:
    """Adam on the logistic loss, with gradients through the attention."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    prior = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    p = {"mean": x.mean(axis=0) if len(x) else np.zeros(WIDTH, np.float32), "scale": (x.std(axis=0) if len(x) else np.ones(WIDTH, np.float32)) + 0.01}
    p |= {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.array(np.log(prior / (1 - prior)), np.float32)}
    model, moving = Model(p), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items() if k not in ("mean", "scale")}
    begins, step = np.cumsum(counts) - counts, 0
    for _ in range(epochs if len(counts) else 0):
        for lo in range(0, len(counts), batch):
            pick = order[lo : lo + batch] if lo else (order := rng.permutation(len(counts)))[:batch]
            n = counts[pick]
            rows = np.concatenate([np.arange(begins[i], begins[i] + counts[i]) for i in pick])
            f = model.forward(x[rows], n)
            dy = ((f["y"] - labels[pick]) / len(pick)).astype(np.float32)
            g = gradients(p, f, n, dy)
            step += 1
            for k, (m, v) in moving.items():
                grad = g[k] + (decay * p[k] if p[k].ndim else 0)
                m[...] = 0.9 * m + 0.1 * grad
                v[...] = 0.999 * v + 0.001 * grad**2
                p[k] = (p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def sampled_passages(text: str, most: int) -> np.ndarray:
    """Features of a text's passages, or of most of them, evenly spread."""
    pieces = [x.astype(np.float16) for x in feature_pieces(text)] if len(text) <= LONG_BYTES else None
    if pieces is not None:
        (x,) = pieces if len(pieces) == 1 else [np.concatenate(pieces)]
        return x[np.arange(most) * len(x) // most] if len(x) > most else x
    total = sum(len(x) for x in feature_pieces(text))
    wanted = np.arange(most) * total // most if total > most else np.arange(total)
    out, before = [], 0
    for x in feature_pieces(text):
        mine = wanted[(wanted >= before) & (wanted < before + len(x))] - before
        out.append(x[mine].astype(np.float16))
        before += len(x)
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS, max_passages: int = MAX_FIT_PASSAGES) -> Model:
    """Learn from labels (doc_id, label 0 or 1) of docs (doc_id, text).

    At most max_docs labelled documents are used, those whose doc_id hashes lowest: the sample is the same on every
    run and independent of the text. Of a text of more than max_passages passages, that many are used, evenly spread,
    which bounds what reaches the driver (max_docs * max_passages * WIDTH * 2 bytes at most). Null labels and ids are left out; a repeated doc_id counts once, with its
    greatest label and text. Without labelled documents every score is 0.5 or so.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # at most max_docs rows

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spread = [sampled_passages(t, max_passages) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [c.tobytes() for c in spread]})

    rows = texts.groupBy("doc_id", "label").agg(F.max("text").alias("text")).mapInPandas(describe, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in rows["x"].to_pylist()]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, WIDTH), np.float32)
    return fit_bags(x, np.array([len(b) for b in bags], np.int64), rows["label"].to_numpy().astype(np.float32))


def add_scores(docs: DataFrame, model: Model, score: str = "score", passages: str = "n_passages") -> DataFrame:
    """docs with a score (0 to 1) and the number of passages of each row's whole text, of any length.

    A long text is described piece by piece: a task holds some thirty bytes for each of its words.

    Null texts score as empty ones, repeated rows and rows of equal texts score alike, an empty table gives no rows.
    Columns of docs that have the new ones' names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(score, passages)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, n = shared.value.score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64()), pa.array(n, pa.int64())], [*batch.schema.names, score, passages])

    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(passages, T.LongType())])
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    score, passages = spare(docs, "_score", "_passages")
    return add_scores(docs, model, score, passages).filter(F.col(score) >= threshold).select(*docs.columns)
