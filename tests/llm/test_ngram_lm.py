import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectrafleet.llm import ngram_lm


def words(text):
    for c in "\t\n\r\x0b\x0c":
        text = text.replace(c, " ")
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if w] + ["\0end"]


def rows():
    rng = random.Random(3)
    chain = {i: rng.sample(range(60), 4) for i in range(60)}
    out = []
    for d in range(120):
        at, text = rng.randrange(60), []
        for _ in range(rng.randrange(0, 120)):
            text.append(f"W{at}é" if at % 3 else f"w{at}")
            at = rng.choice(chain[at])
        out.append((d, " ".join(text) + ("　x\x1cy z" if d % 9 == 0 else "")))
    return out + [(500, None), (501, "new words only"), (None, "no id w1"), (5, "again w1"), (5, "again w1")]


@pytest.mark.parametrize(("block", "bucket"), [(1 << 24, 1 << 24), (700, 1000)])
def test_scores_match_plain_counts(spark, block, bucket):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in data], "doc_id long, text string, train int, n_tokens int").repartition(3, "text")
    from spectrafleet.llm._shared import materialize

    docs = materialize(docs, "docs")
    got = ngram_lm.score_documents(docs, F.col("doc_id") % 4 != 1, block, bucket).collect()
    train = [words(t or "") for i, t in data if i is not None and i % 4 != 1]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["\0end", *t], t))
    n, v = sum(c.values()), len(c)
    bins = Counter()
    cls = lambda x: int(math.log2(x)) + 1 if x > 0 else 0
    lg = lambda p: round(math.log2(p) * 4) if p > 0 else ngram_lm._ZERO
    for (a, b), k in pairs.items():
        bins[cls(c[a] - 1), lg((pairs[a, b] - 1) / max(c[a] - 1, 1)), lg((c[b] - 1) / (n - 1))] += k
    lam = ngram_lm.learn_weights(pd.DataFrame([(*k, w) for k, w in sorted(bins.items())], columns=["size_class", "p2", "p1", "weight"]), v)
    want = []
    for i, t in data:
        w = words(t or "")
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        s = sum(math.log10(lam[cls(c[a])][0] * pairs[a, b] / max(c[a], 1) + lam[cls(c[a])][1] * c[b] / n + lam[cls(c[a])][2] / (v + 1)) for a, b in zip(["\0end", *w], w))
        want.append((i, len(w), sum(c[x] > 0 for x in w), n, base, s))
    key = lambda r: (str(r[0]), r[1], r[4])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 4 == 1 and r["n_tokens"] > 20]
    assert held and all(r["score"] > r["base_score"] for r in held)
    probability = sum(lam[cls(c["w3"])][0] * pairs["w3", x] / c["w3"] + lam[cls(c["w3"])][1] * c[x] / n + lam[cls(c["w3"])][2] / (v + 1) for x in c) + lam[cls(c["w3"])][2] / (v + 1)
    assert abs(probability - 1) < 1e-6


def test_no_rows_and_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ngram_lm.score_documents(docs.limit(0), F.lit(True)).count() == 0
    (row,) = ngram_lm.score_documents(docs, F.lit(False)).collect()
    assert row["train_tokens"] == 0 and row["n_tokens"] == 3 and row["n_known"] == 0 and row["score"] <= 0


def test_classes_without_counts_follow_their_neighbours():
    bins = pd.DataFrame({"size_class": [3, 3, 6], "p2": [-4, ngram_lm._ZERO, -8], "p1": [-40, -20, -30], "weight": [5.0, 2.0, 3.0]})
    w = ngram_lm.learn_weights(bins, 100)
    assert np.allclose(w.sum(axis=1), 1) and (w[1] == w[3]).all() and (w[4] == w[3]).all() and (w[5] == w[6]).all() and (w[47] == w[6]).all()
    assert w[0, 0] == 0 and w[0, 1] == w[3, 0] + w[3, 1]
    assert (ngram_lm.learn_weights(bins.iloc[:0], 100) == [0, 0, 1]).all()


def test_rows_in_another_order_are_reported(spark):
    other = F.udf(lambda i: f"a{i} {random.random()}").asNondeterministic()
    docs = spark.range(50).select(F.col("id").alias("doc_id"), other("id").alias("text"))
    with pytest.raises(Exception, match="same order"):
        ngram_lm.score_documents(docs, F.lit(True), 60).collect()


def test_packed_counts_round_trip():
    x = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert ngram_lm.unpack(ngram_lm.pack(x), len(x)).tolist() == x.tolist()
