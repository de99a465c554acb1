import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from spectrafleet.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, top):
    docs = [(lang or "", source or "", [t.translate(LOW) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    groups = sorted({(lang, source) for lang, source, _ in docs})
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in df[lang].items() if k >= min_docs]
        own = [g for g in groups if g[0] == lang]
        share = lambda c, total, v=len(kept): 1 + 1_000_000_000 * (c + 5) // (total + 5 * v)
        total = {g: sum(n[g][t] for t in kept) for g in own}
        p = {g: {t: share(n[g][t], total[g]) for t in kept} for g in own}
        q = {t: share(sum(n[g][t] for g in own), sum(total.values())) for t in kept}
        for g in own:
            pair = [(sum(abs(p[g][t] - p[h][t]) for t in kept), h[1]) for h in own if h != g]
            term = [(p[g][t] - q[t], t) for t in kept if n[g][t] > 0 and p[g][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if rank <= most:
                        out.add((*g, part, item, value, rank))
    return out


def rows(seed=3, docs=140):
    rng = random.Random(seed)
    words = ["Über", "über", "a", "A", "bé", "x1y", "日本", "Z"] + [f"w{chr(97 + i)}" for i in range(18)]
    out = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "S2", None, "s10"]), " ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=rng.randrange(0, 40))) + rng.choice(["", "!", "\x7f9"])) for _ in range(docs)]
    return out + [out[0], out[0], ("en", "only here", ""), ("fr", "x", "rare"), ("fr", "y", None), (None, "s2", "7 8 9")]


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(data)], "lang string, source string, text string, n long, term string").repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, 8, 6).collect()]
    want = brute(data, 8, 6)
    assert len(got) == len(want) and set(got) == want
    assert {r[2] for r in got} == {"pair", "term"} and ("fr", "x", "pair", "y", 0, 1) in want


def test_with_few_pairs_and_terms_at_a_time_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    data = rows(5, 90)
    docs = spark.createDataFrame(data, "lang string, source string, text string")
    assert {tuple(r) for r in divergence.audit(docs, 4, 50).collect()} == brute(data, 4, 50)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Abc-de ä" * 50 + "longterm" * 9 + " x").encode()
    want = Counter(t.translate(LOW).encode() for t in TERM.findall(text.decode()))
    for size in (1, 2, 7, 64, 10_000):
        monkeypatch.setattr(divergence, "PIECE_BYTES", size)
        assert sum((Counter(p) for p in divergence.pieces_of(text)), Counter()) == want


def test_tasks_hand_on_what_they_hold(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 3)
    data = [("en", "a", "x y x z"), ("en", "b", "q"), ("en", "a", "x w"), ("en", "a", "")]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*data, strict=True)], ["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for out in divergence._count_terms([batch]):
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert n["a", "x"] == 3 and docs["a", "x"] == 2 and n["b", "q"] == docs["b", "q"] == 1 and sum(n.values()) == 7


def test_tallies_do_not_depend_on_how_many_are_held(monkeypatch):
    cells = [[{"source": s, "n": n} for s, n in c] for c in ([("a", 1), ("b", 2), ("c", 2)], [("a", 1), ("b", 2)], [("c", 9)], [], [("b", 7), ("c", 1)])]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en", "de", "de", "de"]), pa.array(cells, pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))], ["lang", "cells"])
    for held in (0, 100):
        monkeypatch.setattr(divergence, "HELD_PAIRS", held)
        out = Counter()
        for b in divergence._tally([batch]):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["other"], r["a"], r["b"]] += r["times"]
        assert out == {("en", "a", "b", 1, 2): 2, ("en", "a", "c", 1, 2): 1, ("en", "b", "c", 2, 2): 1, ("de", "b", "c", 7, 1): 1}


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string, x int")).count() == 0


def test_query_against_brute_force(spark):
    from spectrafleet.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "source", "text").collect()
    got = [tuple(r) for r in QUERIES["op13_joint_histograms"](spark, "/root/testdata/sf0.001").select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute([tuple(r) for r in docs], 30, 50)
    assert len(got) == len(want) and set(got) == want
