import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spectrafleet.llm import decontaminate, simhash
from spectrafleet.llm._shared import connected_components


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "Ünï CODE wörds x x x x x", "a\x0bb\x1cc d　e", "w " * 500])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def groups(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {v: find(v) for v in values}


def test_links_have_the_components_of_all_pairs(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 6])):
            fps.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_duplicate_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    brute = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert groups(signed, [(r["a"], r["b"]) for r in links]) == groups(signed, brute)


def test_near_duplicates_on_rows(spark):
    rng = random.Random(8)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(99)) for _ in range(300)]
    rows = [(5, " ".join(base)), (3, " ".join(base).upper()), (9, " ".join(base) + " end"), (7, None), (6, ""), (8, "other words here now"), (8, "other words here now"), (None, " ")]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, fp int, component int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    fps = {i: slow_fingerprint(t or "") for i, t in rows}
    near = [(a, b) for a in fps for b in fps if a is not None and b is not None and a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    parts = groups([i for i in fps if i is not None], near) | {None: 6}
    assert got == sorted(((i, f"{fps[i]:016x}", parts[i]) for i, _ in rows), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def five_word_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike_groups(rows):
    """Rows' indexes -> the least index of the group that likeness 0.8 links."""
    sets = [five_word_shingles(t) for _, t in rows]
    same = lambda a, b: len(a & b) * 5 >= 4 * len(a | b)
    return groups(range(len(rows)), [(i, j) for j in range(len(rows)) for i in range(j) if same(sets[i], sets[j])])


def survivors(rows):
    """(doc_id, text) that stay: of each group the smallest doc_id, nulls last; repeated rows once."""
    best = {}
    for i, g in alike_groups(rows).items():
        key = (rows[i][0] is None, rows[i][0] or 0)
        best[g] = min(best.get(g, key), key)
    return best


@pytest.mark.parametrize(("bits", "crowd"), [(64, 128), (1 << 16, 4)])
def test_deduplicate_against_all_pairs(spark, monkeypatch, bits, crowd):
    from spectrafleet.llm import _shared

    monkeypatch.setattr(simhash, "CROWD", crowd)

    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 100
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 300]))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    hub = [rng.choice(words) for _ in range(200)]
    rows += [(1000 + i, " ".join(hub[:i] + ["new"] + hub[i:])) for i in range(0, 120, 2)]  # a large group of near copies
    rows += [(5, None), (6, ""), (7, " \n"), (None, "\t"), (8, "One  two"), (9, "one TWO"), (10, "one two three"), (None, rows[0][1]), (11, "twice the same row"), (11, "twice the same row"), (11, "another text of that id"), (None, "alone without any id"), (12, "z " * 20_000)]
    monkeypatch.setattr(_shared, "ROW_FILTER_BITS", bits)
    docs = spark.createDataFrame([(i, t, "x", 1, 2, True) for i, t in rows], "doc_id long, text string, _its_id string, digest int, node int, keep boolean").repartition(5)
    got = simhash.deduplicate(docs)
    assert got.dtypes == docs.dtypes
    kept = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(survivors(rows).values())
    assert {(r["doc_id"], r["text"]) for r in kept} <= set(rows)
    assert simhash.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [2, 16])
def test_crowded_cells_lose_no_link(spark, monkeypatch, crowd):
    """Pairs and chains of alike texts hidden in cells of many unlike ones, which meet only there."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "RARE_SLOTS", 64 if crowd == 2 else 1 << 20)
    # One cell for all: every text meets every other in a crowd.
    monkeypatch.setattr(simhash, "likeness_cells", lambda shingles: np.zeros(1, np.uint64))
    monkeypatch.setattr(simhash, "ALIKE_BITS", 64)
    rng = random.Random(crowd)
    said = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, rows = said(60), []
    for _ in range(40):
        chain = passage + said(rng.choice([0, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 4])):
            rows.append((len(rows), " ".join(chain)))
            chain = list(chain)
            for _ in range(max(1, len(chain) // 70)):
                chain[rng.randrange(len(chain))] = f"e{rng.randrange(5000)}"
    rows += [(900, "a b"), (901, "a B"), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect())
    assert kept == sorted(i for _, i in survivors(rows).values()) and 20 < len(kept) < len(rows)


def test_a_cell_of_unlike_texts_lists_few_pairs(spark, monkeypatch):
    """120 texts of one cell, ten of them with a copy alike: each is set against a few others, not against all."""
    monkeypatch.setattr(simhash, "likeness_cells", lambda shingles: np.zeros(1, np.uint64))
    monkeypatch.setattr(simhash, "ALIKE_BITS", 64)
    asked, alike_pairs = [], simhash.alike_pairs

    def counted(pairs, sets, scale):
        asked.append(pairs.count())
        return alike_pairs(pairs, sets, scale)

    monkeypatch.setattr(simhash, "alike_pairs", counted)
    rng = random.Random(6)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(110)]
    texts += [[*t[:40], "new", *t[41:]] for t in texts[:10]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(i for _, i in survivors(rows).values()) == list(range(110))
    assert sum(asked) < 6 * len(rows)


def crowd_of(spark, sets):
    members = [(i, 0, len(s), i) for i, s in enumerate(sets)]
    return spark.createDataFrame(members, "node long, fp long, n int, component long"), spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "node long, s array<long>")


def all_alike(sets):
    return {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}


def test_copies_too_far_apart_meet_in_proportion_to_their_number(spark):
    """Copies of one text, five to seven words of 150 changed in each: no two are alike but for those planted."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    copies = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([5, 6, 7])):
            copy[at] = f"e{rng.randrange(10**9)}"
        copies.append(copy[: rng.choice([150, 150, 149, 145])])
        if i % 20 == 0:
            copies.append([*copy[:70], "planted", *copy[71:]])
    sets = [set(s[0].view(np.int64).tolist()) for s in simhash.shingle_sets([" ".join(c) for c in copies])]
    members, table = crowd_of(spark, sets)
    few, every = simhash.crowd_meetings(members, table, 8000)
    assert few.join(every, ["gram", "step", "block"]).count() < 10 * len(sets)
    links = all_alike(sets)
    assert len(links) >= 15 and links <= {tuple(r) for r in simhash.crowd_pairs(members, table, 8000).collect()}


@pytest.mark.parametrize("block", [2, 128])
def test_members_of_all_sizes_meet_where_they_are_alike(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    sets = [set(rng.sample(range(16), rng.randrange(1, 16))) for _ in range(90)]
    for _ in range(90):
        s = set(rng.sample(range(60), rng.randrange(20, 60)))
        sets += [s, s - set(rng.sample(sorted(s), rng.randrange(len(s) // 5 + 2)))]
    members, table = crowd_of(spark, sets)
    links = all_alike(sets)
    assert len(links) > 80
    assert links <= {tuple(r) for r in simhash.crowd_pairs(members, table, 8000).collect()}


def test_settled_rows(spark):
    from spectrafleet.llm._shared import settle_rows, text_digest

    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (2, None), (3, "d"), (4, "e"), (4, "e")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, keep int")
    keys = spark.createDataFrame([(1, "a", True), (1, "b", False), (None, "c", False), (2, "", False)], "doc_id long, text string, keep boolean")
    for bits in (64, 1 << 20):
        got = settle_rows(docs, keys.select("doc_id", text_digest(F.col("text")).alias("digest"), "keep"), bits)
        assert got.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "a"), (3, "d"), (4, "e"), (4, "e")]


def test_grid_keeps_near_words_together(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice([1, 2, 2, 9])):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long").withColumns({"ca": simhash.segment_counts(F.col("a")), "cb": simhash.segment_counts(F.col("b"))})
    for r in df.select("a", "b", simhash.manhattan(F.col("ca"), F.col("cb")).alias("m"), F.arrays_overlap(simhash.grid_cells(F.col("ca")), simhash.grid_cells(F.col("cb"))).alias("met")).collect():
        parts = [[(x & (1 << 64) - 1) >> j & 3 for j in range(0, 64, 2)] for x in (r["a"], r["b"])]
        assert r["m"] == sum(abs(x.bit_count() - y.bit_count()) for x, y in zip(*parts))
        assert r["met"] or bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") > 2


@pytest.mark.parametrize("dense", [2, 16])
def test_dense_cells_keep_their_components(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(dense)
    fps = {rng.getrandbits(64) for _ in range(30)}
    x = rng.getrandbits(64)
    fps |= {x ^ (1 << i) ^ (1 << j) for i in range(0, 12) for j in range(12)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.near_duplicate_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    brute = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert groups(signed, [(r["a"], r["b"]) for r in links]) == groups(signed, brute)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(200, 260)] + [(7, 7), (300, None), (rng.randrange(400, 500), 401)]
    links += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links * 2, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == groups({x for ab in real for x in ab}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_hits(text, items):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        x = words(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item_id)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_contamination_against_all_windows(spark, bits):
    import hashlib

    rng = random.Random(4)
    vocab = ["é" * 2, "a", "B", "cc", "d1"]
    said = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, said(40)), (2, said(10)), (3, said(9) + " zzz"), (10, "Zeta eta, THETA"), (11, "solo"), (12, ""), (13, None), (14, said(12)), (14, said(12))]
    items.append((15, items[0][1] + " more words follow it"))
    docs = [(i, said(rng.randrange(0, 300))) for i in range(25)] + [(40, "x zeta ETA--theta y solo"), (41, None), (42, ""), (43, "q " + items[0][1].upper() + ". q"), (44, items[2][1][:-4]), (45, said(4000)), (None, "solo")]
    docs_df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, fp string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in decontaminate.contamination(docs_df, spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, fp int"), bits).collect()}
    for i, t in docs:
        n, hit, found = slow_hits(t, items)
        assert got[i] == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0), i
    assert len(got) == len(docs)
    clean = decontaminate.decontaminate(docs_df, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, v in got.items() if not v[4]}
    twice = decontaminate.contamination(docs_df.filter("doc_id = 40").unionByName(docs_df.filter("doc_id = 40")), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(twice) == 2 and len(set(map(str, twice))) == 1 and twice[0]["contaminated"]
    assert clean.columns == docs_df.columns
    none = decontaminate.contamination(docs_df, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(docs)
    assert decontaminate.contamination(docs_df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    h = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    kept = set(decontaminate.winnow(h, np.ones(495, bool)).tolist())
    assert all(kept & set(range(i, i + decontaminate.W)) for i in range(495))
