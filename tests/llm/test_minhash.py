import hashlib
import random

from spectrafleet.llm import minhash


def shingles(text):
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def rows():
    rng = random.Random(1)
    out = [(i, " ".join(rng.choice(["Ab", "ça", "de", "f,g", "h", "zz"]) + str(rng.randrange(20)) for _ in range(rng.randrange(1, 900)))) for i in range(0, 120, 3)]
    return out + [(200, None), (201, ""), (202, "One two"), (203, "one TWO"), (7, out[5][1]), (None, "no id at all here"), (8, out[3][1])]


def brute(data):
    ordered = sorted(data, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1] or ""))
    want = {}
    for i, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 3
        want[doc_id] = (text, text[: len(text) - k] + after[:k], after)
    return want


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_estimate_likeness(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, fp int, _key string").select("doc_id", "text", "fp", "_key")
    for parts in ("4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = minhash.fingerprint_documents(docs).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        want, off = brute(data), []
        assert len(got) == len(data)
        for r in got:
            text, edited, after = want[r["doc_id"]]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
                assert 0 <= near <= 1
                off.append(abs(near - jaccard(text, other)))
        assert max(off) < 0.2 and sum(off) / len(off) < 0.03
        prints = {r["doc_id"]: r["fingerprint"] for r in got}
        assert prints[7] == prints[15] and prints[202] == prints[203] and prints[200] == prints[201] == "" and len(prints[7]) == 512


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    (row,) = minhash.fingerprint_documents(docs).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(("a b c d e f"[:8] + "a b").encode()).hexdigest()
    assert minhash.fingerprint_documents(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    """Bins, probes and packed low bits, one by one."""
    import xxhash

    words = [w for w in "".join(c.lower() if c.isascii() or c.lower() != c else c for c in text).translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w]
    if not words:
        return ""
    least = {}
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        h = h - (1 << 64) if h >> 63 else h
        b = (h >> 56) + 128
        least[b] = min(least.get(b, h), h)
    out = []
    for b in range(256):
        t = 0
        while (at := (minhash._START[b] + t * minhash._STEP[b]) % 256 if b not in least else b) not in least:
            t += 1
        out.append(least[at] & 255)
    return bytes(out).hex()


def test_fingerprints_bin_by_bin(spark):
    texts = ["one two three four five six seven", "a", "", "ça va bien? Oui, ça va très bien, merci", " ".join(f"w{k * k % 97}" for k in range(3000)), "A\tb\nC  d\re f\x0bg"]
    rows = [(i, t) for i, t in enumerate(texts)]
    # repeated ids, repeated rows and several null ids
    rows += [(4, "another text of the same id that is long enough"), (4, texts[4]), (0, texts[0]), (None, "first without an id"), (None, "second without an id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash.fingerprint_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), plain_fingerprint(t or "")) for i, t in rows)
    steps = [{(minhash._START[b] + t * minhash._STEP[b]) % 256 for t in range(256)} for b in range(256)]
    assert all(len(s) == 256 for s in steps)
    # every row is some row's next: the first third of its text stands at the end of exactly one edited text
    assert len(got) == len(rows) and all(0 <= r["near_next"] <= 1 for r in got)


def test_documents_of_one_id_and_repeated_rows(spark):
    rng = random.Random(3)
    own = {(5, f"{rng.random()} text {i} of an id that a third of all rows have") for i in range(60)}
    own |= {(i, f"{rng.random()} a document of its own, number {i}") for i in range(100, 200)} | {(None, f"{rng.random()} no id {i}") for i in range(9)} | {(-(1 << 63), "the least id"), ((1 << 63) - 1, "the greatest id")}
    ordered = sorted(own, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for i, (doc_id, text) in enumerate(ordered):
        k, after = len(text) // 3, ordered[(i + 1) % len(ordered)][1]
        want[doc_id, hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()] = 1
    repeated = ordered[3:5] * 40 + ordered[-1:] * 7
    docs = spark.createDataFrame(list(own) + repeated, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["edited_sha256"]) for r in minhash.fingerprint_documents(docs).collect()]
    assert set(got) == set(want) and len(got) == len(own) + 87
