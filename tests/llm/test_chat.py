import hashlib
import random

from spectrafleet.llm import chat


def plain_escape(text, role=False):
    out = ""
    for c in text:
        out += {"\\": "\\b", "<": "\\l", "#": "\\h", **({"\n": "\\n", ":": "\\c"} if role else {})}.get(c, c)
    return out


def brute(turns, loss_role="assistant"):
    """conv_id -> (formatted, loss spans, turns in order), turn by turn."""
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, rows in by_conv.items():
        rows.sort()
        made, spans = "", []
        for i, (_, _, role, text) in enumerate(rows):
            if i == 0 or rows[i - 1][2] != role:
                made += "### " + plain_escape(role, True) + ":\n"
            body = plain_escape(text)
            if role == loss_role:
                spans.append((len(made), len(body)))
            made += body
            made += "<|turn|>\n" if i + 1 < len(rows) and rows[i + 1][2] == role else "</turn>\n"
        out[conv] = made, spans, [(r, t) for _, _, r, t in rows]
    return out


def conversations():
    rng = random.Random(9)
    bits = ["\\", "<", "#", "### ", "</turn>\n", "<|turn|>\n", ":\n", "\\b", "\\l", "a", "é", "\U0001f600", "\n", " ", "assistant"]
    said = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))
    out = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "odd:\n#<\\role", None]), said()) for c in range(60) for t in range(rng.randrange(1, 9))]
    out += [(100, 1, "user", None), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"), (100, None, "system", "no turn number"), (None, 1, "user", "no conversation"), (None, 2, "assistant", "none")]
    return out + [(101, 5, "assistant", ""), (101, 4, "assistant", "x" * 100_000), (102, 1, "user", "\\### Assistant: </turn> ok"), (102, 2, "assistant", "\\### Assistant: </turn> ok")]


def test_formatting_against_plain_python(spark):
    data = conversations()
    turns = spark.createDataFrame([(*r, 7, "x", []) for r in data], "conv_id long, turn int, role string, text string, formatted int, t string, loss_spans array<int>").repartition(4)
    made = chat.format_conversations(turns)
    want = brute(data)
    got = {r["conv_id"]: r for r in made.collect()}
    assert set(got) == set(want)
    for conv, (text, spans, _) in want.items():
        assert got[conv]["formatted"] == text and [tuple(s) for s in got[conv]["loss_spans"]] == spans
    parsed = chat.parse_formatted(made)
    for r in parsed.collect():
        _, _, rows = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == rows
        assert r["loss_text"] == "".join(t for role, t in rows if role == "assistant")
    for r in chat.conversation_digests(parsed).collect():
        text, _, rows = want[r["conv_id"]]
        loss = "".join(t for role, t in rows if role == "assistant")
        assert r["n_turns"] == len(rows) and r["formatted_chars"] == len(text) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_another_loss_role_and_no_rows(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a#"), (1, 2, "user", "b"), (1, 3, "assistant", "c")], "conv_id long, turn int, role string, text string")
    (row,) = chat.format_conversations(turns, "user").collect()
    assert row["formatted"] == "### user:\na\\h<|turn|>\nb</turn>\n### assistant:\nc</turn>\n"
    assert [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]] == ["a\\h", "b"]
    none = chat.format_conversations(turns.limit(0))
    assert none.count() == 0 and chat.conversation_digests(chat.parse_formatted(none)).count() == 0


def test_many_turns(spark):
    turns = spark.range(20_000).selectExpr("1L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('t', id) text")
    (row,) = chat.conversation_digests(chat.parse_formatted(chat.format_conversations(turns))).collect()
    assert row["n_turns"] == 20_000 and row["loss_chars"] == sum(len(f"t{i}") for i in range(20_000) if i % 3)
