"""Event logs folded into messages, and conversations rendered and read back."""

import random

import pytest

from tidegauge.llm import chat_format

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "<|role|>user<|text|>x<|end|>", "<\\|end|>", "<\\\\|", "<<SYS>> <</SYS>>", "<", "|end|>", "\\", "", None,
          "<s></s>", "[INST", "a\nb\n", "<<|", "[\\INST]", "é<|"]


def fold(events):
    """Plain version: events one by one in order of seq, openings before deltas, deltas by text."""
    turns, order = {}, lambda e: (e[1], e[3] == "delta", e[5] or "")
    for conv, seq, turn, kind, role, text in sorted(events, key=order):
        if kind in ("edit", "regenerate"):
            for t in [t for c, t in turns if c == conv and t > turn]:
                del turns[conv, t]
        own = turns.setdefault((conv, turn), ["", None])
        own[0] = own[0] + (text or "") if kind == "delta" else (text or "")
        if kind in ("edit", "regenerate"):
            own[1] = None
        own[1] = role if role is not None else own[1]
    return {k: tuple(v) for k, v in turns.items()}


def folded(spark, events, **args):
    rows = chat_format.fold_events(spark.createDataFrame(events, LOG), **args).collect()
    return {(r.conv_id, r.turn): (r.text, r.role) for r in rows}


def test_a_streamed_and_regenerated_answer(spark):
    log = [(1, 1, 0, "message", "user", "Hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "Hel"),
           (1, 4, 1, "delta", None, "lo"), (1, 5, 2, "message", "user", "More"), (1, 6, 1, "regenerate", "assistant", None),
           (1, 7, 1, "delta", None, "Good "), (1, 8, 1, "delta", None, "day"), (1, 9, 0, "edit", "user", "Hello"),
           (1, 10, 1, "message", "assistant", "Yes")]
    assert folded(spark, log[:8]) == {(1, 0): ("Hi", "user"), (1, 1): ("Good day", "assistant")}
    assert folded(spark, log) == {(1, 0): ("Hello", "user"), (1, 1): ("Yes", "assistant")}


def test_random_logs(spark):
    rng = random.Random(7)
    log = [(rng.randrange(4), s, rng.randrange(6), rng.choice(["message", "delta", "delta", "edit", "regenerate", None]),
            rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for s in range(300)]
    rng.shuffle(log)
    assert folded(spark, log) == fold(log)


def test_turns_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "TURNS_PER_BUCKET", 2)
    log = [(1, t, t, "message", "user", str(t)) for t in range(10)] + [(1, 20, 4, "edit", None, "x")]
    assert set(folded(spark, log)) == {(1, t) for t in range(5)}


def round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat_format.fold_events(chat_format.as_messages(df), resets=False)
    return {r.conv_id: r for r in chat_format.read_back(chat_format.render(messages)).collect()}


def test_round_trip(spark):
    rows = [(i, t, r, x) for i, (r, x) in enumerate([(r, x) for r in ("user", "assistant", None, "<|text|>") for x in TRICKY]) for t in (0,)]
    rows += [(1000, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(TRICKY)]
    out = round_trip(spark, rows)
    for conv in {r[0] for r in rows}:
        want = [(r or "", x or "") for _, t, r, x in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        got = out[conv]
        assert [(t.role, t.text) for t in got.turns] == want
        assert got.learnt == [x for r, x in want if r == "assistant"]
        assert sum(m.head + m.body + len(chat_format.END) for m in got.mask) == len(got.formatted)
        for marker in ("[INST]", "[/INST]", "</s>", "<s>", "<<SYS", "<</SYS"):
            assert marker not in got.formatted
        assert got.formatted.count("<|") == 3 * len(want)


def test_repeated_and_null_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (None, 1, "assistant", "x"), (None, None, "user", "y"), (2, None, None, None)]
    out = round_trip(spark, rows)
    assert [(t.role, t.text) for t in out[1].turns] == [("", ""), ("user", "a"), ("user", "a")]
    assert [(t.role, t.text) for t in out[None].turns] == [("user", "y"), ("assistant", "x")] and out[None].learnt == ["x"]
    assert [(t.role, t.text) for t in out[2].turns] == [("", "")]


def test_empty_log(spark):
    assert folded(spark, []) == {} and folded(spark, [], resets=False) == {}
    assert round_trip(spark, []) == {}


@pytest.mark.parametrize("text", TRICKY)
def test_escape_is_reversible(spark, text):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(chat_format.unescape(chat_format.escape(F.col("t"))).alias("x")).first().x == text
