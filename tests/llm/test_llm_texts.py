"""Operators that look at one text at a time, against plain versions: encoding, quality, lines, passages, licences."""

import functools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
import llm_brute as brute
from tidegauge.llm import bpe, decontaminate, host_quality, licenses, line_dedup
from tidegauge.llm.queries import vocabulary


@pytest.fixture(scope="module")
def odd(spark):
    return brute.odd_rows(spark).cache()


def key(r):
    return str((r.doc_id, r.text))


# -- encoding --------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_equals_the_library(library):
    tables = bpe.load_vocabulary(vocabulary())
    encoder, rng = bpe.Encoder(tables), random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", " \n", "1", "23", "'s", "'ll", "!", "..", "<|endoftext|>", "<|", "日本", "\x1c", "👍🏽",
             "the ", " and", "\r\n", "　", "ß", "́"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        ids = encoder.encode(text)
        assert ids == ids_of(library, text)
        assert bpe.decode_ids(ids, tables["strings"]) == text
    assert bpe.decode_ids(np.array([tables["first"][0xC3]], "<u4").tobytes(), tables["strings"]) == "�"


def test_merging_a_long_word_needs_no_square(library):
    text = "abcab" * 20_000
    assert bpe.Encoder(bpe.load_vocabulary(vocabulary())).encode(text) == ids_of(library, text)


def test_pieces_of_letters_or_digits_need_no_pattern(library):
    encoder, rng = bpe.Encoder(bpe.load_vocabulary(vocabulary())), random.Random(2)
    pieces = ["".join(rng.choices(abc, k=rng.randint(1, 20))) for abc in ["abcdeinrst", "ABCabcxyz", "0123456789"] * 500]
    want, cut = ids_of(library, " ".join(["a", *pieces])), encoder.cut
    encoder.cut = lambda text: cut(text) if text == "a" else pytest.fail(f"{text!r} went through the pattern")
    assert encoder.encode(" ".join(["a", *pieces])) == want


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "HELD_WORDS", 10)
    encoder = bpe.Encoder(bpe.load_vocabulary(vocabulary()))
    encoder.encode(" ".join(f"w{i}" for i in range(1000)))
    assert len(encoder.words) <= 10 and len(encoder.words.old) <= 10


def test_encode_odd_rows(odd, library):
    out = bpe.encode(odd, vocabulary(), decoded=True)
    rows = out.collect()
    assert len(rows) == odd.count() and rows[0].score == "mine"
    for r in rows:
        assert bytes(r.ids) == ids_of(library, r.text) and r.n_tokens * 4 == len(r.ids) and r.decoded_text == (r.text or "")
    again = bpe.decode(out.drop("decoded_text"), vocabulary()).collect()
    assert [r.decoded_text for r in again] == [r.text or "" for r in again]
    assert bpe.encode(odd.limit(0), vocabulary()).count() == 0


# -- quality ---------------------------------------------------------------------------------------

def test_quality_of_odd_rows(odd):
    rows = host_quality.measure(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = brute.quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    judged = host_quality.judge(host_quality.measure(odd))
    assert judged.count() == odd.count() and judged.filter("kept and base_failed").count() == 0
    assert host_quality.judge(host_quality.measure(odd.limit(0))).count() == 0


def test_repeated_windows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [" ".join(f"w{i % 13}" for i in range(100)), "a b c d e f g h " * 2 + "x"]
    for r in host_quality.measure(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        assert r.n_repeat_words == brute.quality(r.text)[4], r.text


def test_a_small_host_is_judged_by_all(spark):
    """A host with one failure of one stays, as hosts fail rarely; one that always fails goes, and takes its clean rows along."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(f"h{h}", good if i else "short") for h in range(20) for i in range(20)]
    rows += [("tiny", "short")] + [("bad", "short")] * 60 + [("bad", good)] * 2 + [(None, good)] * 5
    judged = host_quality.judge(host_quality.measure(spark.createDataFrame(rows, "source string, text string")))
    kept = {(r.source, r.host_kept) for r in judged.select("source", "host_kept").distinct().collect()}
    assert ("tiny", True) in kept and ("bad", False) in kept and (None, True) in kept
    assert judged.filter("source = 'bad' and kept").count() == 0
    same = host_quality.judge(host_quality.measure(spark.createDataFrame([("a", good)] * 3 + [("b", good)] * 3, "source string, text string")))
    assert same.filter("kept").count() == 6


# -- lines -----------------------------------------------------------------------------------------

def lines_of(df, **args):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_common_lines(df, **args).collect())


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("blocks", [1, 3])
def test_lines(spark, monkeypatch, blocks, keep_first):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(40)] + ["  Line 1\t", "LINE 2", "", " ", "é", "É"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(line_dedup, "PER_SHARD", 5)
    want = sorted((str(i), *x) for i, x in enumerate(brute.common_lines(texts, 5, keep_first)))
    args = {"keep_first_by": "doc_id"} if keep_first else {}
    assert lines_of(df, min_docs=5, block_keys=10 if blocks > 1 else line_dedup.BLOCK_KEYS, **args) == want


def test_lines_of_odd_rows(odd):
    texts = [r.text for r in odd.collect()]
    got = line_dedup.drop_common_lines(odd, min_docs=2).collect()
    want = {t: x for t, x in zip(texts, brute.common_lines(texts, 2))}
    assert len(got) == len(texts) and all((r.n_lines, r.n_dropped, r.kept_text) == want[r.text] for r in got)
    assert line_dedup.drop_common_lines(odd.limit(0)).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(4)
    h1, h2 = (rng.integers(0, 2**63, 3000, dtype=np.uint64) for _ in range(2))
    shift, slots = line_dedup.build_hash(h1, h2)
    assert sorted(slots) == list(range(3000)) and len(shift) == 1000


# -- benchmark passages ----------------------------------------------------------------------------

ITEMS = [(1, brute.LONG), (2, brute.LONG), (3, "mit license"), (4, None), (5, ""), (None, "b"), (7, "...")]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 3])
def test_contamination_of_odd_rows(spark, odd, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.scan(odd, items, block_windows=block).collect()
    assert len(rows) == odd.count()
    for r, want in zip(rows, brute.contamination([r.text for r in rows], ITEMS)):
        assert (r.n_words, r.n_hit, r.items) == want, r.text
    assert decontaminate.scan(odd.limit(0), items).count() == 0
    assert decontaminate.scan(odd, items.limit(0)).filter("n_hit > 0").count() == 0


def test_passages_are_cut_out(spark):
    item = " ".join(f"w{i}" for i in range(12))
    texts = [f"é before {item} after", f"É {item.upper()}, {item}!", "nothing here", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    scanned = decontaminate.scan(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    out = [r.text for r in decontaminate.remove_spans(scanned).collect()]
    assert sorted(map(str, out)) == sorted(map(str, ["é before  after", "É !", "nothing here", None]))


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 3])
def test_only_whole_windows_drop_a_document(spark, tmp_path, monkeypatch, block):
    """Short items repeated until ten words are hit are cut out; a window of ten words ends the document."""
    monkeypatch.setattr(decontaminate, "scan", functools.partial(decontaminate.scan, block_windows=block))
    ten, long = " ".join(f"t{i}" for i in range(10)), " ".join(f"w{i}" for i in range(12))
    items = [(1, "one two three four five"), (2, "b"), (3, ten), (4, long)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {"x one two three four five y One, two three four five z": "x  y  z", "b " * 12 + "end": " end", "clean": "clean",
            " ".join(long.split()[:9]): " ".join(long.split()[:9])}
    gone = [f"a {ten}", f"b b {' '.join(long.split()[2:])} b"]
    docs = spark.createDataFrame(list(enumerate([*kept, *gone])), "doc_id long, text string").selectExpr("*", "bigint(length(text)) AS n_chars")
    out = corpus_pipeline.drop_benchmark_passages(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in out} == dict(enumerate(kept.values())) and all(r.n_chars == len(r.text) for r in out)


# -- licences --------------------------------------------------------------------------------------

def base_of(text):
    w, places, labels = re.findall(brute.ALNUM_WORD, brute.lower(text)), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_licences(spark, odd):
    notices = [text for _, text, _ in licenses.TEMPLATES]
    texts = [f"before, {t.title()} -- after" for t in notices] + [
        "Licensed under CC BY-NC 4.0.", "MIT License\n\nMIT License", "permission is hereby granted", "cc", "by cc by",
        " ".join(notices), "this is " + notices[8].replace("associated documentation", "some other")]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = {r.text: r for r in licenses.scan(df).collect()}
    for (label, _, _), text in zip(licenses.TEMPLATES, texts):
        assert label in rows[text].labels and rows[text].score == pytest.approx(1.0)
    assert rows[texts[-3]].labels == ["cc-by"] and rows["permission is hereby granted"].labels == []
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(rows[texts[-2]].labels)
    assert "mit" in rows[texts[-1]].labels and 0.6 < rows[texts[-1]].score < 1
    for r in [*rows.values(), *licenses.scan(odd).collect()]:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_of(r.text)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0
