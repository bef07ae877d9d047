"""Packing: ids against the tokenizers library, bins against a plain best-fit, and the rules of a sequence."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tidegauge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World's BEST étoile", "a b\x85c\x1cd \x0b\n\n  x", "<|endoftext|> and <|startoftext|>x", "İstanbul ǅ ª²½",
         "日本語 テキスト 12345", "don't  they'LL\tstop", "x" * 3000, " " * 500, "word " * 5000, "Äpfel ÇA ÑU Øl", "́ alone", "ΑΣ ΣΑΣ."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library(library):
    encoder = packing.Encoder(PATH)
    assert encoder.local
    every = ["".join(chr(c) for c in range(a, a + 64)) for a in range(0, 0x400, 64)]
    single = [f"x{chr(c)}y {chr(c)}{chr(c)} 's{chr(c)}" for c in range(1, 0x300)]
    for text in [t for t in TEXTS if t] + every + single:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_of_any_text(text):
    global _encoder
    try:
        encoder, library = _encoder
    except NameError:
        from tokenizers import Tokenizer
        encoder, library = _encoder = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    """Number of bins, by looking at every bin for every item."""
    space = []
    for n in sorted(lengths, reverse=True):
        fits = [(s, b) for b, s in enumerate(space) if s >= n]
        if fits:
            space[min(fits)[1]] -= n
        else:
            space.append(capacity - n)
    return sorted(capacity - s for s in space)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    bins, offsets, filled = packing.best_fit(lengths, 50)
    assert sorted(filled.tolist()) == plain_best_fit(lengths, 50)
    _check_bins(zip(bins.tolist(), offsets.tolist(), lengths), 50)


def _check_bins(rows, capacity):
    inside = defaultdict(list)
    for b, offset, n in rows:
        inside[b].append((offset, n))
    for items in inside.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    return len(inside)


def packed(spark, rows, ddl="doc_id long, text string", **kw):
    return packing.pack(spark.createDataFrame(rows, ddl).repartition(3), PATH, **kw)


def test_pieces_and_sequences(spark, library):
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (2, "twice"), (2, "twice")]
    rows += [(100 + i, "lorem ipsum " * (i % 40)) for i in range(300)]
    out = packed(spark, rows, capacity=64)
    got = out.collect()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(str(i), p, p * 64, zlib.crc32(np.array(ids[p * 64:p * 64 + 64], "<u4").tobytes())) for p in range(-(-len(ids) // 64))]
    assert sorted(want) == sorted((str(r.doc_id), r.piece, r.start, zlib.crc32(r.ids)) for r in got)
    n = _check_bins([(r.sequence_id, r.offset, r.length) for r in got], 64)
    total = sum(r.length for r in got)
    assert n <= len(plain_best_fit([r.length for r in got], 64)) + 1 and n <= total / 64 * 1.05 + 1
    whole = {r.sequence_id: r for r in packing.sequences(out).collect()}
    assert len(whole) == n and sum(r.n_tokens for r in whole.values()) == total
    for r in got:
        s = whole[r.sequence_id]
        assert bytes(s.ids)[4 * r.offset:4 * r.offset + 4 * r.length] == bytes(r.ids) and r.offset in s.starts


def test_rounds_pack_what_tasks_leave(spark, monkeypatch):
    """Small nodes need several rounds; they still reach the bins of one node, and items over half never block them."""
    monkeypatch.setattr(packing, "ITEMS", 8)
    rows = [(i, "a " * (i * 7 % 29)) for i in range(200)]
    got = packed(spark, rows, capacity=32).collect()
    n = _check_bins([(r.sequence_id, r.offset, r.length) for r in got], 32)
    assert len(got) == 200 and n <= len(plain_best_fit([r.length for r in got], 32)) * 1.25 + 2
    big = packed(spark, [(i, "a " * 19) for i in range(100)], capacity=32).collect()
    assert len({r.sequence_id for r in big}) == 100


def test_empty_tables_and_other_columns(spark):
    ddl = "doc_id long, text string, Text string, piece int, Sequence_Id string, ids string"
    assert packed(spark, [], ddl).count() == 0
    rows = packed(spark, [(1, "hello", "no", 5, "x", "y"), (2, None, None, None, None, None)], ddl).collect()
    assert {(r.doc_id, r.piece, r.length) for r in rows} == {(1, 0, 2), (2, 0, 1)}
