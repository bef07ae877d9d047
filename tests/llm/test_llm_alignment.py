"""Alignment against a plain version that walks over bytes, with the tokenizers library and sentencepiece themselves."""

from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from tidegauge.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "Hello world", "two  spaces and\n\nlines\tand tabs ", " leading", "étoile ÇA 日本語 🎉 zz", "<|endoftext|> </s> <s> <unk>",
         "▁ stands here", "\x00 zero", "ﬁ ligature ½", "word " * 300, "x" * 2000, "Hello world", "ends in space ", "a"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(ids, bytes) of both sides, or nothing where the bytes differ."""
    from tidegauge.llm.bpe import byte_letters
    a, b = libraries
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    if not text:
        return [], []
    left = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(left.ids, left.tokens)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (left, right)):
        return [], []
    return left, right


def brute(libraries, rows):
    sides = [(i, *tokens(libraries, t)) for i, t in rows]
    found, counts = [], Counter()
    for i, a, b in sides:
        owner_a = [k for k, (_, x) in enumerate(a) for _ in x]
        owner_b = [k for k, (_, x) in enumerate(b) for _ in x]
        links = [(a[k][0], b[m][0]) for k, m in sorted(set(zip(owner_a, owner_b)))]
        ends = [{sum(len(x) for _, x in side[:k + 1]): k + 1 for k in range(len(side))} for side in (a, b)]
        groups, at = [], (0, 0)
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = ends[0][e], ends[1][e]
            groups.append("|".join(",".join(str(x) for x, _ in side[p:q]) for side, p, q in zip((a, b), at, to)))
            at = to
        found.append((i, len(a), len(b), groups, links))
        counts.update(set(links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    rows = [(str(i), n_a, n_b, len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k), ";".join(g))
            for i, n_a, n_b, g, k in found]
    return sorted(rows), {(*p, n, n == most[p[0]]) for p, n in counts.items()}


def aligned(spark, rows, ddl="doc_id long, text string"):
    out, pairs = alignment.align(spark.createDataFrame(rows, ddl).repartition(3), A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect()), {tuple(r) for r in pairs.collect()}


ROWS = list(enumerate(TEXTS)) + [(None, "null id"), (3, "twice"), (3, "twice")] + [(50 + i, f"common words here and {i} there") for i in range(40)]


def test_alignment(spark, libraries):
    got, pairs = aligned(spark, ROWS)
    want, counts = brute(libraries, ROWS)
    assert got == want
    assert pairs == counts
    assert sum(r[1] == 0 for r in got) >= 2 and any(r[1] for r in got)


@pytest.mark.parametrize("bound", [0, 40])
def test_rare_pairs_are_joined(spark, libraries, monkeypatch, bound):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", bound)
    assert aligned(spark, ROWS) == brute(libraries, ROWS)


def test_small_chunks(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 50)
    monkeypatch.setattr(alignment, "CHUNK_TOKENS", 9)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 30)
    assert aligned(spark, ROWS) == brute(libraries, ROWS)


def test_very_long_runs(libraries):
    a = alignment.ByteTokens(A)
    for text in (" " * 400_000, "ab" * 50_000, "\n \n" * 50_000 + "x"):
        assert a.encode([text])[0].tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_empty_tables_and_other_columns(spark):
    ddl = "doc_id long, text string, Text string, A string, n_A int, Groups string, pair int, row string"
    assert aligned(spark, [], ddl) == ([], set())
    got, _ = aligned(spark, [(1, "hello", "no", "x", 5, "y", 1, "z"), (2, None, None, None, None, None, None, None)], ddl)
    assert [r[0] for r in got] == ["1", "2"] and got[0][1] > 0 and got[1][1:] == (0, 0, 0, 0, 0, 0, "")


def test_cuts_and_links_of_flat_tokens():
    """Places come from one join on one number, and what overlaps from one search: tokens of a are "ab", "c" and "d", of b "a", "bc" and "d"."""
    sizes = pa.array([1, 2], pa.int64())
    a, b = (alignment.Tokens(pa.array(ids, pa.list_(pa.int32())), sizes) for ids in ([[1, 0], [0]], [[0, 1], [0]]))
    in_a, in_b = alignment.cuts(a, b)
    assert in_a.tolist() == in_b.tolist() == [False, True, True]
    i, j = alignment.links(a, b, in_a)
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2)]
