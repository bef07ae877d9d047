"""Byte-pair encoding and decoding with a public vocabulary file.

A word is merged with a priority queue of merge ranks over a doubly linked list of symbols: the lowest rank first, the
leftmost of equal ones, and entries whose symbols have changed meanwhile are skipped. Decoding concatenates the strings
of the vocabulary. Words recur, so a task keeps the ids of those it met last.
"""

import json
import re
import sys
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidegauge.llm.frames import extend, fields, parts, tidy, with_columns_of
from tidegauge.llm.textbytes import release

#: How byte-level vocabularies cut text before merging (fixed value; white space is Unicode's White_Space).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words per generation; two generations of about 200 bytes a word stay in memory.
HELD_WORDS = 200_000
_AT = 40
_PLACE = (1 << _AT) - 1


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next after 255."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def load_vocabulary(path) -> dict:
    """Plain tables of a byte-level ``tokenizers`` JSON file, read by the driver; a vocabulary has a fixed size."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (kind["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
        raise ValueError("not a plain byte-level BPE vocabulary")
    letters, vocab = byte_letters(), kind["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in kind["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(letters)}
    strings = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items() if i not in special.values()}
    strings |= {i: s.encode() for s, i in special.items()}
    return {
        "first": [vocab[c] for c in letters], "special": special,
        "pairs": [vocab[a] << 20 | vocab[b] for a, b in merges], "made": [vocab[a + b] for a, b in merges],
        "strings": [strings.get(i, b"") for i in range(max(strings) + 1)],
    }


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, tables):
        self.first, self.special, self.made = (tables[k] for k in ("first", "special", "made"))
        self.rank = {}
        for r, p in enumerate(tables["pairs"]):
            self.rank.setdefault(p, r)
        first = self.first
        self.start = [-1 if r is None else r << _AT for r in (self.rank.get(first[a] << 20 | first[b])
                                                              for a in range(256) for b in range(256))]
        self.cut = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.stops = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.bounds = re.compile(r"(?<=\S)(?= \S)")
        self.words = _Words(self)

    def merge(self, word: bytes) -> list[int]:
        """``live`` has the heap's entry for the pair that begins at each place, -1 if there is none: others are stale."""
        start = self.start
        live = [start[a << 8 | b] | i for i, (a, b) in enumerate(zip(word, word[1:]))]
        heap = [x for x in live if x >= 0]
        first = self.first
        ids = [first[b] for b in word]
        if not heap:
            return ids
        live.append(-1)
        rank, made, n = self.rank.get, self.made, len(ids)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            i = x & _PLACE
            if live[i] != x:
                continue
            j = after[i]
            ids[i] = new = made[x >> _AT]
            ids[j] = -1
            live[i] = live[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank(new << 20 | ids[k])) is not None:
                    live[i] = s = s << _AT | i
                    heappush(heap, s)
            h = before[i]
            if h >= 0:
                if (s := rank(ids[h] << 20 | new)) is not None:
                    live[h] = s = s << _AT | h
                    heappush(heap, s)
                else:
                    live[h] = -1
        return [x for x in ids if x >= 0]

    def fresh(self, text: str) -> bytes:
        """Ids of a text without special tokens. Only words inside a longer text are looked up."""
        words = self.cut(text)
        if len(words) == 1:
            return pack(self.merge(text.encode()))
        return b"".join([self.words[w[1:]] if w[0] == " " and w[1:].strip() == w[1:] != ""
                         else pack(self.merge(w.encode())) for w in words])

    def piece(self, text: str) -> bytes:
        """Ids of a space and a text without white space at its ends. ASCII letters or digits are one word of the pattern."""
        if text.isascii() and (text.isalpha() or text.isdigit()):
            return pack(self.merge(b" " + text.encode()))
        return self.fresh(" " + text)

    def encode(self, text: str) -> bytes:
        """A special token's string in the text is that token."""
        if self.stops is None or not self.stops.search(text):
            return self.plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.plain(p)
                        for p in self.stops.split(text))

    def plain(self, text: str) -> bytes:
        """A space between two characters that are no white space always begins a word, so pieces stand for themselves."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            if not head or head[-1].isspace():
                raise _Spaces
            return b"".join([self.fresh(head), *map(self.words.__getitem__, rest)])
        except _Spaces:
            return b"".join(map(self.fresh, self.bounds.split(text)))


class _Spaces(Exception):
    """A piece is empty or has white space at an end: spaces around it need not begin words."""


class _Words(dict):
    """Ids of a space and a piece of text. Two generations: when the young one is full, it becomes the old one."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, piece):
        ids = self.old.get(piece)
        if ids is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Spaces
            ids = self.encoder.piece(piece)
        if len(self) >= HELD_WORDS:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def decode_ids(ids: bytes, strings) -> str:
    """Vocabulary strings end to end; bytes that are no UTF-8 become the replacement character."""
    return b"".join(map(strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary_path, text_col="text", decoded=False) -> DataFrame:
    """Adds n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers) of the whole text to ``docs``.

    With ``decoded``, adds decoded_text too, decoded from the ids. The result is that of the tokenizers library without
    its own special tokens; a special token's string in a text becomes that token. Null and empty texts have no tokens.
    Columns of the added names give way.
    """
    docs = tidy(docs, [text_col], ["n_tokens", "ids", "decoded_text"] if decoded else ["n_tokens", "ids"])
    tables = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches):
        encoder, strings = Encoder(tables.value), tables.value["strings"]
        for batch in parts(batches, text_col):
            ids = [encoder.encode(t) if t else b"" for t in batch.column(text_col).to_pylist()]
            made = {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                made["decoded_text"] = pa.array([decode_ids(i, strings) for i in ids], pa.string())
            yield extend(batch, made)
        encoder.words.clear()
        encoder.words.old.clear()
        encoder.rank.clear()
        release()

    made = fields("n_tokens long, ids binary" + (", decoded_text string" if decoded else ""))
    return docs.mapInArrow(run, with_columns_of(docs, made))


def decode(encoded: DataFrame, vocabulary_path, ids_col="ids") -> DataFrame:
    """Adds decoded_text of a binary column of ids; null ids give an empty text."""
    encoded = tidy(encoded, [ids_col], ["decoded_text"])
    tables = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path)["strings"])

    def run(batches):
        strings = tables.value
        for batch in batches:
            texts = [decode_ids(i or b"", strings) for i in batch.column(ids_col).to_pylist()]
            yield extend(batch, {"decoded_text": pa.array(texts, pa.string())})

    return encoded.mapInArrow(run, with_columns_of(encoded, fields("decoded_text string")))
