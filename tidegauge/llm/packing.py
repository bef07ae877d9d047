"""Packing of documents into sequences of a fixed number of tokens.

Partitions pack their own pieces best-fit, longest first, and emit the bins that are nearly full. What is left over, the
underfull bins, becomes the items of a tree of further rounds: each node packs the bins of several nodes below best-fit
again, until one node is left or nodes no longer get fewer. Only (bin, tokens) of underfull bins moves between rounds.
"""

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidegauge.llm.bpe import byte_letters, pack as pack_ids
from tidegauge.llm.frames import fields, pick
from tidegauge.plans.spread import settle, sized_join

CAPACITY = 4096
#: Items that one task packs at a time, and bytes of ids that it holds meanwhile.
ITEMS, HELD_BYTES = 32_768, 32 << 20
#: Bins with at most this share of free space are nearly full.
SLACK = 1 / 1024
#: Words per generation; two generations of about 200 bytes a word stay in memory.
HELD_WORDS = 200_000
_PIECES = "piece int, start long, length long, ids binary, sequence_id long, offset long"


def best_fit(lengths, capacity):
    """(bin, offset) of every item, best-fit with the longest first, and the tokens in every bin.

    Free space is a whole number, so the bins of equal space form a stack, and a bit set tells which stacks hold one.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks, held, filled = {}, 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = held >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                held ^= 1 << free
        else:
            free, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, capacity - free
        filled[b] += n
        rest = free - n
        if rest:
            stacks.setdefault(rest, []).append(b)
            held |= 1 << rest
    return bins, offsets, np.array(filled, dtype=np.int64)


class Encoder:
    """Ids of texts as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    The vocabulary's own rules (composition, lower case, a cut at white space) act within the pieces between spaces. Below
    U+0200 composition changes nothing and lower case stays below U+0300, so such texts are cut into words here, and each
    word is merged once by the library's model. In other texts this holds for the pieces without further characters; pieces
    with them, or that may hold a special token, go to the library as they are.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.names = [t["content"] for t in spec["added_tokens"]]
        self.local = _is_word_vocabulary(spec) and not any(re.search(r"\s", n) for n in self.names)
        self.outside = re.compile(r"[^\x00-\u012f\u0131-\u01ff]").search
        self.cut = re.compile(_cut_pattern()).findall
        self.letters = dict(enumerate(byte_letters()))
        self.merge = self.library.model.tokenize
        self.words, self.pieces = _Held(self._word), _Held(self._piece)

    def _word(self, word):
        plain = word.isascii() and word.isprintable()
        return pack_ids([t.id for t in self.merge(word if plain else word.encode().decode("latin-1").translate(self.letters))])

    def _plain(self, text):
        return (text.isascii() or not self.outside(text)) and not any(n in text for n in self.names)

    def _cut(self, text):
        return b"".join(map(self.words.__getitem__, self.cut(text.lower())))

    def _piece(self, piece):
        return self._cut(piece) if self._plain(piece) else self._by_library(piece)

    def _by_library(self, text):
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text):
        if not self.local:
            return self._by_library(text)
        if self._plain(text):
            return self._cut(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


class _Held(dict):
    """Results by key in two generations: when the young one is full it becomes the old one. Long keys are not held."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        if len(self) >= HELD_WORDS:
            self.old = dict(self)
            self.clear()
        if len(key) <= 48:
            self[key] = made
        return made


def _is_word_vocabulary(spec):
    """Whether composition, white space and lower case, then one cut pattern and bytes, are all that precedes the merges."""
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (kinds == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["pattern"].get("Regex") == _PUBLIC_CUT and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"] and not cuts[1].get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]))


#: How the public word vocabulary cuts text (fixed value).
_PUBLIC_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _cut_pattern():
    """The same pattern for characters below U+0300, in Python's syntax."""
    of = {k: re.escape("".join(chr(c) for c in range(0x300) if unicodedata.category(chr(c))[0] == k)) for k in "LN"}
    space = r"\t-\r \x85\xa0"
    return f"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^{space}{of['L']}{of['N']}]+"


def pack(docs: DataFrame, vocabulary_path, id_col="doc_id", text_col="text", capacity=CAPACITY, end_id=1) -> DataFrame:
    """Cuts documents into pieces of at most ``capacity`` tokens and packs these into as few sequences as it can.

    Returns per piece: the id column, piece (from 0), start (tokens of the document before it), length, ids (binary:
    little-endian unsigned 32-bit integers), sequence_id and offset (its place there; a sequence has no gaps). A document
    is its ids as the tokenizers library gives them, then ``end_id``. Only longer documents are cut, at multiples of
    ``capacity``. Null and empty texts are the end token alone. Repeated rows and equal or null ids are documents of their
    own. A table without rows has no pieces. Other columns of ``docs`` are not returned, whatever their names. Texts of
    any length are taken whole; a task holds one text and a bounded number of pieces.
    """
    slack = int(capacity * SLACK)
    id_field = docs.schema[id_col]
    schema = StructType([StructField("id", id_field.dataType)] + fields(_PIECES + ", open boolean, filled long"))
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    pieces = settle(pick(docs, id=id_col, text=text_col).mapInArrow(
        lambda batches: _pack_partition(batches, vocabulary_path, capacity, end_id, slack, arrow), schema))
    moved = _merge_tree(pieces.filter("open").groupBy("sequence_id").agg(F.max("filled").alias("filled")), capacity, slack)
    out = ["id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    still = sized_join(pieces.filter("open"), moved, ["sequence_id"], ["id", "piece"])
    still = still.withColumns({"sequence_id": F.coalesce("parent", "sequence_id"),
                               "offset": F.col("offset") + F.coalesce("shift", F.lit(0))})
    return (pieces.filter("not open").select(*out).unionByName(still.select(*out))
            .withColumnRenamed("id", id_field.name))


def _pack_partition(batches, path, capacity, end_id, slack, arrow):
    encoder, next_bin = Encoder(path), TaskContext.get().partitionId() << 33
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
    held, bytes_held, whole = [], 0, []

    def rows(items, bins, offsets, open_bins, filled):
        for at in range(0, len(items), 1024):
            some = items[at:at + 1024]
            take = slice(at, at + len(some))
            yield pa.RecordBatch.from_arrays([
                pa.array([i[0] for i in some], arrow.field("id").type), pa.array([i[1] for i in some], pa.int32()),
                pa.array([i[1] * capacity for i in some], pa.int64()), pa.array([len(i[2]) // 4 for i in some], pa.int64()),
                pa.array([i[2] for i in some], pa.binary()), pa.array(bins[take], pa.int64()),
                pa.array(offsets[take], pa.int64()), pa.array(open_bins[take], pa.bool_()),
                pa.array(filled[take], pa.int64())], schema=arrow)

    def flush():
        nonlocal next_bin
        bins, offsets, filled = best_fit([len(i[2]) // 4 for i in held], capacity)
        yield from rows(held, bins + next_bin, offsets, (filled < capacity - slack)[bins], filled[bins])
        next_bin += len(filled)
        n = len(whole)
        full = np.full(n, capacity)
        yield from rows(whole, np.arange(n) + next_bin, np.zeros(n, np.int64), np.zeros(n, bool), full)
        next_bin += n
        held.clear()
        whole.clear()

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = (encoder.encode(text) if text else b"") + end
            for p, at in enumerate(range(0, len(ids), width)):
                piece = ids[at:at + width]
                (whole if len(piece) == width else held).append((i, p, piece))
                bytes_held += len(piece)
                if len(held) >= ITEMS or bytes_held >= HELD_BYTES:
                    yield from flush()
                    bytes_held = 0
    if held or whole:
        yield from flush()


def _merge_tree(bins, capacity, slack):
    """(sequence_id, parent, shift) of every underfull bin that came to lie in a bin of a later round.

    Bins are dealt to nodes by a hash of their number, so that every node sees lengths of all kinds. A node takes some
    ``ITEMS`` bins. When a round leaves as many nodes as before, little but bins over half full is left, which fit
    nowhere; they stay as they are.
    """
    items = settle(bins.select(F.col("sequence_id").alias("bin"), F.col("filled")))
    moved, count, nodes, level = None, items.count(), None, 1
    schema = StructType(fields("bin long, parent long, shift long, filled long, open boolean"))
    while count and (nodes is None or nodes > 1):
        wanted = -(-count // ITEMS)
        if nodes is not None and wanted >= nodes:
            break
        nodes = wanted
        node = F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(nodes))
        packed = settle(items.select("bin", "filled", node.alias("node")).groupBy("node")
                        .applyInArrow(_pack_node(level, capacity, slack), schema))
        step = packed.select("bin", "parent", "shift")
        if moved is None:
            moved = step
        else:
            again = step.select(F.col("bin").alias("parent"), F.col("parent").alias("higher"), F.col("shift").alias("more"))
            moved = settle(sized_join(moved, again, ["parent"], ["bin"]).select(
                "bin", F.coalesce("higher", "parent").alias("parent"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        items = settle(packed.filter("open").groupBy(F.col("parent").alias("bin")).agg(F.max("filled").alias("filled")))
        count, level = items.count(), level + 1
    if moved is None:
        return items.select(F.col("bin").alias("sequence_id"), F.col("bin").alias("parent"), F.lit(0).cast("long").alias("shift"))
    return moved.withColumnRenamed("bin", "sequence_id")


def _pack_node(level, capacity, slack):
    def run(table):
        table = table.sort_by("bin")
        bins, offsets, filled = best_fit(table.column("filled").to_numpy(), capacity)
        first = level << 56 | table.column("node")[0].as_py() << 32
        return pa.table({"bin": table.column("bin"), "parent": bins + first, "shift": offsets, "filled": filled[bins],
                         "open": (filled < capacity - slack)[bins]})
    return run


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, ids (binary, pieces in order) and starts (offsets of the pieces).

    A sequence has at most as many pieces as tokens, so rows are small; equal sequence ids meet in one group.
    """
    by_place = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), by_place.alias("p")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["offset"]).alias("starts"))
