"""Alignment of the tokens that two tokenizers cut from the same texts.

Everything inside a task is columnar: token lists are flattened with the index of their text, byte ends are cumulative
sums that start anew in every text, and an Acero hash join on (text, end) finds where tokens of both tokenizers end
together. Every task counts by ``Table.group_by`` how many of its texts link two ids; Spark adds these counts up. Counts
that many links ask for are broadcast, at most ``BROADCAST_PAIRS`` of them; links to other pairs are joined.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.acero as acero
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidegauge.llm.bpe import load_vocabulary
from tidegauge.llm.frames import fields, pick
from tidegauge.plans.spread import shared_folder

#: Characters, texts and tokens that a task takes at a time, and pairs it adds up before it hands them on.
CHUNK_CHARS, CHUNK_TEXTS, CHUNK_TOKENS, HELD_PAIRS = 1 << 19, 2048, 1 << 17, 1 << 19
BROADCAST_PAIRS = 1 << 21
_B = 20
_TOKENS = "a array<int>, b array<int>, a_cut binary, b_cut binary"
_COUNTS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

#: How byte-level vocabularies cut text before merging (fixed value).
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Tokens of a byte-level ``tokenizers`` JSON file; strings of special tokens are plain text."""

    def __init__(self, path):
        import tiktoken
        tables = load_vocabulary(path)
        self.path, self.library, special = path, None, set(tables["special"].values())
        self.bytes = tables["strings"]
        ranks = {s: i for i, s in enumerate(self.bytes) if s and i not in special}
        if tables["made"] != sorted(tables["made"]):
            raise ValueError("ids do not follow the order of the merges")
        self.ranks = tiktoken.Encoding("bytes", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts):
        return [self._encode(" " + t) for t in texts]

    def _encode(self, text):
        try:
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        except BaseException as error:  # its pattern can give up on very long runs, with an error of its own kind
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class PieceTokens:
    """Tokens of a sentencepiece model, which itself puts a space before the text."""

    def __init__(self, path):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode_all = getattr(self.model, "encode_as_numpy", self.model.encode)  # without a list of numbers in between
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]

    def encode(self, texts):
        return [np.asarray(ids, np.int32) for ids in self.encode_all(texts, num_threads=1)]


def _lists(arrays):
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.zeros(0, np.int32))


def _faithful(lists, strings, sizes, wanted):
    """Whether the bytes of a text's tokens, end to end, are the text's."""
    flat, offsets = pc.list_flatten(lists), lists.offsets.to_numpy()
    total = np.concatenate([[0], np.cumsum(pc.take(sizes, flat).to_numpy())])
    same = total[offsets[1:]] - total[offsets[:-1]] == [len(w) for w in wanted]
    data = memoryview(pc.take(strings, flat).buffers()[2] or b"").cast("B")
    for i in np.flatnonzero(same).tolist():
        same[i] = data[total[offsets[i]]:total[offsets[i + 1]]] == wanted[i]
    return same


class Tokens:
    """One tokenizer's tokens of a chunk, flat: ids, the text of each, byte ends within the text and over the chunk."""

    def __init__(self, lists, sizes):
        self.ids = pc.list_flatten(lists)
        self.text = pc.list_parent_indices(lists)
        self.offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        running = pc.cumulative_sum(pc.take(sizes, self.ids)).to_numpy()
        self.until = running
        before = np.concatenate([[0], running])[self.offsets[:-1]]
        self.end = running - np.repeat(before, np.diff(self.offsets))

    def __len__(self):
        return len(self.ids)


def cuts(a: Tokens, b: Tokens):
    """Flags of the tokens of either side that end where a token of the other side ends, too."""
    left, right = (pa.table({"at": t.text.to_numpy().astype(np.int64) << 40 | t.end, n: np.arange(len(t), dtype=np.int32)})
                   for t, n in ((a, "i"), (b, "j")))
    # (text, end) is one number, and only the places are handed out: a table's own join would copy the keys, too.
    join = acero.Declaration("hashjoin", acero.HashJoinNodeOptions("inner", ["at"], ["at"], ["i"], ["j"]), inputs=[
        acero.Declaration("table_source", acero.TableSourceNodeOptions(t)) for t in (left, right)])
    met = join.to_table(use_threads=False)
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    in_a[met.column("i").to_numpy()] = True
    in_b[met.column("j").to_numpy()] = True
    return in_a, in_b


def links(a: Tokens, b: Tokens, in_a):
    """(token of a, token of b) of all pairs whose byte ranges overlap. Both sides cover the same bytes of the chunk.

    A token has at least a byte, so what a token of a begins with is where the one before it ended, or the next token of b
    if both ended together (``in_a``).
    """
    last = np.searchsorted(b.until, a.until, side="left")
    first = np.zeros_like(last)
    first[1:] = (last + in_a)[:-1]
    n = last - first + 1
    i = np.repeat(np.arange(len(a)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _keys(a, b, i, j):
    return a.ids.to_numpy().astype(np.int64)[i] << _B | b.ids.to_numpy()[j]


def _document_counts(text, key):
    """(pair, n): how many texts of the chunk hold a pair."""
    once = pa.table({"text": text, "pair": key}).group_by(["text", "pair"], use_threads=False).aggregate([])
    return once.group_by("pair", use_threads=False).aggregate([("text", "count")]).rename_columns(["pair", "n"])


def _added_up(tables):
    both = pa.concat_tables(tables)
    return both.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def _chunks(batches):
    """(ids, texts) of a bounded size; a longer text stands alone."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= CHUNK_CHARS or len(ids) >= CHUNK_TEXTS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _packed(flags, offsets):
    return pa.array([np.packbits(flags[s:e]).tobytes() for s, e in zip(offsets, offsets[1:])], pa.binary())


def _rows(arrow, columns):
    """A batch with the given columns; the others of the schema are null."""
    made = {n: c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, arrow.field(n).type) for n, c in columns.items()}
    n = len(next(iter(made.values())))
    return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) for f in arrow],
                                      schema=arrow)


def _tokenize(batches, a_path, b_path, arrow):
    """Rows of texts (id, row, tokens, cuts) and rows of counts (pair, n)."""
    a_side, b_side = ByteTokens(a_path), PieceTokens(b_path)
    a_strings, b_strings = pa.array(a_side.bytes, pa.binary()), pa.array(b_side.bytes, pa.binary())
    a_sizes, b_sizes = (pc.cast(pc.binary_length(s), pa.int64()) for s in (a_strings, b_strings))
    row, held, n_held = TaskContext.get().partitionId() << 33, [], 0
    none = np.zeros(0, np.int32)

    for ids, texts in _chunks(batches):
        at = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in at]
        wanted = [b" " + t.encode() for t in some]
        sides = [_lists(side.encode(some)) for side in (a_side, b_side)]
        good = _faithful(sides[0], a_strings, a_sizes, wanted) & _faithful(sides[1], b_strings, b_sizes, wanted)
        made = []
        for lists in sides:
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            arrays = [none] * len(texts)
            for k, i in enumerate(at):
                if good[k]:
                    arrays[i] = flat[offsets[k]:offsets[k + 1]]
            made.append(_lists(arrays))
        a, b = Tokens(made[0], a_sizes), Tokens(made[1], b_sizes)
        in_a, in_b = cuts(a, b)
        yield _rows(arrow, {"id": ids, "row": np.arange(row, row + len(ids)), "a": made[0], "b": made[1],
                            "a_cut": _packed(in_a, a.offsets), "b_cut": _packed(in_b, b.offsets)})
        row += len(ids)
        pa.default_memory_pool().release_unused()
        if len(a):
            i, j = links(a, b, in_a)
            held.append(_document_counts(a.text.to_numpy()[i], _keys(a, b, i, j)))
            n_held += held[-1].num_rows
        if n_held >= HELD_PAIRS:
            held = [_added_up(held)]
            n_held = held[0].num_rows
            if n_held >= HELD_PAIRS // 2:
                yield from (_rows(arrow, t) for t in _slices(held[0]))
                held, n_held = [], 0
    if held:
        yield from (_rows(arrow, t) for t in _slices(_added_up(held)))


def _slices(counts, rows=65_536):
    return [{n: counts.column(n).slice(at, rows).combine_chunks() for n in ("pair", "n")} for at in range(0, counts.num_rows, rows)]


def _stored(df):
    """Written to the shared folder, packed tightly: two lists of ids for every text."""
    path = f"{shared_folder(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _frequent(counts):
    """Smallest power of two such that at most ``BROADCAST_PAIRS`` pairs have as many texts; 1 takes all pairs."""
    sizes = {r.p: r["count"] for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("p")).count().collect()}
    least, total = max(sizes, default=-1) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= BROADCAST_PAIRS:
        least -= 1
        total += sizes.get(least, 0)
    return 1 << least


def align(docs: DataFrame, a_path, b_path, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """Aligns the tokens of a byte-level BPE vocabulary (a) with those of a sentencepiece model (b); gives two tables.

    The first has per document: the id column; n_a and n_b, its tokens; n_groups, the parts between two places where
    tokens of both end; n_links, the pairs of tokens that overlap in bytes; n_best, the links whose count is the highest of
    their a id; count_sum, the counts of all links; groups, the ids as text, ``a1,a2|b1;a3|b2``. The second has (a, b, n,
    best): the documents that link a pair of ids, and whether no pair of that a id has more.

    Both encode a space and the text. Null and empty texts, and texts that one of the tokenizers changes, have no tokens:
    zeros and an empty text. Repeated rows and equal or null ids are documents of their own; a table without rows gives
    none. Other columns are not returned, whatever their names. Texts of any length are taken whole.
    """
    id_field = docs.schema[id_col]
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = StructType([StructField("id", id_field.dataType)] + fields(f"row long, {_TOKENS}, pair long, n long"))
    arrow = to_arrow_schema(schema)
    stored = _stored(pick(docs, id=id_col, text=text_col).mapInArrow(lambda batches: _tokenize(batches, a_path, b_path, arrow), schema))
    counts = stored.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", _B))
    counts = _stored(counts)
    # One row per id of the vocabulary.
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(highest), "a").withColumn("best", F.col("n") == F.col("most")).drop("most")
    least = _frequent(counts)
    often = counts.filter(F.col("n") >= least).select("pair", "n", "best").toArrow()
    # Bounded by BROADCAST_PAIRS and by the vocabularies.
    sizes = [np.array([len(s) for s in side.bytes]) for side in (ByteTokens(a_path), PieceTokens(b_path))]
    seen = docs.sparkSession.sparkContext.broadcast(([often.column(c).to_numpy() for c in ("pair", "n", "best")], sizes))
    texts = stored.filter("row is not null").select("id", "row", "a", "b", "a_cut", "b_cut")
    out_schema = StructType([StructField("id", id_field.dataType)] + fields(f"row long, {_COUNTS}, rest array<long>"))
    out_arrow = to_arrow_schema(out_schema)
    found = texts.mapInArrow(lambda batches: _count(batches, seen, out_arrow), out_schema)
    columns = [c.split()[0] for c in _COUNTS.split(", ")]
    if least > 1:  # rarer pairs are joined: a pair has fewer than ``least`` texts, so no key is frequent
        found = _stored(found)
        rare = (found.select("row", F.explode("rest").alias("pair"))
                .join(counts.filter(F.col("n") < least).select("pair", "n", "best").hint("merge"), "pair")
                .groupBy("row").agg(F.sum("n").alias("more"), F.count_if("best").alias("more_best")))
        found = found.join(rare.hint("merge"), "row", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)),
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    pairs = counts.select(F.col("a").cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _B) - 1)).cast("int").alias("b"),
                          "n", "best")
    return found.select(F.col("id").alias(id_field.name), *columns), pairs


class _Places:
    """Places of many keys at once: a hash table with open addressing, at most half full."""

    def __init__(self, keys):
        self.bits = max(int(len(keys) * 2).bit_length(), 4)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.place = np.zeros(1 << self.bits, np.int32)
        left, shift = np.arange(len(keys)), 0
        while len(left):
            slot = self._slots(keys[left], shift)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.place[slot[mine]] = left[mine]
            left, shift = left[~mine], shift + 1
        self.longest = shift

    def _slots(self, keys, shift):
        hashed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return (hashed.astype(np.int64) + shift) & ((1 << self.bits) - 1)

    def find(self, keys):
        """Place of every key, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for shift in range(self.longest):
            slot = self._slots(keys[left], shift)
            held = self.keys[slot]
            mine = held == keys[left]
            out[left[mine]] = self.place[slot[mine]]
            left = left[~mine & (held != -1)]
            if not len(left):
                break
        return out


def _count(batches, seen, arrow):
    (pairs, counts, best), sizes = seen.value
    a_sizes, b_sizes = (pa.array(s, pa.int64()) for s in sizes)
    names = [pa.array([str(i) for i in range(len(s))]) for s in sizes]
    places = _Places(pairs)
    for batch in batches:
        for part in _bounded(batch):
            a, b = Tokens(part.column("a"), a_sizes), Tokens(part.column("b"), b_sizes)
            n = part.num_rows
            in_a, in_b = (_unpacked(part.column(c), t.offsets) for c, t in (("a_cut", a), ("b_cut", b)))
            i, j = links(a, b, in_a)
            text, key = a.text.to_numpy()[i], _keys(a, b, i, j)
            place = places.find(key)
            known = place >= 0
            # Counts add up exactly: links of one text, which stand together, to their known pairs.
            until = np.searchsorted(text, np.arange(n + 1))
            sums, bests = (_sums(np.where(known, v[place], 0), until) if len(v) else np.zeros(n, np.int64) for v in (counts, best))
            rest = _lists_of(text[~known], key[~known], n)
            n_a, n_b = np.diff(a.offsets), np.diff(b.offsets)
            groups, n_groups = _groups(a, b, in_a, in_b, names, n)
            made = [n_a, n_b, n_groups, n_a + n_b - n_groups, bests, sums]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), *[pa.array(m, pa.int64()) for m in made],
                                              groups, rest], schema=arrow)
        pa.default_memory_pool().release_unused()


def _sums(values, until):
    """Sums of consecutive groups, as longs."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[until])


def _bounded(batch):
    """Slices with a bounded number of tokens; a longer text stands alone."""
    size = np.cumsum(pc.list_value_length(batch.column("a")).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(size, before + CHUNK_TOKENS, side="right"))), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _unpacked(column, offsets):
    out = [np.unpackbits(np.frombuffer(v, np.uint8), count=e - s) for v, s, e in zip(column.to_pylist(), offsets, offsets[1:])]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _lists_of(text, values, n):
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(text, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))


def _groups(a, b, in_a, in_b, names, n):
    """``a1,a2|b1;...`` of every text and its number of groups: three joins of strings, from ids up to texts."""
    sides = []
    for t, flags, name in ((a, in_a, names[0]), (b, in_b, names[1])):
        bounds = np.concatenate([[0], np.flatnonzero(flags) + 1]).astype(np.int32)
        lists = pa.ListArray.from_arrays(bounds, pc.take(name, t.ids))
        sides.append(pc.binary_join(lists, ","))
    both = pc.binary_join_element_wise(*sides, "|")
    inside = np.concatenate([[0], np.cumsum(in_a)])[a.offsets].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(inside, both), ";"), np.diff(inside).astype(np.int64)
