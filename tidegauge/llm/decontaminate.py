"""Benchmark passages in training text: a broadcast hash set of the benchmark's word windows, and one scan of the texts.

Windows are found by rolling 64-bit hashes over all words of a chunk of texts at once; every hit is verified by
comparing the words themselves.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.frames import extend, fields, parts, tidy, with_columns_of
from tidegauge.llm.textbytes import (
    ALNUM, LOWER, Powers, Words, byte_values, chunks, span_hashes, window_hashes, windows_inside,
)
from tidegauge.plans.spread import settle

#: Windows per broadcast; about 100 bytes each.
BLOCK_WINDOWS = 200_000


def normalised(data, words):
    """The words of a chunk, lower-cased and each followed by one space, with their starts and ends in it."""
    lengths = words.ends - words.starts
    starts = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
    out = np.full(starts[-1], 0x20, dtype=np.uint8)
    keep = np.zeros(len(data) + 1, dtype=np.int32)
    keep[words.starts] += 1
    np.subtract.at(keep, words.ends, 1)
    letters = data[np.cumsum(keep[:-1]) > 0]
    into = np.arange(len(letters)) + np.repeat(np.arange(len(words)), lengths)
    out[into] = letters
    return out, starts[:-1], starts[:-1] + lengths


def item_windows(n):
    """Rows (item, k, hash, window) of the benchmark's windows of n words, or of all words of a shorter item."""

    def run(batches):
        powers, values = Powers(), byte_values()
        for batch in batches:
            items, column = batch.column("item").to_pylist(), batch.column("text")
            for at, _, data, offsets in chunks(column):
                data = LOWER[data]
                words = Words(data, offsets, ALNUM)
                hashes = span_hashes(data, words.starts, words.ends, powers, values)
                norm, ns, ne = normalised(data, words)
                rows = []
                for i, size in enumerate(words.counts()):
                    first, k = words.first[i], min(n, int(size))
                    for w, h in enumerate(window_hashes(hashes[first:first + size], k) if k else []):
                        window = norm[ns[first + w]:ne[first + w + k - 1]].tobytes()
                        rows.append((items[at + i], k, int(h.astype(np.int64)), window))
                if rows:
                    item, k, h, window = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item, pa.string()), pa.array(k, pa.int32()), pa.array(h, pa.int64()),
                         pa.array(window, pa.binary())], names=["item", "k", "hash", "window"])

    return run


class HashSet:
    """Windows by length: sorted hashes, a bit table before them, and the text and items of each hash."""

    BITS = 20

    def __init__(self, by_length):
        self.by_length = by_length

    @classmethod
    def build(cls, rows):
        """Plain arrays and dicts, so that a broadcast of them needs no class on the executors."""
        by_length = {}
        for k in sorted({r["k"] for r in rows}):
            texts = {}
            for r in rows:
                if r["k"] == k:
                    texts.setdefault(r["hash"] & 0xFFFFFFFFFFFFFFFF, {}).setdefault(bytes(r["window"]), set()).add(r["item"])
            hashes = np.array(sorted(texts), dtype=np.uint64)
            bits = np.zeros(1 << cls.BITS, dtype=bool)
            bits[hashes >> np.uint64(64 - cls.BITS)] = True
            by_length[k] = hashes, bits, texts
        return by_length

    def hits(self, words, hashes, norm, ns, ne):
        """(first word, length, items) of every verified occurrence."""
        for k, (known, bits, texts) in self.by_length.items():
            if len(hashes) < k:
                continue
            at = windows_inside(words, k)
            h = window_hashes(hashes, k)[at]
            maybe = np.flatnonzero(bits[h >> np.uint64(64 - self.BITS)])
            at, h = at[maybe], h[maybe]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for w, x in zip(at[known[place] == h].tolist(), h[known[place] == h].tolist()):
                items = texts[x].get(norm[ns[w]:ne[w + k - 1]].tobytes())
                if items:
                    yield w, k, items


def scan(docs: DataFrame, benchmark: DataFrame, n=10, text_col="text", item_col="item_id", item_text_col="text",
         block_windows=BLOCK_WINDOWS) -> DataFrame:
    """Adds n_words, n_hit (longs), whole_window (boolean), items (sorted array of item ids as strings) and spans to ``docs``.

    A-Z is lower-cased and words are runs of digits, letters and all characters beyond ASCII. A window is n consecutive
    words of an item; an item of fewer words, but not none, is one window. A word inside any occurrence of a window is
    hit; ``whole_window`` tells whether any of them has all n words. ``spans`` has the byte ranges [start, end) of maximal runs of hit words in the UTF-8 text, from the first hit
    word to the last. Null texts have no words. Items without an id count under the empty id; items that share an id are
    one item. Columns of the added names give way.

    The windows are written and counted first. They go out in broadcasts of ``block_windows``; a larger benchmark is
    scanned for block by block.
    """
    spark = docs.sparkSession
    docs = tidy(docs, [text_col], ["n_words", "n_hit", "whole_window", "items", "spans"])
    benchmark = tidy(benchmark, [item_col, item_text_col], [])
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
                             F.col(f"`{item_text_col}`").alias("text"))
    windows = settle(items.mapInArrow(item_windows(n), "item string, k int, hash long, window binary").distinct())
    blocks = max(1, -(-windows.count() // block_windows))
    made = fields("n_words long, n_hit long, whole_window boolean, items array<string>, spans array<struct<start:long,end:long>>")
    state = fields("__hit binary, __whole boolean, __items array<string>")
    out = docs
    for b in range(blocks):
        block = windows.filter(F.pmod("hash", F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(HashSet.build([r.asDict() for r in block.collect()]))
        last = b == blocks - 1
        out = out.mapInArrow(_scan(text_col, n, shared, b == 0, last), with_columns_of(out, made if last else state))
        out = out if last else settle(out)
    return out.drop("__hit", "__whole", "__items")


def _scan(text_col, n, shared, first, last):
    """A pass over the documents; between passes ``__hit`` has a byte per word, ``__whole`` and ``__items`` what is found so far."""

    def run(batches):
        known, powers, values = HashSet(shared.value), Powers(), byte_values()
        for batch in parts(batches, text_col):
            made = []
            for at, end, data, offsets in chunks(batch.column(text_col)):
                data = LOWER[data]
                words = Words(data, offsets, ALNUM)
                hashes = span_hashes(data, words.starts, words.ends, powers, values)
                norm, ns, ne = normalised(data, words)
                texts = words.text_of_word()
                found = [set() for _ in range(end - at)] if first else [set(x) for x in batch.column("__items")[at:end].to_pylist()]
                whole = [False] * (end - at) if first else batch.column("__whole")[at:end].to_pylist()
                step = np.zeros(len(words) + 1, dtype=np.int64)
                for w, k, items in known.hits(words, hashes, norm, ns, ne):
                    step[w] += 1
                    step[w + k] -= 1
                    found[texts[w]] |= items
                    whole[texts[w]] |= k == n
                hit = np.cumsum(step[:-1]) > 0
                if not first:
                    hit |= np.frombuffer(b"".join(batch.column("__hit")[at:end].to_pylist()), bool)
                for i in range(end - at):
                    a, b = words.first[i], words.first[i + 1]
                    made.append((hit[a:b], sorted(found[i]), _runs(hit[a:b], words.starts[a:b], words.ends[a:b], offsets[i]), whole[i]))
            if last:
                yield extend(batch, {
                    "n_words": pa.array([len(m[0]) for m in made], pa.int64()),
                    "n_hit": pa.array([int(m[0].sum()) for m in made], pa.int64()),
                    "whole_window": pa.array([m[3] for m in made], pa.bool_()),
                    "items": pa.array([m[1] for m in made], pa.list_(pa.string())),
                    "spans": pa.array([m[2] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
            else:
                yield extend(batch, {"__hit": pa.array([m[0].tobytes() for m in made], pa.binary()),
                                     "__whole": pa.array([m[3] for m in made], pa.bool_()),
                                     "__items": pa.array([m[1] for m in made], pa.list_(pa.string()))})

    return run


def _runs(hit, starts, ends, base):
    if not hit.any():
        return []
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [{"start": int(starts[x] - base), "end": int(ends[y] - base)} for x, y in zip(a, b)]


def remove_spans(scanned: DataFrame, text_col="text") -> DataFrame:
    """The scanned documents with the bytes of ``spans`` taken out of the text.

    In columns: a second Python operator behind the scan would need a second worker for every core. Spans begin and end with
    words, so what is left between them is whole characters.
    """
    text, spans = F.col(f"`{text_col}`"), F.col("spans")
    raw = text.cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), spans["end"])
    ends = F.concat(spans["start"], F.array(F.octet_length(raw).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return scanned.withColumn(text_col, F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text))
