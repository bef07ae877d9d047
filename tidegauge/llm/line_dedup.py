"""Lines that many documents share, found by counting and dropped by probing minimal perfect hashes.

The hashes of all lines are counted in one shuffle. Those that reach the threshold go into shards; a task per shard builds
a minimal perfect hash over its lines, and with it arrays of fingerprints and counts. Documents then probe the arrays:
no line is joined.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.frames import ROW, extend, fields, parts, tidy, with_columns_of, with_row_ids
from tidegauge.llm.textbytes import mix
from tidegauge.plans.spread import settle

SPACE = b" \t\n\x0b\x0c\r"
PER_SHARD = 20_000
BLOCK_KEYS = 2_000_000
#: In-task counts are passed on when so many distinct lines are held.
HELD = 200_000


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends and A-Z lower-cased; bytes methods leave all other characters alone."""
    return line.strip(SPACE).lower()


def _digests(text):
    """128-bit digest per line, or None for lines without a key."""
    return [xxhash.xxh3_128_digest(k) if (k := line_key(line)) else None for line in (text or "").encode().split(b"\n")]


def count_lines(batches):
    """(h1, h2, docs, first): in how many documents each key stands, and the least row, added up within the task."""
    docs, first = {}, {}

    def out():
        both = np.frombuffer(b"".join(docs), ">u8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.fromiter(docs.values(), np.int64, len(docs))),
             pa.array(np.fromiter(first.values(), np.int64, len(first)))], names=["h1", "h2", "docs", "first"])

    for batch in parts(batches, "text"):
        for text, row in zip(batch.column("text"), batch.column("row").to_pylist()):
            for d in set(_digests(text.as_py())):
                if d is not None:
                    docs[d] = docs.get(d, 0) + 1
                    first[d] = min(first.get(d, row), row)
            if len(docs) > HELD:
                yield out()
                docs, first = {}, {}
    if docs:
        yield out()


def build_hash(h1, h2):
    """Minimal perfect hash of distinct (h1, h2): displacement per bucket, and each key's slot.

    Hash and displace: buckets of about three keys, the largest first, each takes the first displacement that sends its
    keys to free slots of their own.
    """
    n = len(h1)
    m = max(1, n // 3)
    bucket = h1 % np.uint64(m)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(m + 1, dtype=np.uint64))
    shift = np.zeros(m, dtype=np.uint32)
    slots = np.zeros(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    for b in np.argsort(-np.diff(starts), kind="stable"):
        keys = order[starts[b]:starts[b + 1]]
        if not len(keys):
            break
        d = 0
        while True:
            tries = np.arange(d, d + 64, dtype=np.uint64)
            at = slot_of(h1[keys][None, :], h2[keys][None, :], tries[:, None], np.uint64(n))
            good = free[at].all(axis=1)
            if len(keys) > 1:
                good &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
            if good.any():
                i = int(np.argmax(good))
                shift[b], slots[keys], free[at[i]] = d + i, at[i], False
                break
            d += 64
    return shift, slots


def slot_of(h1, h2, displacement, n):
    return (mix(h2 ^ mix(displacement * np.uint64(0x9E3779B97F4A7C15) + h1)) % n).astype(np.int64)


def build_shard(table: pa.Table) -> pa.Table:
    """The arrays of one shard as one row of binaries."""
    h1, h2 = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
    docs, first = table.column("docs").to_numpy(), table.column("first").to_numpy()
    shift, slots = build_hash(h1, h2)
    prints, counts, rows = np.zeros(len(h1), np.uint64), np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
    prints[slots], counts[slots], rows[slots] = h1 ^ (h2 << np.uint64(1)), np.minimum(docs, 0xFFFFFFFF), first
    return pa.table({"shard": table.column("shard")[:1], "keys": pa.array([len(h1)], pa.int64()),
                     "shift": pa.array([shift.tobytes()]), "prints": pa.array([prints.tobytes()]),
                     "counts": pa.array([counts.tobytes()]), "first": pa.array([rows.tobytes()])})


class Arrays:
    """The arrays of some shards, end to end, for vectorised probes."""

    def __init__(self, packed):
        vars(self).update(packed)

    @classmethod
    def pack(cls, rows, shards):
        """Plain arrays, so that a broadcast of them needs no class on the executors."""
        self = cls({})
        rows = sorted(rows, key=lambda r: r["shard"])
        self.shards = shards
        self.place = np.full(shards, -1, dtype=np.int64)
        self.place[[r["shard"] for r in rows]] = np.arange(len(rows))
        self.size = np.array([r["keys"] for r in rows], dtype=np.int64)
        self.key_at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        shift = [np.frombuffer(r["shift"], np.uint32) for r in rows]
        self.buckets = np.array([len(s) for s in shift], dtype=np.int64)
        self.shift_at = np.concatenate([[0], np.cumsum(self.buckets)]).astype(np.int64)
        self.shift = np.concatenate(shift)
        self.prints = np.concatenate([np.frombuffer(r["prints"], np.uint64) for r in rows])
        self.counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
        self.first = np.concatenate([np.frombuffer(r["first"], np.int64) for r in rows])
        return vars(self)

    def probe(self, h1, h2):
        """(documents, least row) per key; 0 documents for keys that are not in these shards."""
        out, rows = np.zeros(len(h1), dtype=np.int64), np.zeros(len(h1), dtype=np.int64)
        place = self.place[shard_of(h1, self.shards)]
        known = np.flatnonzero(place >= 0)
        place, a, b = place[known], h1[known], h2[known]
        bucket = (a % self.buckets[place].astype(np.uint64)).astype(np.int64)
        shift = self.shift[self.shift_at[place] + bucket].astype(np.uint64)
        at = self.key_at[place] + slot_of(a, b, shift, self.size[place].astype(np.uint64))
        out[known] = np.where(self.prints[at] == a ^ (b << np.uint64(1)), self.counts[at], 0)
        rows[known] = self.first[at]
        return out, rows


def shard_of(h1, shards):
    return ((h1 >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def drop_common_lines(docs: DataFrame, min_docs=10, text_col="text", keep_first_by=None, block_keys=BLOCK_KEYS) -> DataFrame:
    """``docs`` without the lines whose key stands in at least ``min_docs`` rows.

    With ``keep_first_by``, a column of ids, such lines stay in the row with the least id that has them (of rows whose ids
    repeat or are null, in the one written first).

    The text is cut at \\n; a line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Lines
    without a key stay. Adds n_lines, n_dropped (longs) and kept_text; columns of these names give way. A null or empty
    text is one empty line and is kept as an empty text. Rows count one by one, whether or not their ids repeat.

    Keys are 128-bit hashes, counted exactly; a foreign line takes a frequent one's place with a chance of 2**-64. The
    arrays hold at most ``block_keys`` lines (about 22 bytes each) per broadcast; more are probed block by block.
    """
    spark = docs.sparkSession
    docs = tidy(docs, [text_col, *([keep_first_by] if keep_first_by else [])], ["n_lines", "n_dropped", "kept_text"])
    docs = with_row_ids(docs, keep_first_by)[0] if keep_first_by else docs.withColumn(ROW, F.lit(-1).cast("long"))
    counted = (docs.select(F.col(f"`{text_col}`").alias("text"), F.col(ROW).alias("row"))
               .mapInArrow(count_lines, "h1 long, h2 long, docs long, first long").groupBy("h1", "h2")
               .agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).filter(F.col("docs") >= min_docs))
    common = settle(counted)
    total = common.count()
    shards = max(1, -(-total // PER_SHARD))
    shard = F.shiftrightunsigned("h1", 40) % F.lit(shards)
    arrays = settle(common.withColumn("shard", shard).groupBy("shard")
                    .applyInArrow(build_shard, "shard long, keys long, shift binary, prints binary, counts binary, first binary"))
    made = fields("n_lines long, n_dropped long, kept_text string")
    per_block = max(1, block_keys // PER_SHARD)
    out, first = docs, True
    for at in range(0, shards, per_block):
        rows = [r.asDict() for r in arrays.filter(F.col("shard").between(at, at + per_block - 1)).collect()]
        shared = spark.sparkContext.broadcast(Arrays.pack(rows, shards) if rows else None)
        last = at + per_block >= shards
        found = [] if last else fields("__common binary")
        out = out.mapInArrow(_probe(text_col, shared, bool(keep_first_by), first, last), with_columns_of(out, (made if last else found)))
        out, first = (out if last else settle(out)), False
    return out.drop("__common", ROW)


def _probe(text_col, shared, keep_first, first, last):
    """A pass over the documents; between passes ``__common`` has a byte per line: whether it was found."""

    def probe(batches):
        arrays = Arrays(shared.value) if shared.value else None
        for batch in parts(batches, text_col):
            texts = [(t or "").encode().split(b"\n") for t in batch.column(text_col).to_pylist()]
            keys = [line_key(line) for lines in texts for line in lines]
            has = np.array([bool(k) for k in keys], dtype=bool)
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">u8").astype(np.uint64).reshape(-1, 2)
            common = np.zeros(len(keys), bool)
            if arrays:
                found, least = arrays.probe(both[:, 0], both[:, 1])
                common = has & (found > 0)
                if keep_first:
                    common &= least != np.repeat(batch.column(ROW).to_numpy(), [len(lines) for lines in texts])
            if not first:
                common |= np.frombuffer(b"".join(batch.column("__common").to_pylist()), bool)
            ends = np.cumsum([len(lines) for lines in texts])
            marks = np.split(common, ends[:-1])
            if not last:
                yield extend(batch, {"__common": pa.array([m.tobytes() for m in marks], pa.binary())})
                continue
            kept = [(b"\n".join(line for line, c in zip(lines, m) if not c) if m.any() else b"\n".join(lines)).decode()
                    for lines, m in zip(texts, marks)]
            yield extend(batch, {
                "n_lines": pa.array([len(m) for m in marks], pa.int64()),
                "n_dropped": pa.array([int(m.sum()) for m in marks], pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return probe
