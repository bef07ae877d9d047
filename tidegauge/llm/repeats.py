"""Passages of texts that stand in an earlier text already, found by parsing the corpus into phrases.

1. Parse. A rolling hash over the bytes triggers phrases: of every ``length`` consecutive bytes the least hash is the
   trigger, so equal passages have equal triggers, wherever they stand. A phrase is all windows that share a trigger, with
   the bytes they cover; neighbours overlap, so no window is lost between two phrases.
2. Dictionary. Phrases are compared by hash, trigger first. A phrase that an earlier text has too is removed whole. Only
   where one trigger stands in different phrases the dictionary's texts are needed.
3. Order. The suffixes of these phrases are sorted by their bytes, to the depth of a window: the corpus order of all
   windows that could be equal, each with the earliest text that has it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.frames import ROW, extend, fields, join_lists, tidy, with_columns_of, with_row_ids
from tidegauge.llm.textbytes import Powers, buffers, byte_values, mix
from tidegauge.plans.spread import settle, sized_join

TRIGGER = 20
SEGMENT = 1 << 19
BLOCK_ROWS = 200_000
#: A trigger with more phrases than this is compared window by window, spread by the windows' hashes.
LARGE = 20_000
#: Bytes of phrases whose suffixes are sorted at a time.
SORTED_BYTES = 2 << 20
_AT = 25
_LEN = 5


def _u(x):
    return np.uint64(x)


def phrases(data, offsets, length, powers, values):
    """(text, start, windows, trigger hash, phrase hash) of the phrases of some texts, a segment of windows at a time."""
    wide = length - TRIGGER + 1
    for at in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[at:at + SEGMENT + length - 1]
        n = len(part) - TRIGGER + 1
        up, down = powers.upto(len(part) + 1)
        running = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * up[:len(part)], out=running[1:])
        h = mix((running[TRIGGER:] - running[:n]) * down[:n])
        # The least hash of every window, its leftmost place in the low bits.
        least, size = (h & ~_u((1 << _AT) - 1)) | np.arange(n, dtype=np.uint64), 1
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < wide:
            least = np.minimum(least[:size - wide], least[wide - size:])
        trigger = (least & _u((1 << _AT) - 1)).astype(np.int64)
        i = np.arange(len(trigger))
        text = np.searchsorted(offsets, at + i, side="right") - 1
        inside = at + i + length <= offsets[text + 1]
        i, trigger, text = i[inside], trigger[inside], text[inside]
        if not len(i):
            continue
        new = np.ones(len(i), dtype=bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        start, end = i[first], i[np.append(first[1:], len(i)) - 1]
        t = trigger[first]
        whole = mix((running[end + length] - running[start]) * down[start] + (((t - start) << 8) + end - start).astype(np.uint64))
        yield text[first], at + start - offsets[text[first]], end - start + 1, h[t], whole


def _parse(length):
    """Rows (k1, k2, doc): 44 bits of the trigger's hash and 20 + 24 of the phrase's, then start and windows.

    Of equal phrases in a segment only the earliest text's is compared further; the others are hits already. They have
    a negative doc and a key of their own, so that a phrase of very many texts does not meet in one task.
    """
    def run(batches):
        powers, values = Powers(), byte_values()
        for batch in batches:
            rows = batch.column("row").to_numpy()
            data, offsets = buffers(batch.column("text"))
            for text, start, windows, h, whole in phrases(data, offsets, length, powers, values):
                doc = rows[text]
                k1 = (h >> _u(20) << _u(20)) | (whole >> _u(44))
                k2 = ((whole & _u(0xFFFFFF)) << _u(40)) | (start.astype(np.uint64) << _u(_LEN)) | (windows - 1).astype(np.uint64)
                order = np.lexsort((doc, k2 >> _u(40), k1))
                k1, k2, doc = k1[order], k2[order], doc[order]
                same = np.zeros(len(doc), dtype=bool)
                same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] >> _u(40) == k2[:-1] >> _u(40))
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
                hit = doc > doc[first]
                k1 = np.where(hit, mix(doc.view(np.uint64) ^ k2), k1)
                doc = np.where(hit, -doc - 1, doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(doc)], names=["k1", "k2", "doc"])

    return run


def _compare(batches):
    """Rows (row, span, trigger) from phrases sorted by trigger, phrase and text; the trigger is null for hits.

    Later texts of a phrase are hits. The earliest text's phrase is open, and goes on with its trigger, if the trigger stands
    in another phrase as well. What must be known of the rows before a block is one row, and the places of the first phrase
    in one text.
    """
    before = None

    def run(k1, k2, doc):
        nonlocal before
        resolved = doc < 0
        out = [(-doc[resolved] - 1, k2[resolved], None)]
        k1, k2, doc = k1[~resolved], k2[~resolved], doc[~resolved]
        if not len(doc):
            return out
        if before is not None:
            k1, k2, doc = np.append(before["k1"], k1), np.append(before["k2"], k2), np.append(before["doc"], doc)
        own = np.ones(len(doc), dtype=bool)
        own[0] = before is None
        h, u = k1 >> _u(20), k2 >> _u(40)
        new_h = np.append(True, h[1:] != h[:-1])
        new_u = new_h | np.append(True, (k1[1:] != k1[:-1]) | (u[1:] != u[:-1]))
        first_u, which_h = np.flatnonzero(new_u), np.cumsum(new_h) - 1
        earliest = doc[first_u][np.cumsum(new_u) - 1]
        hit = doc > earliest
        out.append((doc[hit], k2[hit], None))
        several = np.add.reduceat(new_u.astype(np.int64), np.flatnonzero(new_h)) > 1
        if before is not None and before["several"]:
            several[0] = True
        early = own & (doc == earliest)
        opened = early & several[which_h]
        out.append((doc[opened], k2[opened], h[opened]))
        held = before["held"] if before is not None else []
        if several[0]:
            out += held
        if several[-1]:
            held = []
        else:
            waiting = early & (which_h == which_h[-1])
            held = (held if which_h[-1] == 0 else []) + [(doc[waiting], k2[waiting], h[waiting])]
        last = int(first_u[-1])
        before = {"k1": k1[last], "k2": k2[last], "doc": doc[last], "several": bool(several[-1]), "held": held}
        return out

    def flush(held):
        k1, k2, doc = (np.concatenate(x) for x in zip(*held))
        for row, span, trigger in run(k1, k2, doc):
            if len(row):
                span = (span & _u((1 << 40) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row.astype(np.int64)), pa.array(span),
                     pa.nulls(len(row), pa.int64()) if trigger is None else pa.array(trigger.astype(np.int64))],
                    names=[ROW, "span", "trigger"])

    held, rows = [], 0
    for batch in batches:
        k1, k2, doc = (batch.column(c).to_numpy() for c in ("k1", "k2", "doc"))
        held.append((k1.view(np.uint64), k2.view(np.uint64), doc))
        rows += len(doc)
        if rows >= BLOCK_ROWS:
            yield from flush(held)
            held, rows = [], 0
    if held:
        yield from flush(held)


def _texts_of_phrases(length):
    """(key, row, start, bytes) of the open phrases; those of a large trigger one window at a time under its own hash."""
    def run(batches):
        powers, values = Powers(), byte_values(1)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows, lists = batch.column(ROW).to_pylist(), batch.column("open").to_pylist()
            out, singles = [], {}
            for i, (row, entries) in enumerate(zip(rows, lists)):
                for e in entries or []:
                    start, windows = e["span"] >> _LEN, (e["span"] & ((1 << _LEN) - 1)) + 1
                    at = int(offsets[i]) + start
                    if not e["large"]:
                        out.append((e["trigger"], row, start, data[at:at + windows + length - 1].tobytes()))
                        continue
                    for w in range(windows):
                        singles.setdefault(data[at + w:at + w + length].tobytes(), []).append((row, start + w))
            for text, places in singles.items():
                whole = np.frombuffer(text, np.uint8)
                up, _ = powers.upto(length)
                key = int(mix((values[whole] * up).sum(dtype=np.uint64, keepdims=True)).astype(np.int64)[0])
                earliest = min(p[0] for p in places)
                # Later texts are hits already; they say so by a null text.
                out += [(key if row == earliest else row, row, start, text if row == earliest else None) for row, start in places]
            if out:
                key, row, start, text = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(row, pa.int64()), pa.array(start, pa.int64()),
                                                  pa.array(text, pa.binary())], names=["key", ROW, "start", "bytes"])

    return run


def _order(length):
    """Hits (row, span) among phrases sorted by key: the suffixes of whole keys are put in the order of their bytes."""
    def hits(rows, starts, texts):
        sizes = np.array([len(t) for t in texts])
        windows = sizes - length + 1
        data = np.frombuffer(b"".join(texts), np.uint8)
        phrase = np.repeat(np.arange(len(texts)), windows)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = np.repeat(np.cumsum(sizes) - sizes, windows) + within
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").reshape(-1)
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        doc = np.asarray(rows)[phrase]
        earliest = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = np.zeros(len(doc), dtype=bool)
        hit[order] = doc[order] > earliest
        # Neighbouring hits of a phrase become one span of at most 2**5 windows.
        edge = hit & ~np.append(False, hit[:-1] & (phrase[1:] == phrase[:-1]))
        run = np.cumsum(edge)[hit]
        if not len(run):
            return
        place = np.asarray(starts)[phrase][hit] + within[hit]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        count = np.diff(np.append(first, len(run)))
        yield doc[hit][first], (place[first] << _LEN) | (count - 1)

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            for row, span in hits(*zip(*held)):
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(span, pa.int64())], names=[ROW, "span"])

        for batch in batches:
            sure = []
            for key, row, start, text in zip(*(batch.column(c).to_pylist() for c in ("key", ROW, "start", "bytes"))):
                if text is None:
                    sure.append((row, start << _LEN))
                    continue
                if size >= SORTED_BYTES and key != last:
                    yield from flush()
                    held, size = [], 0
                held.append((row, start, text))
                size, last = size + len(text), key
            if sure:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sure)], names=[ROW, "span"])
        if held:
            yield from flush()

    return run


def _merged(length):
    """(row, spans): the bytes that a text's hits cover, as maximal runs [start, end), end after end."""
    def run(batches):
        for batch in batches:
            spans = []
            for found in batch.column("found"):
                x = np.sort(found.values.to_numpy())
                start = x >> _LEN
                end = np.maximum.accumulate(start + (x & ((1 << _LEN) - 1)) + length)
                first = np.append(True, start[1:] > end[:-1])
                last = np.append(first[1:], True)
                spans.append(np.stack([start[first], end[last]], axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(spans, pa.list_(pa.int64()))], names=[ROW, "spans"])

    return run


def repeated_spans(rows: DataFrame, length=50) -> DataFrame:
    """(__row, spans) of the texts with bytes in a string of ``length`` bytes that also starts in a text of a smaller row."""
    digests = settle(rows.select("row", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("digest"))
                     .filter(F.col("n") >= length))
    several = digests.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    copies = settle(digests.join(several, "digest").filter("row <> rep").select("row", "n"))
    single = sized_join(rows.filter(F.octet_length("text") >= length), copies.select("row"), ["row"], ["row"], "left_anti")
    parsed = single.mapInArrow(_parse(length), "k1 long, k2 long, doc long")
    sorted_ = (parsed.repartition(F.shiftrightunsigned("k1", 20))
               .sortWithinPartitions("k1", F.shiftrightunsigned("k2", 40), "doc"))
    found = settle(sorted_.mapInArrow(_compare, f"{ROW} long, span long, trigger long"))

    opened = found.filter("trigger is not null")
    large = settle(opened.groupBy("trigger").count().filter(F.col("count") > LARGE).select("trigger", F.lit(True).alias("large")))
    opened = sized_join(opened, large, ["trigger"], [ROW], "left").withColumn("large", F.coalesce("large", F.lit(False)))
    lists = settle(opened.groupBy(ROW).agg(F.collect_list(F.struct("span", "trigger", "large")).alias("open")))
    texts = join_lists(single.withColumnRenamed("row", ROW), lists).filter("open is not null")
    dictionary = texts.mapInArrow(_texts_of_phrases(length), f"key long, {ROW} long, start long, bytes binary")
    ordered = (dictionary.repartition("key").sortWithinPartitions("key")
               .mapInArrow(_order(length), f"{ROW} long, span long"))

    hits = found.filter("trigger is null").select(ROW, "span").unionByName(ordered)
    spans = hits.groupBy(ROW).agg(F.collect_list("span").alias("found")).mapInArrow(_merged(length), f"{ROW} long, spans array<long>")
    return settle(spans.unionByName(copies.select(F.col("row").alias(ROW), F.array(F.lit(0).cast("long"), F.col("n").cast("long")).alias("spans"))))


def remove_repeats(docs: DataFrame, length=50, text_col="text", id_col="doc_id") -> DataFrame:
    """Adds n_bytes, n_removed (longs), spans (array of start and end, in bytes) and kept (binary) to ``docs``.

    A byte of a text, as UTF-8, is removed if it is covered by a string of ``length`` bytes that also starts in a text with
    a smaller id; both strings lie in one text, overlapping ones count, and all are judged on the texts as given. ``spans``
    are the maximal removed runs, and ``kept`` has the other bytes end to end (no valid UTF-8 if a character is cut). Null
    texts are empty. Where ids repeat or are null, rows go by id, nulls first, and then in an order that is written down
    once. Columns of the added names give way. Phrases are compared by 88-bit hashes, all else byte by byte.
    """
    made = ["n_bytes", "n_removed", "kept", "spans"]
    numbered, _ = with_row_ids(tidy(docs, [text_col, id_col], made), id_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    spans = repeated_spans(numbered.select(F.col(ROW).alias("row"), text.alias("text")), length)
    own = numbered.select(*[F.col(f"`{c}`") for c in numbered.columns if c not in made])
    joined = join_lists(own, spans.withColumnRenamed("spans", "__spans"))

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(text_col))
            removed, kept, runs = [], [], []
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                raw, at, parts = data[offsets[i]:offsets[i + 1]].tobytes(), 0, []
                spans = list(zip(spans[::2], spans[1::2])) if spans else []
                for a, b in spans:
                    parts.append(raw[at:a])
                    at = b
                removed.append(sum(b - a for a, b in spans))
                kept.append(b"".join([*parts, raw[at:]]) if spans else raw)
                runs.append([{"start": a, "end": b} for a, b in spans])
            yield extend(batch, {
                "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.binary())})

    out = joined.mapInArrow(run, with_columns_of(
        joined, fields("n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")))
    return out.drop(ROW, "__spans")
