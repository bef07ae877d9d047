"""Language of whole texts: kernel ridge regression over a string kernel.

The kernel compares sets of byte n-grams (a blended spectrum of several lengths, presence only): the number of n-grams that
two texts share over the root of both set sizes. Landmark texts give a Nystrom map, and one ridge regression per language
is fitted on it. The kernel is a product of presence vectors, so the landmarks and the fitted weights multiply into one
matrix, and texts are scored by products of whole batches.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.frames import extend, fields, parts, tidy, with_columns_of
from tidegauge.llm.textbytes import chunks

ORDERS = (1, 2, 3, 4)
BINS = 1 << 14
PIECE = 1 << 20
#: Rows of the matrices that a task holds: 80 KB a row.
ROWS = 256
UNKNOWN = "und"
#: Digits, punctuation and control bytes count as white space.
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[[b for b in range(0x80) if not chr(b).isalpha()]] = 0x20


def presence(data, offsets) -> np.ndarray:
    """(texts, BINS): which hashed n-grams each text has. A long text is taken in overlapping pieces."""
    texts, n = np.zeros((len(offsets) - 1, BINS), dtype=bool), len(data)
    flat = texts.reshape(-1)
    for at in range(0, n, PIECE):
        part = _PLAIN[data[at:at + PIECE + max(ORDERS) - 1]]
        where = np.arange(at, at + len(part))
        text = np.searchsorted(offsets, where, side="right") - 1
        gram = np.zeros(len(part), dtype=np.uint32)
        for k in range(1, max(ORDERS) + 1):
            size = len(part) - k + 1
            if size <= 0:
                break
            gram = (gram[:size] << np.uint32(8)) | part[k - 1:]
            if k in ORDERS:
                inside = text[:size] == text[k - 1:]
                slot = ((gram + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
                flat[(text[:size] * BINS + slot)[inside]] = True
    return texts


def normalised(texts: np.ndarray) -> np.ndarray:
    size = np.maximum(texts.sum(axis=1, keepdims=True), 1)
    return texts / np.sqrt(size, dtype=np.float32).astype(np.float32)


def lowered(column):
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: those whose id's CRC-32 is divisible by 5, and those without an id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, text_col, lang_col, id_col, per_language) -> list:
    """(lang, bits) of the fitting sample: of each language the ``per_language`` distinct texts with the least hashes.

    The bound is on each language's rows, so the driver gets per_language * languages presence vectors of 2 KB.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string")
    known = docs.filter(text.isNotNull() & lang.isNotNull() & ~held_out(id_col)).select(
        lang.alias("lang"), F.xxhash64(text).alias("hash"), text.alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = (known.select("lang", "hash").distinct().withColumn("rank", rank)
              .filter(F.col("rank") <= per_language).select("lang", "hash").collect())
    shared = docs.sparkSession.sparkContext.broadcast({(r["lang"], r["hash"]) for r in chosen})

    def bits(batches):
        wanted, seen = shared.value, set()
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist()))
            rows = [i for i, key in enumerate(keys) if key in wanted and not (key in seen or seen.add(key))]
            if rows:
                part = batch.take(pa.array(rows))
                made = [presence(d, o) for _, _, d, o in chunks(lowered(part.column("text")), rows=ROWS)]
                packed = [p.tobytes() for m in made for p in np.packbits(m, axis=1)]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("hash"), pa.array(packed, pa.binary())],
                                                 names=["lang", "hash", "bits"])

    found = known.mapInArrow(bits, "lang string, hash long, bits binary")
    found = found.groupBy("lang", "hash").agg(F.max("bits").alias("bits"))
    return sorted((r["lang"], r["hash"], bytes(r["bits"])) for r in found.collect())


def fit(rows, landmarks=256, ridge=1e-2):
    """(languages, weights): a matrix of BINS rows and a column per language, from (lang, hash, bits) rows."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], np.zeros((BINS, 0), dtype=np.float32)
    x = normalised(np.unpackbits(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(bool))
    place = np.array([langs.index(r[0]) for r in rows])
    each = max(4, landmarks // len(langs))
    chosen = np.concatenate([np.flatnonzero(place == c)[:each] for c in range(len(langs))])
    marks = x[chosen].astype(np.float64)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T.astype(np.float32)).astype(np.float64) @ root
    y = np.where(place[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    # Every language counts alike, however many rows it has.
    weight = 1.0 / np.bincount(place)[place]
    gram = (z * weight[:, None]).T @ z + ridge * np.eye(z.shape[1]) / len(langs)
    dual = root @ np.linalg.solve(gram, (z * weight[:, None]).T @ y)
    return langs, (marks.T @ dual).astype(np.float32)


def identify(docs: DataFrame, text_col="text", lang_col="lang", id_col="doc_id", per_language=400, landmarks=256) -> DataFrame:
    """Adds held_out, lang_pred and score to ``docs``.

    Learns from rows with a text and a language that are not held out, at most ``per_language`` of a language; a row's own
    language and id are no input of its prediction. score is half of one plus the winning regression's value, cut to [0, 1].
    Texts that are null or have no letter are ``und`` with score 0, as is everything when there is nothing to learn from.
    Equal values go to the first language in order. Columns of the added names give way.
    """
    docs = tidy(docs, [text_col, lang_col, id_col], ["held_out", "lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(
        fit(training_rows(docs, text_col, lang_col, id_col, per_language), landmarks))

    def predict(batches):
        langs, weights = shared.value
        names = np.array([*langs, UNKNOWN], dtype=object)
        for batch in parts(batches, text_col):
            column = batch.column(text_col)
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False), bool)
            best = np.full(len(column), len(langs))
            score = np.zeros(len(column))
            for at, end, data, offsets in chunks(lowered(column), rows=ROWS):
                if langs:
                    value = normalised(presence(data, offsets)) @ weights
                    best[at:end], score[at:end] = value.argmax(axis=1), np.clip((value.max(axis=1) + 1) / 2, 0, 1)
            best[~letters], score[~letters] = len(langs), 0.0
            yield extend(batch, {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score, pa.float64())})

    out = docs.mapInArrow(predict, with_columns_of(docs, fields("lang_pred string, score double")))
    own = [F.col(f"`{c}`") for c in out.columns if c not in ("held_out", "lang_pred", "score")]
    return out.select(*own, held_out(id_col).alias("held_out"), "lang_pred", "score")
