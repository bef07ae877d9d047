"""One query per operator over the driver's tables: the operator with its production parameters, and digest columns."""

from pyspark.sql import functions as F

from tidegauge.llm import (
    alignment, bpe, chat_format, decontaminate, host_quality, jaccard, language, licenses, line_dedup, packing, pii, repeats,
    whitening,
)
from tidegauge.plans.spread import settle


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vocabulary(name="byte_bpe_50k.json"):
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pii_surrogates(spark, sf):
    return pii.replace(_table(spark, sf, "documents").select("doc_id", "text"), "tidegauge").select(
        "doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op2_bpe(spark, sf):
    out = bpe.encode(_table(spark, sf, "documents").select("doc_id", "text"), vocabulary(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded_text", 256).alias("decoded_sha256"))


def op3_host_quality(spark, sf):
    measured = settle(host_quality.measure(_table(spark, sf, "documents").select("doc_id", "source", "text")).drop("text"))
    return host_quality.judge(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontaminate(spark, sf):
    out = decontaminate.scan(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op5_jaccard_join(spark, sf):
    return jaccard.near_duplicates(_table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id")


def op6_repeated_passages(spark, sf):
    out = repeats.remove_repeats(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark, sf):
    out = line_dedup.drop_common_lines(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_licenses(spark, sf):
    out = licenses.scan(_table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")


def op9_language(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op10_chat_format(spark, sf):
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    messages = chat_format.fold_events(chat_format.as_messages(rows), resets=False)
    out = chat_format.read_back(chat_format.render(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op11_alignment(spark, sf):
    out, _ = alignment.align(_table(spark, sf, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def op12_whitening(spark, sf):
    rows, model = whitening.whiten(_table(spark, sf, "embeddings"))
    explained = F.array(*map(F.lit, model.explained if model else [])).cast("array<double>")
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_packing(spark, sf):
    out = packing.pack(_table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def all_queries():
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
