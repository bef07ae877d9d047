"""Columns whose names clash with made or used ones, also in another case, for every operator."""

import public_tokenizers

from tidegauge.llm import bpe, decontaminate, host_quality, jaccard, language, licenses, line_dedup, pii, repeats

EXTRA = ("Text Doc_ID N_Words Kept_Text n_lines Stays Component_Id Kept SPANS Items Whole_Window Score Labels Held_Out Lang_Pred LANG "
         "Kinds N_Entities Ids N_Tokens Base_Failed Source other Other").split()
TEXT = "mail jane@example.org about the mit license please " * 4


def docs(spark):
    ddl = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in EXTRA)
    rows = [(i, TEXT if i < 3 else f"{i} {TEXT} {i}", "en", "host") + ("x",) * len(EXTRA) for i in range(5)]
    return spark.createDataFrame(rows + [(9, None, None, None) + (None,) * len(EXTRA)], ddl)


def test_clashing_names(spark):
    spark_docs, path = docs(spark), public_tokenizers.path("byte_bpe_50k.json")
    bench = spark.createDataFrame([("a", "about the mit license", "no")], "item_id string, text string, TEXT string")
    made = {
        "pii": (pii.replace(spark_docs, "key"), {"n_entities", "kinds"}), "bpe": (bpe.encode(spark_docs, path, decoded=True), {"n_tokens", "ids"}),
        "decode": (bpe.decode(bpe.encode(spark_docs, path), path), {"decoded_text"}),
        "hosts": (host_quality.judge(host_quality.measure(spark_docs)), {"n_words", "kept", "host_kept"}),
        "benchmark": (decontaminate.scan(spark_docs, bench, 4), {"n_hit", "items", "spans"}),
        "near": (jaccard.near_duplicates(spark_docs), {"component_id", "stays"}), "repeats": (repeats.remove_repeats(spark_docs), {"spans", "kept"}),
        "lines": (line_dedup.drop_common_lines(spark_docs, 2), {"n_lines", "kept_text"}),
        "licenses": (licenses.scan(spark_docs), {"labels", "score"}), "language": (language.identify(spark_docs), {"lang_pred", "score"}),
    }
    for name, (df, columns) in made.items():
        lower = [c.lower() for c in df.columns]
        assert len(lower) == len(set(lower)) and columns <= set(df.columns) and {"doc_id", "text", "other"} <= set(df.columns), name
        rows = df.collect()
        assert len(rows) == 6 and {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 9} and {r.other for r in rows} == {"x", None}, name
        assert name == "pii" or {r.text for r in rows if r.doc_id < 3} == {TEXT}, name
