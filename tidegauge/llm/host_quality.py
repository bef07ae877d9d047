"""Quality rules per document and per host, with native columns only.

Rules are measured on whole texts. Failures are added up per host; each host's rate is shrunk towards the rate of all
hosts with a beta prior fitted to the hosts themselves, so that a host of few documents is not judged by them alone. The
verdict goes back to every document of the host.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.frames import tidy
from tidegauge.plans.spread import settle

SPACE = r"[ \t-\r]+"
WINDOW = 8
#: One-sided 95 % of a normal distribution, in deviations.
SURE = 1.645
RULES = ("base_failed", "symbols_failed", "lines_failed")


def repeated_words(words: Column, k=WINDOW) -> Column:
    """How many words stand in windows of k words that the text has at least twice.

    Windows are compared by 64-bit hashes. Texts whose hashes all differ, nearly all, are done after one hash set; the
    others sort (hash, place) and add up the places that windows with an equal neighbour cover.
    """
    n = F.size(words)
    hashes = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - F.lit(k - 1)), lambda i: F.xxhash64(F.slice(words, i, k))))

    def places(s):
        twin = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(twin, lambda x: x["at"]))

    def covered(p):
        step = F.transform(p, lambda at, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - at, F.lit(k))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    def count(h):
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return _let(s, lambda s: _let(places(s), covered))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), count(h)).otherwise(F.lit(0)))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def measure(docs: DataFrame, text_col="text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and the failed rules to ``docs``.

    Words are runs of characters other than ASCII white space. ``base_failed``: fewer than 20 words, or more than 30 % of
    them repeated. ``symbols_failed``: a symbol of #*$%&|<> for every two words or more. ``lines_failed``: at least 30 %
    of the lines with a word equal an earlier one. Null texts have no words and fail. Columns of the added names give way.
    """
    docs = tidy(docs, [text_col], _MEASURES)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = [c for c in docs.columns if c not in _MEASURES]
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    df = docs.select(*[F.col(f"`{c}`") for c in own],
                     F.array_remove(F.split(text, SPACE, -1), "").alias("__words"), lines.alias("__lines"),
                     (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"))
    count = F.size("__lines").cast("long")
    df = df.select(*[F.col(f"`{c}`") for c in own], F.size("__words").cast("long").alias("n_words"),
                   F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), "n_symbols",
                   (count - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"), count.alias("__n_lines"),
                   F.coalesce(repeated_words(F.col("__words")), F.lit(0)).cast("long").alias("n_repeat_words"))
    return df.select(
        "*", ((F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).alias("base_failed"),
        ((F.col("n_words") > 0) & (F.col("n_symbols") * 2 >= F.col("n_words"))).alias("symbols_failed"),
        ((F.col("n_dup_lines") > 0) & (F.col("n_dup_lines") * 100 >= F.col("__n_lines") * 30)).alias("lines_failed"),
    ).drop("__n_lines")


_MEASURES = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES, "host_kept", "kept"}


def host_rates(measured: DataFrame, host_col="source") -> DataFrame:
    """Per host: documents, failures per rule, and each rule's rate shrunk by an empirical beta prior.

    The prior of a rule has the mean of all documents; its strength comes from the variance of the hosts' rates (weighted
    by documents) beyond what binomial sampling alone gives. Hosts that do not differ get their common rate. ``_low`` lies
    ``SURE`` deviations of the host's posterior below its rate: one bad host makes the prior weak, and a host of one
    document must not be judged by that. A null host is a host of its own; a table without rows has no hosts.
    """
    hosts = settle(measured.groupBy(F.col(f"`{host_col}`").alias("host")).agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]))
    total = hosts.agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("hosts"), *[F.sum(r).alias(r) for r in RULES],
                      *[F.sum(F.col(r) * F.col(r) / F.col("docs")).alias(f"{r}_sq") for r in RULES]).first()
    for r in RULES:
        rate, spread = _shrunk(F.col(r), F.col("docs"), total, r)
        hosts = hosts.withColumn(f"{r}_rate", rate).withColumn(f"{r}_low", F.col(f"{r}_rate") - F.lit(SURE) * spread(F.col(f"{r}_rate")))
    return hosts


def _shrunk(failed, docs, total, rule):
    """The mean of a host's posterior, and its deviation given the mean."""
    if not total["docs"]:
        return F.lit(0.0), lambda rate: F.lit(0.0)
    mean = total[rule] / total["docs"]
    noise = mean * (1 - mean)
    between = total[f"{rule}_sq"] / total["docs"] - mean * mean - noise * total["hosts"] / total["docs"]
    if noise <= 0 or between <= 1e-9 * noise:
        return F.lit(float(mean)), lambda rate: F.lit(0.0)
    strength = max(noise / between - 1, 0.0)
    rate = (failed + F.lit(mean * strength)) / (docs + F.lit(strength))
    return rate, lambda rate: F.sqrt(rate * (F.lit(1.0) - rate) / (docs + F.lit(strength + 1)))


def judge(measured: DataFrame, host_col="source", max_rate=0.5) -> DataFrame:
    """Adds host_kept and kept: a host goes when it is sure (``_low``) that the rate of a rule exceeds ``max_rate``.

    ``measured`` is read twice; have it written. A document is kept unless it fails the base rule or its host goes. Only
    hosts that go are joined back: Spark broadcasts them if their written size allows it, and else splits skewed hosts.
    """
    measured = tidy(measured, [host_col, *RULES], ["host_kept", "kept"])
    gone = settle(host_rates(measured, host_col).filter(" or ".join(f"{r}_low > {max_rate}" for r in RULES))
                  .select(F.col("host").alias("__host"), F.lit(False).alias("__kept")))
    df = measured.join(gone, F.col(f"`{host_col}`").eqNullSafe(F.col("__host")), "left")
    kept = F.coalesce("__kept", F.lit(True))
    return df.select(*[F.col(f"`{c}`") for c in measured.columns if c not in ("host_kept", "kept")],
                     kept.alias("host_kept"), (~F.col("base_failed") & kept).alias("kept"))
