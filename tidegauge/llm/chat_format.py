"""Conversations rebuilt from their event logs and rendered for training, with native columns only.

``fold_events`` folds a log into final messages, ``render`` writes one string and a loss mask per conversation, and
``read_back`` takes both apart again.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.plans.spread import running

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What may open a control string here or in common chat templates: <|, <s>, </s>, <<SYS, <</SYS, [INST] and [/INST].
_CONTROL = r"(?=\||/?s>|</?SYS|/?INST\])"
TURNS_PER_BUCKET = 1024


def escape(text: Column) -> Column:
    """A backslash after the first character of every control string, and one more where some stand there already."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2")


def fold_events(events: DataFrame, resets=True) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    Kinds: ``message`` opens a turn, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` empties it for
    the deltas that follow. An edit or a regeneration also ends every later turn that was written before it; a log
    without these needs no ``resets``. Other or null kinds count as ``message``. Of a turn's events with equal ``seq``,
    openings come first, then deltas in order of their text. The role is the last one that is not null among the events
    that count. A turn whose events all ended is absent. Null texts are empty; null conversations, turns and sequences
    are values of their own and come first. An empty log gives no message.

    A conversation is cut into buckets of turns for the running maximum; only the events of one turn meet in one task.
    """
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message")
    ev = events.select("conv_id", "seq", "turn", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    later = F.col("kind") == "delta"
    cut = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq")))
    parts = ev.groupBy("conv_id", "turn").agg(
        cut.alias("cut"), F.sort_array(F.collect_list(F.struct("seq", later.alias("later"), "text", "role"))).alias("log"))
    if resets:
        bucket = F.floor(F.coalesce("turn", F.lit(0)) / TURNS_PER_BUCKET)
        parts = running(parts, ["conv_id"], ["turn"], bucket, maxs={"ended": "cut"})
        alive = F.filter("log", lambda e: F.col("ended").isNull() | (e["seq"] >= F.col("ended")))
        parts = parts.select("conv_id", "turn", alive.alias("log")).filter(F.size("log") > 0)
    # The last opening among the events that count, from 0; 0 as well where a turn has deltas alone.
    start = F.array_max(F.transform("log", lambda e, i: F.when(~e["later"], i).otherwise(F.lit(0))))
    parts = parts.select("conv_id", "turn", "log", start.alias("start"))
    texts = F.transform(F.expr("slice(log, start + 1, size(log))"), lambda e: e["text"])
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return parts.select("conv_id", "turn", F.try_element_at(roles, F.lit(-1)).alias("role"),
                        F.array_join(texts, "").alias("text"))


def as_messages(rows: DataFrame) -> DataFrame:
    """Rows of finished turns (conv_id, turn, role, text) as a log of messages.

    Rows that share a turn stay apart: they follow each other in order of role and text, equal ones as often as they stand.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn", "role", "text").orderBy(F.lit(0)))
    return rows.select("conv_id", F.struct("turn", "role", "text", copy.alias("copy")).alias("turn"),
                       F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def render(messages: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted`` and ``mask``, the loss mask, with lengths in code points.

    A turn is written as <|role|>ROLE<|text|>TEXT<|end|> with control strings in ROLE and TEXT escaped, and ``mask`` has
    (head, body, loss) for each: ``head`` code points before the text, ``body`` of the text, and whether it is learnt.
    Null roles are empty. A conversation becomes one string, so its turns meet in one task; each task joins its own
    before the shuffle.
    """
    head = F.concat(F.lit(ROLE), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    body = escape(F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", F.struct(
        "turn", head.alias("head"), body.alias("body"),
        F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select(
        "conv_id", F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"),
                                            t["loss"].alias("loss"))).alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns (role, text) from ``formatted`` and the learnt texts from ``mask``: columns ``turns`` and ``learnt``."""
    pieces = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda p: p != "")
    df = rendered.withColumn("__pieces", pieces)
    turns = F.transform("__pieces", lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<\|role\|>(.*?)<\|text\|>", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)<\|text\|>(.*)$", 1)).alias("text")))
    both = F.filter(F.arrays_zip("__pieces", "mask"), lambda z: z["mask"]["loss"])
    learnt = F.transform(both, lambda z: unescape(
        F.substring(z["__pieces"], z["mask"]["head"] + F.lit(1), z["mask"]["body"])))
    return df.select("*", turns.alias("turns"), learnt.alias("learnt")).drop("__pieces")
