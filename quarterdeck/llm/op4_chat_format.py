"""Chat formatting by event-sourced reconstruction.

A log has rows (conv_id, seq, turn, kind, role, text). `delta` appends text to a message; `edit` replaces a message's text; `regenerate`
discards what a message has so far and its later deltas are the new text. An edit or a regeneration also discards every later message as it
stood before: a conversation goes on from the changed turn.

The fold is made of aggregations: events of a log are first grouped by (conversation, turn), so that a large conversation's events are the
work of many tasks (as_log() numbers stored turns and needs a conversation's rows in one); a running maximum over its turns tells which events are void; the surviving deltas of each message are joined in sequence; only
finished turns meet in one row per conversation, as the result demands. All of it is DataFrame functions.

The template writes a turn as `<s>[INST] role [/INST]text</s>`. Inside roles and texts `~` becomes `~~`, and a `~` is put behind the first
character of each control string, so a text never holds one and parsing restores it exactly.

Defined results: a null text counts as empty, a null role as an empty role; rows with the same turn are turns of their own, in order of role
and text; a null conversation id is a conversation; an empty log gives no rows; a conversation whose every message is void has no row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings of the template.
BEGIN, OPEN, CLOSE, FINISH = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = [BEGIN, FINISH, OPEN, CLOSE]
MASKED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("~"), F.lit("~~"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}~{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for c in reversed(CONTROL):
        out = F.replace(out, F.lit(f"{c[0]}~{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("~~"), F.lit("~"))


def messages(log: DataFrame) -> DataFrame:
    """Final (conv_id, turn, role, text) of each message that is not void."""
    reset = F.col("kind").isin("edit", "regenerate")
    piece = F.struct("seq", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    held = log.groupBy("conv_id", "turn").agg(F.max(F.when(reset, F.col("seq"))).alias("reset"), F.array_sort(F.collect_list(piece)).alias("events"))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    dated = held.withColumn("since", F.max("reset").over(earlier))
    alive = dated.withColumn("events", F.filter("events", lambda e: (F.col("since").isNull() | (e["seq"] > F.col("since"))) & (F.col("reset").isNull() | (e["seq"] >= F.col("reset")))))
    return alive.filter(F.size("events") > 0).select("conv_id", "turn", F.get("events", 0)["role"].alias("role"), F.array_join(F.col("events.text"), "").alias("text"))


def render(messages_: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): mask has, for each turn, where its learned text begins inside the turn's segment and how many code points it
    has, 0 for turns not learned from. Segments are what lies between ends of turns."""
    head = F.concat(F.lit(f"{BEGIN}{OPEN} "), escaped(F.col("role")), F.lit(f" {CLOSE}"))
    body = escaped(F.col("text"))
    learned = F.when(F.col("role") == MASKED_ROLE, F.length("body")).otherwise(F.lit(0)).cast("long")
    turns = messages_.withColumn("head", head).withColumn("body", body).select("conv_id", F.struct(
        "turn", F.concat("head", "body", F.lit(FINISH)).alias("segment"), F.struct(F.length("head").cast("long").alias("at"), learned.alias("n")).alias("mask")).alias("t"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.array_join(F.col("t.segment"), "").alias("formatted"), F.col("t.mask").alias("mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds roles and texts, read back from `formatted` alone, and learned: what lies under the mask, unescaped, turn by turn."""
    cut = formatted.withColumn("__cut", F.split("formatted", FINISH, -1))
    cut = cut.withColumn("__segments", F.slice("__cut", 1, F.size("__cut") - 1)).drop("__cut")
    mark = f" {CLOSE}"
    body = lambda s: F.substring(s, F.length(F.lit(f"{BEGIN}{OPEN} ")) + 1, F.length(s))
    return cut.withColumns({
        "roles": F.transform("__segments", lambda s: unescaped(F.substring_index(body(s), mark, 1))),
        "texts": F.transform("__segments", lambda s: unescaped(F.substring(s, F.locate(mark, s, 1) + len(mark), F.length(s)))),
        "learned": F.zip_with("__segments", "mask", lambda s, m: unescaped(F.substring(s, (m["at"] + 1).cast("int"), m["n"].cast("int")))),
    }).drop("__segments")


def as_log(conversations: DataFrame, piece: int = 256) -> DataFrame:
    """Conversations stored by turn as the log of a stream: one delta per `piece` code points, at least one per turn."""
    numbered = conversations.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(piece))
    return numbered.select("conv_id", "turn", "role", "text", F.posexplode(starts).alias("k", "at")).select(
        "conv_id", F.struct("turn", "k").alias("seq"), "turn", F.lit("delta").alias("kind"), "role", F.substring("text", F.col("at"), F.lit(piece)).alias("text"))
