r"""Chat formatting from an event log.

A conversation is a log of events: conv_id, seq (order), message (which one it belongs to), kind, role, text.
Kinds: `message` sets a message, `delta` appends to it, `edit` replaces its text, `regenerate` discards its
text and, with it, all that was logged before for the messages after it. The log is cut by (conversation,
message), events are sorted by seq (equal ones by kind, role and text), and folded: what came before the last
event that sets, replaces or discards is gone, the rest is joined. Messages without any text event left drop out.

Rendering marks every message as `<|turn|>role` LF text `<|end|>` LF. Control strings inside a text get one
more backslash after their first character, also where there are some already, and reading takes one away;
so any text comes back as it was. A backslash or line feed in a role is escaped too. The loss mask is the
list of spans (code points, end exclusive) of assistant texts in the rendered string.

Null text and null role are empty; a null seq or message sorts first. Equal messages are told apart by seq
in `plain_log`, which makes each row of a conversation table one message. A row without conversation id
belongs to the conversation null. An empty log gives no rows.

The fold is keyed by (conversation, message), so a large conversation is spread over tasks. A rendered
conversation is one string in one row by definition; only the folded messages of one conversation meet there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
# Strings that chat templates read as control, after their first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|[a-z_]+\|>|/?SYS>>)"
KEPT = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|[a-z_]+\|>|/?SYS>>)"
_STARTS = ("message", "edit", "regenerate")


def plain_log(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of whole turns as a log: each row is one message, rows of equal turn in order of role and text."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("seq"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.withColumns({"message": F.struct("seq", "role", "text"), "kind": F.lit("message")})


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text, copies: each message as its events leave it.

    copies counts the events of whole messages that are equal in all columns (repeated rows); it is 1 or more.
    """
    events = log.select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        "kind", F.col("seq").cast("long").alias("seq"),
    )
    cuts = (
        events.where(F.col("kind") == "regenerate").groupBy("conv_id", "message").agg(F.max("seq").alias("seq"))
        .groupBy("conv_id").agg(F.collect_list(F.struct("message", "seq")).alias("cuts"))
        .withColumnRenamed("conv_id", "cut_id")
    )
    live = events.join(cuts, F.col("conv_id").eqNullSafe(F.col("cut_id")), "left").where(
        F.col("cuts").isNull() | ~F.exists("cuts", lambda c: (c["message"] < F.col("message")) & (c["seq"] > F.col("seq")))
    )
    grouped = live.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("events"))
    last = F.array_max(F.transform("events", lambda e, k: F.when(e["kind"].isin(*_STARTS), k).otherwise(0)))
    tail = grouped.withColumn("tail", F.slice("events", last + 1, F.size("events") - last))
    return tail.select(
        "conv_id", "message", F.element_at("tail", -1)["role"].alias("role"),
        F.array_join(F.transform("tail", lambda e: e["text"]), "").alias("text"),
        F.when(F.element_at("events", 1)["kind"] == "message", F.size(F.filter("events", lambda e: e == F.element_at("events", -1)))).otherwise(1).alias("copies"),
    )


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, KEPT, "$1$2$3")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    plain = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescaped(F.replace(plain, F.lit("\\\\"), F.lit("\\")))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans from messages in order; loss_spans are the assistant texts in formatted."""
    head = F.concat(F.lit(TURN), _role_out(F.col("role")), F.lit("\n"))
    parts = messages.withColumns({"head": head, "body": escaped(F.col("text"))}).withColumn("one", F.concat("head", "body", F.lit(END + "\n")))
    parts = parts.withColumn("size", F.char_length("one").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("until", F.sum(F.col("size") * F.col("copies")).over(order))
    many = F.sequence(F.lit(1), F.col("copies"))
    spans = F.when(F.col("role") == "assistant", F.transform(many, lambda k: F.struct(
        (F.col("until") - F.col("size") * (F.col("copies") - k + 1) + F.char_length("head")).alias("start"),
        (F.col("until") - F.col("size") * (F.col("copies") - k + 1) + F.char_length("head") + F.char_length("body")).alias("end"),
    ))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    rows = placed.select("conv_id", F.struct("message", F.repeat("one", F.col("copies")).alias("text"), spans.alias("spans")).alias("m"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select(
        "conv_id", F.array_join(F.transform("m", lambda x: x["text"]), "").alias("formatted"),
        F.flatten(F.transform("m", lambda x: x["spans"])).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) structs of a rendered conversation."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(
        _role_in(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.char_length(p) - F.instr(p, F.lit("\n")) - len(END) - 1)).alias("text"),
    ))


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    made = render(fold(plain_log(turns.unionByName(extra))))
    back = made.withColumns({
        "turns": read_back(F.col("formatted")),
        "loss": F.array_join(F.transform("loss_spans", lambda s: unescaped(
            F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        )), ""),
    })
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|[a-z_]+\|>|/?SYS>>)"
SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(text, '{_SQL_CONTROL}', '\1\\\2\3', 'g')) AS body,
         length(replace(replace(regexp_replace(role, '{_SQL_CONTROL}', '\1\\\2\3', 'g'), '\', '\\'), chr(10), '\n')) AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + head + {len(TURN) + len(END) + 2}) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
