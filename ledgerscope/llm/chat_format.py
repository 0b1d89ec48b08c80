r"""Chat formatting: conversations rebuilt from a log of events, then rendered with a loss mask.

The log is partitioned by conversation and sorted by sequence. A message begins with its first event; a ``delta`` adds its
text at the end, an ``edit`` puts its text in place of all before it, and a ``regenerate`` empties the message and withdraws every
message that began between it and the event. Any other kind counts as ``delta``. All three rules are windows over one
exchange of the log by conversation, and the deltas of a message are joined after what they replace is gone.

A turn is rendered as ``### Role: text</turn>`` and a line break. In texts ``\`` becomes ``\\``, ``</turn>`` becomes ``<\/turn>``
and ``##`` becomes ``#\#``, so neither mark can occur in them, and leaving out every backslash before another character gives
the text back; roles without a name of their own are shown in hexadecimal digits. The mask lists the bytes (UTF-8) of the
assistant's texts, so reading them is a slice.

Scale: one exchange by conversation; a formatted conversation is one string in one row, which is what is asked for, so a
conversation has to fit a task. Nothing else is gathered.

Defined results: null text counts as empty; a null role is an empty one; a null message or sequence comes first. Events that
share a sequence are put in order by message, kind and text; equal rows each count. A null conversation is one of its own. A
conversation whose messages are all withdrawn has no row; an empty log gives an empty table. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import table, whole_text

TURN, END = "### ", "</turn>\n"
#: Names of the roles as they are shown.
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
#: Begins any other role, which is shown in hexadecimal digits.
OTHER = "="
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("##", "#\\#")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _shown(role: Column) -> Column:
    name = F.concat(F.lit(OTHER), F.hex(role.cast("binary")))
    for plain, shown in SHOWN.items():
        name = F.when(role == plain, shown).otherwise(name)
    return name


def _read_role(name: Column) -> Column:
    role = F.unhex(F.substr(name, F.lit(len(OTHER) + 1))).cast("string")
    for plain, shown in SHOWN.items():
        role = F.when(name == shown, plain).otherwise(role)
    return role


def fold(log: DataFrame) -> DataFrame:
    """The final messages of a log ``conv_id, seq, message, kind, role, text``: ``conv_id, began, role, text``.

    A message has the role of its first event; ``began`` counts the events of the conversation up to there.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    events = log.select("conv_id", "seq", "message", kind.alias("kind"), whole_text("role").alias("role"), whole_text("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("seq", "message", "kind", "text", "role")
    events = events.withColumn("n", F.row_number().over(order))
    of_message = Window.partitionBy("conv_id", "message")
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("n"))).over(of_message)
    events = events.withColumns({"began": F.min("n").over(of_message), "reset": F.coalesce(reset, F.lit(0))})
    # A message is withdrawn if a later regeneration is of an earlier message.
    later = Window.partitionBy("conv_id").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    events = events.withColumn("redone", F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(later))
    withdrawn = F.coalesce(F.max(F.when((F.col("n") == F.col("began")) & (F.col("redone") < F.col("began")), 1)), F.lit(0))
    counts = (F.col("n") >= F.col("reset")) & (F.col("kind") != "regenerate")
    pieces = F.sort_array(F.collect_list(F.when(counts, F.struct("n", "text"))))
    return (
        events.groupBy("conv_id", "message")
        .agg(
            F.min("n").alias("began"), F.min_by("role", "n").alias("role"), pieces.alias("pieces"), withdrawn.alias("withdrawn")
        )
        .where("withdrawn = 0")
        .select("conv_id", "began", "role", F.array_join(F.col("pieces.text"), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask`` of messages ``conv_id, began, role, text``: the mask has ``start, length`` in bytes."""
    head = F.concat(F.lit(TURN), _shown(F.col("role")), F.lit(": "))
    turns = messages.select("conv_id", "began", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.octet_length("head") + F.octet_length("body") + len(END)
    so_far = Window.partitionBy("conv_id").orderBy("began").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(size.cast("long")).over(so_far)
    turns = turns.withColumn("start", end - len(END) - F.octet_length("body"))
    part = F.struct("began", F.concat("head", "body", F.lit(END)).alias("turn"))
    learned = F.when(F.col("role") == LEARNED, F.struct("start", F.octet_length("body").cast("long").alias("length")))
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.sort_array(F.collect_list(learned)).alias("mask")
    )
    return grouped.select("conv_id", F.array_join(F.col("parts.turn"), "").alias("formatted"), "mask")


def format_chats(log: DataFrame) -> DataFrame:
    """``conv_id, formatted, mask`` of a log of events ``conv_id, seq, message, kind, role, text``."""
    return render(fold(log))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``role, text``."""
    turns = F.filter(F.split(formatted, END, -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        colon = F.locate(":", t)
        role = F.substr(t, F.lit(len(TURN) + 1), colon - len(TURN) - 1)
        return F.struct(_read_role(role).alias("role"), unescape(F.substr(t, colon + 2)).alias("text"))

    return F.transform(turns, turn)


def read_learned(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, in order."""
    return F.transform(
        mask,
        lambda m: unescape(
            F.substr(formatted.cast("binary"), (m["start"] + 1).cast("int"), m["length"].cast("int")).cast("string")
        ),
    )


#: The conversation that the contract adds: what the template writes stands in its texts.
EXTRA_ID, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"


def conversation_log(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a log: every row is a message that arrives whole. Rows of one turn are put in order by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order))
    return rows.select("conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), "id", role, F.lit(EXTRA_TEXT))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    chats = format_chats(conversation_log(rows))
    read = chats.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_learned(F.col("formatted"), F.col("mask")), "").alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ROLE = " ".join(f"WHEN '{plain}' THEN '{shown}'" for plain, shown in SHOWN.items())
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')"
ORACLE = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES ({EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}'), ({EXTRA_ID}, 1, 'assistant', '{EXTRA_TEXT}')),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, text AS raw, role AS raw_role, turn FROM rows_),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw NULLS FIRST) AS n,
  length('{TURN}' || CASE r {_ROLE} ELSE '{OTHER}' || hex(encode(r)) END || ': ' || {_ESCAPED.format("x")})
  + {len(END)} AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY n) AS said,
  coalesce(string_agg(x, '' ORDER BY n) FILTER (WHERE r = '{LEARNED}'), '') AS learned, sum(chars)::BIGINT AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars FROM g
"""
