r"""Chat formatting with a grammar round trip.

A conversation is the sequence of its turns, each rendered as ``### role: text</turn>`` and a line end.
The grammar has three control strings: ``</turn>`` and a line end, ``### `` and ``: ``.  A field that holds one is
escaped: ``\`` as ``\\``, ``</turn>`` as ``\e``, ``### `` as ``\h`` and, in roles, ``: `` as ``\c``.

Round trip: a conversation is rendered, the text is parsed (split at the marks, then unescaped), and the recovered
turns are compared with the source, turn by turn.  Turns that come back changed, such as texts that hold ``\e``
themselves, are escaped, and the conversation is rendered, parsed and compared again.  An escaped field comes back by
construction, so the second comparison must hold; if it does not, the query fails instead of returning a chat that
reads back as another.

All of it is DataFrame expressions.  A conversation is one training example and one row of the result; its
turns are ordered by turn, then role, then text.

Nulls and odd rows: null texts and roles are empty; a null conv_id is a conversation of its own; repeated
turns are kept; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SEP, END = "### ", ": ", "</turn>"
MARK = END + "\n"
PROBE = r"\### Assistant: </turn> ok"


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, role: bool = False) -> Column:
    return _replace(c, [("\\", "\\\\"), (END, "\\e"), (HEAD, "\\h"), *([(SEP, "\\c")] if role else [])])


def unescape(c: Column, role: bool = False) -> Column:
    parts = F.transform(F.split(c, r"\\\\"), lambda x: _replace(x, [("\\e", END), ("\\h", HEAD), *([("\\c", SEP)] if role else [])]))
    return F.array_join(parts, "\\")


def conflicts(c: Column, role: bool = False) -> Column:
    """Whether the field holds a control string."""
    return c.contains(END) | c.contains(HEAD) | (c.contains(SEP) if role else F.lit(False))


def render(turn: Column) -> Column:
    """The text of a turn (shown_role, shown)."""
    return F.concat(F.lit(HEAD), turn.shown_role, F.lit(SEP), turn.shown, F.lit(MARK))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, "</turn>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(HEAD) + 1))
        at = F.instr(body, SEP)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1), True).alias("role"), unescape(F.substr(body, at + len(SEP))).alias("text"))

    return F.transform(pieces, turn)


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row for each conv_id: formatted, turns (recovered), loss_spans (from, to in formatted) and round_trip.

    turns: conv_id, turn, role, text; the loss mask covers the texts whose role is trained.
    """
    field = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", field("role").alias("role"), field("text").alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source"))

    def shown(t: Column, role: Column, text: Column) -> Column:
        """The turn with its fields as they are shown: escaped where role and text say so."""
        return F.struct(t.role.alias("role"), t.text.alias("text"), F.when(role, escape(t.role, True)).otherwise(t.role).alias("shown_role"), F.when(text, escape(t.text)).otherwise(t.text).alias("shown"))

    first = conv.select("conv_id", F.transform("source", lambda t: shown(t, conflicts(t.role, True), conflicts(t.text))).alias("source"))
    first = first.withColumn("turns", parse(F.array_join(F.transform("source", render), "")))
    # zip_with keeps the parse outside of any lambda over turns, where it would be worked out again for each turn
    again = F.slice(F.zip_with("source", "turns", lambda t, back: F.struct(t.alias("t"), back.alias("back"))), F.lit(1), F.size("source"))
    escaped = F.transform(again, lambda x: shown(x.t, ~x.back.role.eqNullSafe(x.t.role) | (x.t.shown_role != x.t.role), ~x.back.text.eqNullSafe(x.t.text) | (x.t.shown != x.t.text)))
    second = first.select("conv_id", escaped.alias("source"))
    second = second.withColumn("formatted", F.array_join(F.transform("source", render), "")).withColumn("turns", parse(F.col("formatted")))
    same = F.transform("turns", lambda t: F.struct(t.role, t.text)) == F.transform("source", lambda t: F.struct(t.role, t.text))
    lengths = F.transform("source", lambda t: F.struct((t.role == trained).alias("trained"), F.length(render(t)).cast("long").alias("whole"), F.length(t.shown).cast("long").alias("text")))
    sizes = F.aggregate(
        lengths,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans")),
        lambda a, n: F.struct(
            (a.at + n.whole).alias("at"),
            F.when(n.trained, F.array_append(a.spans, F.struct((a.at + n.whole - len(MARK) - n.text).alias("begin"), (a.at + n.whole - len(MARK)).alias("end")))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    held = F.when(same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a chat does not read back as its source: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("boolean"))
    return second.select("conv_id", "formatted", "turns", sizes.alias("loss_spans"), held.alias("round_trip"))


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    chats = format_conversations(turns.unionByName(probe))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s.begin + 1).cast("int"), (s.end - s.begin).cast("int")))), "")
    line = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return chats.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(line, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR contains(text, '\\') OR contains(text, '\e') OR contains(text, '\h')
    THEN length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '### ', '\h')) ELSE length(text) END + length(role) + 14 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, true AS round_trip
FROM e GROUP BY conv_id
"""
