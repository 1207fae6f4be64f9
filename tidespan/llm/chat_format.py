"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its header, the roles that may come before it and its loss flag. Turns become
text segments with a loss flag each; a conversation's formatted text is their concatenation. Control strings start with
"#", "<" or a backslash sequence, and texts are escaped so that these characters never occur outside control strings
("\\b" for a backslash, "\\h" for "#", "\\l" for "<"), which makes parsing exact whatever the texts say.

Defined results: null text is empty; turns are ordered by turn, role and text (nulls first), so repeated rows stay, in a
fixed order; an unknown or null role is formatted under its own name and makes the conversation invalid at that turn; a
null conv_id is a conversation of its own; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """headers: control string by role; follows: the states each role may follow, "" being the start; trained: roles under the loss."""

    headers: dict = field(default_factory=lambda: {"system": "### System:\n", "user": "### User:\n", "assistant": "### Assistant:\n"})
    follows: dict = field(default_factory=lambda: {"system": [""], "user": ["", "system", "assistant"], "assistant": ["user"]})
    trained: tuple = ("assistant",)
    other_header: tuple = ("### Role ", ":\n")
    end: str = "\n</turn>\n"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def header_of(role: Column, template: Template) -> Column:
    """The control string that opens a turn. Unknown roles are named in it, with colons escaped too; null is an empty name."""
    a, b = template.other_header
    out = F.concat(F.lit(a), F.replace(escape(F.coalesce(role, F.lit(""))), F.lit(":"), F.lit("\\c")), F.lit(b))
    for name, text in template.headers.items():
        out = F.when(role == name, F.lit(text)).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, n_turns, valid, first_bad_turn (position from 0, or null), formatted, segments (text, loss) and loss_spans (start and length in formatted, by code points)."""
    own = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    df = own.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    trained = [F.lit(r) for r in template.trained]
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(header_of(t["role"], template).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), F.coalesce(t["role"].isin(*trained), F.lit(False)).alias("loss")),
                F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    legal = F.create_map(*[x for k, v in template.follows.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    roles = F.transform("turns", lambda t: t["role"])
    df = df.withColumns({"segments": segments, "_roles": roles})
    fits = F.transform(
        "_roles",
        lambda r, i: F.coalesce(
            F.array_contains(
                F.try_element_at(legal, F.coalesce(r, F.lit("\0"))),
                F.when(i == 0, F.lit("")).otherwise(F.coalesce(F.get(F.col("_roles"), i - 1), F.lit("\0"))),
            ),
            F.lit(False),
        ),
    )
    df = df.withColumns({"_fits": fits, "_lengths": F.transform("segments", lambda s: F.length(s["text"]))})
    # starts: a running sum in one pass over the segments
    running = F.aggregate(
        F.arrays_zip("segments", "_lengths"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["_lengths"]).alias("at"),
            F.when(s["segments"]["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), s["_lengths"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    bad = F.array_position("_fits", F.lit(False))
    return df.select(
        F.col("conv").alias(conv),
        F.size("turns").cast("long").alias("n_turns"),
        (bad == 0).alias("valid"),
        F.when(bad > 0, bad - 1).alias("first_bad_turn"),
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        "segments",
        running.alias("loss_spans"),
    )


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation. Unknown roles come back by name."""
    a, b = template.other_header
    pieces = F.filter(F.split(formatted, "\\Q" + template.end + "\\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, b)
        name = unescape(F.replace(F.substring(p, F.lit(len(a) + 1), at - len(a) - 1), F.lit("\\c"), F.lit(":")))
        role, body = name, F.substring(p, at + len(b), F.length(p))
        for known, header in template.headers.items():
            role = F.when(p.startswith(header), F.lit(known)).otherwise(role)
            body = F.when(p.startswith(header), F.substring(p, F.lit(len(header) + 1), F.length(p))).otherwise(body)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digest(chats: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """What the output says, read back from formatted and loss_spans alone."""
    df = chats.select(conv, "formatted", "valid", "first_bad_turn", "loss_spans", parse(F.col("formatted"), template).alias("_turns"))
    lines = F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    trained = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))))
    df = df.withColumn("_trained", trained)
    return df.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("_trained"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return digest(format_conversations(rows.unionByName(more)))


ORACLE_OP7 = """
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), u as (
  select *, row_number() over w - 1 as i, lag(role) over w as before from t window w as (partition by conv_id order by turn, role, text)
), f as (
  select *, case role when 'system' then before is null when 'user' then before is null or before in ('system', 'assistant') when 'assistant' then coalesce(before = 'user', false) else false end as fits,
    case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15 end + length(text) + 9
      + length(text) - length(replace(replace(replace(text, '\\', ''), '#', ''), '<', '')) as chars
  from u
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars, bool_and(fits) as valid, min(i) filter (where not fits) as first_bad_turn
from f group by conv_id
"""
