"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log of events is folded into final messages, conversation by conversation in order of sequence, and the messages are
rendered with a template whose control strings cannot occur in a text.

Events of a message: ``message`` (starts it, with a text), ``delta`` (appends), ``edit`` (replaces the text so far) and
``regenerate`` (drops the text so far, and every later message that began before it).  The fold is two aggregations, by
message and then by conversation, so one long conversation is folded message by message in parallel first.

Template of a turn: ``### <role>:\\n<text></turn>\\n``.  Inside roles and texts a backslash becomes ``\\b``, ``#`` becomes
``\\h`` and ``<`` becomes ``\\l`` (in roles also ``:`` becomes ``\\c``), so neither ``###`` nor ``</turn>`` is ever
ambiguous and the rendering can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as c

HEAD, MIDDLE, END = "### ", ":\n", "</turn>\n"
_CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_ROLE_CODES = (*_CODES, (":", "\\c"))


def escape(text: Column, codes=_CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=_CODES) -> Column:
    for plain, code in reversed(codes):  # the backslash last
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_events(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", message_col: str = "message", kind_col: str = "kind", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Final messages of a log: conv_col, message_col, role (of the first event that has one) and text.

    Null texts are empty, null kinds are deltas; equal sequence numbers are ordered by kind, role and text, so ties and
    repeated rows have one result.  Events without a conversation or message number form a group of their own.
    """
    e = events.select(
        c.quoted(conv_col).alias("__gl_conv"), c.quoted(message_col).alias("__gl_msg"), c.quoted(seq_col).alias("__gl_seq"),
        F.coalesce(c.quoted(kind_col), F.lit("delta")).alias("__gl_kind"), c.quoted(role_col).alias("__gl_role"), F.coalesce(c.quoted(text_col), F.lit("")).alias("__gl_text"),
    )
    resets = F.col("__gl_kind").isin("message", "edit", "regenerate")
    part = F.struct("__gl_seq", "__gl_kind", "__gl_role", "__gl_text")
    folded = e.groupBy("__gl_conv", "__gl_msg").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max(F.when(resets, part)).alias("reset"), F.min("__gl_seq").alias("began"),
        F.max(F.when(F.col("__gl_kind") == "regenerate", F.col("__gl_seq"))).alias("regenerated"),
    )
    kept = F.filter("parts", lambda p: F.col("reset").isNull() | (p >= F.col("reset")))
    text = F.array_join(F.transform(kept, lambda p: F.when(p["__gl_kind"] == "regenerate", "").otherwise(p["__gl_text"])), "")
    role = F.get(F.filter(F.transform("parts", lambda p: p["__gl_role"]), lambda r: r.isNotNull()), F.lit(0))
    before = Window.partitionBy("__gl_conv").orderBy(F.col("__gl_msg").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.coalesce(F.max("regenerated").over(before) > F.col("began"), F.lit(False))
    rows = folded.select("__gl_conv", "__gl_msg", role.alias("role"), text.alias("text"), dropped.alias("__gl_dropped")).filter(~F.col("__gl_dropped"))
    return rows.select(F.col("__gl_conv").alias(conv_col), F.col("__gl_msg").alias(message_col), "role", "text")


def render(messages: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv_col, n_turns, formatted, and loss_mask: turn, start and length (code points, within the turn's part of ``formatted``) of each text of the ``trained`` roles.

    Null roles and texts are empty.  Equal turn numbers are ordered by role and text; rows without a conversation are one
    conversation.  An empty table gives an empty result.
    """
    role, text = F.coalesce(c.quoted(role_col), F.lit("")), F.coalesce(c.quoted(text_col), F.lit(""))
    shown, body = escape(role, _ROLE_CODES), escape(text)
    turn = F.concat(F.lit(HEAD), shown, F.lit(MIDDLE), body, F.lit(END))
    rows = messages.select(
        c.quoted(conv_col).alias("__gl_conv"),
        F.struct(c.quoted(order_col).alias("o"), role.alias("r"), turn.alias("t"), (F.length(shown) + len(HEAD + MIDDLE) + 1).alias("s"), F.length(body).alias("n"), role.isin(*trained).alias("on")).alias("__gl_turn"),
    )
    turns = F.col("turns")
    mask = F.filter(F.transform(turns, lambda x, i: F.struct(i.alias("turn"), x["s"].alias("start"), x["n"].alias("length"), x["on"].alias("on"))), lambda x: x["on"])
    return rows.groupBy("__gl_conv").agg(F.sort_array(F.collect_list("__gl_turn")).alias("turns")).select(
        F.col("__gl_conv").alias(conv_col), F.size(turns).cast("long").alias("n_turns"), F.array_join(F.transform(turns, lambda x: x["t"]), "").alias("formatted"),
        F.transform(mask, lambda x: F.struct(x["turn"].alias("turn"), x["start"].alias("start"), x["length"].alias("length"))).alias("loss_mask"),
    )


def parts_of(formatted: Column) -> Column:
    """The turns of a rendered conversation, as they stand in it."""
    split = F.split(formatted, END.replace("/", "\\/"))
    return F.slice(split, F.lit(1), F.size(split) - 1)


def read_back(formatted: Column) -> Column:
    """Role and text of each turn of a rendered conversation."""
    return F.transform(parts_of(formatted), lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), MIDDLE, 1), _ROLE_CODES).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text"),
    ))


def chat_format(events: DataFrame, **names: str) -> DataFrame:
    """``fold_events`` and ``render``: from a log to rendered conversations."""
    folded = fold_events(events, **names)
    return render(folded, names.get("conv_col", "conv_id"), names.get("message_col", "message"))


def as_events(messages: DataFrame) -> DataFrame:
    """A log as a client would stream it, from final messages (conv_id, message, role, text): seq, kind, role and text of each event.

    Every text comes in two parts.  By turns a message is begun with the first and goes on with the second; is begun with a draft,
    regenerated and then streamed; or is begun with a draft that is edited to the first part and goes on.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substr(text, half + 1)
    event = lambda k, kind, said, role=None: F.struct(
        (F.col("message") * 4 + k).cast("long").alias("seq"), F.lit(kind).alias("kind"), (F.col("role") if role else F.lit(None).cast("string")).alias("role"), said.alias("text"),
    )
    draft = F.lit("draft of ### </turn> \\ ")
    plain = F.array(event(0, "message", first, True), event(1, "delta", rest))
    again = F.array(event(0, "message", draft, True), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest))
    edited = F.array(event(0, "message", draft, True), event(1, "edit", first), event(2, "delta", rest))
    by = F.col("message") % 3
    told = messages.select("conv_id", "message", F.explode(F.when(by == 0, plain).when(by == 1, again).otherwise(edited)).alias("e"))
    return told.select("conv_id", "message", "e.*")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    own = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit(odd)}
    rows = rows.unionByName(spark.range(2).select(*[x.cast(rows.schema[k].dataType).alias(k) for k, x in own.items()]))
    # Each row is a message of its own in the log; rows of one turn stay apart.
    place = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(place))
    log = as_events(rows.select("conv_id", n.alias("message"), "role", "text"))
    out = chat_format(log)
    turns, spoken = read_back(F.col("formatted")), F.col("__gl_loss")
    masked = F.transform("loss_mask", lambda m: unescape(F.substring(F.get("__gl_parts", m["turn"]), m["start"], m["length"])))
    out = out.withColumn("__gl_parts", parts_of(F.col("formatted"))).withColumn("__gl_turns", turns)
    out = out.withColumn("__gl_loss", F.array_join(masked, ""))
    return out.select(
        "conv_id", F.size("__gl_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("__gl_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(spoken).cast("long").alias("loss_chars"), F.sha2(spoken, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    esc = lambda x, codes: x if not codes else esc(f"replace({x}, '{codes[0][0]}', '{codes[0][1]}')", codes[1:])
    fixed = len(HEAD) + len(MIDDLE) + len(END)
    return f"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as a,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as b,
  sum({fixed} + length({esc("role", _ROLE_CODES)}) + length({esc("text", _CODES)})) as n from r group by conv_id)
select conv_id, n_turns, sha256(a) as turns_sha256, length(b)::bigint as loss_chars, sha256(b) as loss_sha256, n::bigint as formatted_chars from g"""


SQL = _sql()
