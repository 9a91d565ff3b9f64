"""Chat formatting with typed content parts, with built-in functions only.

A message holds a list of parts: text, image, audio or document.  A visitor
over the parts writes text as it is and puts a numbered placeholder for every
attachment, and records which attachment stands where and how many tokens it
expands to.  A template marks the turns; control strings in texts are escaped
so that the output can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adweave.llm.common import table

PART = "struct<type:string,text:string,ref:string,units:bigint>"

#: Tokens that one unit of an attachment expands to: an image's tile, a second
#: of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 640}

OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    """No ``<`` or ``>`` is left, so none can be taken for a mark."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A message that is one plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def visit_parts(parts: Column) -> Column:
    """One message's parts as ``struct<body, attachments, expanded_tokens>``.

    Parts keep their order.  A text part gives its escaped text; an attachment
    gives ``<type n>``, n counting the message's attachments from 0, and an
    entry ``(n, type, ref, tokens)`` with max(units, 1) times the type's tokens.
    A part of unknown type, or a null one, counts as a text part.  A null list
    is an empty one.
    """
    prices = F.create_map(*(x for k, v in TOKENS_PER_UNIT.items() for x in (F.lit(k), F.lit(v).cast("bigint"))))
    is_media = lambda p: F.coalesce(p["type"].isin(*TOKENS_PER_UNIT), F.lit(False))
    zero = F.struct(
        F.lit("").alias("body"),
        F.array().cast("array<struct<n:int,type:string,ref:string,tokens:bigint>>").alias("attachments"),
        F.lit(0).cast("bigint").alias("expanded_tokens"),
    )

    def step(seen: Column, part: Column) -> Column:
        n = F.size(seen["attachments"])
        tokens = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1)).cast("bigint") * prices[part["type"]]
        entry = F.array(F.struct(n.alias("n"), part["type"].alias("type"), part["ref"].alias("ref"), tokens.alias("tokens")))
        return F.struct(
            F.when(is_media(part), F.concat(seen["body"], F.lit("<"), part["type"], F.lit(" "), n.cast("string"), F.lit(">")))
            .otherwise(F.concat(seen["body"], escape(F.coalesce(part["text"], F.lit("")))))
            .alias("body"),
            F.when(is_media(part), F.concat(seen["attachments"], entry)).otherwise(seen["attachments"]).alias("attachments"),
            F.when(is_media(part), seen["expanded_tokens"] + tokens).otherwise(seen["expanded_tokens"]).alias("expanded_tokens"),
        )

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), zero, step)


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn_role: str = "assistant") -> DataFrame:
    """One row for each conversation: the formatted text and its loss mask.

    ``messages`` has a row for each turn, with ``parts`` a list of
    ``struct<type, text, ref, units>``.  Returns ``conv, formatted, loss_spans,
    attachments, expanded_tokens``: ``loss_spans`` lists (start, length) in code
    points from 0 of every body of ``learn_role``, and ``attachments`` has the
    turn's place added to each entry of ``visit_parts``.

    Turns stand in order of ``turn``, ties by role and body; repeated rows stay.
    A null turn comes first, a null role is an empty one, and rows with a null
    conversation form one.  Other columns of ``messages`` are left out.  A
    conversation becomes one string, so it has to fit a task.
    """
    seen = visit_parts(F.col(parts))
    turns = messages.select(F.col(conv), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), seen.alias("seen")).alias("t"))
    rows = turns.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), t["seen"]["body"], F.lit(CLOSE))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def mask(a: Column, t: Column) -> Column:
        head = F.length(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)))
        size = F.length(t["seen"]["body"])
        span = F.array(F.struct((a["at"] + head).cast("bigint").alias("start"), size.cast("bigint").alias("length")))
        return F.struct(
            (a["at"] + head + size + len(CLOSE)).cast("bigint").alias("at"),
            F.when(t["role"] == learn_role, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"),
        )

    entries = F.flatten(F.transform("turns", lambda t, i: F.transform(t["seen"]["attachments"], lambda x: F.struct(i.alias("at_turn"), x["n"].alias("n"), x["type"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))))
    return rows.select(
        conv,
        F.array_join(F.transform("turns", piece), "").alias("formatted"),
        F.aggregate("turns", zero, mask, lambda a: a["spans"]).alias("loss_spans"),
        entries.alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda n, t: n + t["seen"]["expanded_tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns read back from a formatted text: ``array<struct<role, text>>``.

    The exact reverse for text parts; placeholders stand in the text as written.
    """
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p.substr(F.lit(len(OPEN) + 1), F.length(p)), MIDDLE, 1)).alias("role"),
            unescape(p.substr(F.instr(p, MIDDLE) + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    messages = rows.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    out = format_chats(messages).withColumn("_turns", read_turns(F.col("formatted"))).withColumn("_loss", read_loss_text(F.col("formatted"), F.col("loss_spans")))
    listing = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same digests straight from the table; the last column follows from the template.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS te,
         replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS re
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, te)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, te), '')) AS loss_sha256,
       CAST(sum(length(re) + length(te) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
