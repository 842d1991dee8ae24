"""Chat formatting of conversations with typed content parts; Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A content part: text, or an attachment with the sizes that its kind has.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
END = "</turn>\n"
#: Pixels of a patch's side, audio tokens a second, tokens of a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256


def escape(text: Column) -> Column:
    r"""Every control string starts with ``<``; texts have it as ``\l`` and a backslash as ``\b``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    # Each backslash starts an escape, so neither step can see what the other made.
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def parts_of_text(text: Column) -> Column:
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null("string").alias("ref"),
            null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"),
        )
    )


def tokens_of(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; one at least, none for text."""
    size = (
        F.when(part["type"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["type"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    )
    return F.when(part["type"].isin("image", "audio", "document"), F.greatest(F.coalesce(size, F.lit(1)), F.lit(1))).otherwise(0).cast("long")


def _placeholder(part: Column, turn: Column, at: Column) -> Column:
    """The visitor: what one part adds to its turn's body."""
    return F.when(part["type"].isin("image", "audio", "document"), F.concat(F.lit("<"), part["type"], F.lit(":"), turn.cast("string"), F.lit("."), at.cast("string"), F.lit(">"))).otherwise(
        escape(F.coalesce(part["text"], F.lit("")))
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    r"""One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    ``turns`` has conv_id, turn, role and parts (an array of PART). A turn is
    written ``<turn:role>\nbody</turn>\n``. Text parts are escaped; image, audio
    and document parts become ``<type:turn.part>``, numbered from zero in order,
    and are recorded as attachments (turn, part, type, ref, tokens).
    ``loss_spans`` are the (start, length) in code points of the assistant's
    bodies. Parts of another or no type count as text.

    Turns come by (turn, role, parts), nulls first; repeated rows are turns of
    their own. A null role is empty, a null or empty list of parts an empty body;
    null conv_ids form one conversation. Other columns are ignored. A
    conversation is one record, held by one task. No rows in, none out.
    """
    own = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"))
    ordered = turns.select("conv_id", own.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            F.concat(F.lit("<turn:"), _escape_role(t["role"]), F.lit(">\n")).alias("head"),
            F.array_join(F.transform(t["parts"], lambda p, k: _placeholder(p, i, k)), "").alias("body"),
            F.filter(
                F.transform(t["parts"], lambda p, k: F.struct(i.alias("turn"), k.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens"))),
                lambda a: a["tokens"] > 0,
            ).alias("attachments"),
        ),
    )
    spans = F.aggregate(
        "w",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
            F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    attachments = F.flatten(F.transform("w", lambda x: x["attachments"]))
    return (
        ordered.select("conv_id", written.alias("w"))
        .select("conv_id", F.array_join(F.transform("w", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), spans.alias("loss_spans"), attachments.alias("attachments"))
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars), parsed from ``formatted`` and its loss mask alone.

    ``turns`` has role and text; an attachment reads as its placeholder.
    """
    pieces = F.split("formatted", END, -1)
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda x: F.struct(
            _unescape_role(F.substring_index(x.substr(F.lit(7), F.length(x)), ">\n", 1)).alias("role"),
            unescape(x.substr(F.instr(x, ">\n") + 2, F.length(x))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """The read-back turns and loss text as counts and SHA-256 digests."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Rows of ``digests`` over ``conversations`` and conversation -7, for DuckDB.
CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn:>') + 1 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
      + length(replace(replace(text, '\', '\b'), '<', '\l')) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
