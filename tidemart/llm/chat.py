"""Chat formatting with Spark expressions only.

Rows ``(conv_id, turn, role, text)`` become one text per conversation. The turns of a
conversation are collected and sorted, adjacent turns of one role share one block, and
everything is concatenated::

    <turn>user
    first text<next>second text of the same role</turn>
    <turn>assistant
    answer</turn>

Inside roles and texts every backslash, ``<`` and (in roles) line feed is written as a
backslash and a letter, so a ``<`` in the output always belongs to the template and
nothing in a text can imitate it. ``read_turns`` undoes all of it exactly.

Collected arrays are merged on the map side before the shuffle; a conversation is one
output row by definition, so it has to fit one row. All steps are linear in its length.

Defined cases: null role or text is empty; null ``conv_id`` is a conversation of its own;
a null turn comes first; rows with an equal turn are ordered by role, then text, and
repeated rows all stay; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NEXT, CLOSE = "<turn>", "<next>", "</turn>\n"
LOSS_ROLES = ("assistant",)


def escape(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_feeds else out


def unescape(text: Column, line_feeds: bool = False) -> Column:
    if line_feeds:
        text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_runs``: the loss mask as consecutive runs
    ``(chars, loss)`` of code points that cover the formatted text; the run with an odd
    index (from 0) is the text of one row, those between belong to the template."""
    rows = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def piece(row: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("rows", i - 1)["role"] == row["role"])
        lead = F.concat(F.when(i > 0, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(OPEN),
                        escape(row["role"], line_feeds=True), F.lit("\n"))
        return F.struct(F.when(same, F.lit(NEXT)).otherwise(lead).alias("lead"),
                        escape(row["text"]).alias("body"),
                        row["role"].isin(*loss_roles).alias("loss"))

    pieces = sorted_rows.select("conv_id", F.transform("rows", piece).alias("pieces"))

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"])), ""),
                 F.lit(CLOSE)).alias("formatted"),
        F.concat(F.flatten(F.transform("pieces", lambda p: F.array(
            run(F.char_length(p["lead"]), F.lit(False)), run(F.char_length(p["body"]), p["loss"])))),
            F.array(run(F.lit(len(CLOSE)), F.lit(False)))).alias("loss_runs"))


def read_turns(chats: DataFrame) -> DataFrame:
    """Turns of the formatted text: adds ``turns``, an array of ``(role, text, loss)`` in
    order, unescaped; ``loss`` is what the mask says of the text."""
    def block_turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)), line_feeds=True)
        body = F.substr(block, F.char_length(head) + 2)
        return F.transform(F.split(body, NEXT), lambda part: F.struct(
            role.alias("role"), unescape(part).alias("text")))

    blocks = chats.withColumn("turns", F.split("formatted", CLOSE))
    parts = blocks.withColumn("turns", F.flatten(F.transform(
        F.filter("turns", lambda block: block != ""), block_turns)))
    return parts.withColumn("turns", F.transform("turns", lambda t, i: F.struct(
        t["role"].alias("role"), t["text"].alias("text"),
        F.get("loss_runs", 2 * i + 1)["loss"].alias("loss"))))


def chat_digest(chats: DataFrame) -> DataFrame:
    """What the formatted text holds, read back from it."""
    read = read_turns(chats)
    rows = read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]),
                                 lambda t: t["text"]), "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256",
                       F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
