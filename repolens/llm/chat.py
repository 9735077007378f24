"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example: all turns before it as context and its own text as the only trainable
span. Turns behind the last assistant turn (or all turns, if there is none) form one more example without a
trainable span, so that the output holds every turn. A turn is written `### role: text</turn>` and a line end; inside texts `\\`, `<`
and `#` become `\\b`, `\\l` and `\\h` (in roles also `:` becomes `\\c`), so no mark can occur in a text and each escape
can be undone. Turns are ordered by (turn, role, text); null role and text are empty; rows with null conv_id are
one conversation. The longest example of a conversation holds the whole conversation, as does its digest, so
a conversation is one row by the definition of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

END = "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, pairs: tuple = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, pairs: tuple = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length), positions from 0 in code points; null start: no loss."""
    empty = F.lit("")
    written = turns.select(
        "conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")
    ).withColumn("head", F.concat(F.lit("### "), escaped(F.col("role"), ROLE_ESCAPES), F.lit(": "))).withColumn("body", escaped(F.col("text")))
    talks = written.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns"))
    line = lambda t: F.concat(t["head"], t["body"], F.lit(END))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: (F.element_at("turns", k)["role"] == "assistant") | (k == F.size("turns")))
    expanded = talks.withColumn("lines", F.transform("turns", line)).select("conv_id", "turns", "lines", F.explode(places).alias("example"))
    last = F.element_at("turns", F.col("example"))
    context = F.array_join(F.slice("lines", F.lit(1), F.col("example") - 1), "")
    trained = last["role"] == "assistant"
    return expanded.select(
        "conv_id", "example", F.concat(context, F.element_at("lines", F.col("example"))).alias("formatted"),
        F.when(trained, F.length(context) + F.length(last["head"])).alias("loss_start"),
        F.when(trained, F.length(last["body"])).alias("loss_length"),
    )


def read_back(output: DataFrame) -> DataFrame:
    """Digest columns of each conversation from its examples alone."""
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    parts = output.withColumn("loss", F.when(F.col("loss_start").isNotNull(), loss))
    talks = parts.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "").alias("losses"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    lines = F.filter(F.split("whole", END, -1), lambda x: x != "")
    # the first ": " ends the head: roles hold no colon once escaped
    said = F.transform(
        lines,
        lambda x: F.concat(
            unescaped(F.substring_index(F.substr(x, F.lit(5)), ": ", 1), ROLE_ESCAPES), F.lit("\n"),
            unescaped(F.substr(x, F.position(F.lit(": "), x) + 2)), F.lit("\n")),
    )
    return talks.select(
        "conv_id", F.size(lines).cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("losses").cast("long").alias("loss_chars"), F.sha2("losses", 256).alias("loss_sha256"), "formatted_chars")


def format_chats(turns: DataFrame) -> DataFrame:
    """The examples of `turns` (conv_id, turn, role, text), written to the shared folder and read back."""
    return stored(examples(turns), "chat-examples")
