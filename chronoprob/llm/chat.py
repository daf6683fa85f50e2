"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only the reply
is trainable. Turns are marked by control strings; where a text or role holds such a string, or the sign
that escapes it, it is escaped, and reading back undoes that exactly. Turns after the last assistant turn
come in one more example without a trainable part, so that nothing of a conversation is lost.

The format is built and read with DataFrame functions. A conversation is the unit of work: its examples
repeat its prefixes, so output grows with the square of a conversation's own length, as the format asks.

Defined cases: a null text or role is empty; a null conversation id is one conversation; rows that agree
in conversation and turn are ordered by role, then text; repeated rows are turns of their own; a null turn
comes first; a conversation without assistant turns has one example with an empty trainable part; an empty
table gives an empty result; columns beyond conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Written for a sign in this order; undone in reverse.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _role_escape(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _role_unescape(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars): examples in order; the trainable part of
    ``formatted`` has ``loss_chars`` code points from ``loss_start`` on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), _role_escape(role), F.lit("\n"))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at(F.col("turns"), i)["role"] == "assistant") | (i == F.size("turns")))
    talks = talks.withColumn("written", written).withColumn("place", F.explode(places))
    talks = talks.withColumn("last", F.element_at("turns", F.col("place"))).withColumn("prefix", F.array_join(F.slice("written", F.lit(1), F.col("place") - 1), ""))
    trained = F.col("last.role") == "assistant"
    return talks.select(
        "conv_id", F.col("place").alias("example"), F.concat("prefix", F.element_at("written", F.col("place"))).alias("formatted"),
        (F.length("prefix") + F.length("last.head")).alias("loss_start"), F.when(trained, F.length("last.body")).otherwise(0).alias("loss_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """array of (role, text) of a formatted example."""
    parts = F.split(formatted, r"<\|im_start\|>")
    whole = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        role = F.substring(part, F.lit(1), at - 1)
        body = F.substring(part, at + 1, F.length(part) - at - len(END) - 1)
        return F.struct(_role_unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(whole, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the examples alone."""
    rows = examples.select(
        "conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"),
        unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars"))).alias("loss"),
    )
    talks = rows.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted"))["formatted"].alias("longest"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
    )
    talks = talks.withColumn("turns", read_turns(F.col("longest"))).withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
