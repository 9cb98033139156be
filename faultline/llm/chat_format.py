"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escape(c: Column) -> Column:
    """Put a backslash between ``<`` (and backslashes after it) and ``|``, so no text holds a control string."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    """Take back what ``escape`` did."""
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    """A role on one line: per cent signs and line feeds as in URLs, control strings escaped."""
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chat_examples(turns: DataFrame) -> DataFrame:
    """One row for every assistant turn: all turns up to it as context, only its reply under the loss.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by turn, then
    role, then text, so ties and repeated rows have one order and stay. Null
    role or text is empty; a null conv_id is a conversation of its own. Turns
    after the last assistant turn (or a conversation without one) come as one
    more example with an empty loss span, so that no turn is lost. Columns:
    conv_id, example (position of its last turn), formatted, loss_start,
    loss_end (code points, end exclusive), last (it holds all turns). An empty
    table gives no rows. A conversation is one group: its examples are its own
    prefixes, so it has to fit a task in any case.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t: F.struct(
                (t["role"] == TRAINED).alias("trained"),
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("ts"),
    )
    wanted = F.filter(
        F.sequence(F.lit(1), F.size("ts")),
        lambda i: F.element_at(F.col("ts"), i)["trained"] | (i == F.size("ts")),
    )
    one = convs.select("conv_id", "ts", F.explode(wanted).alias("example"))
    at = F.element_at("ts", F.col("example"))
    context = F.array_join(
        F.transform(
            F.slice("ts", F.lit(1), F.col("example") - 1),
            lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")),
        ),
        "",
    )
    parts = one.select(
        "conv_id",
        "example",
        F.concat(context, at["head"]).alias("before"),
        at["body"].alias("body"),
        at["trained"].alias("trained"),
        (F.col("example") == F.size("ts")).alias("last"),
    )
    start = F.char_length("before").cast("long")
    return parts.select(
        "conv_id",
        "example",
        F.concat("before", "body", F.lit(END + "\n")).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("trained"), start + F.char_length("body")).otherwise(start).alias("loss_end"),
        "last",
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted example: array of struct(role, text)."""
    chunks = F.split(formatted, F.lit(r"<\|im_start\|>"), -1)
    turns = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))

    def one(c: Column) -> Column:
        cut = F.instr(c, F.lit("\n"))
        tail = len(END) + 1
        return F.struct(
            unescape_role(F.substring(c, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(c, cut + 1, F.char_length(c) - cut - tail)).alias("text"),
        )

    return F.transform(turns, one)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """Unescaped text under the loss span."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def chat_digests(examples: DataFrame) -> DataFrame:
    """For each conversation, what its examples say when read back."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    read = examples.select(
        "conv_id",
        "example",
        F.when(F.col("last"), F.size(turns).cast("long")).alias("n"),
        F.when(F.col("last"), F.sha2(said, 256)).alias("sha"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    per = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return per.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
