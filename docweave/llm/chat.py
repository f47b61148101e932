"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and that reply alone
trainable. Turns after the last assistant turn are kept by one more example without a reply.

A turn is `<|im_start|>role`, a line break, the text, `<|im_end|>`, a line break. In roles and
texts a backslash is put before every backslash, and inside every control string (after its first
character), and before line breaks of a role; dropping it again gives the text back exactly.

Rows with equal turn numbers are ordered by role and text; repeated rows stay. Null texts and roles
count as empty, null turns come first, null conversations form one conversation. A conversation
is one value, as its examples are: it must fit a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: First characters of control strings, by what follows them: those of this template and of other
#: common ones.
CONTROL = r"(<(?=\||/?s>|/?SYS>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, F.lit(CONTROL), F.lit(r"$1\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def chat_examples(rows: DataFrame) -> DataFrame:
    """conv_id, example (from 0), n_turns in it, formatted, loss_start and loss_chars (the
    trainable part, in code points from 0), is_last."""
    turn = F.struct(
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns")
    )
    rendered = turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == ASSISTANT).alias("reply"),
                F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    rendered = rendered.withColumn(
        "parts",
        F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))),
    )
    size = F.size("turns")
    targets = F.filter(
        F.sequence(F.lit(1), size), lambda i: F.element_at("turns", i)["reply"] | (i == size)
    )
    examples = rendered.select("conv_id", "turns", "parts", F.posexplode(targets).alias("example", "upto"))
    target = F.element_at("turns", F.col("upto"))
    before = F.array_join(F.slice("parts", F.lit(1), F.col("upto") - 1), "")
    pieces = examples.select(
        "conv_id",
        F.col("example").cast("bigint").alias("example"),
        F.col("upto").cast("bigint").alias("n_turns"),
        (F.col("upto") == size).alias("is_last"),
        before.alias("before"),
        F.element_at("parts", F.col("upto")).alias("part"),
        F.char_length(target["head"]).alias("head_chars"),
        F.when(target["reply"], F.char_length(target["body"])).alias("body_chars"),
    )
    return pieces.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("before", "part").alias("formatted"),
        F.when(
            F.col("body_chars").isNotNull(), F.char_length("before") + F.col("head_chars")
        ).cast("bigint").alias("loss_start"),
        F.coalesce("body_chars", F.lit(0)).cast("bigint").alias("loss_chars"),
        "is_last",
    )


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text), read from a formatted example."""
    marked = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(marked, F.lit(1), F.size(marked) - 1)
    role = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)$"
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, role, 1)).alias("role"),
            unescape(F.regexp_extract(t, role, 2)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable part of a formatted example, unescaped; null if it has none."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted examples."""
    turns = F.transform(
        parse_turns(F.col("formatted")),
        lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")),
    )
    read = examples.select(
        "conv_id",
        "example",
        F.when(F.col("is_last"), turns).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
        F.char_length("formatted").cast("bigint").alias("chars"),
    )
    grouped = read.groupBy("conv_id").agg(
        F.flatten(F.collect_list("turns")).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias(
            "losses"
        ),
        F.sum("chars").alias("formatted_chars"),
    )
    trained = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return grouped.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length(trained).cast("bigint").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )
