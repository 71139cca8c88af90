"""Chat formatting by prefix-target expansion; DataFrame expressions only.

Every turn is one formatted segment.  Every assistant turn is exploded into an example of
its own: the text of all segments of the conversation up to its own, of which only its own
text is trainable.  So examples grow with the square of a conversation's length, in text
and not in rows; ``examples`` only names the contexts, for trainers that keep segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

#: The template's marks, and other control strings that texts must not carry.
START, BREAK, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, BREAK, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

#: A reader holds a row group's texts at once, so long examples get small ones: sizes are looked at every few rows, and
#: pages stay small, as examples with one context in one page would hide their size in the compression.
SMALL = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def escape(text: Column) -> Column:
    """Double backslashes, and break every control string with one after its first character."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, seq (0 upwards), role, segment, text_at and text_chars
    (where the escaped text lies in the segment, in code points).

    Turns come by ``turn`` (null first), equal ones by role and text.  Null text or
    role: empty.  A null conv_id is a conversation of its own; other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    head, body = F.concat(F.lit(START), escape(F.col("role")), F.lit(BREAK)), escape(F.col("text"))
    return (
        rows.withColumns({"head": head, "body": body})
        .select("conv_id", (F.row_number().over(order) - 1).alias("seq"), "role", F.concat("head", "body", F.lit(END + "\n")).alias("segment"), F.length("head").alias("text_at"), F.length("body").alias("text_chars"))
    )


def expand(segs: DataFrame, target_role: str = "assistant") -> DataFrame:
    """The formatted output: a row of kind ``turn`` per segment and one of kind ``example``
    per assistant turn: conv_id, kind, seq, text (the segment; of an example its whole context
    and its own segment after that), and of examples loss_at and loss_len (the trainable
    span of the text, in code points)."""
    upto = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = segs.withColumn("upto", F.collect_list("segment").over(upto)).withColumn("whole", F.when(F.col("role") == target_role, F.array_join("upto", "")))
    none = F.lit(None).cast("int")
    row = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("kind", "seq", "text", "loss_at", "loss_len"))))
    turn = row(F.lit("turn"), F.col("seq"), F.col("segment"), none, none)
    own = row(F.lit("example"), F.col("seq"), F.col("whole"), F.length("whole") - F.length("segment") + F.col("text_at"), F.col("text_chars"))
    return rows.select("conv_id", F.explode(F.when(F.col("role") == target_role, F.array(turn, own)).otherwise(F.array(turn))).alias("x")).select("conv_id", "x.*")


def inline_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Flat examples: conv_id, seq, text (context and target), loss_start, loss_end.  Nulls,
    ties and repeated rows as in ``segments``."""
    rows = expand(segments(conversations), target_role).filter("kind = 'example'")
    return rows.select("conv_id", "seq", "text", F.col("loss_at").alias("loss_start"), (F.col("loss_at") + F.col("loss_len")).alias("loss_end"))


def examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """The same by reference, a row per assistant turn: conv_id, seq of the target, text (its
    segment), context_segments (all before it), context_chars, loss_at and loss_len (in the
    segment).  Nulls, ties and repeated rows as in ``segments``."""
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments(conversations).withColumn("context_chars", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))).filter(F.col("role") == target_role)
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select("conv_id", long("seq", "seq"), F.col("segment").alias("text"), long("seq", "context_segments"), long("context_chars", "context_chars"), long("text_at", "loss_at"), long("text_chars", "loss_len"))


def read_back(text: str) -> tuple[Column, Column]:
    """Role and text of a segment, parsed and unescaped."""
    inner = f"substring({text}, {len(START) + 1}, length({text}) - {len(START) + len(END) + 1})"
    at = f"instr(substring({text}, {len(START) + 1}), '{BREAK}')"
    return unescape(F.expr(f"substring({inner}, 1, {at} - 1)")), unescape(F.expr(f"substring({inner}, {at} + {len(BREAK)})"))


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, all read back from the formatted output, which is written as a
    table: n_turns and turns_sha256 from the segments, loss_chars and loss_sha256 from the
    loss spans of the examples, formatted_chars (of the segments), n_examples, and
    example_chars (of all examples with their contexts).

    Nulls, ties and repeated rows as in ``segments``.  The hashes need a conversation's
    text in one row, as its last example does.
    """
    out = materialize(expand(segments(conversations)), "formatted", **SMALL)
    is_turn, is_example = F.col("kind") == "turn", F.col("kind") == "example"
    role, text = read_back("text")
    parsed = out.select(
        "conv_id", F.when(is_turn, F.struct("seq", role.alias("role"), text.alias("text"))).alias("turn"), F.when(is_turn, F.length("text")).alias("chars"),
        F.when(is_example, F.struct("seq", unescape(F.expr("substring(text, loss_at + 1, loss_len)")).alias("text"))).alias("loss"), F.when(is_example, F.length("text")).alias("example_chars"),
    )
    return (
        parsed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("t"), F.array_sort(F.collect_list("loss")).alias("l"), F.sum("chars").alias("formatted_chars"), F.coalesce(F.sum("example_chars"), F.lit(0)).alias("example_chars"))
        .withColumn("loss", F.array_join(F.transform("l", lambda x: x["text"]), ""))
        .select(
            "conv_id",
            F.size("t").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.col("formatted_chars").cast("long"),
            F.size("l").cast("long").alias("n_examples"),
            F.col("example_chars").cast("long"),
        )
    )
