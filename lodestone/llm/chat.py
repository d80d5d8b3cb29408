"""Chat formatting with Spark expressions only.

Rows of a conversation are collected as structs and sorted by turn; runs of one role are merged by array functions; the
template is put together by concatenation. Layout of one merged block::

    <|role|>ROLE<|text|>TEXT(<|next|>TEXT)*<|end|>

Every original turn keeps its own text: texts of a merged block are parted by <|next|>, so that the output can be read
back. Inside roles and texts a backslash is doubled, and a backslash is put behind the first character of each control
string (``<|`` and the usual strings of other templates: ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``). No control string of
either kind is left in an escaped text, and dropping each escaping backslash gives the text back.

The loss mask has one boolean per segment, where segments are the control strings of the output and what stands between
them; it is true for texts of the roles that are trained on.

Defined cases: null text or role is empty; null turns sort first; equal turns sort by role, then text; null conversation
ids form one conversation; an empty table gives no rows; further columns are ignored; an empty text is an empty segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
#: The places behind which a control string would go on.
CONTROL = r"(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, "\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss_mask array<boolean> (one per segment)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    roles = sorted_turns.withColumn("roles", F.col("turns.role")).withColumn("texts", F.col("turns.text"))
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get("roles", i) != F.get("roles", F.greatest(i - 1, F.lit(0)))),
    )
    runs = roles.withColumn("starts", starts)
    merged = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("roles", s).alias("role"),
            F.slice("texts", s + 1, F.coalesce(F.get("starts", k + 1), n) - s).alias("texts"),
        ),
    )
    blocks = runs.select("conv_id", merged.alias("blocks"))
    block = lambda b: F.concat(
        F.lit(ROLE), escape(b["role"]), F.lit(TEXT), F.array_join(F.transform(b["texts"], escape), NEXT), F.lit(END)
    )
    # Segments of a block: ROLE, role, TEXT, text, (NEXT, text)*, END.
    mask = lambda b: F.concat(
        F.array(F.lit(False), F.lit(False)),
        F.flatten(F.transform(b["texts"], lambda _: F.array(F.lit(False), b["role"].isin(*trained_roles)))),
        F.array(F.lit(False)),
    )
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", block), "").alias("formatted"),
        F.flatten(F.transform("blocks", mask)).alias("loss_mask"),
    )


def segments(formatted: Column) -> Column:
    """Control strings and what stands between them, in order; a text between two control strings may be empty."""
    parts = F.split(formatted, r"<\|")  # "", then NAME|>payload ...
    return F.flatten(
        F.transform(
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda p: F.when(p == "end|>", F.array(F.lit(END))).otherwise(
                F.array(
                    F.concat(F.lit("<|"), F.substring_index(p, "|>", 1), F.lit("|>")),
                    F.substring(p, F.instr(p, "|>") + 2, F.length(p)),
                )
            ),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns as array<struct<role, text>>, read back from a formatted string."""
    blocks = F.split(formatted, r"<\|end\|>")
    return F.flatten(
        F.transform(
            F.slice(blocks, 1, F.size(blocks) - 1),
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, TEXT) + len(TEXT), F.length(b)), r"<\|next\|>"),
                lambda t: F.struct(
                    unescape(F.substring(F.substring_index(b, TEXT, 1), len(ROLE) + 1, F.length(b))).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    picked = F.filter(F.arrays_zip(segments(formatted).alias("s"), loss_mask.alias("m")), lambda z: z["m"])
    return F.array_join(F.transform(picked, lambda z: unescape(z["s"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests, all read back from the output of format_chats."""
    back = formatted.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("back"),
        masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
