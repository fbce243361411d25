"""Chat formatting of typed content parts, in DataFrame operations.

A turn is a list of parts: text, image, audio or document. A visitor flattens
them in order; what is not text becomes a placeholder, and its reference and
the tokens it expands to are recorded beside the text. Control strings begin
with ``<|``. In texts every ``<`` gets a backslash behind it, so no text, nor
two texts side by side, can hold a control string, and taking one backslash
off behind every ``<`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TAIL = f"{END}\n"
LEARNED = ("assistant",)
#: Tokens an attachment expands to for each of its units: tiles, seconds, pages.
EXPANSION = {"image": 256, "audio": 25, "document": 600}

PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    nothing = F.lit(None).cast("string")
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), nothing.alias("ref"),
            F.lit(None).cast("double").alias("units"),
        )
    )


def _visit(part: Column) -> Column:
    """Placeholder of an attachment; any other part is its escaped text, null as empty."""
    shown = F.coalesce(escape(part["text"]), F.lit(""))
    for kind in EXPANSION:
        shown = F.when(part["kind"] == kind, F.lit(f"<|{kind}|>")).otherwise(shown)
    return shown


def _tokens(part: Column) -> Column:
    each = F.lit(0)
    for kind, n in EXPANSION.items():
        each = F.when(part["kind"] == kind, F.lit(n)).otherwise(each)
    return F.ceil(each * F.coalesce(part["units"], F.lit(1.0))).cast("long")


def format_chats(
    messages: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
) -> DataFrame:
    """One row per conversation: ``formatted``, ``turns``, ``attachments``, ``n_attachment_tokens``.

    ``turns`` has (start, length, loss) of each turn's content in ``formatted``
    in code points; ``loss`` marks what is learned. ``attachments`` has (kind,
    ref, tokens, turn) in order, turns counted from 0. Rows go by turn, null
    last; equal turns by role and content. Null roles and parts are empty,
    units default to 1, and null conversation ids form one conversation.
    Repeated rows are turns of their own; other columns are not read. A
    conversation becomes one string, so it is the only thing held whole.
    """
    name = F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit(LINE))
    listed = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    # Attachments are known by their kind alone.
    attached = F.filter(listed, lambda p: p["kind"].isin(*EXPANSION))
    rows = messages.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.concat(F.lit(START), name, F.lit("\n")).alias("head"),
        F.array_join(F.transform(listed, _visit), "").alias("content"),
        F.coalesce(F.col(role).isin(*LEARNED), F.lit(False)).alias("loss"),
        F.transform(
            attached,
            lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
        ).alias("attached"),
    )
    block = F.concat("head", "content", F.lit(TAIL))
    order = (F.col("turn").asc_nulls_last(), "head", "content", F.to_json("attached"))
    ordered = Window.partitionBy("conv").orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    placed = rows.select(
        "conv",
        (F.row_number().over(ordered) - 1).cast("long").alias("at"),
        block.alias("block"),
        (F.coalesce(F.sum(F.length(block)).over(before), F.lit(0)) + F.length("head")).cast("long").alias("start"),
        F.length("content").cast("long").alias("length"),
        "loss",
        "attached",
    )
    gathered = placed.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("at", "block", "start", "length", "loss", "attached"))).alias("t")
    )
    attachments = F.flatten(
        F.transform(
            "t",
            lambda t: F.transform(
                t["attached"],
                lambda a: F.struct(
                    a["kind"].alias("kind"), a["ref"].alias("ref"),
                    a["tokens"].alias("tokens"), t["at"].alias("turn"),
                ),
            ),
        )
    )
    tokens = F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    return gathered.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("t", lambda t: t["block"]), "").alias("formatted"),
        F.transform(
            "t",
            lambda t: F.struct(
                t["start"].alias("start"), t["length"].alias("length"), t["loss"].alias("loss")
            ),
        ).alias("turns"),
        attachments.alias("attachments"),
        tokens.alias("n_attachment_tokens"),
    )


def read_chats(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``read``: (role, text, loss, masked) of each turn, taken out of ``formatted`` again.

    ``text`` is what stands between a turn's marks, ``masked`` what its ``start`` and ``length`` cover; they
    are the same as long as the spans are right. Placeholders come back as they are shown, so a text that
    spells one out keeps its backslash until it is unescaped and the two stay apart.
    """
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.size("turns"))

    def one(b: Column, i: Column) -> Column:
        block, turn, before = b["block"], b["turn"], F.get("turns", i - 1)
        name = F.substring_index(block, "\n", 1)
        start = F.length(name) + 2
        content = F.substr(block, start, F.length(block) - start - (len(TAIL) - 1))
        role = unescape(F.replace(name, F.lit(LINE), F.lit("\n")))
        # A block begins where the one before ends, and its mark is cut off.
        begin = F.coalesce(before["start"] + before["length"] + len(TAIL), F.lit(0)) + len(START)
        span = F.substr(block, (turn["start"] - begin + 1).cast("int"), turn["length"].cast("int"))
        return F.struct(
            role.alias("role"), unescape(content).alias("text"), turn["loss"].alias("loss"), unescape(span).alias("masked")
        )

    zipped = F.arrays_zip(blocks.alias("block"), F.col("turns").alias("turn"))
    return chats.select("*", F.transform(zipped, one).alias("read"))


def digest(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and hashes of what is read back from formatted conversations."""
    turns = F.array_join(
        F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    learned = F.transform(F.filter("read", lambda t: t["loss"]), lambda t: t["masked"])
    read = read_chats(chats, conv).select("*", turns.alias("said"), F.array_join(learned, "").alias("learned"))
    return read.select(
        conv,
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
