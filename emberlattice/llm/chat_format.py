"""Chat formatting: conversations cut into budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlattice.llm.common import let

# The template: <turn ROLE>TEXT</turn> and a line feed. A backslash in front of a backslash, of a < that
# opens a control string, or of an angle bracket in a role makes it plain text.
TOKEN = r"[\p{L}\p{M}]{1,8}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]"
TURN_TOKENS = 4
TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
PIECE = "array<struct<pos:bigint,role:string,text:string,tokens:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|<(?=/?turn)", r"\\$0")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\<>]", r"\\$0")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def token_count(text: Column) -> Column:
    """Tokens of a text by a fixed pattern, plus the marks of its turn."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint") + TURN_TOKENS


def placed_turns(turns: DataFrame, budget: int, history: int, block: int, tokens) -> DataFrame:
    """Turns with their position, their span's key and the conversation's leading system turn.

    Sums run inside blocks of ``block`` turn numbers, then over the blocks' totals, so a conversation
    holding a third of all rows is spread over many tasks. A span takes the turns that start in one
    stretch of the prefix sums; a stretch leaves room for the system turn, the history and the longest
    usual turn. A turn beyond half the budget is a span of its own.
    """
    big = budget // 2
    turns = turns.withColumn("tokens", tokens(F.col("text"))).withColumn("block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.when(F.col("tokens") > big, 1).otherwise(0).cast("bigint")
    turns = turns.withColumns({"i": F.row_number().over(inside).cast("bigint"), "t": F.sum("tokens").over(up_to),
                               "o": F.sum(over).over(up_to)})
    blocks = turns.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("bt"), F.sum(over).alias("bo"),
        F.max(F.when(F.col("tokens") <= big, F.col("tokens"))).alias("longest"),
        F.min(F.struct("turn", "role", "text", "tokens")).alias("head"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("bigint")
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(before), none).alias("n0"), F.coalesce(F.sum("bt").over(before), none).alias("t0"),
        F.coalesce(F.sum("bo").over(before), none).alias("o0"), F.sum("n").over(everything).alias("size"),
        F.coalesce(F.max("longest").over(everything), none).alias("longest"), F.first("head").over(everything).alias("head"))
    blocks = blocks.withColumn("head", F.when((F.col("head.role") == "system") & (F.col("size") > 1), F.col("head")))
    joined = turns.join(blocks, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("block").eqNullSafe(F.col("_block")))
    system = F.coalesce(F.col("head.tokens"), none)
    stretch = F.greatest(F.lit(1), budget - system - history - F.col("longest"))
    start = F.col("t0") + F.col("t") - F.col("tokens") - system
    return joined.select(
        "conv_id", (F.col("n0") + F.col("i")).alias("pos"), "role", "text", "tokens",
        F.floor(start / stretch).alias("stretch"),
        (2 * (F.col("o0") + F.col("o")) - over).alias("part"),
        F.when(F.col("head").isNotNull(), F.struct("head.role", "head.text", "head.tokens")).alias("head"))


def format_chat(conversations: DataFrame, budget: int = 512, history: int = 96, block: int = 1024,
                tokens=token_count) -> DataFrame:
    """Windows of conversations: conv_id, first_turn, formatted, loss_spans, n_repeated, n_tokens.

    Turns go by ``turn``, null first, ties by role and text; repeated rows are turns of their own. Null
    text and null roles count as empty, null conv_id is one conversation. Other columns are ignored, so
    their names may clash. A window is the leading system turn, the last turns of the span before that
    fit into ``history`` tokens, and a span. Only assistant turns of the span itself are under the loss
    mask (code point ranges of ``formatted``), so every one is a target once. A window exceeds ``budget``
    only if one turn is longer than what the system turn and the history leave.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                                 F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = placed_turns(turns, budget, history, block, tokens)
    placed = placed.where(F.col("head").isNull() | (F.col("pos") > 1))
    # A span holds at most a budget of turns, or one long turn.
    spans = placed.groupBy("conv_id", "stretch", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text", "tokens"))).cast(PIECE).alias("own"),
        F.first("head").alias("head"))
    spans = spans.select("conv_id", "own", "head", F.col("own")[0]["pos"].alias("first_turn"),
                         F.element_at("own", -1)["pos"].alias("last_turn"))
    tail = spans.select(F.col("conv_id").alias("_conv"), (F.col("last_turn") + 1).alias("_next"), recent("own", history).alias("past"))
    windows = spans.join(tail, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("first_turn") == F.col("_next")), "left")
    empty = F.array().cast(PIECE)
    past = F.coalesce("past", empty)
    head = F.when(F.col("head").isNull(), empty).otherwise(F.array(F.struct(
        F.lit(1).cast("bigint").alias("pos"), F.col("head.role"), F.col("head.text"), F.col("head.tokens"))).cast(PIECE))
    opening = F.col("head").isNotNull() & (F.col("first_turn") == 2)
    windows = windows.select(
        "conv_id", "first_turn", F.concat(head, past, "own").alias("pieces"),
        (F.size(head) + F.size(past) - F.when(opening, 1).otherwise(0)).alias("n_repeated"))
    parts = let(F.col("pieces"), lambda pieces: F.transform(pieces, lambda p, i: F.struct(
        F.concat(F.lit("<turn "), escaped_role(p["role"]), F.lit(">")).alias("open"), escaped(p["text"]).alias("body"),
        ((p["role"] == "assistant") & (i >= F.col("n_repeated"))).alias("target"))))
    windows = windows.withColumn("parts", parts)
    close = "</turn>\n"

    def walk(acc, p):
        start = acc["at"] + F.length(p["open"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(close)).alias("at"), F.when(p["target"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return windows.select(
        "conv_id", "first_turn",
        F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], F.lit(close))), "").alias("formatted"),
        F.aggregate("parts", begin, walk, lambda acc: acc["out"]).alias("loss_spans"), "n_repeated",
        F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + p["tokens"]).alias("n_tokens"))


def recent(own: str, history: int) -> Column:
    """The last turns of an array whose tokens add up to at most ``history``."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast(PIECE).alias("out"))

    def step(acc, p):
        total = acc["sum"] + p["tokens"]
        return F.struct(total.alias("sum"), F.when(total <= history, F.concat(F.array(p), acc["out"])).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.reverse(F.col(own)), start, step, lambda acc: acc["out"])


class Reader:
    """Reads one conversation back from its windows, one after another, in bounded memory."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, formatted: str, loss_spans, n_repeated: int) -> None:
        for k, m in enumerate(TURN.finditer(formatted)):
            if k >= n_repeated:
                self.n_turns += 1
                self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        for span in loss_spans:
            text = unescape(formatted[span["start"]:span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of every conversation, read from its windows in order as a stream."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in DIGEST.split(", ")]
        current, done = None, []
        for batch in batches:
            for conv, null, formatted, spans, repeated in zip(
                    batch["conv_id"], batch["is_null"], batch["formatted"], batch["loss_spans"], batch["n_repeated"]):
                conv = None if null else int(conv)
                if current is None or current.conv_id != conv:
                    if current is not None:
                        done.append(current.row())
                    current = Reader(conv)
                current.read(formatted, spans, repeated)
            if done:
                yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
                done = []
        if current is not None:
            yield pd.DataFrame([current.row()], columns=columns).astype({"conv_id": "Int64"})

    rows = windows.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("is_null"),
                          "first_turn", "formatted", "loss_spans", "n_repeated")
    rows = rows.repartition("conv_id", "is_null").sortWithinPartitions("conv_id", "is_null", "first_turn")
    return rows.mapInPandas(stream, DIGEST)


PROBE = "\\### Assistant: </turn> ok"


def op1_chat_windows(conversations: DataFrame) -> DataFrame:
    """Digest of all conversations and of the probe conversation -7, read back from their windows."""
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    turns = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in probe.dtypes])
    return read_back(format_chat(turns.unionByName(probe)))
