"""Chat formatting: reply trees to conversations with a reversible template.

Messages name the message they answer. Self-joins first find the runs of messages without a
branch, doubling their reach each round, then grow paths from the roots by one run a round, as lists
of message numbers only; a run without answers ends a path. Paths of a tree are ranked by the sum
of their scores and the chosen ones are formatted.

A turn is ``<turn role=ROLE>TEXT</turn>`` and a line end. In roles and texts ``\\`` becomes
``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``, so control strings never occur inside
a text, and replacing in the opposite order restores it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import column
from clientele.operators.skew import spread_join
from clientele.sources.staging import staged, staged_counted

OPEN, SHUT, END = "<turn role=", ">", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _trees(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("tree")))


def _segments(nodes: DataFrame) -> DataFrame:
    """Runs of messages without a branch: tree, path, score, last and the message above the run.

    From (tree, message, parent, score, size of the tree), one row per message. Every message finds the
    head of its run by self-joins that double the distance, so the rounds are the logarithm of
    the longest run; trees of under 2^k messages are done after k rounds. Rings find no head.
    """
    nodes, rows = staged_counted(nodes)
    answers = (nodes.filter(F.col("parent").isNotNull()).groupBy("tree", "parent").agg(F.count(F.lit(1)).alias("answers"))
               .join(nodes.select("tree", F.col("message").alias("parent")), ["tree", "parent"]))
    head = F.coalesce(F.col("answers") > 1, F.lit(True))
    jump = staged(spread_join(nodes, answers, ["tree", "parent"], "left", rows=rows).select(
        "tree", "message", "score", "size", F.when(F.col("answers") > 1, F.col("parent")).alias("above"),
        F.when(head, F.col("message")).otherwise(F.col("parent")).alias("to"), F.when(head, 0).otherwise(1).cast("long").alias("far"),
        head.alias("done")))
    largest, reach, ended = jump.agg(F.max("size")).first()[0] or 0, 1, []
    while reach < largest:
        ended.append(jump.filter(F.col("done") & (F.col("size") <= reach)))
        live = jump.filter(F.col("size") > reach)
        ahead = live.select("tree", F.col("message").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("found"))
        moved = live.filter(~F.col("done")).join(ahead, ["tree", "to"]).select(
            "tree", "message", "score", "size", "above", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("found").alias("done"))
        jump = staged(live.filter("done").unionByName(moved))
        reach *= 2
    runs = reduce(DataFrame.unionByName, [*ended, jump.filter("done")])
    steps = F.sort_array(F.collect_list(F.struct("far", "message", "score")))
    return staged(runs.groupBy("tree", "to").agg(steps.alias("steps"), F.max("above").alias("above")).select(
        "tree", "above", F.transform("steps", lambda x: x["message"]).alias("path"),
        F.aggregate("steps", F.lit(0.0), lambda acc, x: acc + x["score"]).alias("score"),
        F.element_at("steps", -1)["message"].alias("last")))


def _paths(nodes: DataFrame) -> DataFrame:
    """All root-to-leaf paths (tree, path, score), grown from the roots by one run a round."""
    segments = _segments(nodes)
    answers = segments.filter(F.col("above").isNotNull())
    roots = segments.filter(F.col("above").isNull())
    if answers.isEmpty():
        return roots.select("tree", "path", "score")
    inner = answers.select("tree", F.col("above").alias("last")).distinct()
    answers, rows = staged_counted(answers.select("tree", F.col("above").alias("from"), "last", F.col("path").alias("run"), F.col("score").alias("gain"))
                                   .join(inner.withColumn("goes_on", F.lit(True)), ["tree", "last"], "left"))
    frontier = staged(roots.join(inner.withColumn("goes_on", F.lit(True)), ["tree", "last"], "left").select("tree", "last", "path", "score", "goes_on"))
    ended = []
    while not frontier.isEmpty():
        ended.append(frontier.filter(F.col("goes_on").isNull()).select("tree", "path", "score"))
        grown = frontier.filter("goes_on").select("tree", F.col("last").alias("from"), "path", "score")
        frontier = staged(spread_join(answers, grown, ["tree", "from"], "inner", rows=rows).select(
            "tree", "last", F.concat("path", "run").alias("path"), (F.col("score") + F.col("gain")).alias("score"), "goes_on"))
    return reduce(DataFrame.unionByName, ended) if ended else frontier.select("tree", "path", "score")


def reply_paths(messages: DataFrame) -> DataFrame:
    """All root-to-leaf paths (conv, path, score): numbers of messages in order.

    A message without a parent, or whose parent is not in its conversation, is a root. (A ring
    of replies has no root and no path.) NULL conversations are one conversation, messages
    without a number are left out, rows that repeat a number are one message, the one of the smallest parent.
    """
    nodes = (messages.filter(F.col("message").isNotNull()).groupBy(F.struct("conv").alias("tree"), F.col("message").cast("long").alias("message"))
             .agg(F.min(F.struct(F.col("parent").cast("long").alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))).alias("first"))
             .select("tree", "message", "first.parent", "first.score"))
    return _paths(_trees(nodes)).select(F.col("tree.conv").alias("conv"), "path", "score")


def best_paths(paths: DataFrame, branches: int | None = 1, group: str = "conv") -> DataFrame:
    """Ranked by score within a conversation, ties by path; the first ``branches`` or all."""
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), "path")
    ranked = paths.withColumn("rank", F.row_number().over(order))
    return ranked if branches is None else ranked.filter(F.col("rank") <= branches)


def _formatted(texts: DataFrame, paths: DataFrame, loss_role: str) -> DataFrame:
    """Texts (tree, message, role, text) along paths (tree, rank, path); texts move once, by tree."""
    number = F.col("message").try_cast("int")
    # Numbers from 1 stand at their own place; others are looked for.
    place = F.when(F.get("path", number - 1) == F.col("message"), number).otherwise(F.array_position("path", F.col("message")).cast("int"))
    turns = (texts.join(paths.select("tree", "rank", "path"), "tree").withColumn("place", place).filter(F.col("place") > 0).groupBy("tree", "rank")
             .agg(F.sort_array(F.collect_set(F.struct("place", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"),
                                                      (F.col("role") == loss_role).alias("counts")))).alias("turns")))
    span = "array<struct<start:int,end:int>>"

    def placed(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.length(t["role"]) + len(SHUT)
        end = start + F.length(t["text"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["counts"], F.concat(acc["loss"], own)).otherwise(acc["loss"]).alias("loss"))
    return turns.select(
        F.col("tree.conv").alias("conv"), "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SHUT), t["text"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("loss")), placed, lambda acc: acc["loss"]).alias("loss"))


def format_paths(messages: DataFrame, paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path (conv, rank): formatted text and the spans that count for the loss.

    Spans are code points of the formatted text, end exclusive, of the texts of ``loss_role``. NULL
    roles and texts are empty; equal rows of a message are one turn, differing ones are a turn each.
    """
    blank = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return _formatted(messages.select(F.struct("conv").alias("tree"), F.col("message").cast("long").alias("message"), blank("role"), blank("text")),
                      paths.withColumn("tree", F.struct("conv")), loss_role)


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, OPEN), lambda x: x != "")
    fields = lambda x: F.split(x, "[<>]")
    return F.transform(parts, lambda x: F.struct(unescape(F.element_at(fields(x), 1)).alias("role"),
                                                 unescape(F.element_at(fields(x), 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Conversations by turn as one formatted text each (conv, rank, formatted, loss).

    Each turn answers the one before. Ties of a turn are ordered by role and text; NULL turns come
    first, NULL texts and roles are empty, NULL conversations are one. Repeated rows are turns
    of their own; other columns are ignored; an empty table gives an empty result.
    """
    tree, turn = F.struct(column(turns, conv_col).alias("conv")).alias("tree"), column(turns, turn_col).alias("turn")

    def numbered(rows: DataFrame, *order: str) -> DataFrame:
        return rows.withColumn("message", F.row_number().over(Window.partitionBy("tree").orderBy(*order)).cast("long"))
    # However ties are ordered, the numbers are the same: the tree needs no texts.
    nodes = numbered(turns.select(tree, turn), "turn").select(
        "tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), F.lit(0.0).alias("score"))
    chosen = staged(best_paths(_paths(_trees(nodes)), group="tree"))
    texts = turns.select(tree, turn, F.coalesce(column(turns, role_col), F.lit("")).alias("role"), F.coalesce(column(turns, text_col), F.lit("")).alias("text"))
    return _formatted(numbered(texts, "turn", "role", "text"), chosen, loss_role)
