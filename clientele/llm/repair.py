"""Conversation repair as a lightest derivation, by Knuth's agenda.

The rows of a conversation are read in order, and edits make their roles a legal sequence: one
optional system row, then pairs of user and assistant, or nothing at all. An item is a place in
the rows with the state that the output has reached; a deduction is an edit (or, for long conversations, the
union of a prefix and a block of rows). Items leave the agenda by cost, then audit, the initials of the
edits made so far. Both only grow along a deduction, and of two derivations of an item with
equal costs neither audit begins with the other, so the first one popped is the lightest and stays it.

A conversation of up to ``BLOCK`` rows is one group. Longer ones are sorted across tasks and cut into
blocks; each block gives the lightest derivations between all its states, blocks are united by
sixteens in a tree, and the chosen audits go back to the rows of their blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import SPACE_CHARS, column
from clientele.operators.skew import heavy_keys, spread_join
from clientele.sources.staging import staged, staged_counted

# Rows a task takes of one conversation; a power of two.
BLOCK = 1 << 12
FAN = 4  # bits of the block number that a round of the tree takes off

# Costs of the edits, roles that follow each other, and states of the output.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEIGHBOURS = {("s", "u"), ("u", "a"), ("a", "u")}
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = (NOTHING, ASSISTANT)

Weight = tuple[int, str]
Rule = tuple[Hashable, tuple[Hashable, ...], Weight]  # head, tails, what the deduction adds


def lightest(axioms: dict[Hashable, Weight], rules: Callable[[Hashable], Iterable[Rule]],
             goals: set[Hashable]) -> dict[Hashable, Weight]:
    """Weights of items, lightest derivation each, until all goals (or the agenda) are done.

    ``rules(item)`` are the deductions with the item among their tails; one fires when its last
    tail is done. A head weighs its tails and what the deduction adds: costs summed, audits joined in order.
    """
    agenda, done, open_goals = [(*w, item) for item, w in axioms.items()], {}, set(goals)
    heapify(agenda)
    while agenda and open_goals:
        cost, audit, item = heappop(agenda)
        if item in done:
            continue
        done[item] = cost, audit
        open_goals.discard(item)
        for head, tails, (more, letters) in rules(item):
            if head not in done and all(t in done for t in tails):
                heappush(agenda, (sum(done[t][0] for t in tails) + more, "".join(done[t][1] for t in tails) + letters, head))
    return done


def _edits(rows: Sequence[tuple[str, str]]) -> Callable[[tuple[int, int]], Iterator[Rule]]:
    """Deductions over rows of (initial of the role, fault)."""
    def rules(item: tuple[int, int]) -> Iterator[Rule]:
        i, state = item
        wanted = "a" if state == USER else "u"
        if i < len(rows):
            initial, fault = rows[i]
            yield (i + 1, state), (item,), (DELETE, "D")
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault == "truncated" else 0
                if (state, initial) in NEXT:
                    yield (i + 1, NEXT[state, initial]), (item,), (KEEP + more, "K")
                yield (i + 1, NEXT[state, wanted]), (item,), (REROLE + more, "R")
        yield (i, NEXT[state, wanted]), (item,), (INSERT, "I")
    return rules


def repair_rows(rows: Sequence[tuple[str, str]]) -> Weight:
    """Least cost and its audit for the rows of a whole conversation."""
    edits, n, goal = _edits(rows), len(rows), (len(rows) + 1, NOTHING)

    def rules(item: tuple[int, int]) -> Iterator[Rule]:
        if item[0] <= n:
            yield from edits(item)
            if item[0] == n and item[1] in LEGAL:
                yield goal, (item,), (0, "")
    return lightest({(0, NOTHING): (0, "")}, rules, {goal})[goal]


def block_items(rows: Sequence[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block, for all states that can follow each other."""
    edits, n, out = _edits(rows), len(rows), []
    for before in range(4):
        done = lightest({(0, before): (0, "")}, edits, {(n, after) for after in range(4)})
        out += [(before, after, *done[n, after]) for after in range(4) if (n, after) in done]
    return out


def united(blocks: Sequence[Sequence[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str, list[str], list[int]]]:
    """Items of neighbouring blocks as items of all: also each block's audit and the state before it.

    A prefix and a block that starts in the state the prefix ends in make a longer prefix.
    """
    out = []
    for before in range(4):
        axioms = {(0, "prefix", before, before): (0, "")}
        axioms |= {(j, "block", a, b): (cost, audit) for j, items in enumerate(blocks) for a, b, cost, audit in items}

        def rules(item: tuple) -> Iterator[Rule]:
            j, kind, a, b = item
            if kind == "prefix" and j < len(blocks):
                yield from (((j + 1, "prefix", before, c), (item, (j, "block", b, c)), (0, "")) for c in range(4))
            elif kind == "block":
                yield (j + 1, "prefix", before, b), ((j, "prefix", before, a), item), (0, "")
        done = lightest(axioms, rules, {(len(blocks), "prefix", before, after) for after in range(4)})
        for after in range(4):
            if (end := (len(blocks), "prefix", before, after)) in done:
                cost, audit = done[end]
                parts, states, state, left = [], [], after, audit
                for j in reversed(range(len(blocks))):
                    a, letters = next((a, w[1]) for a in range(4) if (w := done.get((j, "block", a, state)))
                                      and (p := done.get((j, "prefix", before, a))) and left == p[1] + w[1]
                                      and p[0] + w[0] == done[j + 1, "prefix", before, state][0])
                    parts, states, state, left = [letters, *parts], [a, *states], a, left[:len(left) - len(letters)]
                out.append((before, after, cost, audit, parts, states))
    return out


def edited(rows: Iterable[tuple[str, str]], audit: str, state: int = NOTHING) -> list[str]:
    """``role:text`` of the rows that an audit leaves, inserted ones included."""
    out, rows = [], iter(rows)
    for letter in audit:
        role, text = ("assistant" if state == USER else "user"), ""
        if letter != "I":
            own, text = next(rows)
            if letter == "D":
                continue
            role = own if letter == "K" else role
        out.append(f"{role}:{text}")
        state = NEXT[state, role[:1]]
    return out


def _fault_counts(faults: Sequence[str]) -> list[int]:
    return [sum(f == kind for f in faults) for kind in ("blank", "duplicate", "truncated")]


def _illegal(initials: Sequence[str]) -> int:
    return sum(pair not in NEIGHBOURS for pair in zip(initials, initials[1:]))


_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
           ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.string())]
_COLUMNS = ["key", *[name for name, _ in _RESULT]]


def _per_row(frame: DataFrame, work: Callable[[dict], Iterable[dict]], keep: str, made: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """Rows that ``work`` makes of each row's lists; the column ``keep`` goes along as it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != keep]
            at, out = [], []
            for i, row in enumerate(batch.select(names).to_pylist()):
                for new in work(row):
                    at.append(i)
                    out.append(new)
            columns = [pa.array([r[n] for r in out], t) for n, t in made]
            yield pa.RecordBatch.from_arrays([batch.column(keep).take(pa.array(at, pa.int64())), *columns], [keep, *[n for n, _ in made]])
    return frame.mapInArrow(run, f"{keep} {dict(frame.dtypes)[keep]}, {ddl}")


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of few rows, one group each."""
    def solved(conversation: dict) -> Iterator[dict]:
        seen, initials, faults, lines = set(), [], [], []
        for row in conversation["rows"]:
            line = row["role"], row["text"]
            faults.append("duplicate" if row["fault"] != "blank" and line in seen else row["fault"])
            seen.add(line)
            initials.append(line[0][:1])
            lines.append(line)
        cost, audit = repair_rows(list(zip(initials, faults)))
        turns = {row["turn"] for row in conversation["rows"]} - {None}
        counts = dict(zip(("blank", "duplicate", "truncated"), _fault_counts(faults)))
        yield {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts, "illegal": _illegal(initials),
               "cost": cost, "audit": audit, "repaired": "\n".join(edited(lines, audit))}
    grouped = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "h", "text", "fault"))).alias("rows"))
    return _per_row(grouped, solved, "key", _RESULT, "gaps long, blank long, duplicate long, truncated long, illegal long, "
                    "cost long, audit string, repaired string")


_ITEMS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()),
                             ("parts", pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])))]))
_NODE = [("node", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64()), ("items", _ITEMS)]
_NODE_DDL = ("node long, head string, tail string, illegal long, items array<struct<before:int,after:int,cost:bigint,audit:string,"
             "parts:array<struct<block:bigint,state:int,audit:string>>>>")


def _node_of_block(group: dict) -> Iterator[dict]:
    rows = [(r["initial"], r["fault"]) for r in group["rows"]]
    initials = [i for i, _ in rows]
    yield {"node": group["block"], "head": initials[0], "tail": initials[-1], "illegal": _illegal(initials),
           "items": [{"before": a, "after": b, "cost": cost, "audit": audit, "parts": [{"block": group["block"], "state": a, "audit": audit}]}
                     for a, b, cost, audit in block_items(rows)]}


def _node_of_nodes(group: dict) -> Iterator[dict]:
    nodes = group["nodes"]
    between = sum((a["tail"], b["head"]) not in NEIGHBOURS for a, b in zip(nodes, nodes[1:]))
    items = []
    for before, after, cost, audit, _, states in united([[(i["before"], i["after"], i["cost"], i["audit"]) for i in n["items"]] for n in nodes]):
        ends = [*states[1:], after]
        parts = [p for n, a, b in zip(nodes, states, ends) for i in n["items"] if (i["before"], i["after"]) == (a, b) for p in i["parts"]]
        items.append({"before": before, "after": after, "cost": cost, "audit": audit, "parts": parts})
    yield {"node": group["node"], "head": nodes[0]["head"], "tail": nodes[-1]["tail"],
           "illegal": sum(n["illegal"] for n in nodes) + between, "items": items}


def _long(rows: DataFrame) -> DataFrame:
    """Conversations of any number of rows, none of them ever in one task as a group of rows."""
    single = staged(rows.groupBy("key", "turn", "role", "h", "fault").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")))
    first = single.groupBy("key", "role", "h").agg(F.min(F.struct("turn")).alias("first"))
    later = F.struct("turn") > F.col("first")
    copies = (spread_join(single, first, ["key", "role", "h"], "inner")
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
              .withColumn("fault", F.when((F.col("fault") != "blank") & (later | (F.col("copy") > 1)), "duplicate").otherwise(F.col("fault"))))
    order = ["key", "turn", "role", "h", "copy"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged(copies.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .select("key", "turn", "role", "text", "fault", F.monotonically_increasing_id().alias("place")))
    block = F.shiftright("place", BLOCK.bit_length() - 1)
    slim = (ordered.groupBy("key", block.alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("place", F.substring("role", 1, 1).alias("initial"), "fault"))).alias("rows")))
    nodes, n = staged_counted(_per_row(slim, _node_of_block, "key", _NODE, _NODE_DDL))
    keys = nodes.select("key").distinct().count()
    while n > keys:
        grouped = (nodes.groupBy("key", F.shiftright("node", FAN).alias("up"))
                   .agg(F.sort_array(F.collect_list(F.struct("node", "head", "tail", "illegal", "items"))).alias("nodes"))
                   .withColumnRenamed("up", "node"))
        nodes, n = staged_counted(_per_row(grouped, _node_of_nodes, "key", _NODE, _NODE_DDL))
    goals = F.filter("items", lambda i: (i["before"] == NOTHING) & i["after"].isin(*LEGAL))
    best = F.array_min(F.transform(goals, lambda i: F.struct(i["cost"], i["audit"], i["parts"])))
    solved = nodes.select("key", "illegal", best.alias("best")).select("key", "illegal", "best.cost", "best.audit", "best.parts")
    chosen = solved.select("key", F.inline("parts"))

    texts = (ordered.groupBy("key", block.alias("block"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("rows"))
             .join(chosen, ["key", "block"]))

    def lines_of(group: dict) -> Iterator[dict]:
        lines = edited([(r["role"], r["text"]) for r in group["rows"]], group["audit"], group["state"])
        if lines:
            yield {"block": group["block"], "lines": "\n".join(lines)}
    lines = _per_row(texts, lines_of, "key", [("block", pa.int64()), ("lines", pa.string())], "block long, lines string")
    repaired = lines.groupBy("key").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("block", "lines"))), lambda x: x["lines"]), "\n").alias("repaired"))
    kinds = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    counts = ordered.groupBy("key").agg(gaps, *kinds)
    return (counts.join(solved.drop("parts"), "key").join(repaired, "key", "left")
            .withColumn("repaired", F.coalesce("repaired", F.lit(""))).select(*_COLUMNS))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: gaps, faults, cost and audit of the lightest repair, and the repaired rows.

    Rows are taken by turn (NULL first), equal turns by role and hash of the text. The first fault of a row
    counts: blank (nothing but white space), duplicate (role and text seen before), truncated (not ended by . ! or ?).
    ``repaired`` holds ``role:text`` lines. NULL roles and texts are one space, which no repair keeps as
    they are; NULL conversations are one conversation; rows that repeat are duplicates; other columns are ignored; an
    empty table gives none. Very long texts are only compared and copied.
    """
    blank = F.lit(" ")
    text, role = F.coalesce(column(turns, text_col), blank), F.coalesce(column(turns, role_col), blank)
    rows = turns.select(F.struct(column(turns, conv_col).alias("conv")).alias("key"), column(turns, turn_col).cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("h"))
    end = F.substring(F.rtrim("text", F.lit(SPACE_CHARS)), -1, 1)
    rows = rows.withColumn("fault", F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated").otherwise(""))
    heavy = heavy_keys(rows, ["key"], BLOCK)
    if heavy is None:
        done = _whole(rows)
    else:
        marked = rows.join(F.broadcast(heavy.select("key", F.lit(True).alias("long"))), "key", "left")
        done = (_whole(marked.filter(F.col("long").isNull()).drop("long"))
                .unionByName(_long(marked.filter("long").drop("long"))))
    return done.select(F.col("key.conv").alias("conv"), *_COLUMNS[1:])
