"""Lightest repairs against the enumeration of all edits, and long conversations against short ones."""

import itertools
import random
import re

import pytest

from clientele.llm import queries, repair

LEGAL = re.compile(r"(s?(ua)+)?")
ROLES = ("system", "user", "assistant", " ", "tool", "")


def every_repair(rows):
    """(cost, audit, roles) of all edits of rows (initial, fault) with up to two inserted rows at a place."""
    def grow(i):
        insert = [(5 * n, "I" * n, kinds) for n in range(3) for kinds in itertools.product("ua", repeat=n)]
        if i == len(rows):
            yield from insert
            return
        initial, fault = rows[i]
        own = [(2, "D", ())]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            own += [(more, "K", (initial,)), (1 + more, "R", ("u",)), (1 + more, "R", ("a",))]
        rest = list(grow(i + 1))
        for (a, b, c), (d, e, f), (g, h, k) in itertools.product(insert, own, rest):
            yield a + d + g, b + e + h, c + f + k
    return ((cost, audit) for cost, audit, roles in grow(0) if LEGAL.fullmatch("".join(r or "?" for r in roles)))


def test_repairs_equal_the_enumeration_of_all_edits():
    rng = random.Random(7)
    for _ in range(60):
        rows = [(rng.choice("suaaut "), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(4))]
        assert repair.repair_rows(rows) == min(every_repair(rows)), rows


def test_blocks_united_equal_the_whole():
    rng = random.Random(8)
    for _ in range(40):
        rows = [(rng.choice("suauat"), rng.choice(["", "", "", "duplicate", "truncated"])) for _ in range(rng.randrange(1, 40))]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(4))})
        blocks = [rows[a:b] for a, b in itertools.pairwise(cuts)]
        items = repair.united([repair.block_items(b) for b in blocks])
        cost, audit, parts, states = min(x[2:] for x in items if x[0] == 0 and x[1] in repair.LEGAL)
        assert (cost, audit) == repair.repair_rows(rows) and "".join(parts) == audit and states[0] == 0


def conversations(spark, seed=5, n=40, longest=30):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(longest)):
            text = rng.choice(["", " \n", "yes.", "no", f"text {rng.randrange(9)}.", "why? \t", None, "a" * 5000 + "."])
            rows += [(conv, rng.choice([turn, turn, turn, None]), rng.choice([*ROLES, "user", "assistant", None]), text, 1)] * rng.choice([1, 1, 1, 2])
    rows += [(None, 1, "user", "hm.", 1), (None, 2, "assistant", "ok.", 1), (77, 1, "user", "one", 1)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit int")


def test_long_conversations_are_repaired_as_short_ones(spark, monkeypatch):
    turns = conversations(spark)
    whole = {r.conv: r for r in repair.repair_conversations(turns).collect()}
    assert len(whole) == turns.select("conv_id").distinct().count() and whole[None].cost == 0 and whole[None].audit == "KK"
    assert whole[77].audit == "D" and whole[77].repaired == "" and whole[77].truncated == 1
    for block in (1, 2, 8):
        monkeypatch.setattr(repair, "BLOCK", block)
        assert {r.conv: r for r in repair.repair_conversations(turns).collect()} == whole


def test_repaired_rows_are_legal_and_empty_tables_give_none(spark):
    turns = conversations(spark, seed=6)
    for row in repair.repair_conversations(turns).collect():
        roles = "".join(line[0] for line in re.findall(r"(?:^|\n)(system:|user:|assistant:)", row.repaired))
        assert LEGAL.fullmatch(roles) and len(roles) == len(row.audit.replace("D", ""))
        assert row.cost >= 2 * row.audit.count("D") + row.audit.count("R") + 5 * row.audit.count("I")
    assert repair.repair_conversations(turns.limit(0)).count() == 0


def test_a_heavy_agenda_stops_at_its_goal():
    popped = []

    def rules(item):
        popped.append(item)
        yield (item[0] + 1,), (item,), (1, "x")
    assert repair.lightest({(0,): (0, "")}, rules, {(3,)})[(3,)] == (3, "xxx") and popped == [(0,), (1,), (2,), (3,)]


@pytest.mark.parametrize("n", [0, 3000])
def test_a_long_row_of_faults_is_one_agenda(n):
    assert repair.repair_rows([("u", "duplicate")] * n) == (2 * n, "D" * n)


def test_the_query_lists_conversations_that_lost_all_rows(spark, tmp_path):
    rows = [(c, 0, "user", "Hello.") for c in range(60)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    done = {r.conv_id: r for r in queries.conversation_repair(spark, str(tmp_path)).collect()}
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert set(done) == {*range(60), None}
    lost = [r for r in done.values() if r.audit == ""]
    assert lost and all(r.repaired_sha256 == empty and r.cost == 0 for r in lost)
