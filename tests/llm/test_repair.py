"""Conversation repair against a plain search over edits."""

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from fluxframe.llm import repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def cheapest(rows):
    """Best-first search over (cost, audit); a state is the turns read and the roles so far, as far as they matter."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        able = lambda r: r == "s" and not state or r == "u" and state in ("", "s", "a") or r == "a" and state == "u"
        for r, name in (("u", "user"), ("a", "assistant")):
            if able(r):
                heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*out, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                if able(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if able(r) and r != role[:1]:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, r, (*out, f"{name}:{text}")))


def brute(turns):
    out = []
    for conv in {c for c, *_ in turns}:
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, rows = set(), []
        for _, role, text in own:
            ink = text.strip(SPACE)
            rows.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else None if ink[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        known = [t for t, _, _ in own if t is not None]
        cost, audit, said = cheapest(rows)
        count = lambda what: sum(f == what for _, _, f in rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((str(conv), gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(5)).withColumn("fault", F.lit("own"))


def noise(seed, convs=25, longest=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    texts = ["Yes.", "No!", "why?", "cut", "", " \x0b\n", "Ünd. ", "Yes.", "one. two", None]
    turns = []
    for c in [*range(convs), None]:
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t, None, rng.randint(0, 5)])
            turns += [(c, turn, rng.choice(roles), rng.choice([*texts, f"own {rng.random()}.", f"own {rng.random()}"]))] if rng.random() < 0.9 else [(c, turn, "user", "same.")] * 3
    return turns


def test_chart():
    rng = random.Random(5)
    for _ in range(300):
        keys = [(rng.choice("suax"), rng.randrange(4), 1) for _ in range(rng.randint(0, 9))]
        names = {"s": "system", "u": "user", "a": "assistant", "x": "x"}
        chart, cost, backs = repair.parsed(keys, (("open", 0),))
        more, head, after = repair.closed(chart)
        rows = [(names[r], "t", [None, "truncated", "blank", "duplicate"][f]) for r, f, _ in keys]
        letters = repair.traced(backs, head)
        turns = repair.edited(letters, [{"role": r, "text": t} for r, t, _ in rows], "open", after)
        assert (cost + more, repair.spelled(letters, keys, after), tuple(f"{t['role']}:{t['text']}" for t in turns)) == cheapest(rows)


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 1), (3, 3)])
def test_brute_force(spark, monkeypatch, seed, block):
    """Conversations whole in a partition, and ones in pieces of a few turns."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(seed)
    turns = noise(seed)
    turns += [(99, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"own {t}."])) for t in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(block > 3).lower())
    try:
        pieces, summary = (df.collect() for df in repair.repair(table(spark, turns).repartition(3)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((str(r.conv_id), *r[1:]) for r in summary) == brute(turns)
    said = {}
    for p in sorted(pieces, key=lambda p: (p.part, p.seq)):
        said.setdefault(str(p.conv_id), []).extend(f"{t.role}:{t.text}" for t in p.turns)
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in said.items()} == {x[0]: x[-1] for x in brute(turns)}
    assert len({p.part for p in pieces}) > 1 or block > 3


def test_hot_row_and_empty(spark):
    turns = [(1, 0, "user", "Hi.")] * 5000 + [(1, 1, "assistant", "Yes.")]
    (row,) = repair.repair(table(spark, turns))[1].collect()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (4999, 4999, 9998, "K" + "D" * 4999 + "K")
    assert repair.repair(table(spark, turns).filter("false"))[1].collect() == []


def test_damage_leaves_every_conversation(spark, sf, same_as_sql):
    same_as_sql(repair.op11_repair(spark, sf), repair.SQL)


def test_first_turns_join_by_all_keys(spark):
    """A text said in every turn of a hot conversation is no hot key: the join also goes by the turn."""
    turns = spark.range(4000).selectExpr("1 AS conv_id", "id AS turn", "'user' AS role", "'Same.' AS text")
    rows = repair.marked(turns)
    assert rows.groupBy("fault").count().orderBy("fault").collect() == [(repair.FINE, 1), (repair.DUPLICATE, 3999)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
