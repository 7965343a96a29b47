"""Conversation structure repair: error-correcting Earley parsing of roles with a weighted grammar.

A repaired conversation's roles are s?(ua)+ or nothing, by initials: s is the system, u the user, a the assistant. RULES are
that grammar, left-linear, so that every item starts where the conversation does. Error productions are laid over it: a turn
can be deleted, a turn can be taken for a user's or an assistant's, and an empty turn of either can be inserted anywhere. A
chart set has, for each head, the least (cost, audit) with which the turns so far make it; the audit is the edits' initials
(Keep, Rerole, Delete, Insert), ties ASCII-least. Insertions count to the turn that follows, so that the audits of a chart all
end with a turn's edit, and none is the beginning of another of the same cost: audits are compared by their order in the chart
before and the letters added since. So sets are small and few, and each step is looked up once it has been taken.

Faults: a turn is blank (no ink), or else a duplicate (role and text said earlier), or else cut (its last ink is not . ! or ?).
Blank turns and duplicates must go.

Turns are sorted by conversation and turn over range partitions, so that a conversation of any length lies in many. One wholly
inside a partition is parsed there. Of one cut by a border or longer than a block, each piece is parsed from every head at
once; the pieces' small tables of heads and costs are chained in order, and each piece is read back between its ends. Only the
digest and the audit, a row by contract, pass over a conversation's pieces in order, a batch in memory.

Defined results: null roles and texts are one space; a null conv_id is a conversation as any; turns of null come first, turns of
one number are in order of role and text; equal rows count as so many, all but one duplicates; other roles go by their initial,
and an empty role has none that the grammar takes; very long texts and conversations are taken whole; an empty table gives no
rows, a conversation without turns zeros and an empty audit; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from fluxframe.llm.tables import at, drop, keep, table
from fluxframe.plans.views import CRC_TABLE, crc_sql

#: head, the head before, and the initial that leads from one to the other.
RULES = (("system", "open", "s"), ("asked", "open", "u"), ("asked", "system", "u"), ("asked", "answered", "u"), ("answered", "asked", "a"))
START, GOALS, HEADS = "open", ("open", "answered"), ("open", "system", "asked", "answered")
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
FINE, IS_CUT, BLANK, DUPLICATE = range(4)
#: The most turns of a piece, and the bytes after which one ends.
BLOCK, BYTES = 4096, 1 << 20

Chart = tuple[tuple[str, int], ...]  # head and cost above the least, in order of audits
Back = dict[str, tuple[str, str]]  # for each head: the head in the chart before, and the letters since


def completed(chart: Chart) -> list[tuple[int, int, str, str]]:
    """Cost, place of the item it comes from, letters and head of all that insertions make of a chart's items."""
    out = []
    for place, (head, cost) in enumerate(chart):
        agenda, seen = [(cost, "", head)], set()
        for cost, letters, head in agenda:  # it grows; each further insertion costs the same, so the first is the cheapest
            if head not in seen:
                seen.add(head)
                out.append((cost, place, letters, head))
                agenda += [(cost + INSERT, letters + "I", to) for to, left, role in RULES if left == head and role in NAMES]
    return out


@functools.cache
def scanned(chart: Chart, role: str, fault: int) -> tuple[Chart, int, Back]:
    """The chart after one more turn, what all its costs have risen by, and where its items come from."""
    items: dict[str, tuple[int, int, str]] = {}
    for cost, place, letters, head in completed(chart):
        moves = [(DELETE, "D", head)]
        if fault < BLANK:
            extra = CUT if fault == IS_CUT else 0
            moves += [(extra + (r != role) * REROLE, "K" if r == role else "R", to) for to, left, r in RULES if left == head and (r == role or r in NAMES)]
        for more, letter, to in moves:
            new = cost + more, place, letters + letter
            items[to] = min(items.get(to, new), new)
    least = min(cost for cost, _, _ in items.values())
    order = sorted(items, key=lambda h: items[h][1:])
    return tuple((h, items[h][0] - least) for h in order), least, {h: (chart[items[h][1]][0], items[h][2]) for h in order}


def closed(chart: Chart) -> tuple[int, str, str]:
    """Cost, head in the chart and letters after the last turn of the cheapest end."""
    cost, place, letters, _ = min(x for x in completed(chart) if x[3] in GOALS)
    return cost, chart[place][0], letters


def parsed(turns: list[tuple[str, int, int]], chart: Chart) -> tuple[Chart, int, list[Back]]:
    """turns: initial, fault, and how often the turn comes; all but the first of these are duplicates."""
    cost, backs = 0, []
    for role, fault, n in turns:
        chart, more, back = scanned(chart, role, fault)
        cost += more + DELETE * (n - 1)
        backs.append(back)
    return chart, cost, backs


def traced(backs: list[Back], head: str) -> list[str]:
    """The letters of each turn on the way to head."""
    out = []
    for back in reversed(backs):
        head, letters = back[head]
        out.append(letters)
    return out[::-1]


def edited(letters: list[str], rows: list[dict], head: str, after: str) -> list[dict]:
    """The repaired turns: role and text."""
    out = []
    for edits, row in zip([*letters, after], [*rows, None], strict=True):
        for x in edits:
            if x == "D":
                continue
            role = row["role"][:1] if x == "K" else next(r for _, left, r in RULES if left == head and r in NAMES)
            head = next(to for to, left, r in RULES if left == head and r == role)
            out.append(row if x == "K" else {"role": NAMES[role], "text": "" if x == "I" else row["text"]})
    return out


def lines_of(turns: list[dict]) -> str:
    return "\n".join(f"{t['role']}:{t['text']}" for t in turns)


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows) and fault of turns (conv_id, turn, role, text)."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), said("role"), said("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    # A row of several equal ones is unique by now, so the join has no hot key: it goes by the first turn as well.
    first = rows.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).turn.alias("t")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "t", F.lit(True).alias("first"))
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")) & F.col("turn").eqNullSafe(F.col("t"))
    ink = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(~ink, BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), IS_CUT).otherwise(FINE)
    return rows.join(first, on, "left").select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


class Piece:
    """Turns of one conversation that follow each other in a partition."""

    def __init__(self, conv_id: int | None, seq: int, fresh: bool) -> None:
        self.conv_id, self.seq, self.whole = conv_id, seq, fresh
        self.rows, self.keys, self.bytes, self.turns = [], [], 0, []

    def add(self, turn: int | None, role: str, text: str, n: int, fault: int) -> None:
        self.rows.append({"role": role, "text": text})
        self.keys.append((role[:1], fault, n))
        self.bytes += len(text)
        if turn is not None and self.turns[-1:] != [turn]:
            self.turns.append(turn)

    def record(self, part: int) -> dict:
        seen = lambda fault: sum(n for _, f, n in self.keys if f == fault)
        copies = sum(n - 1 for _, f, n in self.keys if f != BLANK)
        first_duplicates = sum(f == DUPLICATE for _, f, _ in self.keys)
        pairs = sum(a + b not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(self.keys, self.keys[1:], strict=False))
        out = {
            "conv_id": self.conv_id, "part": part, "seq": self.seq, "whole": self.whole, "lo": min(self.turns, default=None), "hi": max(self.turns, default=None), "n_turns": len(self.turns), "blank": seen(BLANK), "duplicate": first_duplicates + copies,
            "truncated": sum(f == IS_CUT for _, f, _ in self.keys), "illegal": pairs + sum(n - 1 for _, _, n in self.keys), "left": self.keys[0][0], "right": self.keys[-1][0], "cost": None, "audit": None, "turns": self.rows, "faults": None, "counts": None, "moves": None,
        }
        if self.whole:
            chart, cost, backs = parsed(self.keys, ((START, 0),))
            more, head, after = closed(chart)
            letters = traced(backs, head)
            return out | {"cost": cost + more, "audit": spelled(letters, self.keys, after), "turns": edited(letters, self.rows, START, after)}
        moves = []
        for start in HEADS:
            chart, cost, _ = parsed(self.keys, ((start, 0),))
            moves += [{"start": start, "head": head, "cost": cost + more} for head, more in chart]
        return out | {"faults": [f for _, f, _ in self.keys], "counts": [n for _, _, n in self.keys], "moves": moves}


def spelled(letters: list[str], keys: list[tuple[str, int, int]], after: str) -> str:
    return "".join(x + "D" * (n - 1) for x, (_, _, n) in zip(letters, keys, strict=True)) + after


_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *((c, pa.int64()) for c in ("lo", "hi", "n_turns", "blank", "duplicate", "truncated", "illegal")), ("left", pa.string()), ("right", pa.string()), ("cost", pa.int64()), ("audit", pa.string()),
    ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("faults", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("moves", pa.list_(pa.struct([("start", pa.string()), ("head", pa.string()), ("cost", pa.int64())]))),
])


def pieces(rows: DataFrame) -> DataFrame:
    """The pieces of sorted rows (conv_id, turn, role, text, n, fault), those of conversations that lie whole in one parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, held, size, seq = TaskContext.get().partitionId(), None, [], 0, 0

        def packed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([p.record(part) for p in held], _ARROW)
            held.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv = row[0]
                full = now is not None and (len(now.rows) >= BLOCK or now.bytes >= BYTES)
                if now is None or conv != now.conv_id or full:
                    if now is not None:
                        now.whole &= conv != now.conv_id
                        held.append(now)
                        size += now.bytes
                    if size >= BYTES or len(held) >= 256:
                        yield packed()
                        size = 0
                    now, seq = Piece(conv, seq, now is not None and conv != now.conv_id), seq + 1
                now.add(*row[1:])
        if now is not None:
            now.whole = False  # the next partition may go on with it
            held.append(now)
            yield packed()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 256)).sortWithinPartitions(*order, "text")
    return dealt.select("conv_id", "turn", "role", "text", "n", "fault").mapInArrow(run, from_arrow_schema(_ARROW))


def by_conversation(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def chained(moves: DataFrame) -> DataFrame:
    """part, seq, start, head, after and cost of each open piece (conv_id, part, seq, moves): where its parse begins and ends,
    the letters after a conversation's last piece, and there its cost."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.string()), ("head", pa.string()), ("after", pa.string()), ("total", pa.int64())])

    def ways(found: list[tuple[int, int, list[dict]]]) -> list[dict]:
        chart, total, backs = ((START, 0),), 0, []
        for _, _, moves in found:
            items: dict[str, tuple[int, int, int]] = {}
            for place, (start, cost) in enumerate(chart):
                for k, m in enumerate(m for m in moves if m["start"] == start):
                    new = cost + m["cost"], place, k
                    items[m["head"]] = min(items.get(m["head"], new), new)
            least = min(cost for cost, _, _ in items.values())
            order = sorted(items, key=lambda h: items[h][1:])
            backs.append({h: chart[items[h][1]][0] for h in order})
            chart, total = tuple((h, items[h][0] - least) for h in order), total + least
        more, head, after = closed(chart)
        out, total = [], total + more
        for (part, seq, _), back in zip(reversed(found), reversed(backs), strict=True):
            out.append({"part": part, "seq": seq, "start": back[head], "head": head, "after": after, "total": total})
            head, after, total = back[head], "", 0
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, found = None, []
        for batch in batches:
            for c, *piece in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if found and c != conv:
                    yield pa.RecordBatch.from_pylist(ways(found), schema)
                    found = []
                conv = c
                found.append(piece)
        if found:
            yield pa.RecordBatch.from_pylist(ways(found), schema)

    return by_conversation(moves).mapInArrow(run, from_arrow_schema(schema))


def read_back(open_: DataFrame) -> DataFrame:
    """Open pieces with their start, head, after and total: their cost, audit and repaired turns."""
    names = [f.name for f in _ARROW if f.name not in ("whole", "faults", "counts", "moves")]
    schema = pa.schema([_ARROW.field(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                keys = [(t["role"][:1], f, n) for t, f, n in zip(row["turns"], row["faults"], row["counts"], strict=True)]
                letters = traced(parsed(keys, ((row["start"], 0),))[2], row["head"])
                row |= {"cost": row["total"], "audit": spelled(letters, keys, row["after"]), "turns": edited(letters, row["turns"], row["start"], row["after"])}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in names}], schema)

    return open_.mapInArrow(run, from_arrow_schema(schema))


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def summed(parts: DataFrame) -> DataFrame:
    """A row for each conversation of its pieces."""
    schema = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in SUMS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audits = None, hashlib.sha256(), []

        def done() -> dict:
            gaps = 0 if now["lo"] is None else min(now["hi"] - now["lo"] + 1 - now["n_turns"], (1 << 63) - 1)
            return {"conv_id": now["conv_id"], "gaps": gaps, **{c: now[c] for c in SUMS}, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                if now is not None and row["conv_id"] == now["conv_id"]:
                    now |= {c: now[c] + row[c] for c in SUMS}
                    now["illegal"] += now["right"] + row["left"] not in ("su", "ua", "au")
                    now["n_turns"] += row["n_turns"] - (row["lo"] is not None and row["lo"] == now["hi"])
                    now |= {"right": row["right"], "lo": row["lo"] if now["lo"] is None else now["lo"], "hi": now["hi"] if row["hi"] is None else row["hi"]}
                else:
                    if now is not None:
                        out.append(done())
                    now, digest, audits, empty = row, hashlib.sha256(), [], True
                audits.append(row["audit"])
                if row["turns"]:
                    digest.update(("" if empty else "\n").encode() + lines_of(row["turns"]).encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    return by_conversation(parts).mapInArrow(run, from_arrow_schema(schema))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text): the repaired conversations, as pieces in order of part and seq (conv_id, part, seq,
    audit, turns), and a summary of each (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    spark = turns.sparkSession
    rows = marked(turns)
    rows = at(spark, rows_path := keep(rows, "marked-turns"), rows)
    found = pieces(rows)
    found = at(spark, keep(found, "conversation-pieces"), found)
    drop(spark, rows_path)
    open_ = found.filter("not whole")
    ends = chained(open_.select("conv_id", "part", "seq", "moves"))
    more = read_back(open_.drop("whole", "cost", "audit", "moves").join(ends, ["part", "seq"]))
    parts = found.filter("whole").select(*more.columns).union(more)
    parts = at(spark, keep(parts, "repaired-pieces"), parts)
    return parts.select("conv_id", "part", "seq", "audit", "turns"), summed(parts)


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage, by a checksum of conversation and turn: of 20 residues 0 drops a row, 1 empties its text, 2 removes
    its ends of sentences, 3 repeats it, 4 makes it the user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw: Column = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(draw == 3, 2).otherwise(1)))
    return conversations.filter(draw != 0).select("conv_id", "turn", F.when(draw == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = every.join(repair(damaged(conversations))[1], F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", *SUMS)]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_plus = lambda x, cost, letter: f"(lpad((substr({x}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({x}, 13) || '{letter}')"
_other = lambda x, extra, role: f"CASE WHEN i = '{role}' THEN {_plus(x, extra, 'K')} ELSE {_plus(x, f'{extra} + 1', 'R')} END"
_extra = "(CASE WHEN cut THEN 5 ELSE 0 END)"

#: Each state's cheapest (cost in 12 digits, audit) as one string, a row at a time.
SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (SELECT conv_id, turn, role, text, {crc_sql("list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)")} % 20 AS draw FROM keyed, crc_table),
hurt AS (
    SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM drawn, (SELECT unnest([1, 2]) AS copy) WHERE draw <> 0 AND (copy = 1 OR draw = 3)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, substr(role, 1, 1) AS i FROM placed),
turns AS (
    SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[^\x20\x09-\x0D]') AND again AS duplicate,
           regexp_matches(text, '[^\x20\x09-\x0D]') AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
           coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au'), false) AS bad
    FROM seen
),
chart AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000000000' AS o, NULL::VARCHAR AS s, NULL::VARCHAR AS q, NULL::VARCHAR AS a FROM turns
    UNION ALL
    SELECT conv_id, n, {_plus("o", 2, "D")},
           least({_plus("s", 2, "D")}, CASE WHEN NOT gone AND i = 's' THEN {_plus("o", _extra, "K")} END),
           least({_plus("q2", 2, "D")}, CASE WHEN NOT gone THEN least({", ".join(_other(x, _extra, "u") for x in ("o", "s", "a2"))}) END),
           least({_plus("a2", 2, "D")}, CASE WHEN NOT gone THEN {_other("q2", _extra, "a")} END)
    FROM (
        SELECT *, least(a, {_plus("q2", 5, "I")}) AS a2 FROM (
            SELECT c.conv_id, t.n, c.o, c.s, c.a, least(c.q, {_plus("c.o", 5, "I")}, {_plus("c.s", 5, "I")}, {_plus("c.a", 5, "I")}) AS q2, t.i, t.cut, t.blank OR t.duplicate AS gone
            FROM chart c JOIN turns t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.n = c.n + 1
        )
    )
),
ended AS (
    SELECT conv_id, least(o, a, {_plus("q", 5, "I")}, {_plus(_plus("s", 5, "I"), 5, "I")}, {_plus(_plus("o", 5, "I"), 5, "I")}) AS best
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS back FROM chart) WHERE back = 1
),
letters AS (SELECT conv_id, substr(best, 13) AS audit, unnest(range(len(best) - 12)) + 1 AS j FROM ended),
told AS (
    SELECT conv_id, j, substr(audit, j, 1) AS x, len(regexp_replace(substr(audit, 1, j), 'I', '', 'g')) AS n, len(regexp_replace(substr(audit, 1, j), 'D', '', 'g')) AS m FROM letters
),
led AS (SELECT o.conv_id, bool_or(t.i = 's' AND o.m = 1 AND o.x = 'K') AS system FROM told o JOIN turns t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.n = o.n WHERE o.x <> 'D' GROUP BY o.conv_id),
said AS (
    SELECT o.conv_id, string_agg((CASE WHEN x = 'K' THEN t.role WHEN (o.m + (CASE WHEN l.system THEN 1 ELSE 0 END)) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN x = 'I' THEN '' ELSE t.text END), chr(10) ORDER BY j) AS whole
    FROM told o LEFT JOIN led l ON l.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM o.conv_id AND t.n = o.n WHERE x <> 'D' GROUP BY o.conv_id
),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(cut) AS truncated, count_if(bad) AS illegal FROM turns GROUP BY conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(substr(d.best, 1, 12)::BIGINT, 0) AS cost, coalesce(substr(d.best, 13), '') AS audit, sha256(coalesce(s.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""
