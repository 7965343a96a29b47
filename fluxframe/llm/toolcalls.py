"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

link() takes calls (call_id, name, arguments: JSON text, after: the call whose result this one needs, or null) and results
(call_id, content). Calls and results are hash-joined by call_id. A call's level is its number of predecessors by `after`;
any order by level is topological. Levels come from pointer doubling: in each round a call's pointer jumps to the pointer
of the call it points to, so a chain of n calls takes log2(n) rounds. Arguments are parsed into variants, checked against
the schema of their tool, and written with sorted keys and no white space.

Everything is DataFrame functions. Joins are by unique ids after a pre-aggregation, so no conversation is gathered in a task.

Defined results: of calls (or results) with one id the least by content counts, and n_calls and n_results say how many
there were; a call without result has status "open", a result without call "orphan"; calls in a cycle of `after`, or behind
one, have level null and the error "cycle"; an `after` that names no call has the error "unknown after"; arguments that are
null or no JSON object have the error "not an object"; rows without call_id are kept alone with status "unnamed".
Contents of any length are kept whole; empty tables give no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxframe.llm.tables import at, drop, keep, spread_join, table

#: tool -> argument -> (types as schema_of_variant names them, required, least length of a string)
Schemas = dict[str, dict[str, tuple[tuple[str, ...], bool, int]]]

CHAT: Schemas = {
    "answer": {"prompt": (("STRING",), True, 1), "turn": (("BIGINT",), True, 0)},
    "instruct": {"prompt": (("STRING",), True, 1), "turn": (("BIGINT",), True, 0)},
}


def levels(calls: DataFrame) -> DataFrame:
    """call_id, level (null in or behind a cycle) and known (is there a call of this `after`; null for an `after` of null) of
    calls (call_id unique, after). Calls that many others come after are dealt over tasks; calls after none join nothing."""
    spark = calls.sparkSession
    ids = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("is"))
    behind = spread_join(calls.select("call_id", "after").filter(F.col("after").isNotNull()), ids, ["after"], ["call_id"], "left")
    behind = behind.select("call_id", F.when(F.col("is"), F.col("after")).alias("jump"), F.when(F.col("is"), 1).otherwise(0).cast("long").alias("level"), F.coalesce("is", F.lit(False)).alias("known"))
    start = behind.union(calls.filter(F.col("after").isNull()).select("call_id", F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(None).cast("boolean")))
    path = keep(start, "call-levels")
    now = at(spark, path, start)
    open_, total = now.agg(F.count("jump"), F.count("*")).first()
    for _ in range(total.bit_length() + 1):
        if not open_:
            break
        to = now.select(F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("level").alias("more"))
        step = spread_join(now.filter(F.col("jump").isNotNull()), to, ["jump"], ["call_id"], "left")
        step = step.select("call_id", F.col("next").alias("jump"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"), "known")
        new = keep(step.union(now.filter(F.col("jump").isNull())), "call-levels")
        drop(spark, path)
        path, now = new, at(spark, new, start)
        open_ = now.agg(F.count("jump")).first()[0]
    return now.select("call_id", F.when(F.col("jump").isNull(), F.col("level")).cast("int").alias("level"), "known")


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a variant of arguments, as sorted texts."""
    out = F.array(F.lit("unknown tool"))
    keys = F.json_object_keys(F.to_json(arguments))
    for tool, schema in schemas.items():
        said: list[Column] = []
        for key, (types, required, least) in sorted(schema.items()):
            value = F.variant_get(arguments, f"$['{key}']", "variant")
            given = value.isNotNull()
            typed = F.schema_of_variant(value).isin(*types)
            if required:
                said.append(F.when(~given, f"missing {key}"))
            said.append(F.when(given & ~typed, f"type of {key}"))
            if least:
                said.append(F.when(given & typed & (F.length(F.try_variant_get(arguments, f"$['{key}']", "string")) < least), f"length of {key}"))
        extra = F.when(F.exists(keys, lambda k: ~k.isin(*schema)), "unknown argument")
        out = F.when(name == tool, F.array(*said, extra)).otherwise(out)
    out = F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(out)
    return F.array_sort(F.array_compact(out))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """call_id, status, level, errors, n_calls, n_results and record (canonical JSON) of all calls and results."""
    named = calls.filter(F.col("call_id").isNotNull())
    one = named.groupBy("call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls")
    one = at(calls.sparkSession, keep(one, "calls"), one)
    got = results.filter(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    joined = one.join(levels(one), "call_id").join(got.hint("shuffle_hash"), "call_id", "full_outer")
    joined = joined.withColumn("status", F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "open").otherwise("linked"))
    alone = named.sparkSession.createDataFrame([], joined.schema)
    alone = alone.unionByName(calls.filter(F.col("call_id").isNull()).select("name", "arguments", "after", F.lit(1).cast("long").alias("n_calls"), F.lit("unnamed").alias("status")), allowMissingColumns=True)
    alone = alone.unionByName(results.filter(F.col("call_id").isNull()).select("content", F.lit(1).cast("long").alias("n_results"), F.lit("unnamed").alias("status")), allowMissingColumns=True)
    every = joined.unionByName(alone, allowMissingColumns=True)

    parsed = F.try_parse_json("arguments")
    is_call = F.col("n_calls").isNotNull()
    more = F.array_compact(F.array(F.when(is_call & F.col("after").isNotNull() & ~F.coalesce("known", F.lit(False)), "unknown after"), F.when(is_call & F.col("level").isNull() & (F.col("status") != "unnamed"), "cycle")))
    errors = F.when(is_call, F.concat(argument_errors(F.col("name"), parsed, schemas), more)).otherwise(F.array().cast("array<string>"))
    record = F.to_json(F.struct("after", parsed.alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"), "status"))
    return every.select("call_id", "status", "level", errors.alias("errors"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), record.alias("record"))


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations (conv_id, turn, role, text): a user's turn calls `answer`, any other role's but
    the assistant's `instruct`; the assistant's turn is the result of the call in the turn before. A call comes after the
    call of the turn before or, if that turn is a result, the call that it answers."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    spoken = F.coalesce(F.col("role") == "assistant", F.lit(False))
    before = turns.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min(spoken).alias("answered"))
    calls = turns.filter(~spoken).join(before, ["conv_id", "turn"], "left")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = calls.select(name(0).alias("call_id"), F.when(F.col("role") == "user", "answer").otherwise("instruct").alias("name"), arguments.alias("arguments"), F.when(F.col("answered"), name(2)).when(~F.col("answered"), name(1)).alias("after"))
    return calls, turns.filter(spoken).select(name(1).alias("call_id"), F.col("text").alias("content"))


def op5_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(*chat_calls(table(spark, sf_dir, "conversations")), CHAT)
    return out.withColumn("errors", F.array_join("errors", ","))


SQL = """
WITH RECURSIVE t AS (SELECT *, coalesce(role = 'assistant', false) AS said, conv_id::VARCHAR || ':' || turn::VARCHAR AS id FROM conversations),
b AS (SELECT conv_id, turn + 1 AS turn, min(said) AS answered FROM t GROUP BY ALL),
call AS (
    SELECT id, CASE WHEN role = 'user' THEN 'answer' ELSE 'instruct' END AS name, text, turn,
           CASE WHEN answered THEN conv_id::VARCHAR || ':' || (turn - 2)::VARCHAR WHEN NOT answered THEN conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR END AS after
    FROM t LEFT JOIN b USING (conv_id, turn) WHERE NOT said
),
c AS (SELECT id, min(struct_pack(name, text, turn, after)) AS c, count(*) AS n_calls FROM call GROUP BY id),
r AS (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS id, min(text) AS content, count(*) AS n_results FROM t WHERE said GROUP BY 1),
l AS (
    SELECT id, 0 AS level FROM c WHERE c.c.after IS NULL OR c.c.after NOT IN (SELECT id FROM c)
    UNION ALL SELECT c.id, l.level + 1 FROM l JOIN c ON c.c.after = l.id
),
j AS (
    SELECT coalesce(c.id, r.id) AS call_id, c.c, n_calls, n_results, content, level,
           CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'open' ELSE 'linked' END AS status
    FROM c FULL JOIN r ON c.id = r.id LEFT JOIN l ON l.id = c.id
)
SELECT call_id, status, level::INTEGER AS level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       concat_ws(',', CASE WHEN n_calls IS NOT NULL AND c.text IS NOT NULL AND c.text = '' THEN 'length of prompt' END,
                 CASE WHEN n_calls IS NOT NULL AND c.text IS NULL THEN 'missing prompt' END,
                 CASE WHEN c.after IS NOT NULL AND c.after NOT IN (SELECT id FROM c) THEN 'unknown after' END) AS errors,
       '{' || concat_ws(',', '"after":' || to_json(c.after)::VARCHAR,
                        CASE WHEN n_calls IS NOT NULL THEN '"arguments":{' || concat_ws(',', '"prompt":' || to_json(c.text)::VARCHAR, '"turn":' || c.turn) || '}' END,
                        '"id":' || to_json(call_id)::VARCHAR, '"level":' || level, '"name":' || to_json(c.name)::VARCHAR,
                        '"result":' || to_json(content)::VARCHAR, '"status":' || to_json(status)::VARCHAR) || '}' AS record
FROM j
"""
