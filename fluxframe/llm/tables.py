"""Reading tables, names that no table has, joins with frequent keys, and cutting lineage by tables written to the cluster's
shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that more than one row in HEAVY has is frequent; there are fewer than HEAVY of them in any table.
HEAVY = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary folder, as its one
    machine shares it with itself; on a cluster there is none that all executors are known to reach, so this raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='fluxframe-')}")
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read again: later stages restart from there when an executor is lost."""
    return at(df.sparkSession, keep(df, label), df)


def keep(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def at(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing needs any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column in taken has it, whatever the case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those of these names, whatever the case: the ones that stay when columns of these names are added."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str | Column], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """left joined (how: inner or left) with right, which has one row a key, so that no task gets all of left's rows of a
    frequent key. left's key columns are not null, or the join is an inner one.

    A key is frequent if it has more than one in HEAVY of left's rows. The keys of highest counts, HEAVY at most, come to
    the driver. A frequent key with n rows is dealt over n * HEAVY / total tasks by a hash of the columns `by`, and its row of
    right is repeated as often: fewer than 2 * HEAVY rows more, whatever the data. left should be a written table or cheap, or counted, which has left's
    keys as often.
    """
    counted = left if counted is None else counted
    n, salt, ways = fresh([*left.columns, *right.columns], "n", "salt", "ways")
    total = counted.count()
    top = counted.groupBy(*keys).agg(F.count("*").alias(n)).orderBy(F.desc(n)).limit(HEAVY).collect()
    heavy = [(*(r[k] for k in keys), -(-r[n] * HEAVY // total)) for r in top if r[n] * HEAVY > total and r[n] > 1]
    if not heavy:
        return left.join(right, keys, how)
    types = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    few = F.broadcast(left.sparkSession.createDataFrame(heavy, ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"{ways} int"])))
    many = left.join(few, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(ways)).cast("int"), F.lit(0))).drop(ways)
    once = right.join(few, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(ways) - 1, F.lit(0))))).drop(ways)
    return many.join(once, [*keys, salt], how).drop(salt)
