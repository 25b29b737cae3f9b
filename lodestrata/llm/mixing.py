"""Mixing sources to target weights by Poisson replication, with built-in functions only.

Every document is repeated N times, N drawn from a Poisson distribution whose mean is the rate its source needs:
target weight x mean output size / rows of the source. The draw inverts the distribution at a uniform number that
a keyed hash of doc_id gives, so it is the same on every run and needs no state. Copies are dealt out by a second
keyed hash and sorted by it, which is a global shuffle.

Sources without a target share what the targets leave, in proportion to their rows; a null source is a source of
its own. Rows of equal doc_id draw the same number; a null doc_id draws as the text "null". An empty table gives
an empty result; a target for a source without rows is ignored, its weight is not handed on. Other columns pass;
where one of them has the name of a column that is added, the added one's name ends in an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.frames import every, unused
from lodestrata.llm.storage import materialise

#: A mean above this is drawn as a sum of independent parts, so exp(-mean) never underflows.
PART = 32.0
#: Tasks that the rows of a source are dealt to where the rates are too many to broadcast.
SALTS = 32
#: Rows of a task of the global shuffle on average, and tasks at most.
TASK_ROWS, MOST_TASKS = 10_000, 100_000


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the key's parts."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("null")) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column) -> Column:
    """The smallest n whose cumulative probability exceeds u. The steps reach beyond where 52 bits of u can."""
    steps = F.ceil(mean + 9 * F.sqrt(mean) + 18).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["cdf"] + p).alias("cdf"), (s["n"] + (u >= s["cdf"]).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["n"])


def rates(docs: DataFrame, targets: dict[str, float], epochs: float) -> DataFrame:
    """Rows and mean repetitions by source: source, n, rate."""
    if min(targets.values(), default=0) < 0 or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets must be weights that sum to 1 at most")
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    spark = docs.sparkSession
    wanted = spark.createDataFrame(list(targets.items()) or [("", 0.0)], "source string, target double").limit(max(1, len(targets)))
    if not targets:
        wanted = wanted.where("false")
    joined = counts.join(F.broadcast(wanted), "source", "left")
    sums = joined.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("target").isNull(), F.col("n"))).alias("free"))
    left = max(0.0, 1.0 - sum(targets.values()))
    weight = F.coalesce(F.col("target"), F.lit(left) * F.col("n") / F.col("free"))
    return joined.crossJoin(F.broadcast(sums)).select("source", "n", (weight * F.lit(float(epochs)) * F.col("rows") / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, targets: dict[str, float], epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` with each row repeated by its draw, in shuffled order, and then rate, copy_no (from 1) and mix_key."""
    names = {n: unused(docs, n) for n in ("__source", "__salt", "__row", "__parts", "__n", "rate", "copy_no", "mix_key")}
    source, salt, row, parts, n, rate, copy, key = names.values()
    table = materialise(rates(docs, targets, epochs), "rates")
    rows = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Written down, so that Spark knows its size when it plans: small, it is broadcast and the documents stay where
    # they are; large, the salt deals the rows of a source to SALTS tasks.
    named = table.select(F.col("source").alias(source), F.col("rate").alias(rate), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    named = materialise(named, "salted-rates")
    out = docs.withColumn(row, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    out = out.join(named, out["source"].eqNullSafe(named[source]) & (out[row] == named[salt])).drop(source, salt, row)
    out = out.withColumn(parts, F.greatest(F.lit(1), F.ceil(F.col(rate) / PART)).cast("int"))
    draw = lambda part: poisson(uniform(F.lit(seed), F.col("doc_id"), part), F.col(rate) / F.col(parts))
    many = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda total, part: total + draw(part))
    out = out.withColumn(n, F.when(F.col(parts) == 1, draw(F.lit(1))).otherwise(many)).where(F.col(n) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    place = F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy).cast("string")))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, rows // TASK_ROWS + 1))
    return out.drop(n, parts).withColumn(key, place).repartition(tasks, key).sortWithinPartitions(key)


def repeated(docs: DataFrame, targets: dict[str, float], epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """The same rows in the same order with the columns of ``docs`` only."""
    return mix_sources(docs, targets, epochs, seed).select(*every(docs))
