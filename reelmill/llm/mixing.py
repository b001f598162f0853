"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Documents stand in one order
within their source, by size first, so that neighbours are alike and the words taken stay within about one document of
the target; expected copies are prefix-summed in that order, one random offset a source is added, and a document is
emitted once for each integer boundary its interval crosses.

Ranks come from a range shuffle of (source, size, doc_id) rows: each task numbers its own rows, and offsets are summed
over one row a task and source. A hot source spreads over as many tasks as it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm._shared import WORD, materialize, shuffle_partitions


@dataclass(frozen=True)
class Params:
    weights: tuple[int, ...] = (1, 2, 3)
    max_repeat: int = 3
    seed: str = "mix-1"


def _unit(column: Column, params: Params) -> Column:
    """A number in (0, 1) from the seed and the column: an odd multiple of 1 / 131072, so that sums stay exact."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{params.seed}|"), F.coalesce(column, F.lit("<null>")))), 1, 4), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(65536.0)


def source_targets(sizes: DataFrame, params: Params = Params()) -> DataFrame:
    """sizes (key, source, source_size) -> and weight, target. One row a source goes in; sources are ordered by code point, null last.

    A target is the source's weight times a common level, or max_repeat times its size where that is less. The level
    is found by filling sources in order of size over weight: the first k are full, and the rest share what remains.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in params.weights])
    ranked = sizes.select("key", "source", "source_size", F.get(weights, (F.row_number().over(by_name) - 1) % len(params.weights)).alias("weight"))
    cap = F.lit(float(params.max_repeat)) * F.col("source_size")
    ranked = ranked.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", rest / left).withColumn("open", F.col("level") <= F.col("full_at"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    return levels.select("key", "source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies) for every row of docs.

    size: words of the text (null or empty: 0). A null source is a source of its own, the last in order. A source
    without words has target 0 and no copies. Ties in size are broken by a hash and then by doc_id; rows that are
    equal in all of that are interchangeable. A text of any length is counted whole. Reruns agree: offsets and ties come from the seed alone. An empty table
    gives an empty table; other columns are not read.
    """
    tie = F.md5(F.concat(F.lit(f"{params.seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("<null>"))))
    rows = docs.select(
        "doc_id",
        "source",
        F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source"))).alias("key"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        tie.alias("tie"),
    )
    rows = materialize(rows, "mix-sizes")  # the range shuffle reads its input twice: once to sample, once to deal
    within = ["size", "tie", "doc_id", "text_hash"]
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("source").asc_nulls_last(), *within)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()), "mix-order")
    counts = materialize(dealt.groupBy("part", "key", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-counts")
    targets = source_targets(counts.groupBy("key", "source").agg(F.sum("words").alias("source_size")), params).drop("source")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    terms = materialize(offsets.join(targets, "key"), "mix-terms")
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("part", "key").orderBy(*within)))
    joined = local.join(terms, ["part", "key"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("offset") + F.col("local")
    crossed = F.floor(_unit(F.col("source"), params) + rank * share) - F.floor(_unit(F.col("source"), params) + (rank - 1) * share)
    copies = F.least(F.lit(params.max_repeat).cast("long"), crossed)
    return joined.select("doc_id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The mix itself: each row of docs as often as it has copies. Columns are those of docs. Rows that agree in
    doc_id, source and text share their copies out evenly."""
    keys = ["doc_id", "source", "text_hash"]
    chosen = mix(docs, params).groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    chosen = chosen.select(*[F.col(c).alias(f"__{c}") for c in chosen.columns])
    named = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    on = named["doc_id"].eqNullSafe(F.col("__doc_id")) & named["source"].eqNullSafe(F.col("__source")) & (F.col("__hash") == F.col("__text_hash"))
    joined = named.join(chosen, on)
    single = joined.where("__rows = 1").withColumn("__times", F.col("__copies"))
    at = F.row_number().over(Window.partitionBy("__doc_id", "__source", "__text_hash").orderBy("__copies"))
    share = F.col("__copies") / F.col("__rows")
    repeated = joined.where("__rows > 1").withColumn("__at", at).withColumn("__times", F.floor(F.col("__at") * share + 1e-9) - F.floor((F.col("__at") - 1) * share + 1e-9))
    both = single.select(*docs.columns, "__times").unionByName(repeated.select(*docs.columns, "__times"))
    return both.where("__times > 0").select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("__times").cast("int"))).alias("__copy")).drop("__copy")


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The columns of op4."""
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix(docs, params).select("doc_id", "size", "source_size", "target", taken)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1|' || coalesce(cast(doc_id AS varchar), '<null>')) AS tie FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS double) AS weight,
         3.0::double * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS full_at,
         (cast(sum(source_size) OVER () AS double) - coalesce(sum(cap) OVER f, 0.0::double))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0::double)) AS level
  FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, weight * (max(level) FILTER (WHERE level <= full_at) OVER ())) AS target,
         (cast('0x' || substr(md5('mix-1|' || coalesce(source, '<null>')), 1, 4) AS integer) + 0.5::double) / 65536.0::double AS unit
  FROM l),
r AS (
  SELECT d.*, t.source_size, t.target, t.unit,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::double END AS share,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie, d.doc_id) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * least(3, cast(floor(unit + rank * share) - floor(unit + (rank - 1) * share) AS bigint)) AS taken
FROM r
"""
