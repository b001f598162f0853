"""Line dedup across documents: levelled sorted runs of line hashes, DataFrame operations only.

Documents come in batches of ascending doc_id. The index of lines seen so far is a set of runs, each a table of
(h1, h2, first_doc) bucketed and sorted by the hash. A batch reduces its lines to one row per hash, probes the runs
with a merge join on the buckets, and what no run holds (the anti join) becomes a new run of level 0. When a level
has `fanout` runs they are merged into one run of the next level, so a batch probes few runs however many came before.

Hot lines are reduced to one row per task before any shuffle; the join that marks their occurrences is a plain
inner join, which adaptive execution splits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm._shared import SPACES, ascii_lower, discard, materialize, new_path, shuffle_partitions

#: Stands for a null doc_id: rows without one count together as the last document.
LAST_DOC = 2**63 - 1


@dataclass(frozen=True)
class Params:
    min_chars: int = 10
    batches: int = 4
    fanout: int = 2


@dataclass
class RunIndex:
    """Runs by level. Each run is a bucketed table in the shared folder."""

    spark: SparkSession
    fanout: int
    buckets: int
    levels: list[list[str]] = field(default_factory=list)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run = run.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", new_path(self.spark, "line-run")).saveAsTable(name)
        return name

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Adds a run, and merges the runs of a full level into the next one. Runs are disjoint by construction."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(run))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.add(merged, level + 1)
            self._drop(full)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def release(self) -> None:
        """Removes all runs, once no further batch will come."""
        self._drop([name for level in self.levels for name in level])
        self.levels = []

    def probe(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...) with owner: first_doc of the one run that holds the hash, else null."""
        held: list[Column] = []
        for i, run in enumerate(self.tables()):
            keys = keys.join(run.withColumnRenamed("first_doc", f"in_run_{i}").hint("merge"), ["h1", "h2"], "left")
            held.append(F.col(f"in_run_{i}"))
        owner = F.coalesce(*held) if held else F.lit(None).cast("long")
        return keys.withColumn("owner", owner).drop(*[f"in_run_{i}" for i in range(len(held))])


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, row_hash, pos, h1, h2): each line whose key has min_chars code points or more, by a 128-bit hash of its key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(LAST_DOC)).alias("doc"),
        F.xxhash64(text).alias("row_hash"),
        F.posexplode(F.split(ascii_lower(text), "\n", -1)).alias("pos", "line"),
    )
    keys = lines.select("doc", "row_hash", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc, row_hash, drops): positions of the lines that go, for documents that lose any."""
    spark = docs.sparkSession
    seen = materialize(occurrences(docs, params.min_chars), "line-occurrences")
    cuts = [i / params.batches for i in range(1, params.batches)]
    bounds = seen.agg(F.percentile_approx("doc", cuts, 1000).alias("q")).first()["q"] if cuts else None
    bounds = sorted(set(bounds or []))
    index, parts = RunIndex(spark, params.fanout, shuffle_partitions(spark)), []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = seen
        batch = batch.where(F.col("doc") > low) if low is not None else batch
        batch = batch.where(F.col("doc") <= high) if high is not None else batch
        keys = batch.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
        probed = materialize(index.probe(keys), "line-probe")
        index.add(probed.where("owner IS NULL").select("h1", "h2", "first_doc"))
        shared = probed.where("owner IS NOT NULL OR first_doc < last_doc").select("h1", "h2", F.coalesce("owner", "first_doc").alias("owner"))
        parts.append(batch.join(shared, ["h1", "h2"]).where(F.col("doc") != F.col("owner")).select("doc", "row_hash", "pos"))
    index.release()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("doc", "row_hash").agg(F.collect_list("pos").alias("drops"))


def line_dedup(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with text replaced by its kept lines, plus n_lines and n_dropped (columns of those names are replaced).

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of min_chars code points or
    more that stands in two documents or more stays only in the smallest doc_id holding it, with all its lines there;
    lines with shorter keys stay. Null or empty text is one empty line and comes back as ''. Rows with the same
    doc_id are one document, and so are all rows with a null doc_id, which counts as the largest. Texts and lines of any
    length are read whole. An empty table
    gives an empty table; further columns pass through.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(LAST_DOC)).alias("__doc"),
        F.xxhash64(text).alias("__row_hash"),
        F.split(text, "\n", -1).alias("__lines"),
        *[F.col(c) for c in rest],
    )
    gone = dropped_lines(docs, params).select(F.col("doc").alias("__doc"), F.col("row_hash").alias("__row_hash"), F.col("drops").alias("__drops"))
    joined = left.join(gone, ["__doc", "__row_hash"], "left")
    n = F.size("__lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drops"))
    lines = F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(F.transform(kept, lambda i: F.get(F.col("__lines"), i)))
    dropped = F.when(F.col("__drops").isNull(), 0).otherwise(n - F.size(kept))
    return joined.select(*[F.col(c) for c in rest], F.array_join(lines, "\n").alias("text"), n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The digest columns of op7."""
    done = line_dedup(docs.select("doc_id", "text"), params)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (
  SELECT k.doc_id, k.pos, k.line, (o.owner IS NOT NULL AND o.owner <> k.doc_id) AS gone
  FROM k LEFT JOIN o ON k.key = o.key AND length(k.key) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
