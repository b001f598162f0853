"""Shared folders for intermediate tables, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.views import spread

#: The bytes that separate words, and A-Z with its lower case.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset in a local session (tests),
    a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reelmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a finished query at once where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that travel to and from Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def settle(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """materialize(), whose shuffle files go as soon as the table is written, as nothing reads them again. batch_rows: rows
    that Python takes at once, where rows are large."""
    conf = df.sparkSession.conf
    own = {CLEANUP: "true"} | ({BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        return materialize(df, label)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def discard(df: DataFrame) -> None:
    """Removes the files of a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def first_rows(docs: DataFrame, key: str) -> DataFrame:
    """One row for each value of key: of several the one whose text, and then whose row, has the smallest hash."""
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.xxhash64("text"), F.xxhash64(*plain))
    return docs.groupBy(key).agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found
