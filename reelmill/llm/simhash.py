"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of its shingles' XXH64 values. Two fingerprints within `radius` bits
have a word halfway, within half the radius of both: every distinct fingerprint emits all its variants within
radius // 2, the shuffle is on variants, and fingerprints that meet are linked. A variant's bucket holds at most
1 + 64 distinct fingerprints for radius 2 (each is the variant or one flip away), whatever the data, so no bucket can be hot. All fingerprints of a
bucket are within `radius` of one another, so linking neighbours in the bucket's order loses nothing; colliding pairs
are deduplicated and verified. Documents with equal fingerprints are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm._graph import connected_components
from reelmill.llm._shared import first_rows, materialize

#: SPREAD[v] has bit k of the byte v in its byte k.
SPREAD = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


@dataclass(frozen=True)
class Params:
    words: int = 3
    seed: int = 42


#: Differing bits at which two fingerprints still link; the halfway words are those one flip away.
RADIUS = 2


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, lowest bit first."""
    spread = SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(spread, np.arange(0, len(hashes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, params: Params = Params()) -> int:
    """The unsigned fingerprint of one text. No words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= params.words:
        return xxhash.xxh64_intdigest(joined, params.seed)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    total, ones, step = len(words) - params.words + 1, np.zeros(64, dtype=np.int64), 1 << 16
    digest, seed = xxhash.xxh64_intdigest, params.seed
    for at in range(0, total, step):
        here = starts[at : min(at + step, total)].tolist()
        there = ends[at + params.words - 1 : at + params.words - 1 + len(here)].tolist()
        ones += _bit_counts(np.array([digest(joined[a:b], seed) for a, b in zip(here, there)], dtype=np.uint64))
    bits = (2 * ones > total).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of any 64-bit hashes: a bit is 1 if set in over half of them."""
    step = 1 << 16
    ones = sum((_bit_counts(hashes[at : at + step]) for at in range(0, len(hashes), step)), np.zeros(64, dtype=np.int64))
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


def flips(bits: int = 64) -> Column:
    """What a word of so many bits is XORed with for its ball: nothing, and each single bit."""
    return F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(bits)])


def fingerprints(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long with the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), params) for t in batch.column(1)]
            fps = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """nodes (fp, node), one row a fingerprint -> (u, v): verified pairs that connect all fingerprints within RADIUS."""
    variants = nodes.select("fp", "node", F.explode(flips()).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp", "node")
    order = Window.partitionBy("variant").orderBy("fp")
    met = variants.select("fp", "node", F.lag("fp").over(order).alias("fp2"), F.lag("node").over(order).alias("node2")).where("fp2 IS NOT NULL")
    pairs = met.dropDuplicates(["fp", "fp2"])
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS).select(F.col("node2").alias("u"), F.col("node").alias("v"))


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest doc_id reachable over links, the row's own included. Text that is null or has no word
    has fingerprint 0 and links like any other. Equal rows and texts share a fingerprint and so a component. Rows with
    a null doc_id get a fingerprint, take no part in linking, and have a null component_id. A text of any
    length is read whole; a bit set in exactly half the hashes is 0. An empty table gives an empty table; other columns
    are not read.
    """
    fps = materialize(fingerprints(docs, params), "fingerprints")
    nodes = materialize(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    found = connected_components(links(nodes)).select("node", "component")
    labels = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    joined = fps.join(labels, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs without all but one document of each component: the row of its smallest doc_id stays; where that is repeated, the
    one whose text and then whose row has the smallest hash. Rows without a doc_id stay. Columns are those of docs."""
    classes = near_duplicates(docs, params)
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    marked = docs.join(kept, docs["doc_id"] == kept["__kept"], "left_semi")
    return first_rows(marked, "doc_id").unionByName(docs.where("doc_id IS NULL"))


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The digest columns of op9."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs, params).select("doc_id", digits.alias("fingerprint"), "component_id")
