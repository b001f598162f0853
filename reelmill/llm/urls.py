"""URL filters: host and path rules, and a Bloom filter cascade for listed hosts.

The cascade answers exactly for a known universe of keys, here all hosts of the corpus. Level 0 encodes the listed
keys; the keys of the universe that it takes for listed by mistake are encoded by level 1, the listed keys that level 1
holds by mistake by level 2, and so on until a level has no mistakes. A key's answer is the parity of the first level
that doesn't hold it. Pages are then judged by bit tests on their host, without a join.

Building works on distinct hosts only: levels are bit_or sums over 64-bit words on Spark, one narrow shuffle a level.
A cascade whose levels would pass `max_filter_bytes` is dealt into parts by a hash of the key, each with levels of its
own; parts travel to the executors one after the other, and each marks its own hosts in a pass over the pages' hosts.
There is no join at any size; memory stays within one part, and passes grow with the listed hosts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm._shared import LOWER, UPPER, discard, materialize

#: Fixed values: (rule, host, path prefix, verdict); of the rules that fit a url the longest decides.
RULES = (
    ("net/", "net", "/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"),
    ("org/fr/", "org", "/fr/", "allow"),
)
#: Names of unwanted sites. A host is listed if one of its labels is one of them.
LISTED_LABELS = ("ads-track", "cheap-pills", "free-bets", "spam-farm")


@dataclass(frozen=True)
class Params:
    """bits: of filter for each key of a level; hashes: bits set for each key; max_filter_bytes: of the levels of one part,
    which the driver and each task hold."""

    bits: int = 10
    hashes: int = 5
    max_filter_bytes: int = 64 << 20


#: Levels after which a cascade counts as never ending: only two keys with the same 128 bits of hashes lead there.
MAX_LEVELS = 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    found = url.isNotNull() & (at > 0)
    return F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def rule_for(host: Column, path: Column) -> Column:
    """The longest rule that fits, or null. A rule fits its host and that host's subdomains, where the path starts with the rule's."""
    found = F.lit(None).cast("string")
    for rule, rule_host, prefix, _ in sorted(RULES, key=lambda r: len(r[0])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def parts_of(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, h1, h2): each page's url in parts, with two hashes of its host."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return parts.select("*", F.xxhash64("host").alias("h1"), F.xxhash64(F.lit(1), "host").alias("h2"))


def listed_hosts(pages: DataFrame, labels: tuple[str, ...] = LISTED_LABELS) -> DataFrame:
    """(host): the hosts of pages of which a label is one of `labels`, once each: a list for judge()."""
    found = F.arrays_overlap(F.split("host", r"\.", -1), F.array(*map(F.lit, labels)))
    return parts_of(pages).where(found).select("host").distinct()


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """(n, hashes) bit positions of keys in a level of `bits` bits, from their two 64-bit hashes."""
    with np.errstate(over="ignore"):
        a = h1 ^ (np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        step = h2 | np.uint64(1)
        i = np.arange(hashes, dtype=np.uint64)
        mixed = a[:, None] + i[None, :] * step[:, None]
        mixed ^= mixed >> np.uint64(33)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
    return mixed % np.uint64(bits)


def _holds(words: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int, hashes: int) -> np.ndarray:
    at = _positions(h1, h2, level, 64 * len(words), hashes)
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


@dataclass(frozen=True)
class Cascade:
    """levels: each level's 64-bit words, lowest first; every odd one holds mistakes of the one before."""

    levels: tuple[np.ndarray, ...]
    hashes: int

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for the keys of the universe that it was built over: is a key listed?"""
        out = np.zeros(len(h1), dtype=bool)
        open_ = np.arange(len(h1))
        for level, words in enumerate(self.levels):
            held = _holds(words, h1[open_], h2[open_], level, self.hashes)
            out[open_[~held]] = level % 2 == 1
            open_ = open_[held]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _as_uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _encode(keys: DataFrame, level: int, words: int, hashes: int) -> np.ndarray:
    """One level over keys (h1, h2): each task sets its keys' bits, and equal words are joined by bit_or on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _positions(_as_uint(batch.column(0)), _as_uint(batch.column(1)), level, 64 * words, hashes).ravel()
            bits = np.uint64(1) << (at & np.uint64(63))
            index, where = np.unique(at >> np.uint64(6), return_inverse=True)
            joined = np.zeros(len(index), dtype=np.uint64)
            np.bitwise_or.at(joined, where, bits)
            yield pa.RecordBatch.from_arrays([pa.array(index.view(np.int64)), pa.array(joined.view(np.int64))], ["word", "bits"])

    found = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(words, dtype=np.uint64)
    table = found.toArrow()  # at most `words` rows of one part
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _split(keys: DataFrame, words: np.ndarray, level: int, hashes: int) -> DataFrame:
    """The keys that a level holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _holds(words, _as_uint(batch.column(0)), _as_uint(batch.column(1)), level, hashes)
            yield batch.filter(pa.array(held))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def build(universe: DataFrame, params: Params = Params()) -> Cascade:
    """universe (h1, h2, listed), distinct keys -> the cascade."""
    inside, outside = universe.where("listed").select("h1", "h2"), universe.where("NOT listed").select("h1", "h2")
    n_in, levels, held = inside.count(), [], []
    while n_in:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("a listed and an unlisted host share both hashes")
        words = math.ceil(n_in * params.bits / 64) + 1
        levels.append(_encode(inside, len(levels), words, params.hashes))
        wrong = materialize(_split(outside, levels[-1], len(levels) - 1, params.hashes), "cascade-level")
        held.append(wrong)
        inside, outside, n_in = wrong, inside, wrong.count()
    for table in held:
        discard(table)
    return Cascade(tuple(levels), params.hashes)


def _marked(parts: DataFrame, cascade: Cascade, part: int, count: int) -> DataFrame:
    """parts with listed set for the hosts of one part of the cascade."""
    sent = parts.sparkSession.sparkContext.broadcast(cascade)
    at = parts.columns.index("listed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = _as_uint(batch.column("h1")), _as_uint(batch.column("h2"))
            listed = batch.column(at).to_numpy(zero_copy_only=False).copy()
            mine = np.flatnonzero(h2.view(np.int64) % count == part)
            listed[mine] = sent.value.contains(h1[mine], h2[mine])
            yield pa.RecordBatch.from_arrays([pa.array(listed) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return parts.mapInArrow(run, parts.schema)


def judge(pages: DataFrame, params: Params = Params(), listed: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    listed (host): the listed hosts, by default those of listed_hosts(pages); repeats and nulls count for nothing, hosts that no page has change nothing, and only hosts
    as they stand count, not their subdomains. A rule's verdict counts first; else the page is blocked where its host is
    listed. Null urls and urls without :// have empty host and path, fit no rule and are allowed, unless the empty host is
    listed. Of rules that fit the longest counts; no two are equally long. Urls of any length are read whole. Repeated rows are
    judged alike, an empty table gives an empty table, other columns are not read. Answers are exact for the hosts of
    these pages; other pages need a cascade of their own.
    """
    parts = parts_of(pages).withColumn("rule", rule_for(F.col("host"), F.col("path"))).withColumn("listed", F.lit(False))
    listed = listed_hosts(pages) if listed is None else listed
    found = listed.where(F.col("host").isNotNull()).select("host").distinct().withColumn("listed", F.lit(True))
    named = found.select(F.xxhash64("host").alias("h1"), F.xxhash64(F.lit(1), "host").alias("h2"), "listed")
    keys = parts.select("h1", "h2", "listed").unionByName(named)
    both = keys.groupBy("h1", "h2").agg(F.bool_or("listed").alias("listed"), F.bool_or(~F.col("listed")).alias("seen"))
    universe = materialize(both.where("seen").select("h1", "h2", "listed"), "hosts")
    n = universe.where("listed").count()
    count = max(1, math.ceil(2 * n * params.bits / 8 / params.max_filter_bytes))  # later levels are a small part of the first
    for part in range(count):
        mine = universe.where(F.pmod("h2", F.lit(count)) == part)
        parts = _marked(parts, build(mine, params), part, count)
        if count > 1:
            parts = materialize(parts, "marked-pages")
    ruled = F.create_map(*[F.lit(x) for rule, _, _, verdict in RULES for x in (rule, verdict)])
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", "rule", F.coalesce(F.element_at(ruled, F.col("rule")), own).alias("verdict"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN list_has_any(string_split(host, '.'), ['ads-track', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
            ELSE 'allow' END AS verdict
FROM r
"""
