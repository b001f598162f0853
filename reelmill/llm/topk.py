"""Exact top-k search by inner product: columnar branch-and-bound over blocks.

Candidates stay where they are: one block of queries of bounded size after the other travels to them, so no vector is
shuffled or copied. A task turns its candidates into blocks of columns. Scores accumulate one block of dimensions at a
time; what the dimensions still to come can add is at most the product of the remaining lengths of query and candidate,
so a candidate whose score plus that bound is below the query's floor leaves the arrays, which are compacted. The floor
is the k-th best score known so far: at first that among a few seed rows of the whole table, then the best of each
block that the task has seen. What survives in the tasks is merged by rank.

Components are whole numbers held exactly by doubles. Sums of products are exact below 2^53; past that, floats only
bound the scores, with a margin for their rounding, and the survivors are scored by whole-number arithmetic of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm._shared import materialize

#: The largest magnitude of a returned score; rows are ranked by the whole score.
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Params:
    """query_block: queries that travel at once; candidate_block: rows scored at once; seeds: rows for the first floors."""

    scale: int = 256
    query_every: int = 50
    k: int = 5
    query_block: int = 4096
    candidate_block: int = 4096
    dimension_block: int = 16
    seeds: int = 2048


def _lengths(columns: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Lengths of the vectors from each cut on, and 0 at the end."""
    squares = np.stack([(columns[a:b] ** 2).sum(axis=0) for a, b in zip(cuts, [*cuts[1:], len(columns)], strict=True)])
    return np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, columns.shape[1]))]))


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """rows divided by a power of two, so that no magnitude passes 1, and its exponent; nothing is rounded."""
    exponent = int(np.frexp(np.abs(rows).max(initial=0.0))[1])
    return np.ldexp(rows, -exponent), exponent


def _exact(query: np.ndarray, rows: np.ndarray) -> list[int]:
    """Inner products as whole numbers of any size; equal rows are scored once."""
    unique, where = np.unique(rows, axis=0, return_inverse=True)
    terms = [int(x) for x in query]
    scores = [sum(a * int(x) for a, x in zip(terms, row, strict=True) if a) for row in unique]
    return [scores[i] for i in where.ravel()]


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, params: Params = Params(), floors: list | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of the k best candidates of one block for each query. Arrays of whole numbers.

    floors: for each query a score that k rows are known to reach, or None; candidates below it may be left out. It is
    raised where the block holds k better ones.
    """
    d, step = rows.shape[1], params.dimension_block
    if not len(rows) or not len(queries):
        return []
    cuts = list(range(0, d, step)) or [0]
    scaled, shift = _scaled(rows)
    columns = np.ascontiguousarray(scaled.T)
    asked, asked_shift = _scaled(queries)
    row_left, query_left = _lengths(columns, cuts), _lengths(np.ascontiguousarray(asked.T), cuts)
    exact = math.ldexp(1.0, -shift - asked_shift)  # the unit of scaled scores
    rounding = (d + 4) * 2.0**-52
    whole = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(d, 1) < 2**53
    out = []
    for n, (q, own) in enumerate(zip(asked, query_ids, strict=True)):
        alive = np.flatnonzero(ids != own)
        if not len(alive):
            continue
        known = None if floors is None or floors[n] is None else floors[n]
        least = -math.inf if known is None else _below(known, shift + asked_shift)
        scores, held = np.zeros(len(alive)), None
        for b, at in enumerate(cuts):
            part = columns[at : at + step] if held is None else held[at : at + step]
            part = part if held is not None or len(alive) == columns.shape[1] else part[:, alive]
            scores = scores + q[at : at + step] @ part
            slack = rounding * row_left[0][alive] * query_left[0][n] + 1e-300
            reach = row_left[b + 1][alive] * query_left[b + 1][n] * (1 + 1e-12) + slack
            floor = least
            if len(alive) > params.k:
                worst = scores - reach
                floor = max(floor, np.partition(worst, len(worst) - params.k)[len(worst) - params.k])
            keep = scores + reach >= floor
            last = b + 1 == len(cuts)
            if last or keep.sum() < 0.7 * len(keep):
                alive, scores = alive[keep], scores[keep]
                held = None if last else columns[:, alive]
        if whole:
            totals = [int(x) for x in np.rint(scores / exact).astype(np.int64)]
        else:
            totals = _exact(queries[n], rows[alive])
        best = sorted(zip((-t for t in totals), ids[alive].tolist(), strict=True))[: params.k]
        out += [(int(own), i, -t) for t, i in best]
        if floors is not None and len(best) == params.k and (known is None or -best[-1][0] > known):
            floors[n] = -best[-1][0]
    return out


def _below(score: int, exponent: int) -> float:
    """A float no greater than a score, in units of 2^exponent."""
    extra = max(0, abs(score).bit_length() - 53)
    try:
        return math.ldexp(float(score >> extra), extra - exponent)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def _matrix(values: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, shorter vectors with zeros behind."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    limit = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -limit, limit)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec): the components as doubles. Rows take no part whose id, vector or a component is null, or that hold
    a component that isn't finite."""
    x = F.col("embedding")
    rows = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull())
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vec"))


#: A score as text whose order is that of the scores: sign, number of digits, digits; negative ones in nines' complement.
def _order(score: int) -> str:
    digits = str(abs(score))
    text = f"{len(digits):04d}{digits}"
    return f"1{text}" if score >= 0 else "0" + text.translate(str.maketrans("0123456789", "9876543210")) + "~"


FOUND = "query_id long, vec_id long, score long, place string"


def _against(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, floors: list, params: Params) -> DataFrame:
    """FOUND: what each task of rows has among the k best for each of the queries."""
    sent = rows.sparkSession.sparkContext.broadcast((ids, queries, floors))  # at most query_block vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked, known = sent.value
        known, best = list(known), {}
        for batch in batches:
            for at in range(0, batch.num_rows, params.candidate_block):
                part = batch.slice(at, params.candidate_block)
                vectors = part.column(1).to_pylist()
                width = max([asked.shape[1], *map(len, vectors)])
                found = search_block(np.pad(asked, ((0, 0), (0, width - asked.shape[1]))), query_ids, _matrix(vectors, width, params.scale), part.column(0).to_numpy(), params, known)
                for q, v, score in found:
                    best.setdefault(q, []).append((-score, v))
                for n, q in enumerate(query_ids.tolist()):
                    if len(held := best.get(q, ())) >= params.k:
                        best[q] = sorted(held)[: params.k]
                        known[n] = -best[q][-1][0]
        rows = [(q, v, max(-LARGEST, min(LARGEST, -s)), _order(-s)) for q, held in best.items() for s, v in sorted(held)[: params.k]]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score", "place"])

    return rows.mapInArrow(run, FOUND)


def _best(found: DataFrame, params: Params) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k)


def top_k(embeddings: DataFrame, params: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by query_every its k best other rows.

    Ties go to the smaller vec_id. A shorter vector counts as having zeros for what it lacks. Repeated vectors are
    candidates of their own; rows that repeat a vec_id count once for each copy, but never for a query of that id; a
    query id with several vectors has the best of all of them. Scores past the range of long are ranked in full and
    returned as its end. Very long vectors are scored a block of dimensions at a time. An empty table gives no rows;
    other columns are not read.
    """
    rows = materialize(whole_vectors(embeddings), "vectors")
    queries = rows.where(F.col("vec_id") % params.query_every == 0).dropDuplicates(["vec_id", "vec"])
    blocks = max(1, math.ceil(queries.count() / params.query_block))
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks))), "queries")
    seeds = rows.limit(params.seeds).toArrow()  # any rows will do: a floor only has to be reached by k of the table's rows
    seed_ids, seed_vectors = seeds.column("vec_id").to_numpy(), seeds.column("vec").to_pylist()
    parts = []
    for i in range(blocks):
        block = queries.where(F.col("block") == i).select("vec_id", "vec").toArrow()  # one block of bounded size
        ids, vectors = block.column("vec_id").to_numpy(), block.column("vec").to_pylist()
        width = max(map(len, [*vectors, *seed_vectors]), default=0)
        asked, floors = _matrix(vectors, width, params.scale), [None] * len(ids)
        search_block(asked, ids, _matrix(seed_vectors, width, params.scale), seed_ids, params, floors)
        found = _best(_against(rows, ids, asked, floors, params), params)
        parts.append(found.drop("rank") if blocks == 1 else materialize(found.drop("rank"), "top-k-block"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _best(found, params).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.vec, c.vec) AS bigint) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
