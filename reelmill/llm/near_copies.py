"""Near copies by ball hashing of SimHash fingerprints over word shingles; the exact Jaccard similarity of the shingle sets decides.

Texts with equal shingle sets are one node from the start. Each node has `prints` fingerprints of 64 bits, each cut into
two words of 32. As in `simhash`, a word emits itself and all words one flip away, and words within two bits of one another
meet. A node is compared with one of those it meets, the one that meets most others. A pair at similarity 0.8 differs in
5 of 32 bits on average, so a part of such pairs stays beyond the balls' radius, and a wider ball would have thousands
of words. For these there are bands of minima (MinHash) as the exact way: each node has `bands` band keys of `rows`
minima each; nodes that share a key and that the balls have not connected are candidates. The node of a bucket that meets most
other nodes in all its buckets is the bucket's hub: the text of which a group's others are copies meets all of them, while two copies
may be further apart. Each node is first compared with the best of its hubs; then, where the two are still in different
components, with the hubs of its other buckets. What this leaves apart is compared pair by pair within a bucket; in crowded
buckets only pairs that share one of the rarest differences from the bucket's hub, which all pairs alike do. A large group
of near copies so costs a multiple of its size, and no candidate pair that could join two components is left out.
The shingle sets of candidates are made in one more pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm import simhash
from reelmill.llm._graph import connected_components
from reelmill.llm._shared import discard, first_rows, materialize, settle


@dataclass(frozen=True)
class Params:
    """A pair at similarity 0.8 shares none of 24 bands of 5 minima with probability 0.00007. crowd: nodes of a bucket beyond
    which counting differences costs less than comparing pairs; it changes the work, not the result. far: differing bits of a
    fingerprint beyond which words that meet are taken for chance; the bands see such pairs all the same."""

    words: int = 5
    least: tuple[int, int] = (4, 5)
    bands: int = 24
    rows: int = 5
    seed: int = 42
    crowd: int = 32
    prints: int = 4
    far: int = 14


def shingles(text: str | None, params: Params = Params()) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles, A-Z lower-cased; a shorter text is one shingle, no words are none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: max(1, len(words) - params.words + 1)].tolist()
    stops = ends[min(params.words, len(words)) - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, params.seed
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64))


def band_keys(found: np.ndarray, params: Params = Params()) -> list[int]:
    """One signed key a band; none for an empty set."""
    if not len(found):
        return []
    n, random = params.bands * params.rows, np.random.default_rng(params.seed)
    factors = random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = random.integers(0, 1 << 63, n, dtype=np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        for i in range(n):
            least[i] = min(least[i], ((part ^ flips[i]) * factors[i]).min())
    least = least.reshape(params.bands, params.rows)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], dtype=np.uint64).view(np.int64).tolist()


def fingerprints(found: np.ndarray, params: Params = Params()) -> list[int]:
    """Signed SimHash fingerprints of a set of shingle hashes, each over its own mix of the hashes; none for an empty set."""
    out = []
    for i in range(params.prints if len(found) else 0):
        mixed = found + np.uint64((i * 0x9E3779B97F4A7C15) % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(simhash.majority(mixed ^ (mixed >> np.uint64(31))))
    return np.array(out, dtype=np.uint64).view(np.int64).tolist()


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds the shingle sets of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signatures(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, h, k, k2, n, keys, prints): a hash of each row's text, two hashes and the size of its shingle set, its band
    keys and its fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = [shingles(t.as_py(), params) for t in batch.column(2)]
            hashes = [np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in found], dtype=np.uint64).view(np.int64) for seed in (1, 2)]
            keys = pa.array([band_keys(s, params) for s in found], type=pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in found], type=pa.int64())
            prints = pa.array([fingerprints(s, params) for s in found], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, hashes), sizes, keys, prints], ["doc_id", "h", "k", "k2", "n", "keys", "prints"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, k long, k2 long, n long, keys array<long>, prints array<long>")


def _sets(docs: DataFrame, ids: DataFrame, params: Params) -> DataFrame:
    """(node, k, hashes): the shingle sets of the rows whose doc_id is one of ids (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found = [shingles(t.as_py(), params) for t in batch.column(1)]
            k = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in found], dtype=np.uint64).view(np.int64)
            hashes = pa.array([s.view(np.int64) for s in found], type=pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k), hashes], ["node", "k", "hashes"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return wanted.mapInArrow(run, "node long, k long, hashes array<long>")


def verified(sets: DataFrame, pairs: DataFrame, params: Params = Params()) -> DataFrame:
    """The (u, v) of pairs (u, ku, nu, v, kv, nv) whose shingle sets are at least as similar as params.least."""
    part, whole = params.least
    able = pairs.where((whole * F.least("nu", "nv") >= part * F.greatest("nu", "nv"))).select("u", "ku", "v", "kv").distinct()
    pairs = materialize(able, "copy-pairs")
    left = sets.select(F.col("node").alias("u"), F.col("k").alias("ku"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("k").alias("kv"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    same = whole * both >= part * (F.size("a") + F.size("b") - both)
    return materialize(pairs.join(left, ["u", "ku"]).join(right, ["v", "kv"]).where(same).select("u", "v"), "copy-links")


def _turned(pairs: DataFrame) -> DataFrame:
    """pairs (u, ku, nu, v, kv, nv), each with its smaller node first."""
    other = dict(zip(pairs.columns, [*pairs.columns[3:], *pairs.columns[:3]], strict=True))
    return pairs.where("u <> v").select(*[F.when(F.col("u") < F.col("v"), F.col(a)).otherwise(F.col(b)).alias(a) for a, b in other.items()])


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """members (bucket, node, ..) with the component of each node under the links found so far."""
    labels = materialize(connected_components(found), "copy-labels")
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _differing(sets: DataFrame, members: DataFrame, params: Params) -> DataFrame:
    """Candidates of crowded buckets: members (hub, node, k, n, component) -> pairs (u, ku, nu, v, kv, nv).

    Two texts differ in no shingle in which both differ from their hub. For texts of different components, of which the
    hub is like one at most, this bounds from below how many differences from the hub they have in common: a pair that
    is alike meets on one of the rarest differences of each. Differences within one component come first, as no pair
    needs them. At the first difference that a pair shares, those that follow bound what it can share in all.
    Every alike pair is found; texts that have only frequent differences in common never meet.
    """
    part, whole = params.least
    less, more = whole - part, whole + part  # alike: more * differing shingles <= less * both sizes
    own = members.select(F.col("hub.node").alias("hub"), F.col("hub.k").alias("kh"), F.col("hub.n").alias("nh"), "node", "k", "n", "component").distinct()
    base = sets.select(F.col("node").alias("hub"), F.col("k").alias("kh"), F.col("hashes").alias("theirs"))
    apart = own.join(base, ["hub", "kh"]).join(sets, ["node", "k"]).withColumn("apart", F.concat(F.array_except("hashes", "theirs"), F.array_except("theirs", "hashes")))
    found = apart.select("hub", "kh", "nh", "node", "k", "n", "component", F.size("apart").alias("d"), F.explode("apart").alias("hash"))
    found = materialize(found, "copy-differences")
    wide = found.groupBy("hub", "kh", "hash").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("low", "high")
    mine = Window.partitionBy("hub", "kh", "node", "k")
    place = F.col("d") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("held", "hash"))
    d, n, nh = F.col("d"), F.col("n"), F.col("nh")
    most = F.floor(less * n / part) + 1
    to_far = F.least(d - F.floor((more * d + less * (nh - n)) / (2 * more)), most)
    to_near = F.when(part * more * d <= less * (part * n + part * nh + 2 * whole * nh), F.least(d + 1 - F.ceil((more * d - less * (n + nh) + more - less) / (2 * more)), d, most)).otherwise(0)
    placed = found.join(wide, ["hub", "kh", "hash"]).withColumns({"place": place, "near": more * d <= less * (n + nh), "to_far": to_far, "to_near": to_near})
    placed = placed.where("place <= to_far OR (NOT near AND place <= to_near)").select("hub", "kh", "hash", "node", "k", "n", "component", "d", "place", "near", (F.col("place") <= F.col("to_far")).alias("meets_far"), (F.col("place") <= F.col("to_near")).alias("meets_near"))
    placed = materialize(placed, "copy-places")
    shared = 1 + F.least(F.col("du") - F.col("pu"), F.col("dv") - F.col("pv"))  # at most, if a pair's first common difference is here
    enough = 2 * more * shared >= more * (F.col("du") + F.col("dv")) - less * (F.col("nu") + F.col("nv"))
    far = placed.where("NOT near")
    ours = far.where("meets_far"), placed.where("near AND meets_far")
    others = far.where("meets_far"), far.where("meets_near")
    pairs = []
    for left, right, once in zip(ours, others, ("u < v", "u <> v"), strict=True):
        left = left.select("hub", "kh", "hash", F.col("node").alias("u"), F.col("k").alias("ku"), F.col("n").alias("nu"), F.col("component").alias("cu"), F.col("d").alias("du"), F.col("place").alias("pu"))
        right = right.select("hub", "kh", "hash", F.col("node").alias("v"), F.col("k").alias("kv"), F.col("n").alias("nv"), F.col("component").alias("cv"), F.col("d").alias("dv"), F.col("place").alias("pv"))
        pairs.append(left.join(right, ["hub", "kh", "hash"]).where("cu <> cv").where(once).where(enough).select("u", "ku", "nu", "v", "kv", "nv"))
    return pairs[0].unionByName(_turned(pairs[1]))


def ball_pairs(nodes: DataFrame, params: Params = Params()) -> DataFrame:
    """nodes (node, k, n, prints) -> (u, ku, nu, v, kv, nv): each node that meets others in a ball of a fingerprint's half, with
    the one among them that meets most. A fingerprint at a time, so that its words leave the disk before the next."""
    met = []
    for i in range(params.prints):
        fp = F.get("prints", F.lit(i))
        halves = F.array(F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
        words = nodes.select("k", fp.alias("fp"), F.posexplode(halves).alias("half", "word")).where("fp IS NOT NULL")
        near = words.select("k", "fp", "half", "word", F.explode(simhash.flips(32)).alias("flip"))
        of = (F.col("half") + 2 * i).cast("long") * (1 << 32)
        balls = near.select((of + F.col("word").bitwiseXOR(F.col("flip"))).alias("ball"), "k", "fp")
        shared = balls.withColumn("size", F.count("*").over(Window.partitionBy("ball"))).where("size > 1")
        met.append(settle(shared, "copy-balls"))
    if not met:
        return nodes.where("false").select(*[F.col(c).alias(a) for a, c in zip(("u", "ku", "nu", "v", "kv", "nv"), ("node", "k", "n") * 2, strict=True)])
    every = reduce(DataFrame.unionByName, met)
    weighed = every.withColumn("weight", F.sum("size").over(Window.partitionBy("k")))
    hub = F.max(F.struct("weight", "k", "fp")).over(Window.partitionBy("ball"))
    toward = weighed.select("k", "fp", hub.alias("hub")).where("k <> hub.k").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= params.far)
    best = settle(toward.groupBy("k").agg(F.max("hub").alias("hub")).select("k", F.col("hub.k").alias("hub")), "copy-ball-hubs")
    for table in met:
        discard(table)
    left = nodes.select(F.col("node").alias("u"), F.col("k").alias("ku"), F.col("n").alias("nu"))
    right = nodes.select(F.col("node").alias("v"), F.col("k").alias("kv"), F.col("n").alias("nv"))
    pairs = best.join(left, F.col("k") == F.col("ku")).join(right, F.col("hub") == F.col("kv"))
    return _turned(pairs.select("u", "ku", "nu", "v", "kv", "nv"))


def links(docs: DataFrame, nodes: DataFrame, params: Params = Params()) -> DataFrame:
    """nodes (node, k, n, keys, prints) -> (u, v): verified pairs that connect all candidates similar enough."""
    near = materialize(ball_pairs(nodes, params), "copy-ball-pairs")
    dealt = nodes.select("node", "k", "n", F.explode("keys").alias("bucket"))
    shared = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "copy-buckets")
    members = materialize(dealt.join(shared, "bucket"), "copy-members")
    weights = members.groupBy("node", "k").agg(F.sum("size").alias("weight"))
    weighed = members.join(weights, ["node", "k"])
    me = F.struct("weight", (-F.col("node")).alias("turned"), "node", "k", "n")
    members = materialize(weighed.join(weighed.groupBy("bucket").agg(F.max(me).alias("hub")), "bucket").select("bucket", "node", "k", "n", "hub"), "copy-hubs")
    asked = members.select(F.col("node").alias("doc_id")).union(near.select("u")).union(near.select("v"))
    ids = materialize(asked.distinct(), "copy-ids")
    sets = materialize(_sets(docs, ids, params).dropDuplicates(["node", "k"]), "copy-sets")
    ends = [F.col("hub.node").alias("u"), F.col("hub.k").alias("ku"), F.col("hub.n").alias("nu"), F.col("node").alias("v"), F.col("k").alias("kv"), F.col("n").alias("nv")]
    found = verified(sets, near, params)
    labels = materialize(connected_components(found), "copy-labels")
    best = members.where("hub.node <> node").groupBy("node", "k", "n").agg(F.max("hub").alias("hub")).withColumn("at", F.col("hub.node"))
    ours, theirs = labels.withColumnRenamed("component", "ours"), labels.select(F.col("node").alias("at"), F.col("component").alias("theirs"))
    open_ = best.join(ours, "node", "left").join(theirs, "at", "left").where("coalesce(ours, node) <> coalesce(theirs, at)")
    found = found.unionByName(verified(sets, _turned(open_.select(*ends)), params))
    labelled = materialize(_labelled(members, found), "copy-labelled")
    held = labelled.where("hub.node = node").select("bucket", F.col("component").alias("of_hub"))
    apart = labelled.join(held, "bucket").where("component <> of_hub")
    found = found.unionByName(verified(sets, _turned(apart.select(*ends)), params))
    marked = materialize(_labelled(members, found), "copy-marked")
    split = marked.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a < b").select("bucket", "size")
    rest = materialize(marked.join(split, "bucket").select("bucket", "node", "k", "n", "hub", "component", "size"), "copy-apart")
    few = rest.where(F.col("size") <= params.crowd)
    left = few.select("bucket", F.col("node").alias("u"), F.col("k").alias("ku"), F.col("n").alias("nu"), F.col("component").alias("cu"))
    right = few.select("bucket", F.col("node").alias("v"), F.col("k").alias("kv"), F.col("n").alias("nv"), F.col("component").alias("cv"))
    cross = left.join(right, "bucket").where("u < v AND cu <> cv").select("u", "ku", "nu", "v", "kv", "nv")
    crowded = _differing(sets, rest.where(F.col("size") > params.crowd), params)
    return found.unionByName(verified(sets, cross.unionByName(crowded), params))


def components(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, h, component_id) for every row of docs, h being a hash of its text. component_id is the smallest doc_id reachable over links, the row's
    own included. Texts without words are alike. Rows with a null doc_id take no part and have a null component_id."""
    signed = materialize(signatures(docs, params), "copy-signatures")
    nodes = signed.where("doc_id IS NOT NULL").groupBy("k", "k2", "n").agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys"), F.min("prints").alias("prints"))
    nodes = materialize(nodes, "copy-nodes")
    found = connected_components(links(docs, nodes, params)).select("node", "component")
    named = nodes.select("k", "k2", "node").join(found, "node", "left").select("k", "k2", F.coalesce("component", "node").alias("component_id"))
    joined = signed.select("doc_id", "h", "k", "k2").join(named, ["k", "k2"], "left")
    return joined.select("doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs without all but one document of each component: the row of its smallest doc_id stays. Where that id is
    repeated one of its rows in the component stays, the one whose text and then whose row has the smallest hash. Rows
    without a doc_id stay. Columns are those of docs."""
    kept = components(docs, params).where("doc_id = component_id").groupBy(F.col("doc_id").alias("__kept")).agg(F.min("h").alias("__h"))
    marked = docs.join(kept, docs["doc_id"] == F.col("__kept")).where(F.xxhash64(docs["text"]) == F.col("__h")).select(*[docs[c] for c in docs.columns])
    return first_rows(marked, "doc_id").unionByName(docs.where("doc_id IS NULL"))
