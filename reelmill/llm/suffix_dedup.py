"""Removal of repeated 50-byte strings by a Burrows-Wheeler transform built column by column.

Every string of `length` bytes has a key, the least hash of the `anchor`-byte strings inside it, so equal strings have
equal keys wherever they stand. Neighbouring strings of one key are cut out together as a segment. A first pass over the
texts sends one row a segment to its key; keys met once go. What stays is cut out of the texts again, equal segments
become one with the smallest doc_id, and all different segments of a key form a collection. For collections the transform
and the common prefixes are built as for many documents at once: in each round one symbol of every segment, from its end
on, is put into the transform in one sequential pass, and the common prefixes next to it are brought up to date. Stretches
of common prefixes of `length` or more are the equal strings; the least doc_id of a stretch owns them.

The files between the steps are Parquet tables of the shared folder. The arrays of a round belong to one bounded set of
collections and stay in memory, as a task's own files would be machine-local. A key with very many segments is cut up
again by longer anchors, down to single strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmill.llm._shared import discard, settle

#: Stands for a null doc_id: rows without one count together as the last document.
LAST_DOC = 2**63 - 1


@dataclass(frozen=True)
class Params:
    length: int = 50
    #: Lengths of anchors; the later ones serve keys with more than max_group segments. The last is the whole string.
    anchors: tuple[int, ...] = (24, 36, 50)
    seed: int = 42
    max_group: int = 20_000
    #: Bytes of texts that one pass compares before it sends keys out, of texts that are cut at once, and of segments whose transform is built at once.
    block_bytes: int = 8_000_000
    piece_bytes: int = 1_000_000
    built_bytes: int = 350_000


@lru_cache(maxsize=8)
def _byte_hashes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


def keys(data: np.ndarray, length: int, anchor: int, seed: int) -> np.ndarray:
    """The key of every string of length bytes in data: the least mixed hash of its anchors."""
    h, size, power = _byte_hashes(seed)[data], 1, np.uint64(0x9E3779B97F4A7C15)
    parts, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if anchor & size:
                parts = h if parts is None else parts[: len(h) - done] * power + h[done:]
                done += size
            if size * 2 > anchor:
                break
            h, size, power = h[:-size] * power + h[size:], size * 2, power * power
        parts = parts[: len(data) - anchor + 1]
        parts = (parts ^ (parts >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        parts ^= parts >> np.uint64(29)
    width, span = length - anchor + 1, 1
    while span * 2 <= width:
        parts, span = np.minimum(parts[:-span], parts[span:]), span * 2
    return parts if span == width else np.minimum(parts[: len(parts) - (width - span)], parts[width - span :])


def cut(data: np.ndarray, level: int, params: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, key) of the segments of data: runs of strings with one key, of length - anchor + 1 strings at most."""
    starts, counts, found = [], [], []
    anchor = params.anchors[level]
    most = params.length - anchor + 1
    for at in range(0, len(data) - params.length + 1, params.piece_bytes):
        k = keys(data[at : at + params.piece_bytes + params.length - 1], params.length, anchor, params.seed + level)
        edges = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
        sizes = np.diff(edges)
        if sizes.max() > most:
            parts = -(-sizes // most)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = np.repeat(edges[:-1], parts) + step * most
            edges = np.r_[begin, len(k)]
            sizes = np.diff(edges)
        starts.append(edges[:-1] + at)
        counts.append(sizes)
        found.append(k[edges[:-1]])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(found).view(np.int64)


def transform(symbols: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common) of the segments whose bytes and sizes these are: the Burrows-Wheeler transform of a collection,
    symbols one above their byte and 0 at a segment's start, and the common prefix of each suffix with the one before it, up
    to depth. Suffixes of no symbols come first, in the order of the segments."""
    m, ends = len(sizes), np.cumsum(sizes)
    bwt, common = np.zeros(m, np.uint16), np.zeros(m, np.uint8)
    at = np.arange(m)
    for j in range(1, int(sizes.max()) + 1 if m else 1):
        live = np.flatnonzero(sizes >= j)
        place = at[live]
        bwt[place] = symbols[ends[live] - j].astype(np.uint16) + 1
        order = np.argsort(bwt, kind="stable")
        open_ = len(bwt) - int(np.count_nonzero(bwt))
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        by = np.argsort(-place, kind="stable")
        live, place = live[by], place[by]
        old = rank[place].astype(np.int64)
        new = old - open_ + m
        # common prefixes with the neighbours that start alike: one more than the least between where the rest stands
        low = order[old - 1]
        alike = (old > open_) & (bwt[low] == bwt[place])
        high = order[np.minimum(old + 1, len(bwt) - 1)]
        after = (old + 1 < len(bwt)) & (bwt[high] == bwt[place])
        padded = np.r_[common, np.uint8(0)]
        before_least = np.minimum.reduceat(padded, np.stack([np.where(alike, low + 1, place), place + 1], 1).ravel())[::2]
        by_high = np.argsort(-high, kind="stable")
        high_to = np.where(after, high, place)
        spans = np.stack([np.minimum(place + 1, len(padded) - 1), np.minimum(high_to + 1, len(padded) - 1)], 1)[by_high]
        after_least = np.empty(len(place), np.uint8)
        after_least[by_high] = np.minimum.reduceat(padded, spans.ravel())[::2]
        grown = len(bwt) + len(live)
        stays = np.ones(grown, bool)
        stays[new] = False
        wider, prefixes = np.zeros(grown, np.uint16), np.zeros(grown + 1, np.uint8)
        wider[stays] = bwt
        prefixes[:-1][stays] = common
        prefixes[new] = np.where(alike, np.minimum(before_least, depth - 1) + 1, 0)
        prefixes[new + 1] = np.where(after, np.minimum(after_least, depth - 1) + 1, 0)
        bwt, common = wider, prefixes[:-1]
        at[live] = new
    return bwt, common


def build(segments: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """transform() of segments."""
    return transform(np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments], np.int64), depth)


def least_owners(symbols: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For every string of length bytes of the segments, one behind the other, the least of docs that holds it."""
    bwt, common = transform(symbols, sizes, length)
    # walks all segments from their ends along the transform, to learn whose suffix stands where
    order = np.argsort(bwt, kind="stable")
    open_ = len(bwt) - int(np.count_nonzero(bwt))
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt)) - open_ + len(sizes)
    counts = sizes - length + 1
    first = np.cumsum(counts) - counts
    at, spots = np.arange(len(sizes)), np.empty(int(counts.sum()), np.int64)
    for j in range(1, int(sizes.max()) + 1):
        live = np.flatnonzero(sizes >= j)
        at[live] = rank[at[live]]
        if j >= length:
            spots[first[live] + sizes[live] - j] = at[live]
    stretch = np.cumsum(common < length)
    whose, group = np.repeat(docs, counts), stretch[spots]
    by = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
    out = np.empty(len(by), np.int64)
    out[by] = np.repeat(np.minimum.reduceat(whose[by], edges), np.diff(np.r_[edges, len(by)]))
    return out


def owners(segments: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    """least_owners() of segments, one array each."""
    sizes = np.array([len(s) for s in segments], np.int64)
    found = least_owners(np.frombuffer(b"".join(segments), np.uint8), sizes, docs, length)
    return np.split(found, np.cumsum(sizes - length + 1)[:-1])


def _texts(docs: DataFrame, *rest: str) -> DataFrame:
    """(doc, row_hash, data): a row's document, the hash of its text, which tells rows of one document apart, and its bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc"), F.xxhash64(text).alias("row_hash"), F.encode(text, "utf-8").alias("data"), *rest)


def _met(texts: DataFrame, params: Params) -> DataFrame:
    """(doc, starts): the segments whose key stands in two documents or more.

    A block of texts is compared inside itself first: a key that several of its documents hold is known to be met, so its
    segments need no answer and travel by a hash of their place, and the block asks after it once. A key sends one row a
    block however many documents hold it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def send() -> pa.RecordBatch:
            key, start = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            doc = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
            order = np.lexsort((doc, key))
            key, start, doc = key[order], start[order], doc[order]
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            runs = np.diff(np.r_[edges, len(key)])
            several = np.repeat(doc[edges] != doc[edges + runs - 1], runs) if len(key) else np.empty(0, bool)
            head = np.zeros(len(key), bool)
            head[edges] = True
            with np.errstate(over="ignore"):
                spread = (doc * np.int64(-7046029254386353131) + start) * np.int64(-4658895280553007687)
            return pa.RecordBatch.from_arrays([pa.array(np.where(several & ~head, spread, key)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(several)], ["key", "doc", "start", "met"])

        for batch in batches:
            for doc, data in zip(batch["doc"].to_pylist(), batch["data"], strict=True):
                data = np.frombuffer(data.as_buffer(), np.uint8)
                start, _, key = cut(data, 0, params)
                held.append((doc, key, start))
                size += len(data)
                if size >= params.block_bytes:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    sent = texts.select("doc", "data").mapInArrow(run, "key long, doc long, start int, met boolean")
    times = F.count("*").over(Window.partitionBy("key"))
    return sent.withColumn("times", times).where("met OR times > 1").groupBy("doc").agg(F.collect_list("start").alias("starts"))


def _segments(texts: DataFrame, met: DataFrame, params: Params) -> DataFrame:
    """(doc, row_hash, start, key, segment) of the segments in met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, found, cuts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
            for value, met_starts in zip(batch["data"], batch["starts"], strict=True):
                whole = value.as_py()
                start, count, key = cut(np.frombuffer(whole, np.uint8), 0, params)
                keep = np.isin(start, met_starts.values.to_numpy())
                start, count = start[keep], count[keep]
                starts.append(start)
                found.append(key[keep])
                cuts += [whole[a:b] for a, b in zip(start.tolist(), (start + count + params.length - 1).tolist(), strict=True)]
            n = [len(x) for x in starts[1:]]
            own = [pa.array(np.repeat(batch[c].to_numpy(), n)) for c in ("doc", "row_hash")]
            cells = [*own, pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(found)), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["doc", "row_hash", "start", "key", "segment"])

    return texts.join(met, "doc").mapInArrow(run, "doc long, row_hash long, start int, key long, segment binary")


def _built(groups: DataFrame, params: Params) -> DataFrame:
    """groups (key, segment, low) -> (segment, owners): one owner where all strings of a segment have the same, else one each."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        key, low = rows["key"].to_numpy(), rows["low"].to_numpy()
        segments = rows["segment"].combine_chunks()
        segments = segments.combine_chunks() if isinstance(segments, pa.ChunkedArray) else segments
        # a collection of one segment has no other to share with: its document owns all its strings
        edge = np.r_[True, key[1:] != key[:-1], True]
        alone = edge[:-1] & edge[1:]
        sizes = pc.binary_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
        same, least = alone.copy(), low.copy()
        counts, flat = np.ones(len(low), np.int64), low
        if not alone.all():
            many = segments.filter(pa.array(~alone))
            offsets = np.frombuffer(many.buffers()[1], np.int32)[many.offset : many.offset + len(many) + 1]
            symbols = np.frombuffer(many.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            found = least_owners(symbols, sizes[~alone], low[~alone], params.length)
            n = sizes[~alone] - params.length + 1
            first = np.cumsum(n) - n
            least[~alone] = np.minimum.reduceat(found, first)
            same[~alone] = least[~alone] == np.maximum.reduceat(found, first)
            counts[~alone] = np.where(same[~alone], 1, n)
            flat = np.repeat(least, counts)
            flat[np.repeat(~same, counts)] = found[np.repeat(~same[~alone], n)]
        held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([segments, held], ["segment", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            key = batch["key"].to_numpy()
            ends = np.cumsum(pc.binary_length(batch["segment"]).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(key):
                # as many rows as fill the rest, and on to the end of their key
                stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + params.built_bytes - size))
                full = stop < len(key)
                if full:
                    change = np.flatnonzero(key[stop + 1 :] != key[stop:-1])
                    full, stop = len(change) > 0, stop + 1 + int(change[0]) if len(change) else len(key)
                rows.append(batch.slice(at, min(stop, len(key)) - at))
                size += int(ends[min(stop, len(key)) - 1] - (ends[at - 1] if at else 0))
                at = min(stop, len(key))
                if full:
                    yield made(pa.Table.from_batches(rows))
                    rows, size = [], 0
        if rows:
            yield made(pa.Table.from_batches(rows))

    return groups.repartition("key").sortWithinPartitions("key").select("key", "segment", "low").mapInArrow(run, "segment binary, owners array<long>")


def _owned(groups: DataFrame, params: Params, level: int = 0) -> DataFrame:
    """groups (key, segment, low), all segments different -> (segment, owners)."""
    crowded = groups.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > params.max_group).select("key")
    crowded = settle(crowded, "suffix-crowded")
    if level + 1 == len(params.anchors) or not crowded.head(1):
        return _built(groups, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for segment, low in zip(batch["segment"].to_pylist(), batch["low"].to_pylist(), strict=True):
                for start, count, key in zip(*cut(np.frombuffer(segment, np.uint8), level + 1, params), strict=True):
                    out.append((segment, int(start), int(count), int(key), segment[start : start + count + params.length - 1], low))
            kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["parent", "start", "count", "key", "segment", "low"]) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], ["parent", "start", "count", "key", "segment", "low"])

    parts = groups.join(crowded, "key", "left_semi").select("segment", "low").mapInArrow(run, "parent binary, start int, count int, key long, segment binary, low long")
    parts = settle(parts, "suffix-parts")
    inner = _owned(settle(parts.groupBy("key", "segment").agg(F.min("low").alias("low")), "suffix-groups"), params, level + 1)
    each = F.when(F.size("owners") == 1, F.array_repeat(F.get("owners", F.lit(0)), F.col("count"))).otherwise(F.col("owners"))
    whole = parts.join(inner, "segment").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("start", each.alias("o")))).alias("runs"))
    back = whole.select(F.col("parent").alias("segment"), F.flatten(F.transform("runs", lambda r: r["o"])).alias("owners"))
    return _built(groups.join(crowded, "key", "left_anti"), params).unionByName(back)


def _marks(docs: DataFrame, params: Params) -> DataFrame:
    """(doc, row_hash, marks): for rows that lose bytes, the starts of strings that a smaller document holds, as starts of
    segments with a bit for each string."""
    texts = _texts(docs)
    met = settle(_met(texts, params), "suffix-met")
    found = settle(_segments(texts, met, params), "suffix-segments")
    discard(met)
    groups = settle(found.groupBy("key", "segment").agg(F.min("doc").alias("low")), "suffix-groups")
    owned = settle(_owned(groups, params), "suffix-owned")
    discard(groups)
    ids = lambda: [F.xxhash64("segment").alias("s1"), F.xxhash64(F.lit(1), "segment").alias("s2")]
    places = found.select("doc", "row_hash", "start", *ids())
    bit = lambda o, i: F.when(o < F.col("doc"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    bits = F.aggregate(F.transform("owners", bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    mask = F.when(F.size("owners") == 1, F.when(F.get("owners", F.lit(0)) < F.col("doc"), F.lit(-1).cast("long")).otherwise(0)).otherwise(bits)
    joined = places.join(owned.select(*ids(), "owners", (F.octet_length("segment") - params.length + 1).alias("n")), ["s1", "s2"])
    hit = joined.select("doc", "row_hash", "start", "n", mask.alias("mask")).where("mask <> 0")
    marks = settle(hit.groupBy("doc", "row_hash").agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks")), "suffix-marks")
    discard(found)
    discard(owned)
    return marks


def removed(length: int, n_bytes: int, start: np.ndarray, n: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n_bytes are covered by marked strings: n of them from each start, those whose bit is set (-1: all)."""
    whole = mask == -1
    part, many, bits = start[~whole], n[~whole], mask[~whole]
    at = np.repeat(part, many)
    i = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    set_ = (np.repeat(bits, many) >> i) & 1 == 1
    hit = at[set_] + i[set_]
    begin, end = np.r_[start[whole], hit], np.r_[start[whole] + n[whole] - 1, hit] + length
    edges = np.bincount(begin, minlength=n_bytes + 1) - np.bincount(end, minlength=n_bytes + 1)
    return np.cumsum(edges[:-1]) > 0


def dedup(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with data, the bytes of its text that stay, and n_bytes, n_removed and n_spans (columns of those names are
    replaced, text goes: bytes that stay need not be UTF-8).

    A byte goes if a string of `length` bytes over it also starts in a document of smaller doc_id; of several documents the
    smallest keeps it. Rows with the same doc_id are one document and take nothing from each other, and so are all rows with
    a null doc_id, which counts as the largest. Null text is empty; texts shorter than a string lose nothing; very long ones
    are cut in pieces and read whole. Repeated rows lose the same bytes. An empty table gives an empty table; further columns
    pass through.
    """
    own = ("text", "data", "n_bytes", "n_removed", "n_spans")
    rest = [c for c in docs.columns if c not in own]
    marks = _marks(docs.select("doc_id", "text"), params)
    kept = _texts(docs, F.struct(*[F.col(c) for c in rest]).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                whole, marks = batch["data"][i].as_py(), batch["marks"][i].values
                if marks is None:
                    out.append((whole, len(whole), 0, 0))
                    continue
                start, n, mask = (marks.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "mask"))
                gone = removed(params.length, len(whole), start, n, mask)
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((np.frombuffer(whole, np.uint8)[~gone].tobytes(), len(whole), int(gone.sum()), spans))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            cells = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["rest"], *cells], ["rest", "data", "n_bytes", "n_removed", "n_spans"])

    joined = kept.join(marks, ["doc", "row_hash"], "left").select("rest", "data", "marks")
    done = joined.mapInArrow(run, f"rest {kept.schema['rest'].dataType.simpleString()}, data binary, n_bytes long, n_removed long, n_spans long")
    return done.select("rest.*", "data", "n_bytes", "n_removed", "n_spans")


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The columns of op11."""
    return dedup(docs.select("doc_id", "text"), params).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))
