"""Spelling variants by dynamic programming over sorted lists.

Words are counted on the JVM. Two words one edit apart agree outside the block of letters that holds their first
difference, so every word is listed once for each block of its letters, under what stands before and after the block, and
for the length that it has or the one below. Lists start from halves of a word; a list beyond `max_list` words is dealt out
again by halves of its block, down to blocks of one letter, whose lists the alphabet bounds. Inside a list, sorted by the
letters of the block, the queries scan the sorted words together: a banded row of the edit matrix is computed once for
each prefix that neighbouring words share (their LCP), and a range is skipped as soon as its shared prefix needs more than
one edit. What a list finds is reduced to a count and a best word per word before it travels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm._shared import ascii_lower, discard, settle

#: Fixed value: the letters of a word.
LETTERS = r"[A-Za-zÀ-ÿ]+"


@dataclass(frozen=True)
class Params:
    #: One occurrence in so many, by checksum, loses a letter (0: none does); least length and count of a word.
    noise: int = 199
    least_chars: int = 6
    least_count: int = 5
    #: A word's form has at least so many times its count (more than once, so that chains end).
    form_ratio: int = 5
    #: Words of one list at most, queries that scan together, and letters of the lists held at once.
    max_list: int = 20_000
    queries: int = 4096
    held_letters: int = 1_000_000


def vocabulary(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with their planted deletions, counted over all texts. Null texts have
    none; a null doc_id is written as nothing. Every row counts, repeated ones too."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= params.least_chars)
    word = F.col("run")
    if params.noise:
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % params.noise == 0, cut).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= params.least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= params.least_count)


def _listed(rows: DataFrame) -> DataFrame:
    """rows (word, n, l, s, e) with key, the list they stand in, and block, their letters there. l is the shorter length of
    a pair, [s, e) the block in letters of the shorter word; what follows the block is counted from the word's end."""
    length, after = F.char_length("word"), F.col("l") - F.col("e")
    before, rest = F.substring("word", F.lit(1), F.col("s")), F.substring("word", length - after + 1, after)
    key = F.concat_ws(":", F.lpad(F.col("l").cast("string"), 9, "0"), "s", "e", before, rest)
    return rows.withColumn("key", key).withColumn("block", F.substring("word", F.col("s") + 1, length - after - F.col("s")))


def lists(words: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, n, l, s, e, key, block): every word in each list where a word one edit away could stand."""
    least = F.filter(F.array(F.char_length("word"), F.char_length("word") - 1), lambda x: x > 0)
    rows = words.select("word", "n", F.explode(least).alias("l"))
    half = F.floor(F.col("l") / 2).cast("int")
    ends = F.filter(F.array(F.struct(F.lit(0).alias("s"), half.alias("e")), F.struct(half.alias("s"), F.col("l").alias("e"))), lambda b: b["s"] < b["e"])
    rows = _listed(rows.select("word", "n", "l", F.explode(ends).alias("b")).select("word", "n", "l", "b.s", "b.e"))
    done = None
    while True:
        crowded = settle(rows.where("e - s > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > params.max_list).select("key"), "spelling-crowded")
        if not crowded.head(1):
            return rows if done is None else done.unionByName(rows)
        fits = rows.join(crowded, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        middle = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
        ends = F.array(F.struct("s", middle.alias("e")), F.struct(middle.alias("s"), "e"))
        split = rows.join(crowded, "key", "left_semi").select("word", "n", "l", F.explode(ends).alias("b"))
        rows = _listed(split.select("word", "n", "l", "b.s", "b.e"))


def scan(blocks: list[str], starts: np.ndarray, asks: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (asking, found, lcp) of blocks one edit apart inside a list. blocks are sorted inside each list; starts holds
    the first index of every list, and the number of blocks at its end; asks are the indices that ask."""
    lengths = np.array([len(b) for b in blocks], np.int32)
    width = int(lengths.max()) if len(blocks) else 0
    letters = np.zeros((len(blocks), width + 3), np.uint32)
    if width:
        letters[:, 1 : width + 1] = np.array(blocks, dtype=f"<U{width}").view(np.uint32).reshape(len(blocks), width)
    differ = letters[1:, 1:] != letters[:-1, 1:]
    lcp = np.full(len(blocks) + 1, -1, np.int32)
    lcp[1:-1] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp[starts] = -1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(asks), queries):
        q = asks[at : at + queries]
        home = np.searchsorted(starts, q, "right")
        lo, hi = starts[home - 1].copy(), starts[home].copy()
        # the matrix's cells left of, on and right of the diagonal; 2 stands for two or more
        left, on, right = np.full(len(q), 2, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        for depth in range(width + 1):
            ends = lengths[lo] == depth
            if ends.any():
                gap = lengths[q] - depth
                cell = np.select([gap == -1, gap == 0, gap == 1], [left, on, right], 2)
                hit = ends & (cell == 1)
                found.append((q[hit], lo[hit]))
                lo = lo + ends
            live = lo < hi
            if not live.any():
                break
            q, lo, hi, left, on, right = (x[live] for x in (q, lo, hi, left, on, right))
            edges = np.flatnonzero(lcp <= depth)
            first, last = np.searchsorted(edges, lo, "right"), np.searchsorted(edges, hi, "left")
            parts = last - first + 1
            total, base = int(parts.sum()), np.cumsum(parts) - parts
            up = np.repeat(np.arange(len(q)), parts)
            step = np.arange(total) - base[up]
            begin = np.where(step == 0, lo[up], edges[np.minimum(first[up] + step - 1, len(edges) - 1)])
            end = np.where(step == parts[up] - 1, hi[up], edges[np.minimum(first[up] + step, len(edges) - 1)])
            c, asked = letters[begin, depth + 1], q[up]
            was_left, was_on, was_right = left[up], on[up], right[up]
            beyond = np.minimum(depth + 2, width + 2)
            new_left = np.minimum(was_on + 1, was_left + (c != letters[asked, depth]))
            new_on = np.minimum(np.minimum(was_on + (c != letters[asked, depth + 1]), new_left + 1), was_right + 1)
            new_right = np.minimum(was_right + (c != letters[asked, beyond]), new_on + 1)
            keep = np.minimum(np.minimum(new_left, new_on), new_right) <= 1
            q, lo, hi = asked[keep], begin[keep], end[keep]
            left, on, right = (np.minimum(x[keep], 2).astype(np.int8) for x in (new_left, new_on, new_right))
            if not len(q):
                break
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    shared = np.empty(len(a), np.int64)
    for at in range(0, len(a), 100_000):
        part = slice(at, at + 100_000)
        shared[part] = (letters[a[part], 1:] != letters[b[part], 1:]).argmax(axis=1)
    return a, b, shared


def _best(table: pa.Table, params: Params) -> pa.RecordBatch:
    """What whole lists find: for each word that has near words, how many, and the one of largest count."""
    keys, words, blocks = table["key"].to_pylist(), table["word"].to_pylist(), table["block"].to_pylist()
    n, l, s, e = (table[c].to_numpy() for c in ("n", "l", "s", "e"))
    changes = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    short = np.array([len(w) for w in words]) == l
    a, b, shared = scan(blocks, np.array([*changes, len(keys)]), np.flatnonzero(short), params.queries)
    # a pair counts in the block of its first difference only; blocks meet, so that is one block
    own = (shared + s[a] < e[a]) | (e[a] == l[a])
    a, b = a[own], b[own]
    back = ~short[b]
    one, other = np.concatenate([a, b[back]]), np.concatenate([b, a[back]])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(one)])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in one[first]], pa.string()), pa.array(counts, pa.int64()), pa.array([words[i] for i in other[first]], pa.string()), pa.array(n[other[first]], pa.int64())],
        ["word", "near", "best", "best_n"],
    )


def near_words(words: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, n_near, best, best_n) for the words (word, n) that have words one edit away: how many they are, and the one
    of largest n, of several the first by code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            letters += batch.num_rows * (4 + max(len(batch["block"][-1].as_py()), len(batch["block"][0].as_py())))
            if letters < params.held_letters:
                continue
            table = pa.Table.from_batches(held)
            last = table["key"][-1].as_py()
            cut = table.num_rows
            while cut and table["key"][cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield _best(table.slice(0, cut), params)
                held, letters = table.slice(cut).combine_chunks().to_batches(), 0
        if held:
            yield _best(pa.Table.from_batches(held), params)

    rows = lists(words, params).repartition("key").sortWithinPartitions("key", "block").select("key", "word", "block", "n", "l", "s", "e")
    parts = rows.mapInArrow(run, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n"))


def variants(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(word, n, n_near, form, form_n, root): each word of the texts with its count, how many words are one edit away, the
    near word of largest count if that is form_ratio times the word's or more, and the last form of the chain of forms.

    Null and empty texts have no words; very long texts and words are read whole; ties go to the first word by code points;
    repeated rows count each; an empty table has no words; other columns are not read. Counts rise along a chain, so it
    ends; chains are followed by doubling.
    """
    words = settle(vocabulary(docs, params), "spelling-words")
    near = near_words(words, params)
    form = F.col("best_n") >= F.col("n") * params.form_ratio
    known = settle(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")
        ),
        "spelling-near",
    )
    discard(words)
    chains = settle(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(chains.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "spelling-chains")
        ends = moved.where("went").head(1) == []
        discard(chains)
        chains = moved.select("word", "root")
        if ends:
            break
    return known.join(chains, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The columns of op12."""
    return variants(docs.select("doc_id", "text"), params).select("word", "form", "root", "n", "n_near", "form_n")
