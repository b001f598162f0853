"""Similarities of short texts, and a fuzzy join that loses no pair.

ratio is 200 x (longest common subsequence) / (sum of lengths). It can reach t only if
200 x (shorter length) >= t x (sum of lengths), so the join deals texts into blocks of one length each, pairs only blocks
whose lengths allow t, bounds a block pair's scores by shared letters and scores the rest bit-parallel on whole arrays.
Before that, texts that differ by a few letters meet by an equi-join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.sources.scratch import scratch_path
from reelmill.views import spread

#: Texts of a tile of each side that are scored at once, texts in a block at most, pairs of blocks that the work is dealt into; rows of
#: a broadcast table of lengths; pairs of texts that are worth a task.
LEFT_TILE, RIGHT_TILE, BLOCK, DEALT, MAX_BROADCAST, WORTH = 1000, 4000, 50_000, 1000, 100_000, 20_000_000


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    row = (1 << len(b)) - 1
    full = row
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def ratio_of(a: str | None, b: str | None) -> float:
    """S1. Two empty texts are equal; a null text is empty."""
    a, b = a or "", b or ""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def _sorted_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def _partial(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text against any stretch of the longer one of at most its length; 0 where the
    letters that they share rule `least` out."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, shared = len(short), (Counter(a) & Counter(b)).total()
    if not shared or 200.0 * shared / (n + shared) < least:
        return 0.0
    best = 0.0
    for i in range(1 - n, len(long)):
        best = max(best, ratio_of(short, long[max(0, i) : i + n]))
        if best == 100.0:
            break
    return best


def _token_set(a: str, b: str, scorer) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [scorer(one, two)]
    return max([*found, scorer(both, one), scorer(both, two)]) if both else max(found)


def wratio_of(a: str | None, b: str | None, least: float = 0.0) -> float:
    """S3: the best of ratio, token ratios x .95, and for lengths 1.5 times apart or more partial ratios x .9 (.6 from 8 times on).
    A score below `least` may come out lower than it is."""
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio_of(a, b)
    sa, sb = _sorted_tokens(a), _sorted_tokens(b)
    if apart < 1.5:
        return max(best, 0.95 * ratio_of(sa, sb), 0.95 * _token_set(a, b, ratio_of))
    scale = 0.6 if apart >= 8 else 0.9
    near, loose = least / scale, least / scale / 0.95
    return max(best, scale * _partial(a, b, near), scale * 0.95 * max(_partial(sa, sb, loose), _token_set(a, b, lambda x, y: _partial(x, y, loose))))


def block_ratio_of(a: str | None, b: str | None) -> float:
    """200 x letters in common blocks over all letters: the longest common block (the first of several) is taken, then the
    same left and right of it. Never above ratio. Two empty texts are equal; a null text is empty."""
    a, b = a or "", b or ""
    total, open_ = 0, [(0, len(a), 0, len(b))]
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    while open_:
        a0, a1, b0, b1 = open_.pop()
        at, bt, size, runs = a0, b0, 0, {}
        for i in range(a0, a1):
            now = {}
            for j in places.get(a[i], ()):
                if b0 <= j < b1:
                    now[j] = n = runs.get(j - 1, 0) + 1
                    if n > size:
                        at, bt, size = i - n + 1, j - n + 1, n
            runs = now
        if size:
            total += size
            open_ += [(a0, at, b0, bt), (at + size, a1, bt + size, b1)]
    return 100.0 if not a and not b else 200.0 * total / (len(a) + len(b))


def block_ratio(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([block_ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def can_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the texts may have a ratio of least or more: it bounds their edit distance, which the JVM computes."""
    return 100 * F.levenshtein(a, b) <= (100 - least) * (F.length(a) + F.length(b))


def letter_bits(text: Column) -> Column:
    """A bit for each letter that the text holds, letters 64 code points apart sharing one."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))


def bits_reach(a: Column, b: Column, a_bits: Column, b_bits: Column, least: float) -> Column:
    """can_reach() from letter_bits() alone: each bit of one text only is a letter that the other one lacks. True for more pairs, in a
    fraction of the time."""
    return 100 * F.bit_count(a_bits.bitwiseXOR(b_bits)) <= (100 - least) * (F.length(a) + F.length(b))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def wratio(a: Column, b: Column, least: float = 0.0) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([wratio_of(x, y, least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def parts(text: Column) -> Column:
    """What may_reach() reads of a text; words end where Python's do."""
    words = F.filter(F.split(text, r"[\s\p{Z}\x1c-\x1f\x85]+"), lambda w: w != "")
    once = F.array_distinct(words)
    return F.struct(text.alias("text"), once.alias("words"), F.array_join(F.array_sort(words), " ").alias("sorted"), F.array_join(F.array_sort(once), " ").alias("once"), letter_bits(text).alias("bits"))


def may_reach(x: Column, y: Column, least: float) -> Column:
    """Whether two texts, as parts(), may have a ratio or a weighted ratio (S3) of least or more: they share a word, or edit distances of
    the texts or their sorted words allow it, or one is half as long again as the other and holds nearly all letters of the shorter."""
    n, m = F.length(x["text"]), F.length(y["text"])
    near = bits_reach(x["text"], y["text"], x["bits"], y["bits"], least) & (can_reach(x["text"], y["text"], least) | can_reach(x["sorted"], y["sorted"], least) | can_reach(x["once"], y["once"], least))
    short, k = F.when(n <= m, x["bits"]).otherwise(y["bits"]), F.least(n, m)
    lacks = F.bit_count(short.bitwiseXOR(short.bitwiseAND(x["bits"].bitwiseAND(y["bits"]))))
    repeats = (x["sorted"] != x["once"]) | (y["sorted"] != y["once"])
    inside = (F.greatest(n, m) >= 1.5 * k) & (repeats | (200 * (k - lacks) >= least / 0.9 * (2 * k - lacks) - 1e-6))
    return F.arrays_overlap(x["words"], y["words"]) | inside | near


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """S2."""
    return ratio(sorted_tokens(a), sorted_tokens(b))


def _tokens(text: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens, 0 if a side has none."""
    x, y = _tokens(a), _tokens(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def _sized(sets: Column, size: int) -> Column:
    return F.transform(sets, lambda s: F.struct(s["text"].alias("token_set"), F.lit(size).alias("set_size")))


def _subsets(tokens: Column, most: int) -> Column:
    """All sets of 1 to `most` of the tokens, each as its sorted tokens joined by a space, with its size."""
    spots = F.transform(F.array_sort(tokens), lambda t, i: F.struct(i.alias("last"), t.alias("text")))
    longer = lambda s: F.transform(F.filter(spots, lambda p: p["last"] > s["last"]), lambda p: F.struct(p["last"].alias("last"), F.concat_ws(" ", s["text"], p["text"]).alias("text")))
    level, found = spots, [_sized(spots, 1)]
    for size in range(2, most + 1):
        level = F.flatten(F.transform(level, longer))
        found.append(_sized(level, size))
    return F.concat(*found)


def best_jaccard(left: DataFrame, right: DataFrame, ids: list[str], within: str, most: int = 4, longer: bool = True) -> DataFrame:
    """left (ids, within, key), right (within, ckey) -> (ids, similarity): the highest S4 of each left text with a right
    text of its group. Left texts score 0 that are null or whose group has no right text.

    Texts meet on sets of tokens, not pair by pair: for each set that a right text of the group holds, the least number
    of tokens of such a text is enough, and the set that is their whole intersection gives the pair's own score. Left
    texts of more than `most` tokens are joined on single tokens instead; longer=False says that there are none.
    """
    a = left.select(*ids, within, _tokens("key").alias("l")).withColumn("l_size", F.size("l"))
    b = right.select(within, _tokens("ckey").alias("r")).withColumn("r_size", F.size("r"))
    held = b.select(within, "r_size", F.inline(_subsets(F.col("r"), most))).groupBy(within, "token_set").agg(F.min("r_size").alias("r_size"))
    short = a.where((F.col("l_size") <= most) | F.col("l").isNull()) if longer else a
    asked = short.select(*ids, within, "l_size", F.inline_outer(_subsets(F.col("l"), most)))
    met = asked.join(held, [within, "token_set"], "left").select(*ids, "l_size", "r_size", F.col("set_size").cast("long").alias("n"))
    if longer:
        one = a.where(F.col("l_size") > most).select(*ids, within, "l_size", F.explode("l").alias("token"))
        two = b.select(within, F.array_sort("r").alias("r"), "r_size").distinct().select(within, "r", "r_size", F.explode("r").alias("token"))
        rest = one.join(two, [within, "token"], "left").groupBy(*ids, within, "r", "l_size", "r_size").agg(F.count("*").alias("n"))
        met = met.unionByName(rest.select(*ids, "l_size", "r_size", "n"))
    score = F.max(F.col("n") / (F.col("l_size") + F.col("r_size") - F.col("n")))
    return met.groupBy(*ids).agg(F.coalesce(score, F.lit(0.0)).alias("similarity"))


def positional(a: Column, b: Column) -> Column:
    """100 x share of positions with the same character."""
    n = F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (i <= F.least(F.length(a), F.length(b)))))
    return F.when(a == b, 100.0).when(n == 0, 0.0).otherwise(same * 100.0 / n)


def containment(a: Column, b: Column) -> Column:
    """100 equal, 80 one holds the other, else 0."""
    return F.when(a == b, 100.0).when((F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a)), 80.0).otherwise(0.0)


def duck_ratio(a: str, b: str) -> str:
    """S1 as DuckDB SQL over columns or aliases."""
    return f"""(CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 100.0::double WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::double ELSE
      200.0::double * list_reduce(range(1, length({a}) + 1), lambda row, i: list_reduce(range(1, length({b}) + 1),
        lambda nr, j: list_append(nr, CASE WHEN {a}[i] = {b}[j] THEN row[j] + 1 ELSE greatest(row[j + 1], nr[j]) END), [0::bigint]),
        list_resize([]::bigint[], length({b}) + 1, 0))[-1] / (length({a}) + length({b})) END)"""


def duck_sorted_tokens(text: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')), ' ')"


def block_scores(left: list[str], right: list[str]) -> np.ndarray:
    """ratio of every left text with every right text; all left texts have one length, and so have all right ones."""
    n, m = len(left[0]), len(right[0])
    if m > 64 or not n or not m:
        return np.array([[ratio_of(a, b) for b in right] for a in left])
    codes: dict[str, int] = {}
    rows = [np.zeros(len(right), dtype=np.uint64)]
    for j, b in enumerate(right):
        for i, c in enumerate(b):
            at = codes.setdefault(c, len(codes) + 1)
            if at == len(rows):
                rows.append(np.zeros(len(right), dtype=np.uint64))
            rows[at][j] |= np.uint64(1 << i)
    table = np.stack(rows)
    coded = np.array([[codes.get(c, 0) for c in a] for a in left])
    full = np.uint64((1 << m) - 1)
    row = np.full((len(left), len(right)), full, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            hit = row & table[coded[:, i]]
            row = ((row + hit) | (row - hit)) & full
    return 200.0 * (m - np.bitwise_count(row).astype(np.int64)) / (n + m)


def _points(texts: list[str]) -> np.ndarray:
    """The code points of texts of one length, a row a text."""
    return np.array(texts, dtype=f"<U{len(texts[0])}").view(np.uint32).reshape(len(texts), -1)


def _counted(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters, the second a of a text apart from its first: the product of two rows is how many letters the texts share."""
    columns: tuple[list, list] = [], []
    for c in np.intersect1d(one, two):
        x, y = (one == c).sum(axis=1), (two == c).sum(axis=1)
        for times in range(1, min(x.max(), y.max()) + 1):
            columns[0].append(x >= times)
            columns[1].append(y >= times)
    return tuple(np.array(side, dtype=np.float32).reshape(len(side), len(texts)).T.copy() for side, texts in zip(columns, (one, two), strict=True))


def _bits(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """For each letter, and one row more for any other, the places of each text that hold it."""
    table, at = np.zeros((len(letters) + 1, len(points)), dtype=np.uint64), np.arange(len(points))
    code = np.searchsorted(letters, points)
    for bit in range(points.shape[1]):
        table[code[:, bit], at] |= np.uint64(1 << bit)
    return table


def block_matches(left: list[str], right: list[str], least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places left, places right, ratios): the k right texts of highest ratio of each left one, from its own least on, the first ones on
    ties. All left texts have one length, and so have all right ones. A product of matrices of letters bounds each pair first: only
    what may reach the left text's least, or its k-th ratio so far, is scored. Texts meet in tiles, so memory is that of a tile."""
    n, m = len(left[0]), len(right[0])
    x, y = _points(left), _points(right)
    one, two = _counted(x, y)
    letters = np.unique(y)
    table = _bits(y, letters) if m <= 64 else None
    place = np.minimum(np.searchsorted(letters, x), len(letters) - 1)
    coded = np.where(letters[place] == x, place, len(letters))
    full = np.uint64((1 << min(m, 64)) - 1)
    need = least.astype(np.float64)
    order = np.argsort(need, kind="stable")  # texts that need much meet few, so they share tiles
    done = []
    for at in range(0, len(left), LEFT_TILE):
        rows = order[at : at + LEFT_TILE]
        rows = rows[200.0 * min(n, m) / (n + m) >= need[rows]]
        i, j, found = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        for start in range(0, len(right) if len(rows) else 0, RIGHT_TILE):
            a, b = np.nonzero(one[rows] @ two[start : start + RIGHT_TILE].T >= (need[rows] * (n + m) / 200.0 - 0.01).astype(np.float32)[:, None])
            if not len(a):
                continue
            a, b = rows[a], b + start
            if table is None:
                score = np.array([ratio_of(left[p], right[q]) for p, q in zip(a, b, strict=True)], dtype=np.float64)
            else:
                row = np.full(len(a), full, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for step in range(n):
                        hit = row & table[coded[a, step], b]
                        row = ((row + hit) | (row - hit)) & full
                score = 200.0 * (m - np.bitwise_count(row).astype(np.int64)) / (n + m)
            good = score >= need[a]
            i, j, found = np.concatenate([i, a[good]]), np.concatenate([j, b[good]]), np.concatenate([found, score[good]])
            best = np.lexsort((j, -found, i))
            rank = np.arange(len(i)) - np.searchsorted(i[best], i[best])
            i, j, found, rank = *(v[best][rank < k] for v in (i, j, found)), rank[rank < k]
            last = rank == k - 1
            need[i[last]] = np.maximum(need[i[last]], found[last])
        done.append((i, j, found))
    return tuple(map(np.concatenate, zip(*done, strict=True)))


#: Lengths of texts that meet by what is left of them without a letter or two.
SHORTEST, LONGEST = 6, 28


def _without_one(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _close_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, score, bound): the pairs that agree once the left text has lost a letter at most and the right one two.
    Any other pair of the left text has a ratio of bound at most: it loses two of its own letters, or the right text three."""
    short = left.where(F.length("l_text").between(SHORTEST, LONGEST))
    held = right.where(F.length("r_text").between(SHORTEST - 1, LONGEST + 2))
    once = _without_one(F.col("r_text"))
    asked = short.select("l_id", "l_text", F.explode(F.array_distinct(F.concat(F.array("l_text"), _without_one(F.col("l_text"))))).alias("piece"))
    known = held.select("r_id", F.explode(F.array_distinct(F.concat(F.array("r_text"), once, F.flatten(F.transform(once, _without_one))))).alias("piece"))
    met = asked.select("l_id", F.xxhash64("piece").alias("h")).hint("merge").join(known.select("r_id", F.xxhash64("piece").alias("h")), "h").select("l_id", "r_id").distinct()
    n = F.length("l_text")
    bound = 100.0 * (1 - F.least(2 / (2 * n - 2), 3 / (2 * n + 3)))
    pairs = met.join(short.hint("merge"), "l_id").join(held.hint("merge"), "r_id")
    return pairs.select("l_id", "r_id", ratio(F.col("l_text"), F.col("r_text")).alias("score"), bound.alias("bound"))


def _all_pairs(left: DataFrame, right: DataFrame, threshold: float, k: int = 1) -> DataFrame:
    """fuzzy_join by blocks of compatible lengths; left has a column `least`, from which on a ratio counts for its text."""
    left, right = left.withColumn("n", F.length("l_text")), right.withColumn("n", F.length("r_text"))
    sizes = [{r["n"]: r["c"] for r in side.groupBy("n").agg(F.count("*").alias("c")).collect()} for side in (left, right)]
    able = [(a, b) for a in sizes[0] for b in sizes[1] if 200.0 * min(a, b) >= threshold * (a + b)]
    # a text travels once for each block of the other side: few large blocks, but enough pairs of them to share the work
    work = sum(sizes[0][a] * sizes[1][b] for a, b in able)
    block = min(BLOCK, max(LEFT_TILE, math.isqrt(work // DEALT)))
    counts = [{n: math.ceil(c / block) for n, c in side.items()} for side in sizes]
    spark = left.sparkSession
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, min(work // WORTH, 16 * cores))

    def dealt(side: DataFrame, own: str, other: str, mine: dict, theirs: dict, pairs: list, *more: str) -> DataFrame:
        to = [(x, mine[x], y, theirs[y]) for x, y in pairs]
        lengths = spark.createDataFrame(to, f"n int, {own}_blocks int, {other}_n int, {other}_blocks int")
        lengths = F.broadcast(lengths) if len(to) <= MAX_BROADCAST else lengths  # one row a pair of lengths, however many texts have them
        own_block = F.pmod(F.xxhash64(f"{own}_id"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        return side.join(lengths, "n").select(F.col("n").alias(f"{own}_n"), f"{own}_id", f"{own}_text", *more, own_block, f"{other}_n", every)

    keys = ["l_n", "l_block", "r_n", "r_block"]
    # a number of tasks of its own: rows are few for the work that they make
    a = dealt(left, "l", "r", counts[0], counts[1], able, "least").repartition(tasks, *keys).groupBy(*keys)
    b = dealt(right, "r", "l", counts[1], counts[0], [(y, x) for x, y in able]).repartition(tasks, *keys).groupBy(*keys)
    ids = f"l_id {left.schema['l_id'].dataType.simpleString()}, r_id {right.schema['r_id'].dataType.simpleString()}"

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("l_id", "r_id", "score")})
        y = y.sort_values("r_id")
        i, j, found = block_matches(list(x["l_text"]), list(y["r_text"]), x["least"].to_numpy(), k)
        return pd.DataFrame({"l_id": x["l_id"].to_numpy()[i], "r_id": y["r_id"].to_numpy()[j], "score": found})

    pairs = a.cogroup(b).applyInPandas(score, f"{ids}, score double")
    best = pairs.groupBy("l_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "r_id"))).alias("all"))
    top = best.select("l_id", F.explode(F.slice("all", 1, k)).alias("m"))
    return top.select("l_id", "m.r_id", (-F.col("m.s")).alias("score"))


def fuzzy_join(left: DataFrame, right: DataFrame, threshold: float, k: int = 1) -> DataFrame:
    """left (l_id, l_text), right (r_id, r_text), one row a text -> (l_id, r_id, score): for each left text its k right
    texts of highest ratio from threshold on, smaller r_id first on ties. Null and empty texts match nothing.

    Texts that agree once the left one has lost a letter at most and the right one two meet by an equi-join. A left text whose k best
    pairs there are above what any other pair can reach is done; only the others go to blocks, where the k-th of those pairs is the
    least that counts for its text. Joins say "merge": these sides grow with the texts, and small files of them pass for small tables.
    """
    spark, path = left.sparkSession, scratch_path(left.sparkSession, "fuzzy")
    for side, name in ((left, "l"), (right, "r")):  # both are read several times
        side.where(f"{name}_text <> ''").select(f"{name}_id", f"{name}_text").write.parquet(f"{path}/{name}")
    left, right = spread(spark.read.parquet(f"{path}/l")), spread(spark.read.parquet(f"{path}/r"))
    close = _close_pairs(left, right).where(F.col("score") >= threshold)
    best = close.groupBy("l_id", "bound").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "r_id"))).alias("all")).select("l_id", "bound", F.slice("all", 1, k).alias("top"))
    kth = F.when(F.size("top") == k, -F.element_at("top", -1)["s"])
    best.select("l_id", "top", kth.alias("kth"), F.coalesce(kth > F.col("bound") + 1e-9, F.lit(False)).alias("done")).write.parquet(f"{path}/best")
    best = spark.read.parquet(f"{path}/best")
    rest = left.join(best.select("l_id", "kth", "done").hint("merge"), "l_id", "left").where("done IS NULL OR NOT done").select("l_id", "l_text", F.coalesce("kth", F.lit(threshold)).alias("least"))
    rest.write.parquet(f"{path}/rest")
    found = _all_pairs(spread(spark.read.parquet(f"{path}/rest")), right, threshold, k)
    return best.where("done").select("l_id", F.explode("top").alias("m")).select("l_id", "m.r_id", (-F.col("m.s")).alias("score")).unionByName(found)
