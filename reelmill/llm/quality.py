"""Quality rules: word and line counts, and compression bands.

A text's zstandard ratio (UTF-8 bytes over compressed bytes) says how repetitive it is. Ratios rise with length, so
each length has its own band: below it the text is close to random, above it it repeats itself. The whole text is
judged by the band of its length, and then each of its chunks by the band of the chunk's length, since a long text can
hide a run of repeats or noise in an ordinary mean; a last chunk too short for a band belongs to the one before it. A
text fails when chunks outside their bands have more than a share of the bytes judged. fit_bands() sets the largest
ratios from labelled rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm._shared import SPACES


@dataclass(frozen=True)
class Params:
    """bands: (bytes from, least ratio, largest ratio), by rising length; below the first no ratio is judged.

    The largest ratios are those of fit_bands() over the labelled rows of sf0.1: 3 % beyond the extremes of the 3243
    labelled-good documents that pass the base rules, their whole texts and chunks together. No labelled-bad document has a
    low ratio to set the least ones by, so they are wide.
    """

    level: int = 3
    bands: tuple[tuple[int, float, float], ...] = (
        (200, 1.05, 1.706),
        (350, 1.05, 1.894),
        (500, 1.15, 1.924),
        (700, 1.15, 2.033),
        (1000, 1.3, 2.085),
        (1400, 1.3, 2.212),
        (2000, 1.45, 2.222),
        (2800, 1.45, 2.343),
        (5000, 1.5, 2.389),
        (7000, 1.5, 2.432),
        (10000, 1.5, 2.510),
        (20000, 1.55, 2.554),
    )
    chunk_bytes: int = 4096
    bad_chunk_share: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50


SYMBOLS = "#*$%&|<>"

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, verdict string"


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    ids = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
    n = len(index)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]  # keeps the next product below 2^63 for any text
    _, at, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    marked = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        marked[shift : shift + len(again)] |= again
    return int(marked.sum())


def _band(size: int, params: Params) -> tuple[float, float] | None:
    found = None
    for start, low, high in params.bands:
        if size >= start:
            found = (low, high)
    return found


def _outside(ratio: float, size: int, params: Params) -> str | None:
    band = _band(size, params)
    if band is None or band[0] <= ratio <= band[1]:
        return None
    return "incompressible" if ratio < band[0] else "repetitive"


def _parts(data: bytes, params: Params) -> list[memoryview]:
    """The chunks of a text; a last one below the first band is part of the one before it."""
    view, size = memoryview(data), params.chunk_bytes
    ends = [*range(size, len(data), size), len(data)]
    if len(ends) > 1 and len(data) - ends[-2] < params.bands[0][0]:
        del ends[-2]
    return [view[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def measure(text: str | None, compressor: zstandard.ZstdCompressor, params: Params = Params()) -> tuple:
    """METRICS of one text; null counts as empty. verdict is null, or why the compression bands reject the text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    ratio = len(data) / len(compressor.compress(data)) if data else 0.0
    verdict = _outside(ratio, len(data), params)
    parts = _parts(data, params)
    chunks = len(parts) if len(parts) > 1 else 0
    bad: dict[str, list[int]] = {}
    for part in parts if chunks else []:
        if why := _outside(len(part) / len(compressor.compress(part)), len(part), params):
            bad.setdefault(why, []).append(len(part))
    if verdict is None and sum(map(sum, bad.values())) > params.bad_chunk_share * sum(map(len, parts)):
        verdict = f"{max(bad, key=lambda why: sum(bad[why]))} chunks"
    word_chars = len(text) - sum(map(text.count, SPACES))
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words), ratio, chunks, sum(map(len, bad.values())), verdict


def added_column(docs: DataFrame) -> str:
    """The name of the column that measured() adds: one that docs doesn't have."""
    name = "__quality"
    while name in docs.columns:
        name += "_"
    return name


def measured(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """docs with METRICS of its text as a last struct column; one pass over the rows, no shuffle."""
    fields = [(f.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]]) for f in METRICS.split(", ")]
    at, name = docs.columns.index("text"), added_column(docs)
    ddl = ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in METRICS.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=params.level)
        for batch in batches:
            rows = [measure(t.as_py(), compressor, params) for t in batch.column(at)]
            columns = [pa.array([r[i] for r in rows], type=kind) for i, (_, kind) in enumerate(fields)]
            found = pa.StructArray.from_arrays(columns, names=[name for name, _ in fields])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    kind = F.lit(None).cast(f"struct<{ddl}>")
    return docs.mapInArrow(run, docs.select("*", kind.alias(name)).schema)


def _failed(params: Params):
    words, repeat = F.col("n_words"), F.col("n_repeat_words")
    return (words < params.min_words) | (100 * repeat > params.max_repeat_percent * words)


def keep_good(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of docs that the rules keep. Columns are those of docs, whatever their names; null and empty texts fail on
    their word count. Texts of any length are read whole; repeated rows are judged alike; a ratio at a band's limit is
    inside; an empty table gives an empty table."""
    marked = measured(docs, params)
    at = added_column(docs)
    q = lambda name: F.col(f"{at}.{name}")
    failed = (q("n_words") < params.min_words) | (100 * q("n_repeat_words") > params.max_repeat_percent * q("n_words"))
    return marked.where(~failed & q("verdict").isNull()).drop(at)


def fit_bands(docs: DataFrame, labels: DataFrame, params: Params = Params(), margin: float = 0.03) -> tuple[tuple[int, float, float], ...]:
    """The bands of params with their largest ratios set margin beyond the extremes of the documents that labels (doc_id,
    quality) call good and that pass the base rules: ratios of whole texts and of chunks, by the band of their length.
    A band that no such text falls in keeps its limit. All labelled rows count, reduced to one row a band before they
    reach the driver."""
    good = labels.where("quality = 1").select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=params.level)
        for batch in batches:
            sizes, ratios = [], []
            for text in batch["text"].to_pylist():
                words, *_, repeat, _, _, _, _ = measure(text, press, params)
                data = (text or "").encode("utf-8", "surrogatepass")
                if words >= params.min_words and 100 * repeat <= params.max_repeat_percent * words:
                    for part in [data, *_parts(data, params)]:
                        sizes.append(len(part))
                        ratios.append(len(part) / len(press.compress(part)))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(ratios, pa.float64())], ["size", "ratio"])

    parts = docs.join(good, "doc_id", "left_semi").select("text").mapInArrow(run, "size long, ratio double")
    band = F.lit(-1)
    for i, (start, _, _) in enumerate(params.bands):
        band = F.when(F.col("size") >= start, i).otherwise(band)
    most = {r["band"]: r["most"] for r in parts.groupBy(band.alias("band")).agg(F.max("ratio").alias("most")).collect()}
    return tuple((start, low, round(most[i] * (1 + margin), 3) if i in most else high) for i, (start, low, high) in enumerate(params.bands))


def report(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The columns of op8, with the ratio and the verdict of the compression bands. Null and empty texts have no words and
    fail on that; texts below the first band have no ratio to fail by; a text of any length is read whole, chunk by
    chunk. Where bad chunks of both sorts have equally many bytes the sort met first is named. Repeated rows are judged
    alike; an empty table gives an empty table; other columns are not read."""
    found = measured(docs.select("doc_id", "text"), params).select("doc_id", "__quality.*")
    failed = _failed(params)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & F.col("verdict").isNull()).alias("kept"), "ratio", "n_bad_chunks", F.col("verdict").alias("band_verdict"),
    )
