"""Stacked names and common blocks against plain versions."""

import difflib
import random

from hypothesis import given
from hypothesis import strategies as st

from reelmill.functions import similarity
from reelmill.operators import layout, matching


@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_block_ratio(a, b):
    found = similarity.block_ratio_of(a, b)
    assert abs(found - 100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) < 1e-9
    assert found <= similarity.ratio_of(a, b) + 1e-9


def test_title_hints_where_the_ratios_differ(spark):
    """One pair that both ratios join, and one whose scattered letters only S1 joins."""
    near, loose = ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxy"), ("abababababababababababababab", "babababababababababababababa")
    assert similarity.ratio_of(*loose) >= 92 and similarity.ratio_of(*near) >= 92
    crossed = ("mnopqrstuvwxabcdefghijkl1234567890", "mnopqrstuvwxabcdefghijkl3412567890")
    videos = spark.createDataFrame([(i, p[0], i) for i, p in enumerate((near, loose, crossed))], "video_id long, film_title string, true_tconst long")
    titles = spark.createDataFrame([(i, p[1]) for i, p in enumerate((near, loose, crossed))], "tconst long, primary_title string")
    got = {r["video_id"]: r["score"] for r in matching.title_hints_blocks(videos, titles).collect()}
    want = {i: round(similarity.block_ratio_of(*p), 6) for i, p in enumerate((near, loose, crossed)) if similarity.block_ratio_of(*p) >= 92}
    assert got == want and 0 in got


def word(video, line, k, x, y, text, width=40.0, height=20.0):
    return (video, 0, line, k, text, x, x + width, y, y + height, 0.9)


COLUMNS = "video_id long, frame_no long, line_no long, wpos long, text string, x1 double, x2 double, y1 double, y2 double, confidence double"


def slow(rows):
    frames = {}
    for r in rows:
        frames.setdefault((r[0], r[1]), {}).setdefault(r[2], []).append(r)
    out = set()
    for lines in frames.values():
        order, used = sorted(lines), set()
        for a, b in zip(order, order[1:], strict=False):
            u, v = (sorted(lines[i], key=lambda r: ((r[5] + r[6]) / 2, r[3])) for i in (a, b))
            gaps = lambda w: all(q[5] - p[6] >= layout.LEAST_GAP for p, q in zip(sorted(w, key=lambda r: (r[5], r[3])), sorted(w, key=lambda r: (r[5], r[3]))[1:], strict=False))
            if a in used or len(u) < 3 or len(u) != len(v) or not gaps(u) or not gaps(v) or {u[0][4].lower(), v[0][4].lower()} & {"the", "cast", "actor"}:
                continue
            down = sum((r[7] + r[8]) / 2 for r in v) / len(v) - sum((r[7] + r[8]) / 2 for r in u) / len(u)
            height = sum(r[8] - r[7] for r in u) / len(u)
            if not 0.5 * height <= down <= 2.5 * height or any(abs((p[5] + p[6]) / 2 - (q[5] + q[6]) / 2) > layout.MOST_SHIFT for p, q in zip(u, v, strict=True)):
                continue
            used |= {a, b}
            out |= {(u[0][0], a, p[3], f"{p[4]} {q[4]}") for p, q in zip(u, v, strict=True)}
    return out


def test_stacked_names(spark):
    rng, rows = random.Random(3), []
    for video in range(60):
        y = 0.0
        for line in range(rng.randint(2, 7)):
            y += rng.choice([25.0, 25.0, 30.0, 70.0])
            n = rng.choice([3, 3, 3, 4])
            for k in range(n):
                rows.append(word(video, line, k, k * rng.choice([150.0, 150.0, 150.0, 150.0, 60.0]), y, rng.choice(["ada", "bob", "cem", "The"] if k == 0 else ["dan", "eva"])))
    got = set(map(tuple, layout.stacked_names(spark.createDataFrame(rows, COLUMNS)).collect()))
    want = slow(rows)
    assert got == want and len(want) > 30
    assert any((v, i + 1) not in {(w[0], w[1]) for w in want} for v, i, *_ in want)
