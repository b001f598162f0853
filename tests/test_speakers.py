"""Speaker naming by all words of a name."""

import random

from reelmill.operators import segments


def slow(said, people):
    out = {}
    for v, seg, speaker, text in sorted(said):
        words = text.lower().split()
        for w, _, name in sorted(people, key=lambda p: p[1]):
            parts = name.lower().split()
            n = len(parts)
            hit = any(words[i : i + n] == parts or any(words[i : i + k] + words[i + k + 1 : i + n + 1] == parts for k in range(1, n)) for i in range(len(words)))
            if v == w and parts and hit and (v, speaker) not in out:
                out[v, speaker] = name
    return out


def test_all_words_of_a_name(spark):
    rng = random.Random(4)
    names = ["Anna Maria Berg", "Anna Maria", "Berg", "Cem Kaya", "Anna Berg Anna Berg", ""]
    people = [(v, i, n) for v in range(20) for i, n in enumerate(rng.sample(names, 4))]
    said = [(v, s, f"S{rng.randint(0, 2)}", " ".join(rng.choice("anna maria berg cem kaya and".split()) for _ in range(rng.randint(0, 9)))) for v in range(20) for s in range(5)]
    people += [(30, 0, "Anna Maria Berg"), (30, 1, "Anna Maria"), (31, 0, "Anna Maria Berg")]
    said += [(30, 0, "S0", "then anna maria and berg came"), (30, 1, "S1", "anna maria came"), (31, 0, "S0", "anna and maria and berg"), (31, 1, "S1", "maria anna berg")]
    a = spark.createDataFrame(said, "video_id long, seg_no long, speaker string, text string")
    b = spark.createDataFrame(people, "video_id long, line_no long, name string")
    got = {(r["video_id"], r["speaker"]): r["name"] for r in segments.speaker_naming(a, b).collect()}
    assert got == slow(said, people)
    assert {k: v for k, v in got.items() if k[0] >= 30} == {(30, "S0"): "Anna Maria Berg", (30, "S1"): "Anna Maria"}
