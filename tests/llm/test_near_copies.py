import random

import corpus_pipeline
from reelmill.llm import near_copies

WORDS = [f"w{i}" for i in range(4000)]


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(texts):
    sets, label = {i: slow_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j])) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if c == high else c for k, c in label.items()}
    return label


def planted():
    """Texts of 120 words, copies with 1 to 6 changed words, and a chain whose ends are not alike."""
    draw, texts = random.Random(7), {}
    for base in range(12):
        words = [draw.choice(WORDS) for _ in range(120)]
        for changes in range(7):
            copy = list(words)
            for at in draw.sample(range(0, 120, 5), changes):
                copy[at] = "changed"
            texts[base * 10 + changes] = " ".join(copy)
    words = [draw.choice(WORDS) for _ in range(150)]
    for step in range(8):
        texts[500 + step] = " ".join(words[: 60 + 10 * step])
    return texts


def test_stage_drops_near_copies_that_differ_in_some_words(spark, make_docs, small):
    texts = planted()
    want = slow_components(texts)
    assert want[2] == 0 and want[507] == 500
    got = corpus_pipeline.near_dedup(spark, make_docs(list(texts.items())), small).collect()
    assert {r["doc_id"] for r in got} == set(want.values())


def test_awkward(make_docs, awkward):
    rows = [*awkward, (30, "one TWO"), (30, "three four"), (None, "one two"), (31, None)]
    got = near_copies.components(make_docs(rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in awkward}
    want = slow_components(texts)
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert {i: found[i] for i in texts} == want
    assert found[31] == 0 and found[None] is None
    assert {r["component_id"] for r in got if r["doc_id"] == 30} == {5, 30}


def test_empty_table(make_docs):
    assert near_copies.keep_first(make_docs([])).collect() == []


def test_one_id_with_several_texts(make_docs):
    """The kept row is the one that lies in the group of its id, and reruns keep the same one."""
    words = [" ".join(WORDS[i : i + 40]) for i in (0, 100, 200)]
    rows = [(1, words[0]), (5, words[0]), (5, words[1]), (7, words[1]), (9, words[2]), (9, words[2] + " x"), (9, words[2])]
    for order in (rows, rows[::-1]):
        got = near_copies.keep_first(make_docs(order)).collect()
        assert [(r["doc_id"], r["text"]) for r in sorted(got, key=lambda r: r["doc_id"])][:2] == [(1, words[0]), (5, words[1])]
        assert len({r["text"] for r in got if r["doc_id"] == 9}) == len(got) - 2 == 1
    first = {r["text"] for r in near_copies.keep_first(make_docs(rows)).collect()}
    assert first == {r["text"] for r in near_copies.keep_first(make_docs(rows[::-1])).collect()}


def test_crowded_buckets_give_the_same_groups(make_docs):
    texts = planted()
    want = slow_components(texts)
    for crowd in (1, 3):
        got = near_copies.components(make_docs(list(texts.items())), near_copies.Params(crowd=crowd)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_differences_from_a_hub_lose_no_link(make_docs):
    """Copies of one text with changes drawn from few places and words, so that copies far from the text are alike."""
    draw, texts = random.Random(11), {}
    words = [draw.choice(WORDS) for _ in range(150)]
    for i in range(140):
        copy, shared = list(words), draw.randrange(4)
        for at in draw.sample(range(shared * 30, shared * 30 + 60, 6), draw.randrange(1, 9)):
            copy[at] = f"c{draw.randrange(2)}"
        texts[i] = " ".join(copy[: draw.choice((150, 150, 140, 125))])
    want = slow_components(texts)
    got = near_copies.components(make_docs(list(texts.items())), near_copies.Params(crowd=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_recall_of_pairs_at_the_limit(make_docs):
    """Pairs of 300 texts whose exact similarity is 0.8 or little more: at least nine in ten are joined, and none below."""
    draw, texts = random.Random(11), {}
    for base in range(150):
        words = [draw.choice(WORDS) for _ in range(draw.randint(60, 200))]
        copy = list(words)
        for at in draw.sample(range(len(words)), max(1, len(words) // draw.choice([45, 50, 55, 70]))):
            copy[at] = "changed"
        texts |= {2 * base: " ".join(words), 2 * base + 1: " ".join(copy)}
    sets = {i: slow_set(t) for i, t in texts.items()}
    alike = {b: len(sets[2 * b] & sets[2 * b + 1]) / len(sets[2 * b] | sets[2 * b + 1]) for b in range(150)}
    found = {r["doc_id"]: r["component_id"] for r in near_copies.components(make_docs(list(texts.items()))).collect()}
    joined = {b for b in alike if found[2 * b] == found[2 * b + 1]}
    near = {b for b, s in alike.items() if s >= 0.8}
    assert len([b for b in near if alike[b] < 0.9]) > 20
    assert joined <= near and len(joined) >= 0.9 * len(near)


def alike_pairs():
    """Pairs 2b, 2b + 1 of texts that differ in some words, and the exact similarity of each."""
    draw, texts = random.Random(5), {}
    for base in range(150):
        words = [draw.choice(WORDS) for _ in range(draw.randint(80, 200))]
        copy = list(words)
        for at in draw.sample(range(len(words)), max(1, len(words) // draw.choice([45, 60, 90, 200]))):
            copy[at] = "changed"
        texts |= {2 * base: " ".join(words), 2 * base + 1: " ".join(copy)}
    sets = {i: slow_set(t) for i, t in texts.items()}
    return texts, {b: len(sets[2 * b] & sets[2 * b + 1]) / len(sets[2 * b] | sets[2 * b + 1]) for b in range(150)}


def test_ball_hashing_joins_near_copies_by_itself(make_docs):
    """Without bands: nearly all pairs from 0.9 on and half of those from 0.8 on are joined, and none below."""
    texts, alike = alike_pairs()
    found = {r["doc_id"]: r["component_id"] for r in near_copies.components(make_docs(list(texts.items())), near_copies.Params(bands=0)).collect()}
    joined = {b for b in alike if found[2 * b] == found[2 * b + 1]}
    assert all(alike[b] >= 0.8 for b in joined)
    for least, most, share in ((0.9, 1, 0.9), (0.8, 0.9, 0.5)):
        near = {b for b, s in alike.items() if least <= s < most}
        assert len(near) > 15 and len(joined & near) >= share * len(near), (least, len(joined & near), len(near))


def test_words_within_two_bits_meet(spark, make_docs):
    """ball_pairs proposes a pair for each node that has another one within two bits in a half, and for no other one."""
    params = near_copies.Params(bands=0, far=64)
    texts, _ = alike_pairs()
    texts = {i: t for i, t in texts.items() if i < 120}
    prints = {i: [p & (1 << 64) - 1 for p in near_copies.fingerprints(near_copies.shingles(t), params)] for i, t in texts.items()}
    halves = {i: [h for p in ps for h in (p >> 32, p & 0xFFFFFFFF)] for i, ps in prints.items()}
    meets = lambda i, j: any((a ^ b).bit_count() <= 2 for a, b in zip(halves[i], halves[j], strict=True))
    want = {i for i in texts if any(i != j and meets(i, j) for j in texts)}
    nodes = near_copies.signatures(make_docs(list(texts.items())), params).withColumnRenamed("doc_id", "node")
    got = [(r["u"], r["v"]) for r in near_copies.ball_pairs(nodes, params).collect()]
    assert all(meets(u, v) for u, v in got)
    assert want and {i for pair in got for i in pair} == want
