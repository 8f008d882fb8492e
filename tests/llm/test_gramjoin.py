"""The n-gram join against plain sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import gramjoin


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_join(rows, percent=90):
    """(id, size, component) of every row, by comparing all pairs."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def answer(found):
    return sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr)


def near_copies(seed, count, words, edits, spread=3):
    """Copies of a few texts with words replaced, cut and repeated, among unlike texts that share a passage."""
    draw = random.Random(seed)
    base = [[f"w{draw.randrange(4000)}" for _ in range(words)] for _ in range(spread)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(count):
        text = list(draw.choice(base))
        for _ in range(draw.randrange(edits + 1)):
            at = draw.randrange(len(text))
            text[at:at + draw.choice((0, 1, 1, 2))] = [f"e{draw.randrange(200)}"] * draw.choice((0, 1, 1))
        if i % 5 == 0:
            text = [f"u{draw.randrange(10 ** 6)}" for _ in range(draw.randrange(3, 90))] + passage
        rows.append((i * 7 % 1009, draw.choice((" ", "  ", "\n")).join(text) if i % 3 else " ".join(text).upper()))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,words,edits", [(1, 60, 2), (2, 120, 4)])
def test_against_all_pairs(spark, docs, seed, words, edits):
    rows = near_copies(seed, 160, words, edits)
    assert answer(gramjoin.similar_sets(docs(rows))) == sorted(plain_join(rows), key=repr)


def test_without_hubs_the_index_alone_finds_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(gramjoin, "HUB_ROUNDS", 0)
    rows = near_copies(4, 120, 60, 3)
    assert answer(gramjoin.similar_sets(docs(rows))) == sorted(plain_join(rows), key=repr)


def test_odd_rows(spark, docs):
    long = " ".join(f"v{i % 5000}" for i in range(40_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "one  TWO"), (8, "one two three"),
            (9, long), (10, long + " tail"), (9, long), (None, "one two three"), (None, "alone in a row"), (11, "é É  x"), (12, "é é  x"),
            (13, same), (14, same + " thirteen"), (15, same + " thirteen fourteen"), (13, same), (16, "one one one one one"), (17, "one one one")]
    frame = docs(rows).selectExpr("*", "1 as id", "'x' as key", "2 as n", "3 as c", "'t' as tokens", "4 as root")
    assert answer(gramjoin.similar_sets(frame)) == sorted(plain_join(rows), key=repr)


def test_empty_table(spark, docs):
    found = gramjoin.similar_sets(docs([]))
    assert found.columns == ["id", "n_shingles", "component_id"] and found.collect() == []


def test_sets_of_a_block_are_those_of_single_texts():
    texts = ["a b c d", None, "", "x", "x y", "a b c", " lead and trail ", "É é", "A B C D a b c d"]
    whole = list(gramjoin.shingle_sets(pa.array(texts)))
    for text, tokens in zip(texts, whole):
        alone, = gramjoin.shingle_sets(pa.array([text], pa.string()))
        assert tokens.tolist() == alone.tolist() and len(tokens) == len(plain_set(text))
    assert np.isin(whole[5], whole[0]).all() and whole[8].size == 4


def test_parities_bound_the_difference():
    draw = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(draw.integers(0, 1 << 63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.9], draw.integers(0, 1 << 63, 20).astype(np.uint64)]))
        bits = int.from_bytes(gramjoin.parities(a), "big") ^ int.from_bytes(gramjoin.parities(b), "big")
        assert bits.bit_count() <= len(np.setxor1d(a, b))
