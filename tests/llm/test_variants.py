"""Spelling variants against comparing all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, every=31):
    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'null' if k is None else k}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    around = {w: [v for d in (-1, 0, 1) for v in by_length.get(len(w) + d, ()) if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(around[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(around[w]), form[w], form[w] and n[form[w]], root))
    return sorted(out)


def answer(found):
    return sorted(tuple(r) for r in found.select("word", "n", "n_near", "form", "form_n", "root").collect())


def misspelt_texts(seed, texts, words, alphabet="abcdefgé"):
    draw = random.Random(seed)
    known = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(6, 11))) for _ in range(words)]
    rows = []
    for i in range(texts):
        said = []
        for _ in range(150):
            w = list(known[min(int(draw.expovariate(0.05)), words - 1)])
            if draw.random() < 0.15:
                at = draw.randrange(len(w))
                w[at:at + draw.choice((0, 1))] = draw.choice(("", "x", "a", "É"))
            said.append("".join(w))
        rows.append((i, draw.choice((" ", ", ", "1")).join(said)))
    return rows


@pytest.mark.parametrize("seed,cell_words", [(1, 8192), (2, 40)])
def test_against_all_words(spark, docs, seed, cell_words, monkeypatch):
    """Also where the lengths are cut into many cells."""
    monkeypatch.setattr(variants, "SAMPLE_WORDS", 600)
    rows = misspelt_texts(seed, 120, 90)
    assert answer(variants.variant_groups(docs(rows), every=31, cell_words=cell_words)) == plain(rows)


def test_forms_follow_each_other(spark, docs):
    said = {"aaaaaaaaaa": 2, "aaaaaaaaab": 20, "aaaaaaaabb": 200, "aaaaaaabbb": 2000, "aaaaaaaaac": 19}
    rows = [(i, " ".join(w for w, c in said.items() for _ in range(c // 2))) for i in (1, 2)]
    found = {r["word"]: r["root"] for r in variants.variant_groups(docs(rows)).collect()}
    assert answer(variants.variant_groups(docs(rows))) == plain(rows, every=None)
    assert found["aaaaaaaaaa"] == "aaaaaaabbb"


def test_odd_rows(spark, docs):
    long = "z" * 700
    rows = [(1, None), (2, ""), (3, "short words only"), (None, "lettered Lettered LETTERED lettere"), (None, "lettere"), (4, "ÀÉÎÕÜ×÷ ÀÉÎÕÜ×÷ ÀÉÎÕÜ×÷ÿ ÀÉÎÕÜ×÷ÿ"),
            (5, f"{long} {long}a {long} {long}a"), (5, f"{long} {long}a {long} {long}a"), (6, "anagram managra anagram managra granama granama"),
            (7, "日本語lettered日本語" * 3), (8, " ".join(["doubled", "doubledd", "doubleddd"] * 12))]
    frame = docs(rows).selectExpr("*", "1 as id", "'w' as word", "2 as n", "3 as size", "4 as cell", "5 as root")
    assert answer(variants.variant_groups(frame, every=31)) == plain(rows)


def test_empty_table(spark, docs):
    found = variants.variant_groups(docs([]))
    assert found.collect() == [] and "root" in found.columns


def test_a_tree_finds_all_points_in_reach():
    draw = np.random.default_rng(3)
    points, asks = draw.integers(0, 3, (400, 32)).astype(np.int16), draw.integers(0, 3, (60, 32)).astype(np.int16)
    points[:, 6:], asks[:, 6:] = 0, 0
    cells = variants.Cells(points[:100], 12)
    assert cells.count > 8
    own = {i: cell for cell, found in cells.find(points, (0, 0)) for i in found.tolist()}
    assert sorted(own) == list(range(400))
    for reach in variants.REACH.values():
        rise = np.maximum(points[None] - asks[:, None], 0).sum(axis=2)
        fall = np.maximum(asks[:, None] - points[None], 0).sum(axis=2)
        want = set(zip(*(x.tolist() for x in np.nonzero((rise <= reach[0]) & (fall <= reach[1])))))
        got = [(int(a), int(b)) for i, j in variants.Tree(points).pairs_in_reach(asks, reach) for a, b in zip(i, j)]
        assert len(got) == len(set(got)) and set(got) == want
        routed = {(int(a), cell) for cell, which in cells.find(asks, reach) for a in which}
        assert all((a, own[b]) in routed for a, b in want)
