from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from pagemill.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """By shares that stop at their cap, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


def key(i, text):
    n, signs = size(text), sum(c in "#*$%&|<>" for c in text or "")
    weight = max(0.1, 1 - 4 * signs / max(n, 1)) if text is not None else 0.1
    u = (int(hashlib.md5(f"0:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
    return -math.log(u) / weight


def brute(rows):
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((key(i, t), i is None, i or 0, size(t)))
    sizes = {s: sum(x[3] for x in d) for s, d in by.items()}
    goal, out = targets(sizes), []
    for s, d in by.items():
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, upto = goal[s] - epochs * sizes[s], 0
        for k, null, i, n in sorted(d):
            upto += n
            more = rest > 1e-9 and 2 * upto - n <= 2 * rest
            out.append((None if null else i, n, sizes[s], round(goal[s], 6), n * (epochs + more)))
    return sorted(out, key=repr)


def rows(n=700, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "b", "c", "é", "Z", None, "tiny"] if i > 3 else ["tiny"])
        out.append((i, " ".join(rnd.choice(["w", "x\n", "#", "yy"]) for _ in range(rnd.choice([0, 1, 5, 40, 300]))), source))
    return out + [(9000, None, "a"), (9001, "", "empty"), (None, "with no id", "b")]


def got(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("range_rows", [7, 4096])
def test_against_brute_force(spark, docs, range_rows):
    assert got(mixing.mix(docs(rows()), range_rows=range_rows)) == brute(rows())


@pytest.mark.parametrize("few", [[], [(1, "a b", "s")], [(1, None, None)], [(1, "", "s"), (2, "a b c", "t")]])
def test_small_tables(spark, docs, few):
    assert got(mixing.mix(docs(few))) == brute(few)


def test_targets_are_met(spark, docs):
    sums = defaultdict(lambda: [0, 0, 0.0])
    for i, n, total, goal, taken in got(mixing.mix(docs(rows()))):
        s = sums[goal, total]
        s[0] += taken
        s[1], s[2] = max(s[1], n), goal
        assert taken <= 2 * n
    for taken, largest, goal in sums.values():
        assert abs(taken - goal) <= largest / 2 + 1e-6


def test_equal_rows_are_taken_together(spark, docs):
    same = [(1, "a b c", "s")] * 300 + [(i, "w " * 5, "s") for i in range(2, 60)] + [(i, "w", "t") for i in range(100, 900)]
    taken = {r["taken"] for r in mixing.mix(docs(same)).where("doc_id = 1").collect()}
    assert len(taken) == 1


def test_rows_of_the_mix(spark, docs):
    table = docs(rows()).withColumnRenamed("lang", "key")
    times = {r[0]: r[4] // r[1] for r in brute(rows()) if r[1]}
    out = mixing.mixed(table)
    assert out.columns == table.columns
    count = {r["doc_id"]: r["count"] for r in out.where("text <> ''").groupBy("doc_id").count().collect()}
    assert count == {i: n for i, n in times.items() if n}
