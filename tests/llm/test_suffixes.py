from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pagemill.llm import suffixes


def brute(rows, length=100):
    """Rows in their order; equal ids in the order given."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        data = (rows[k][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in seen:
                gone[p:p + length] = True
            seen.add(window)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((rows[k][0], len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in df.collect()), key=repr)


def passages(seed):
    rnd = random.Random(seed)
    say = lambda n: "".join(rnd.choice(["a", "b", "cd", " ", "é", "日", "the ", "\n", "\x00"]) for _ in range(n))
    shared = [say(n) for n in (60, 99, 130, 300, 700)] + ["x" * 500, "ab" * 300, "line of text\n" * 40]
    rows = []
    for i in range(60):
        text = "".join(rnd.choice([say(rnd.randint(0, 80)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 40):]]) for _ in range(rnd.randint(0, 5)))
        rows.append((i * 7 % 61, text))
    whole = say(400)
    rows += [(100 + i, whole) for i in range(30)]
    rows += [(200 + i, whole[:200] + say(3) + whole[200:]) for i in range(30)]
    rows += [(300 + i, say(50) + shared[2] + say(50)) for i in range(60)]  # one passage, all contexts different
    return rows + [(400, None), (401, ""), (402, "short"), (None, whole), (None, whole)]


@pytest.mark.parametrize("seed", [1, 2])
def test_small_blocks_and_split_anchors(spark, docs, seed):
    rows = passages(seed)
    random.Random(seed).shuffle(rows)
    found = suffixes.without_repeats(docs(rows).repartition(4), block_bytes=3000, gather_bytes=4000, shard_bytes=1500, sample_bytes=9000)
    assert got(found) == brute(rows)


def test_production_parameters_and_kept_bytes(spark, docs):
    rows = passages(3)
    found = suffixes.without_repeats(docs(rows).withColumnRenamed("lang", "block"), with_kept=True)
    assert got(found) == brute(rows)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in found.collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a" * 99)], [(1, "a" * 100)], [(1, "a" * 101)], [(2, "ab" * 60_000), (1, "b" + "ab" * 70)]])
def test_few_rows(spark, docs, rows):
    assert got(suffixes.without_repeats(docs(rows))) == brute(rows)


def test_equal_ids(spark, docs):
    text = "".join(chr(97 + i * i % 26) for i in range(150)) + "end"
    rows = [(5, text), (5, text), (5, text), (4, text[:120])]
    assert got(suffixes.without_repeats(docs(rows))) == brute(rows)


def test_runs_cover_every_window_once():
    rnd = random.Random(1)
    data = np.frombuffer("".join(rnd.choice("ab cd") for _ in range(5000)).encode() + b"z" * 400, np.uint8)
    sizes = np.array([1200, 0, 99, 100, len(data) - 1399])
    runs = suffixes.runs_of(data, sizes)
    windows = sorted(p for s, n in zip(runs["start"].tolist(), runs["n"].tolist()) for p in range(s, s + n))
    ends = np.cumsum(sizes)
    assert windows == [p for a, b in zip(ends - sizes, ends) for p in range(a, b - 99)]
