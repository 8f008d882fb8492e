from __future__ import annotations

import random
import re

import pytest
import xxhash

from pagemill.llm import simhash
from pagemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    different = sorted(set(prints))
    root = {p: p for p in different}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    for i, a in enumerate(different):
        for b in different[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    names = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            names[find(p)] = min(names.get(find(p), i), i)
    return sorted(((i, f"{p:016x}", names.get(find(p))) for (i, _), p in zip(rows, prints)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op10_simhash"](spark, SF)) == brute(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(None, None), (None, "")],
    [(4, "A b"), (2, "a  B"), (9, " "), (1, ""), (None, None), (4, "a b"), (4, "other"), (4, "a b c d"), (3, "É é"), (7, "x " * 30_000)]])
def test_odd_rows(spark, docs, rows):
    assert got(simhash.component_ids(docs(rows))) == brute(rows)


def test_links_and_components_against_brute_force(spark):
    rnd = random.Random(3)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(seeds) | {0, (1 << 64) - 1}
    for s in seeds:  # chains: each step flips up to three bits
        for _ in range(12):
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                s ^= 1 << bit
            prints.add(s)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    assert {tuple(r) for r in simhash.links(table).collect()} == pairs
    root = {p: p for p in signed}
    for _ in signed:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    linked = {p for pair in pairs for p in pair}
    from pagemill.llm.store import shared_dir
    found = simhash.components(spark.createDataFrame(sorted(pairs), "a long, b long"), shared_dir(spark, "t"))
    assert {r["node"]: r["root"] for r in found.collect()} | {r["root"]: r["root"] for r in found.collect()} == {p: root[p] for p in linked}


def test_representatives(spark, docs):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (8, "quite another text here"), (None, "only null here now"), (5, None)]
    kept = simhash.representatives(docs(rows).withColumnRenamed("lang", "_row"))
    assert kept.columns == ["doc_id", "text", "_row", "source", "n_chars"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, "a b c d"), (8, "quite another text here"), (None, "only null here now"), (5, None)], key=repr)
