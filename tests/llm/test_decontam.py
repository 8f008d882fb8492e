from __future__ import annotations

import random
import re
from functools import partial

import pyarrow.parquet as pq
import pytest

from pagemill.llm import decontam
from pagemill.llm.store import in_blocks, shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, slop=0):
    windows = [(str(i) if i is not None else "null", w[p:p + 10]) for i, t in items for w in [words(t)]
               for p in (range(max(1, len(w) - 9)) if w else [])]
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, window in windows:
            for s in range(-slop, len(w) + slop):
                if all(any(0 <= s + j + d < len(w) and w[s + j + d] == t for d in range(-slop, slop + 1)) for j, t in enumerate(window)):
                    found.add(item)
                    hit |= {p for p in range(s, s + len(window)) if 0 <= p < len(w)}
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()), key=repr)


def tables(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))


def rows():
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice(["a", "B", "c", "É", "7", "d-e", "f."]) for _ in range(n))
    items = [(k, say(rnd.choice([3, 5, 10, 14]))) for k in range(12)] + [(None, "a b"), (3, "x Y"), (3, None), (99, " ,.- ")]
    docs = [(k, say(rnd.randint(0, 60))) for k in range(60)]
    docs += [(200 + k, say(3) + "\n" + (t or "") + "\t" + say(3)) for k, (_, t) in enumerate(items)]
    return docs + [(5, "x y"), (5, "x y"), (None, "A, b"), (7, None), (8, ""), (9, "z " * 30_000 + "x y")], items


def test_exact(spark):
    docs, items = rows()
    assert got(decontam.decontaminate(*tables(spark, docs, items))) == brute(docs, items)


def test_passes_and_small_blocks(spark, monkeypatch):
    docs, items = rows()
    monkeypatch.setattr(decontam, "CANDIDATES", 3)
    d, i = tables(spark, docs, items)
    index = decontam.build_index(d.repartition(3), "doc_id", shared_dir(spark, "t"))
    found = decontam.find(index, decontam.item_words(i), pass_words=20)
    found = found.select("id", "n_words", decontam.covered(found["spans"]).alias("n_hit"), "items")
    assert got(found) == brute(docs, items)


def test_tasks_write_and_read_one_block_at_a_time(spark, monkeypatch, tmp_path):
    docs, items = rows()
    monkeypatch.setattr(decontam, "in_blocks", partial(in_blocks, block_bytes=200))
    d, i = tables(spark, docs, items)
    index = decontam.build_index(d.coalesce(1), "doc_id", f"{tmp_path}/index")
    [file] = tmp_path.glob("index/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups == meta.num_rows == index.count() > 20
    assert not any(meta.row_group(g).column(c).is_stats_set for g in range(meta.num_row_groups) for c in range(meta.num_columns))
    found = decontam.find(index, decontam.item_words(i))
    found = found.select("id", "n_words", decontam.covered(found["spans"]).alias("n_hit"), "items")
    assert got(found) == brute(docs, items)


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity(spark, slop):
    docs, items = rows()
    docs, items = [(i, (t or "")[:120]) for i, t in docs], [(i, t) for i, t in items if len(words(t)) < 8]
    assert got(decontam.decontaminate(*tables(spark, docs, items), slop=slop)) == brute(docs, items, slop)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = tables(spark, [(1, "a b")], [(1, "a b")])
    assert got(decontam.decontaminate(docs.limit(0), items)) == []
    assert got(decontam.decontaminate(docs, items.limit(0))) == [(1, 2, 0, [])]
    odd = docs.selectExpr("doc_id", "text", "1 as id", "2 as items", "3 as block", "4 as spans")
    assert got(decontam.decontaminate(odd, items)) == [(1, 2, 2, ["1"])]
