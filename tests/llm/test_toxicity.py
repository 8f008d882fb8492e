from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pagemill.llm import toxicity
from pagemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
NEUTRAL = ["the men went home", "women read books", "christians sing songs", "muslims cook dinner", "plain day in town"]


def labelled(n=600, seed=3):
    rnd = random.Random(seed)
    fill = [f"word{i}" for i in range(80)]
    out = []
    for i in range(n):
        toxic = rnd.random() < 0.4
        words = rnd.choices(fill, k=rnd.randint(5, 30))
        # the group is named in most toxic texts, and in few others
        if rnd.random() < (0.8 if toxic else 0.1):
            words.append("muslims")
        if rnd.random() < (0.1 if toxic else 0.3):
            words.append("christians")
        if toxic and rnd.random() < 0.9:
            words.append(rnd.choice(["awful", "vile"]))
        rnd.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return out


def scores(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["score"] for r in sorted(toxicity.score(docs, model).collect(), key=lambda r: r["id"])]


def trained(spark, change):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return toxicity.train(docs, labels, change=change)


def test_swapped_groups_get_equal_scores(spark):
    pair = ["the muslims of word1", "the christians of word1"]
    a, b = scores(spark, trained(spark, 0.0), pair)
    c, d = scores(spark, trained(spark, toxicity.CHANGE), pair)
    assert abs(c - d) < 0.5 * abs(a - b)
    assert c < a  # naming the group alone is less of a sign
    assert scores(spark, trained(spark, toxicity.CHANGE), ["word3 vile word4"])[0] > 0.7


def test_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, SF).collect()}
    assert len(rows) == 1000
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["score"], truth[i]) for i, r in rows.items() if r["held_out"] and i in truth]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.8 and np.mean([s >= 0.7 for s in zeros]) < 0.06


def test_reruns_agree(spark):
    runs = [sorted(map(tuple, QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.001").collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, "bad " * 9), (None, "bad"), (2, ""), (3, "good " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.withColumnsRenamed({}), labels)
    assert toxicity.score(docs, model).count() == 5
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model).collect())
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert set(r["score"] for r in toxicity.score(docs, toxicity.train(docs, few)).collect()) <= {0.5, 1 / (1 + np.exp(-40))}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ids_with_several_texts(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), *[(3, "hot")] * 50, (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    taken = toxicity.sampled(docs, labels, "doc_id", "text", "toxic", 10, 1).collect()
    assert sorted(tuple(r) for r in taken) == [("a", 1), ("b", 1), ("c", 0), ("d", 0)]
    assert toxicity.sampled(docs, labels, "doc_id", "text", "toxic", 60, 1).count() == 54


def plain_features(text):
    out = set()
    for word in re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower()):
        out |= {"=" + word} | {"<" + word[:n] for n in (3, 4, 5, 6) if len(word) > n} | {">" + word[-n:] for n in (4, 5) if len(word) > n}
    return out


def test_counts_and_vocabulary_against_plain_python(spark):
    rows = [(t, y) for _, t, y in labelled(300)] + [("Été FOO-bar  foo", 1), ("", 0), ("x\n日本語日本語 x", 1)]
    counts = toxicity.feature_counts(spark.createDataFrame(rows, "text string, label long").repartition(3)).persist()
    want = [Counter(f for t, y in rows if y == label for f in plain_features(t)) for label in (0, 1)]
    assert {r["feature"]: (r["n0"], r["n1"]) for r in counts.collect()} == {f: (want[0][f], want[1][f]) for f in want[0] | want[1]}
    n = [sum(y == label for _, y in rows) for label in (0, 1)]
    told = {}
    for f in want[0] | want[1]:
        share = (want[0][f] + want[1][f]) / sum(n)
        spread = math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
        told[f] = abs(want[1][f] / n[1] - want[0][f] / n[0]) / spread if want[0][f] + want[1][f] >= toxicity.LEAST_ROWS else 0
    names = toxicity.vocabulary(counts, *n, groups=())
    assert set(names) == {f for f, z in told.items() if z > toxicity.LEAST_SPREAD} and len(names) > 5


def plain_loss(w, b, texts, swapped, labels, ridge, change):
    sigmoid = lambda on: 1 / (1 + math.exp(-sum(w[f] for f in on) - b))
    ones = sum(labels)
    loss = ridge / 2 * sum(x * x for x in w)
    for on, y in zip(texts, labels):
        loss -= (0.5 / ones if y else 0.5 / (len(labels) - ones)) * math.log(sigmoid(on) if y else 1 - sigmoid(on))
    return loss + change * sum((sigmoid(texts[i]) - sigmoid(on)) ** 2 for i, on in swapped.items()) / max(len(swapped), 1)


def test_fit_against_plain_descent():
    rnd = random.Random(8)
    labels = [int(rnd.random() < 0.4) for _ in range(60)]
    texts = [{f for f, (a, b) in enumerate([(0.2, 0.8), (0.1, 0.6), (0.4, 0.2), (0.5, 0.5)]) if rnd.random() < (b if y else a)} for y in labels]
    swapped = {i: (on - {1}) | {2} for i, on in enumerate(texts) if 1 in on}
    for change in (0.0, 4.0):
        def flat(rows):
            pairs = [(i, f) for i, on in rows for f in sorted(on)]
            return np.array([p[0] for p in pairs], np.int32), np.array([p[1] for p in pairs], np.int32)
        model = toxicity.fit(list("abcd"), np.array(labels, float), flat(enumerate(texts)), flat(swapped.items()), ridge=0.01, change=change)
        loss = lambda v: plain_loss(v[:4], v[4], texts, swapped, labels, 0.01, change)  # noqa: E731, B023
        at = [0.0] * 5
        for _ in range(1500):  # steps along differences of the loss itself
            slope = [(loss(at[:k] + [at[k] + 1e-5] + at[k + 1:]) - loss(at[:k] + [at[k] - 1e-5] + at[k + 1:])) / 2e-5 for k in range(5)]
            at = [x - 0.8 * g for x, g in zip(at, slope)]
        assert abs(loss([*model.weights, model.bias]) - loss(at)) < 1e-3


def test_features():
    f = toxicity.Features(["=bad", "<unk", "=men", "=women", ">ness"])
    rows, found = f.pairs(pa.array(["Bad bad unkind", None, "", "MEN, badness", "other"]))
    assert list(zip(rows.tolist(), found.tolist())) == [(0, 0), (0, 1), (3, 2), (3, 4)]
    rows, found = f.pairs(pa.array(["men"]), toxicity.swaps())
    assert found.tolist() == [3]
