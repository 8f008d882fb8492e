from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from pagemill.llm import quality


def signals(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(text.split("\n")), len(re.findall(r"[^\x20\x09-\x0D]!![\x20\x09-\x0D]", text)))


def kept(text):
    n, chars, symbols, dup, repeat, lines, shouts = signals(text)
    return not (n < 20 or 100 * repeat > 30 * n or 5 * symbols > n or 2 * shouts > n or 2 * dup > lines or chars > 60 * n)


def texts():
    rnd = random.Random(4)
    out = [None, "", " ", "\n\n", "a\x0bb c", "é" * 70, "word " * 19, "word " * 25, " ".join(map(str, range(40))),
           "x | y " * 20, "LOUD!! " * 30, "same line here\n" * 12, "many words " * 20_000]
    for _ in range(150):
        out.append("".join(rnd.choice(["a ", "b ", "cc ", "d\n", "#", "!! ", "é\t", "a b c d e f g h "]) for _ in range(rnd.randint(0, 80))))
    return out


def test_signals_and_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.cascade(quality.with_signals(docs), signals="signals").collect()}
    for i, text in enumerate(texts()):
        s = rows[i]["signals"]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"], s["n_lines"], s["n_shouts"]) == signals(text), repr(text)[:200]
        assert (rows[i]["rejected_by"] is None) == kept(text), repr(text)[:200]


def test_order_never_changes_the_verdict(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = [sorted(r["doc_id"] for r in docs.withColumn("by", quality.verdict(rules, docs["text"])).where("by is null").collect())
           for rules in (list(quality.RULES), list(quality.RULES)[::-1])]
    assert got[0] == got[1] == [i for i, t in enumerate(texts()) if kept(t)]


def test_cheap_and_selective_rules_come_first():
    rule = {n: quality.Rule(n, lambda t: t) for n in "abc"}
    estimates = [quality.Estimate(rule["a"], 2.0, 0.5), quality.Estimate(rule["b"], 0.1, 0.2), quality.Estimate(rule["c"], 0.1, 0.0)]
    assert [r.name for r in quality.ordered(estimates)] == ["b", "a", "c"]


def test_kept_rows_keep_their_columns(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(1, good, "x"), (1, good, "x"), (None, good, None), (2, "short", "y"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, signals string").withColumnRenamed("signals", "_row")
    out = quality.kept(docs)
    assert out.columns == ["doc_id", "text", "_row"]
    assert sorted((r["doc_id"] or 0, r["_row"]) for r in out.collect() if r["_row"]) == [(1, "x"), (1, "x")] and out.count() == 3
    assert quality.kept(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [3, 1000])
def test_sample_is_bounded(spark, rows):
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text")
    assert quality.sampled(docs, rows).count() <= rows


def test_known_signals_are_read_and_others_made(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    some = quality.with_signals(docs, names=("n_words", "n_repeat_words"))
    assert some.schema["signals"].dataType.fieldNames() == ["n_words", "n_repeat_words"]
    rows = quality.cascade(some, signals="signals").where("rejected_by is null").collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, t in enumerate(texts()) if kept(t)]


def test_words_are_split_once_for_all_rules(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = docs.select(quality.verdict(list(quality.RULES), docs["text"]).alias("by"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[^\x20\x09-\x0D]+") == 1


def test_query_on_odd_rows(spark, docs, tmp_path):
    from pagemill.llm.queries import QUERIES
    for name, some in (("odd", texts()), ("none", [])):
        rows = [(i if i % 7 else None, t) for i, t in enumerate(some)]
        (docs(rows * 2).withColumnRenamed("lang", "signals").withColumnRenamed("source", "rejected_by")
         .write.parquet(f"{tmp_path}/{name}/documents.parquet"))
        out = QUERIES["op3_quality_rules"](spark, f"{tmp_path}/{name}").collect()
        plain = [(i, *signals(t)[:5], signals(t)[0] < 20 or 100 * signals(t)[4] > 30 * signals(t)[0], kept(t)) for i, t in rows * 2]
        assert sorted(map(tuple, out), key=repr) == sorted(plain, key=repr)


def test_sample_comes_from_the_whole_table(spark):
    docs = spark.range(0, 4000, 1, 40).selectExpr("cast(id as string) as text")
    got = [int(r["text"]) for r in quality.sampled(docs, 400).collect()]
    assert len(got) <= 400 and max(got) >= 3800 and min(got) < 200
