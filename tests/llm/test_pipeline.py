"""The pipeline against plain Python, and its parts on odd rows."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import test_decontam, test_mixing, test_quality, test_simhash, test_tokens

SF = "/root/testdata/sf0.001"


def brute(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if test_quality.kept(d["text"])]
    groups = {i: c for i, _, c in test_simhash.brute([(d["doc_id"], d["text"]) for d in docs])}
    docs = [d for d in docs if groups[d["doc_id"]] == d["doc_id"]]
    wanted = {tuple(w[p:p + 10]) for _, t in items for w in [test_decontam.words(t)] for p in (range(max(1, len(w) - 9)) if w else [])}
    sizes = {len(w) for w in wanted}

    def clean(text):
        w = test_decontam.words(text)
        return not any(tuple(w[p:p + n]) in wanted for n in sizes for p in range(len(w) - n + 1))
    docs = [d for d in docs if clean(d["text"])]
    taken = test_mixing.brute([(d["doc_id"], d["text"], d["source"]) for d in docs])
    times = {i: n // size for i, size, _, _, n in taken}
    return test_tokens.brute([(d["doc_id"], d["text"]) for d in docs for _ in range(times[d["doc_id"]])])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, out.collect()), key=repr) == brute(spark)


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_return_the_columns_of_documents(spark, docs, stage):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "a"), (1, good, "a"), (2, None, None), (None, good + " more", "b"), (3, "", "a"), (4, good.replace("3", "x"), None)]
    table = docs(rows).withColumn("_row", F.lit(1)).withColumn("id", F.lit("x")).withColumn("_key", F.lit(2))
    for part in (table, table.limit(0)):
        out = corpus_pipeline.STAGES[stage][1](spark, part, SF)
        assert out.columns == table.columns
        out.collect()
