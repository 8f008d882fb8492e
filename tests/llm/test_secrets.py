from __future__ import annotations

import random
import re

from pagemill.llm import secrets
from pagemill.llm.store import shared_dir

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def texts():
    rnd = random.Random(9)
    parts = ["password", "PassWD", "token", "secret", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdefgh", "abc", "AKIA", "ABCDEFGH1234",
             "0123456789abcdef" * 2, "deadbeef", "é", "日本", "🙂", "\n", "\t", "ſecret", "toKen", "="]
    out = [None, "", "token: secret: abcdefghi", "AKIA" * 6, "x" * 10 + "f" * 100, "token=" + "a" * 100_000, ("a" * 33 + " ") * 20_000]
    return out + ["".join(rnd.choices(parts, k=rnd.randint(1, 14))) for _ in range(800)]


def got(df):
    return sorted(((r["id"], [(f["kind"], f["start"], f["end"]) for f in r["findings"]]) for r in df.collect()), key=repr)


def test_spans(spark, docs):
    rows = list(enumerate(texts())) + [(None, "token=abcdefgh"), (3, "token=abcdefgh"), (3, "token=abcdefgh")]
    found = secrets.scan(docs(rows).withColumnRenamed("lang", "blob"), shared_dir(spark, "t"))
    assert got(found) == sorted(((i, spans(t)) for i, t in rows), key=repr)


def test_empty_table(spark, docs):
    assert secrets.scan(docs([]), shared_dir(spark, "t")).count() == 0


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, docs):
    ledger = shared_dir(spark, "t")
    scanned = lambda: spark.read.parquet(f"{ledger}/scanned").count()
    first = [(1, "token=abcdefgh"), (2, "plain"), (3, "token=abcdefgh")]
    assert got(secrets.scan(docs(first), ledger)) == [(i, spans(t)) for i, t in first]
    assert scanned() == 2 * 3
    second = [*first, (4, "plain"), (1, "secret=12345678")]  # a new version of path 1, an old text at path 4
    assert got(secrets.scan(docs(second), ledger)) == sorted(((i, spans(t)) for i, t in second), key=repr)
    assert scanned() == 3 * 3
    newer = (secrets.Rule("assign", 2, "plain", 0, 1), *secrets.RULES[1:])
    out = got(secrets.scan(docs(second), ledger, newer))
    assert scanned() == 3 * 3 + 3
    assert out == [(1, []), (1, []), (2, [("assign", 0, 5)]), (3, []), (4, [("assign", 0, 5)])]


def test_a_run_that_broke_off_is_done_again(spark, docs):
    ledger = shared_dir(spark, "t")
    rows = docs([(1, "token=abcdefgh")])
    secrets.scan(rows, ledger)
    spark.createDataFrame([], "blob string, kind string, version int").write.mode("overwrite").parquet(f"{ledger}/scanned")
    assert got(secrets.scan(rows, ledger)) == [(1, spans("token=abcdefgh"))]


def test_native_plan(spark, docs):
    plan = secrets.matches(docs([(1, "x")]).selectExpr("'b' as blob", "text", "array('hex') as kinds"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
