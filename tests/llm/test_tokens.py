from __future__ import annotations

import copy
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from pagemill.llm import tokens
from pagemill.llm.queries import QUERIES, tokenizer_path
from pagemill.llm.store import shared_dir

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "B", "s", "'", "'s", "t", " ", "\n", "\t", "\x0b", " ", "　", "é", "É", "×", "÷", "ß", "́", ".", ",", "!!",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", "1", "23", "“", "日本", "İ", "\x00", "\x1c", "\x7f", "-", "_", "🙂", "​"]


def other_path():
    """A tokenizer that keeps case and white space."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def plain(texts, path=None):
    t = Tokenizer.from_file(path or tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("path", [tokenizer_path(), other_path()])
def test_whole_texts_by_any_tokenizer(path):
    rnd = random.Random(1)
    texts = [None, "", " ", "don't STOP. it's <|endoftext|>x"] + ["".join(rnd.choices(ALPHABET, k=rnd.randint(1, 40))) for _ in range(1000)]
    ids, n = tokens.Encoder(path, "<u2").encode(pa.array(texts + texts[:9], pa.string()))
    ends = np.cumsum(n)
    for text, a, b, w in zip(texts + texts[:9], ends - n, ends, plain(texts + texts[:9], path)):
        assert ids[a:b].tolist() == w, repr(text)


def test_whole_texts_are_encoded_without_offsets():
    encoder, asked = tokens.Encoder(tokenizer_path(), "<u2"), []

    class WithoutOffsets:
        def encode_batch_fast(self, texts, add_special_tokens, real=encoder.tokenizer):
            asked.extend(texts)
            return real.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = WithoutOffsets()
    texts = ["one  two\n\nit's É", "", "".join(ALPHABET) * 3, "one  two\n\nit's É"]
    ids, n = encoder.encode(pa.array([*texts, None]))
    assert asked == texts[:3]
    assert ids.tolist() == sum(plain([*texts, None]), []) and n.sum() == len(ids)


def test_white_space_is_not_rewritten_where_the_splitter_drops_it():
    """The file's step \\s+ -> blank is left out: the same ids for every sort of white space, alone, in runs and beside marks and special tokens."""
    encoder = tokens.Encoder(tokenizer_path(), "<u2")
    assert "Replace" not in str(encoder.tokenizer.normalizer) and "Lowercase" in str(encoder.tokenizer.normalizer)
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()] + ["\u180e", "\u200b", "\ufeff"]
    texts = [f"{c}aB{c}'s{c}{c}\t{c}\u0301 {c}<|endoftext|>{c}{d}İ!{c}'ll" for c in blanks for d in blanks]
    ids, n = encoder.encode(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[a:b].tolist() for a, b in zip(ends - n, ends)] == plain(texts)


def changed(spec, change):
    change(spec := copy.deepcopy(spec))
    return spec


@pytest.mark.parametrize("change", [
    lambda s: s["normalizer"]["normalizers"].append({"type": "NFC"}),
    lambda s: s["normalizer"]["normalizers"][1].update(content=""),
    lambda s: s["normalizer"]["normalizers"][1].update(pattern={"String": " "}),
    lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
    lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(pattern={"Regex": r"\S+ ?"}),
    lambda s: s["pre_tokenizer"]["pretokenizers"].reverse(),
    lambda s: s["added_tokens"][0].update(normalized=True),
    lambda s: s.update(normalizer=None), lambda s: s.update(pre_tokenizer=None)])
def test_other_files_keep_all_their_steps(change):
    with open(tokenizer_path(), encoding="utf-8") as file:
        spec = json.load(file) | {"model": None}
    assert tokens.without_blanks(spec) == changed(spec, lambda s: s["normalizer"]["normalizers"].pop(1))
    spec = changed(spec, change)
    assert tokens.without_blanks(copy.deepcopy(spec)) == spec


def test_ids_must_fit_their_type():
    with pytest.raises(ValueError, match="don't fit"):
        tokens.Encoder(tokenizer_path(), "<u1")


def test_shards_by_another_tokenizer(spark, docs):
    rows = [(i, f"Word{i}  AND more\n{i % 7}") for i in range(60)]
    got = tokens.round_trip(docs(rows), shared_dir(spark, "t"), other_path())
    want = {i: ids for (i, _), ids in zip(rows, plain([t for _, t in rows], other_path()))}
    assert {r["id"]: (r["n_tokens"], r["crc32"]) for r in got.collect()} == {
        i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def brute(rows):
    """doc_id → of its rows in order of (doc_id, text): start, n, crc."""
    def text_hash(text):
        h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), text_hash(r[1])))
    out, start = [], 0
    for (i, _), ids in zip(rows, plain([r[1] for r in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op5_token_output"](spark, SF).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(5, "b c"), (5, "a"), (5, "a"), (None, "x"), (None, None), (-3, ""), (7, "long " * 50_000)]])
def test_odd_rows(spark, docs, rows):
    got = tokens.round_trip(docs(rows), shared_dir(spark, "t"), tokenizer_path())
    assert sorted((tuple(r) for r in got.select("id", "start", "n_tokens", "crc32").collect()), key=repr) == brute(rows)


def test_many_shards_and_parts(spark, docs):
    rows = [(i * 37 % 1009, f"word{i} and more {i % 7}") for i in range(1009)]
    folder = shared_dir(spark, "t")
    entries = tokens.encode_shards(docs(rows), folder, tokenizer_path(), shard_bytes=2000)
    parts = tokens.build_index(entries, folder, part_keys=100)
    assert parts == 11 and entries.select("shard").distinct().count() > 5
    found = tokens.read_ids(entries.select("id", "k"), folder, parts)
    got = {r["id"]: list(r["ids"]) for r in found.collect()}
    assert got == dict(zip([r[0] for r in rows], plain([r[1] for r in rows])))


def test_foreign_keys_are_not_found(spark, docs):
    folder = shared_dir(spark, "t")
    parts = tokens.build_index(tokens.encode_shards(docs([(i, "x") for i in range(500)]), folder, tokenizer_path()), folder)
    keys = docs([(i, "") for i in range(500, 3000)]).selectExpr("doc_id as id", "0 as k")
    assert tokens.read_ids(keys, folder, parts).count() == 0


def test_an_id_that_fills_several_shards(spark, docs):
    rows = [(i, "one") for i in range(40)] + [(20, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)]
    folder = shared_dir(spark, "t")
    entries = tokens.encode_shards(docs(rows), folder, tokenizer_path(), shard_bytes=500).cache()
    assert entries.where("id = 20").select("shard").distinct().count() > 2 and entries.where("id is null").select("shard").distinct().count() > 1
    for key, n in (("id = 20", 301), ("id is null", 200)):
        assert sorted(r["k"] for r in entries.where(key).collect()) == list(range(n))
    found = tokens.read_ids(entries.select("id", "k"), folder, tokens.build_index(entries, folder))
    got = sorted((str(r["id"]), list(r["ids"])) for r in found.collect())
    assert got == sorted((str(i), ids) for (i, _), ids in zip(rows, plain([t for _, t in rows])))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_and_minimal(n):
    hashes = tokens.key_hash(pa.array(range(n), pa.int64()), np.zeros(n, np.int64))
    levels, rest, slots = tokens.build_mph(hashes)
    assert sorted(slots.tolist()) == list(range(n))
    ranks, base = [], 0
    for level in levels:
        ranks.append(base + np.concatenate([[0], np.cumsum(np.bitwise_count(level), dtype=np.int64)])[:-1])
        base += int(np.bitwise_count(level).sum())
    assert tokens.find_slots(hashes, levels, ranks, rest, base).tolist() == slots.tolist()
