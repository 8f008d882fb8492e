from __future__ import annotations

import random
import time

import numpy as np
import pytest

from pagemill.llm import sais


def naive(text: bytes):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    prefix = [0] * len(text)
    for a, b in zip(order, order[1:]):
        n = 0
        while b + n < len(text) and a + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        prefix[b] = n
    return order, prefix


def texts():
    rnd = random.Random(5)
    yield from (b"\x01", b"ab", b"ba", b"aa", b"abab", b"mississippi", b"a" * 300, b"ab" * 150, b"aab" * 90 + b"b", bytes(range(1, 256)))
    for _ in range(300):
        alphabet = bytes(rnd.sample(range(1, 256), rnd.choice([1, 2, 3, 5, 30])))
        yield bytes(rnd.choices(alphabet, k=rnd.randint(1, 200)))
    for _ in range(40):
        part = bytes(rnd.choices(b"abc ", k=rnd.randint(20, 120)))
        yield b"\xff".join(part[rnd.randint(0, 9):] for _ in range(6))


def test_against_sorting():
    for text in texts():
        array = np.frombuffer(text, np.uint8)
        order, prefix = naive(text)
        got = sais.suffix_array(array)
        assert got.tolist() == order, text
        assert sais.common_prefixes(array, got).tolist() == prefix, text
        for enough in (1, 7, 100):
            told = sais.common_prefixes(array, got, enough)
            assert all(p == q or min(p, q) >= enough for p, q in zip(told.tolist(), prefix)), text


@pytest.mark.parametrize("depth", [1, 10, 50])
def test_depth(depth):
    for text in texts():
        array = np.frombuffer(text, np.uint8)
        got = sais.suffix_array(array, depth).tolist()
        assert sorted(got) == list(range(len(text)))
        keys = [text[i:i + depth] for i in got]
        assert keys == sorted(keys)


def test_long_runs_take_no_round_each():
    text = np.frombuffer(b"a" * 300_000 + b"b" + b"ab" * 100_000, np.uint8)
    begin = time.perf_counter()
    got = sais.suffix_array(text, 100)
    assert time.perf_counter() - begin < 20 and len(got) == len(text)
