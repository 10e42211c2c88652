"""Runs of repeating words against every period tried at every place."""

import random

import numpy as np
import pytest
from llm_cases import CLASHING, TEXTS, documents, key, none
from pyspark.sql import functions as F

from tidemark.llm import common, periodic


def plain_runs(words, min_length=6, min_exponent=4):
    """(start, length, period) by start and period."""
    least = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_length, min_exponent * q):
                least.setdefault((start, i - start + q), q)
            i = max(i, start + 1)
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(dice):
    n = dice.randrange(70)
    words = [dice.choice("abcdefgh"[:dice.choice([1, 2, 3, 8])]) for _ in range(n)]
    for _ in range(dice.randrange(3) if n else 0):
        a, p, m = dice.randrange(n), dice.randrange(1, 9), dice.randrange(40)
        for i in range(a + p, min(n, a + m)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("length, exponent", [(6, 4), (2, 2), (5, 3), (1, 2), (12, 2)])
@pytest.mark.parametrize("together", [100_000, 20])
def test_runs(monkeypatch, length, exponent, together):
    monkeypatch.setattr(periodic, "TREE_WORDS", together)
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 7)
    dice = random.Random(length)
    for _ in range(60):
        texts = [repeating(dice) for _ in range(dice.randrange(1, 6))]
        for words, (n, runs, kept) in zip(texts, periodic.analyse([" ".join(w).encode() for w in texts], length, exponent)):
            want = plain_runs(words, length, exponent)
            assert n == len(words) and [tuple(r) for r in runs.tolist()] == want
            assert kept.decode() == plain_kept(words, want)


def test_common_prefixes():
    dice = random.Random(4)
    for _ in range(30):
        s = [dice.randrange(1, 4) for _ in range(dice.randrange(1, 50))] + [0]
        n = len(s)
        parent, child, length, _ = periodic.ukkonen(s, 4)
        order, low = periodic.tour(parent, child, length, n)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:])
        i, j = np.array([(i, j) for i in range(n) for j in range(n) if i != j]).T if n > 1 else (np.empty(0, int),) * 2
        same = [next(k for k in range(n) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
        assert periodic.CommonPrefixes(order, low)(i, j).tolist() == same


def test_odd_rows(spark):
    common.configure(spark)
    rows = TEXTS + [(30, "a b " * 50), (30, "a b " * 50), (31, "x\x0by\x0b" * 9 + "\x1cz"), (32, "É é " * 8), (33, "a " * 30_000 + "end")]
    out = periodic.find_runs(documents(spark, rows))
    assert out.columns == ["doc_id", "text", *CLASHING, "periodic"]
    want = []
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words) if len(words) < 10_000 else [(0, 30_000, 1)]
        want.append((i, len(words), runs, plain_kept(words, runs)))
    got = [(r.doc_id, r.periodic.n_words, [tuple(x) for x in r.periodic.runs], r.periodic.collapsed) for r in out.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic.find_runs(none(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(none(spark), min_exponent=1)


def test_a_very_long_text():
    dice = random.Random(9)
    words = [f"w{dice.randrange(300)}" for _ in range(400_000)]
    words[100_000:160_000] = words[100_000:110_000] * 6
    (n, runs, kept), = periodic.analyse([" ".join(words).encode()], 6, 4)
    assert n == 400_000 and [r for r in runs.tolist() if r[2] > 1000] == [[100_000, 60_000, 10_000]]
    assert kept.count(b" ") < 400_000 - 50_000


def test_no_shuffle(spark):
    plan = periodic.find_runs(documents(spark).coalesce(1).withColumn("n", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "hashpartitioning" not in plan
