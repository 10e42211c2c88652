import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M


def items(spark, rows):
    return spark.createDataFrame(rows, "case_id bigint, label string, score double").select(
        F.lit("s").alias("scorer_key"), "case_id", M.is_positive(F.col("label")).cast("int").alias("y"), "score")


def test_perfect_ranking(spark):
    rows = [(1, "rumour", 0.95), (2, "rumor", 0.90), (3, "non_rumour", 0.20), (4, "non_rumour", 0.10)]
    m = M.model_metrics(items(spark, rows)).first()
    assert m.precision_at_10 == m.precision_at_20 == 0.5
    assert m.precision == m.recall == m.f1 == m.roc_auc == m.pr_auc == 1.0
    assert 0.21 <= m.best_threshold <= 0.95


def test_saturated_scores_spread_over_cells(spark):
    rng = random.Random(3)
    near = [10.0 ** -rng.uniform(5, 12) for _ in range(400)]
    scores = [*near, *[1 - x for x in near], 0.0, 1.0, 0.5, *[rng.random() for _ in range(400)]]
    rows = [(i, "rumour" if rng.random() < 0.2 + 0.6 * s else "x", s) for i, s in enumerate(scores)]
    df = items(spark, rows)
    cells = df.select("score", M._grid(F.col("score")).alias("g")).orderBy("score").collect()
    assert all(a.g <= b.g for a, b in zip(cells, cells[1:]))
    assert len({c.g for c in cells if c.score < 1 / 65_536}) > 300 and len({c.g for c in cells if c.score > 1 - 1 / 65_536}) > 300
    ys = [(s, int(label == "rumour")) for _, label, s in rows]
    pos, neg = [s for s, y in ys if y], [s for s, y in ys if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df).first().roc_auc == pytest.approx(auc, abs=1e-12)


def test_k_larger_than_n(spark):
    rows = [(1, "rumour", 0.9), (2, "non_rumour", 0.8), (3, "rumour", 0.7)]
    assert M.precision_at(items(spark, rows), 10).first().precision_at_10 == pytest.approx(2 / 3)


def test_one_class_has_no_roc_auc(spark):
    assert M.roc_auc(items(spark, [(1, "rumour", 0.9), (2, "rumour", 0.8)])).first().roc_auc is None


def test_undefined_rates_at_a_threshold(spark):
    none = M.confusion_at(items(spark, [(1, "x", 0.9), (2, "x", 0.1)]), 0.95).first()
    assert none.precision is None and none.recall is None and none.f1 is None
    missed = M.confusion_at(items(spark, [(1, "rumour", 0.9), (2, "x", 0.1)]), 0.95).first()
    assert missed.precision == 0.0 and missed.recall == 0.0 and missed.f1 == 0.0


def test_ties_against_brute_force(spark):
    rows = [(i, "rumour" if (i * 7) % 3 == 0 else "other", ((i * 13) % 10) / 10.0) for i in range(300)]
    got = M.roc_auc(items(spark, rows)).first().roc_auc
    pos = [s for _, l, s in rows if l == "rumour"]
    neg = [s for _, l, s in rows if l != "rumour"]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)
    ordered = sorted(rows, key=lambda r: (-r[2], r[0]))
    seen, gain = 0, 0.0
    for k, (_, l, _) in enumerate(ordered, 1):
        if l == "rumour":
            seen += 1
            gain += seen / k
    assert M.pr_auc(items(spark, rows)).first().pr_auc == pytest.approx(gain / len(pos))


def test_weights_must_match():
    with pytest.raises(ValueError):
        M.normalised_weights({"a": 1.0}, ["a", "b"])
    assert M.normalised_weights({"a": 1.0, "b": 3.0}, ["a", "b"]) == {"a": 0.25, "b": 0.75}
