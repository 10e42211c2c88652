import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import upsert as U

A, B = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
CASE = "id string, label string, status string, first_event_at timestamp, last_event_at timestamp, metadata map<string,string>"


def test_case_rules(spark):
    base = spark.createDataFrame([("a", "rumour", "open", A, None, {"x": "1", "y": "1"}), ("b", None, "open", None, B, {})], CASE)
    batch = spark.createDataFrame([("a", "", "closed", B, A, {"y": "2"}), ("b", "x", "closed", A, A, {}), ("c", "", "open", A, B, {"z": "3"})], CASE)
    rows = {r.id: r for r in U.upsert(base, batch, ["id"], U.CASE_RULES).collect()}
    assert (rows["a"].label, rows["a"].status, rows["a"].first_event_at, rows["a"].last_event_at) == ("rumour", "closed", A, A)
    assert rows["a"].metadata == {"x": "1", "y": "2"}
    assert (rows["b"].label, rows["b"].first_event_at, rows["b"].last_event_at, rows["b"].metadata) == ("x", A, B, {})
    assert rows["c"].label == "" and rows["c"].metadata == {"z": "3"}


def test_a_batch_with_repeats_is_merged_in_order(spark):
    schema = "id string, label string, first_event_at timestamp, closed_at timestamp, seq int"
    rules = {"label": "filled", "first_event_at": "least", "closed_at": "known"}
    batch = spark.createDataFrame([("a", "one", B, A, 1), ("a", "two", A, None, 2), ("a", "", B, None, 3)], schema)
    got = U.upsert(batch.drop("seq").where("false"), batch, ["id"], rules, "seq").first()
    assert (got.label, got.first_event_at, got.closed_at) == ("two", A, A)


def test_unknown_columns_need_a_rule(spark):
    df = spark.createDataFrame([(1, 2)], "id int, other int")
    with pytest.raises(ValueError):
        U.upsert(df, df, ["id"], {})


def test_history_counts(spark):
    rows = [("a", [("d", " 12 people", "7x")]), ("b", []), ("c", [("d", "none", "-3")]), ("d", None)]
    df = spark.createDataFrame(rows, "tag string, history array<struct<day:string,accounts:string,uses:string>>")
    assert {r.tag: (r.today_accounts, r.today_uses) for r in U.with_today(df).collect()} == {"a": (12, 7), "b": (0, 0), "c": (0, -3), "d": (0, 0)}


def test_runs_are_added(spark, tmp_path):
    U.append_run(spark.range(1), str(tmp_path / "runs"))
    U.append_run(spark.range(1), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_decisions_are_checked(spark):
    cases = spark.createDataFrame([(1, "open"), (2, "closed")], "case_id bigint, status string")
    rows = [(1, "suspicious", A), (1, " ", B), (2, "finalized", A)]
    got = {r.case_id: r.decision for r in U.apply_decisions(cases, spark.createDataFrame(rows, "case_id bigint, decision string, recorded_at timestamp")).collect()}
    assert got == {1: "unclear", 2: None}
    refused = U.refused_decisions(spark.createDataFrame(rows, "case_id bigint, decision string, recorded_at timestamp"))
    assert [tuple(r) for r in refused.collect()] == [("2", "decision is not allowed", "finalized")]


def test_replies_find_parents_that_come_later(spark):
    rows = [(1, 1, "a", "b"), (2, 1, "b", ""), (3, 2, "c", "b")]
    posts = spark.createDataFrame(rows, "post_id bigint, source_id int, external_id string, reply_to_external_id string").withColumn("reply_to_post_id", F.lit(None).cast("bigint"))
    assert {r.post_id: r.reply_to_post_id for r in U.resolve_replies(posts).collect()} == {1: 2, 2: None, 3: None}


def test_objects_of_any_shape_are_merged(spark):
    """Nested values are taken or kept as a whole; a replay changes nothing; nulls and what is no object have no entries."""
    import json

    def rows(*pairs):
        return spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(pairs)], "id string, seq int, t string").select("id", F.parse_json("t").alias("metadata"), "seq")

    base = rows(("a", '{"x":{"y":1,"z":[1,2]},"keep":true}'), ("b", None), ("c", "5"), ("d", '{"only":"base"}')).drop("seq")
    batch = rows(("a", '{"x":{"w":null}}'), ("a", '{"n":1.5}'), ("b", '{"k":{}}'), ("c", None), ("e", "[1]"), ("e", '{"m":"é"}'), ("f", None))
    once = U.upsert(base, batch, ["id"], {"metadata": "merged"}, "seq")
    twice = U.upsert(once, batch, ["id"], {"metadata": "merged"}, "seq")
    want = {"a": {"x": {"w": None}, "keep": True, "n": 1.5}, "b": {"k": {}}, "c": None, "d": {"only": "base"}, "e": {"m": "é"}, "f": None}
    for out in (once, twice):
        assert {r.id: r.j and json.loads(r.j) for r in out.select("id", F.to_json("metadata").alias("j")).collect()} == want
