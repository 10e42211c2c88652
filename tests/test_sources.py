import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions.times import parse_time, parse_tweet_time
from tidemark.sources import accounts as A, labelled as B, posts as P, threads as H

NOW = dt.datetime(2026, 1, 1)


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def test_times(spark):
    texts = ["2026-04-14T10:00:00Z", "2026-04-14T10:00:00.5+02:00", "2026-04-14 10:00:00", "2026-04-14", "14.04.2026", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_time(F.col("t"), now())).collect()]
    assert got == [dt.datetime(2026, 4, 14, 10), dt.datetime(2026, 4, 14, 8, 0, 0, 500000), dt.datetime(2026, 4, 14, 10), dt.datetime(2026, 4, 14), NOW, NOW, NOW]
    tweet = spark.createDataFrame([("Wed Oct 10 20:19:24 +0000 2018",), ("x",)], "t string").select(parse_tweet_time(F.col("t"), now())).collect()
    assert [r[0] for r in tweet] == [dt.datetime(2018, 10, 10, 20, 19, 24), NOW]


def test_line_numbers_across_blocks(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 37)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i + 1}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = P.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(lines) == 5037
    assert all(r.value[1:] == str(r.line_no) for r in lines)


def test_json_lines(spark):
    raw = [
        '{"id": 42, "external_id": "x", "author": "ann", "text": "hi", "content": " ", "timestamp": "2024-01-02", "likes": "7", "reposts_count": 2.9}',
        "", "not json", "[1]", '{"id": " ", "post_id": 1.5, "username": true, "likes_count": "many", "likes": 3}', '{"published_at": "soon"}']
    lines = spark.createDataFrame([(i + 1, v) for i, v in enumerate(raw)], "line_no bigint, value string")
    assert tuple(P.line_counts(lines).first()) == (3, 2)
    rows = {r.line_no: r for r in P.posts_from_lines(lines, "d", "s", now(), 5).collect()}
    assert (rows[1].external_id, rows[1].username, rows[1].content, rows[1].likes_count, rows[1].reposts_count) == ("42", "ann", "hi", 7, 2)
    assert rows[1].raw_payload_hash == hashlib.sha256(raw[0].encode()).hexdigest() and rows[1].raw_payload_ref == "d:s:line=1"
    assert (rows[5].external_id, rows[5].username, rows[5].likes_count) == ("1.5", "dataset_actor", 3)
    assert rows[6].external_id == "dataset-row-6" and rows[6].published_at == NOW


def test_thread_archive(spark, tmp_path):
    def put(path, payload):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(payload if isinstance(payload, str) else json.dumps(payload))

    tweet = {"id_str": "1", "created_at": "Wed Jan 07 11:06:08 +0000 2015", "text": " root ", "user": {"id_str": "9", "screen_name": "bob"},
             "entities": {"hashtags": [{"text": "tag"}, {"text": " "}], "urls": [{"url": "http://t.co/a", "expanded_url": "http://u@site.example:80/p"}]}}
    reply = {"id_str": "2", "created_at": "Wed Jan 07 11:16:08 +0000 2015", "text": "re", "in_reply_to_status_id_str": "1", "user": {}}
    put("all-rnr-annotated-threads/ottawa-all-rnr-threads/rumours/7/source-tweets/1.json", tweet)
    put("all-rnr-annotated-threads/ottawa-all-rnr-threads/rumours/7/reactions/2.json", reply)
    put("all-rnr-annotated-threads/ottawa-all-rnr-threads/rumours/7/reactions/._2.json", "junk")
    put("all-rnr-annotated-threads/ottawa-all-rnr-threads/rumours/7/annotation.json", {"true": 1})
    put("pheme-rnr-dataset/ferguson/non-rumours/8/reactions/3.json", reply)  # no source tweet
    entries = H.thread_entries(H.read_archive(spark, str(tmp_path)))
    cases = H.thread_cases(entries, now())
    case = cases.first()
    assert cases.count() == 1 and (case.event_name, case.label, case.archive_type, case.title) == ("ottawa", "rumour", "veracity", "root")
    assert case.reaction_count == 1 and case.annotation and case.structure is None
    posts = {r.external_id: r for r in H.thread_posts(entries, cases, now()).collect()}
    assert set(posts) == {"1", "2"} and posts["1"].tags == ["tag"] and posts["1"].links[0].domain == "site.example"
    assert posts["2"].account_external_id == "author:2" and posts["2"].username == "user_author:2" and posts["2"].reply_to_external_id == "1"
    assert H.thread_cases(H.thread_entries(H.read_archive(spark, str(tmp_path)), events=["ferguson"]), now()).isEmpty()


def test_account_files(spark, tmp_path):
    folder = tmp_path / "fake_followers.csv"
    folder.mkdir()
    head = ",".join(A.USER_COLUMNS)
    (folder / "users.csv").write_bytes((head + "\n" + "1" + ",5" * 5 + ",,,,1,,caf\xe9,,,2012-01-01,2012-01-02\n" + "1" + ",6" * 5 + ",,,,,,,,,,\n").encode("latin-1"))
    (folder / "tweets.csv").write_text(",".join(A.TWEET_COLUMNS) + "\n1,hello,web,0,0,1,2,3,0,0,0\n2,other,web,0,0,1,2,3,0,0,0\n")
    users, tweets = A.read_account_csv(spark, str(tmp_path), {"fake_followers": 1})
    assert users.count() == 1 and tweets.count() == 1 and users.first().description == "café"
    record = {"user_id": "7", "label": "BOT", "dataset": "x", "user_tweets": [
        {"text": "a", "entities": {"hashtags": [{}, {}]}}, {"full_text": "b", "text": "c", "user": {"followers_count": 3}, "created_at": "2020-01-01"}]}
    with gzip.open(tmp_path / "n.ndjson.gz", "wt") as f:
        f.write(json.dumps(record) + "\n" + json.dumps({**record, "label": "other"}) + "\n")
    users, tweets = A.accounts_from_nested(A.read_nested(spark, str(tmp_path / "n.ndjson.gz")))
    user = users.first()
    assert users.count() == 1 and user.label == 1 and user.followers_count == "3" and user.updated == "2020-01-01"
    assert {r.text: r.num_hashtags for r in tweets.collect()} == {"a": 2.0, "b": 0.0}


def test_quoted_records_across_blocks(spark, tmp_path):
    """Texts with line breaks, quotes and commas, in files of many blocks, as the reader of whole files gives them."""
    import csv
    import random

    dice = random.Random(3)
    pieces = ["a,b", 'say ""', "line\nbreak", "", "é", '"', "\n\n", "x" * 50]
    rows = [[str(i), "".join(dice.choices(pieces, k=dice.randrange(6))), str(dice.random())] for i in range(900)]
    for k in range(2):
        with open(tmp_path / f"{k}.csv", "w", encoding="ISO-8859-1", newline="") as out:
            writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if k else "\n")
            writer.writerows([["id", "text", "n"], *rows[k::2]])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = A._csv(spark, str(tmp_path), ["id", "text", "n"])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        found = {r.id: (r.text or "", r.n) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert found == {i: (text, n) for i, text, n in rows}


def test_broken_lines_go_whatever_is_read(spark, tmp_path):
    lines = ["\t".join(["x", *B.POST_COLUMNS]), "\t".join("k123456789"), "k\t1", "\t".join("kabcdefghijk"), '"\t' + "\t".join('1"345678"')]
    (tmp_path / "posts.tsv").write_text("\n".join(lines))
    rows = B.read_tsv(spark, str(tmp_path / "posts.tsv"), B.POST_COLUMNS)
    assert sorted(r.id for r in rows.collect()) == ["1", "1"] and rows.select("score").count() == 2
    assert sorted(r.clean_title for r in rows.collect()) == ['"', "2"]
    with pytest.raises(ValueError):
        B.read_tsv(spark, str(tmp_path / "posts.tsv"), ["none"])


def test_predictions_keep_the_order_of_their_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text("fold,case_id,oof_probability\n" + "".join(f"a,{i % 50},{i / 1000}\n" for i in range(1000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        cases = spark.range(60).withColumnRenamed("id", "case_id")
        out = {r.case_id: r.risk_score for r in B.import_predictions(B.read_predictions(spark, str(tmp_path)), cases, "k", "v", order="place").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert out == {i: (950 + i) / 1000 for i in range(50)}


def test_labelled_posts_and_comments(spark, tmp_path):
    path = tmp_path / "posts.tsv"
    path.write_text("\t".join(B.POST_COLUMNS) + "\n1\t\tRaw title\t0\tsub\t1\t2\t0.5\tTrue\n2\tclean\tx\tnan?\tsub\t1\t2\t0.5\tTrue\n3\t \t \t1\tsub\t1\t2\t0.5\tTrue\n4\tok\tx\t1\tsub\t1\t2\t0.5\tTrue\n")
    posts = B.labelled_posts(B.read_tsv(spark, str(path), B.POST_COLUMNS))
    assert {r.id: (r.text, r.label) for r in posts.collect()} == {"1": ("Raw title", 1), "4": ("ok", 0)}
    comments = spark.createDataFrame([("1", " a  b ", "3"), ("1", "c", "x"), ("1", "d", "9"), ("9", "z", "1"), ("1", " ", "99")], "submission_id string, body string, ups string")
    out = {r.id: r.text_with_comments for r in B.attach_comments(posts, B.top_comments(comments, posts, 2)).collect()}
    assert out == {"1": "Raw title [COMMENTS] d a b", "4": "ok"}
    B.write_predictions(posts.withColumn("probability", F.lit(0.5)), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_violations(spark):
    df = spark.createDataFrame([(1, "open", 0.5, 2), (2, "gone", 1.5, 9)], "case_id int, status string, risk_score double, escalation_priority int")
    got = schema.violations(df, "case_id", {"status": schema.ALLOWED["case_status"]})
    assert {(r.key, r.rule.split()[0]) for r in got.collect()} == {("2", "status"), ("2", "risk_score"), ("2", "escalation_priority")}
