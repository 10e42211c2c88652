"""Edge rules of threads: one post, no flagged root, giant threads, windows and medians."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import case_features as C, skew

T0 = dt.datetime(2024, 1, 1, 12)
POSTS = ("post_id bigint, case_id bigint, account_id bigint, published_at timestamp, is_case_root boolean, reply_to_post_id bigint, content string")


def frames(spark, rows, tags=(), links=()):
    posts = spark.createDataFrame([(p, c, a, T0 + dt.timedelta(seconds=s), r, to, text) for p, c, a, s, r, to, text in rows], POSTS)
    return (posts, spark.createDataFrame(list(tags), "post_id bigint, tag string"),
            spark.createDataFrame(list(links), "post_id bigint, url string, domain string, expanded_url string"))


def test_one_post_case(spark):
    f = C.case_features(*frames(spark, [(1, 1, 9, 0, True, None, "Breaking: is it true?")])).first()
    assert f.event_count == 1 and f.gap_intensity == 0.5 and f.median_reaction_delay_seconds == 0.0
    assert f.median_reaction_delay_score == 1.0 and f.root_question_flag == 1.0 and f.reply_tree_available == 0.0
    assert f.peak_10m_share == 1.0 and f.activity_density == 1.0


def test_without_flagged_root_the_first_post_is_root_and_reaction(spark):
    rows = [(5, 1, 2, 60, False, 4, "one two three four"), (4, 1, 1, 0, False, None, "one two three four"), (6, 1, 1, 120, False, 5, "else")]
    f = C.case_features(*frames(spark, rows)).first()
    assert f.root_post_id == 4 and f.root_author_reaction_share == 1.0
    assert f.direct_reply_ratio == 0.5 and f.deep_reply_ratio == 0.5
    assert f.root_jaccard_max == 1.0 and f.root_copy_ratio == 1.0  # two copies over two others
    assert f.lexical_similarity_ratio == 0.5  # the first post itself is not compared
    assert f.median_reaction_delay_seconds == 60.0


def test_tags_and_links(spark):
    rows = [(1, 1, 1, 0, True, None, "a"), (2, 1, 2, 5, False, 1, "b")]
    tags = [(1, " X "), (1, "x"), (2, "")]
    links = [(1, "http://t.co/1", "", "http://Site.example/a"), (2, "http://t.co/2", "", "http://site.example/a"), (2, "http://t.co/2", "", None)]
    f = C.case_features(*frames(spark, rows, tags, links)).first()
    assert (f.unique_hashtag_count, f.unique_url_count, f.unique_domain_count) == (1, 2, 2)
    assert f.repeated_url_ratio == pytest.approx(1 / 3) and f.repeated_domain_ratio == pytest.approx(1 / 3)
    assert C.case_features_v1(*frames(spark, rows, tags, links)).first().unique_hashtag_count == 2  # version 1 counts the blank tag


def test_windows_and_median_against_brute_force(spark, monkeypatch):
    # every case is hot here: salts and minute groups must not change the answer
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 20)
    random.seed(3)
    rows, want = [], {}
    for case in range(4):
        times = sorted(random.choice([random.randrange(0, 4000), 1000]) for _ in range(150 + case))
        for i, s in enumerate(times):
            rows.append((case * 1000 + i, case, i % 7, s, i == 3, None, "t"))
        root = times[3]
        delays = [max(s - root, 0) for i, s in enumerate(times) if i != 3]
        want[case] = (max(sum(1 for b in times if a - 600 <= b <= a) for a in times),
                      max(sum(1 for b in times if a - 1800 <= b <= a) for a in times), statistics.median(delays))
    posts, _, _ = frames(spark, rows)
    got = C.time_profile(posts, C.root_posts(posts), {"peak_10m": 10 * C.MINUTE, "peak_30m": 30 * C.MINUTE})
    assert {r.case_id: (r.peak_10m, r.peak_30m, r.median_reaction_delay_seconds) for r in got.collect()} == want


def test_salting_changes_nothing(spark, monkeypatch):
    random.seed(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "rumour", "fake", "why"]
    rows = [(i, i % 3 * (i % 2), i % 11, i * 30, i % 40 == 0, (i - 1) if i % 4 else None, " ".join(random.choices(words, k=5))) for i in range(1, 400)]
    data = frames(spark, rows)
    plain = C.case_features(*data).drop("evidence").withColumn("risk_score", F.round("risk_score", 9))
    before = {r.case_id: (r.risk_score, r.root_jaccard_mean.__round__(9), r.lexical_diversity, r.unique_account_count) for r in plain.collect()}
    defaults = list(skew.salted_join.__defaults__)
    monkeypatch.setattr(skew.salted_join, "__defaults__", tuple(defaults[:-1] + [10]))
    after = {r.case_id: (round(r.risk_score, 9), r.root_jaccard_mean.__round__(9), r.lexical_diversity, r.unique_account_count)
             for r in C.case_features(*data).collect()}
    assert after == before


def test_bot_profile_counts_and_root(spark):
    posts, tags, links = frames(spark, [(1, 1, 5, 0, True, None, "a"), (2, 1, 6, 9, False, 1, "b")])
    scores = spark.createDataFrame([(1, 5, 0.75), (1, 6, 0.25)], "case_id bigint, account_id bigint, bot_score double")
    f = C.case_features(posts, tags, links, scores).first()
    assert (f.bot_account_count, f.bot_score_mean, f.bot_high_share, f.root_author_bot_score, f.bot_top_score_2, f.bot_top_score_3) == (2.0, 0.5, 0.5, 0.75, 0.25, 0.0)
    assert "bot_score_max=0.750" in f.evidence and "bot_high_share=0.500" in f.evidence


def test_parts_of_a_case_change_nothing(spark, monkeypatch):
    random.seed(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "rumour", "fake", "why", "now"]
    rows = [(i, i % 2, i % 11, i * 30, i % 40 == 0, (i - 1) if i % 4 else None, " ".join(random.choices(words, k=4))) for i in range(1, 120)]
    data = frames(spark, rows, [(i, f"t{i % 3}") for i in range(1, 120)])
    features = lambda: [[round(v, 9) if isinstance(v, float) else v for v in r] for r in C.case_features(*data).drop("evidence").orderBy("case_id").collect()]
    first = lambda: C.case_features_v1(*data).drop("evidence").orderBy("case_id").collect()
    whole, whole_v1 = features(), first()
    kinds = {c: len({w for r in rows if r[1] == c for w in r[6].split()} - {""}) for c in (0, 1)}
    uses = {c: sum(len(set(r[6].split())) for r in rows if r[1] == c) for c in (0, 1)}
    assert {r.case_id: r.lexical_diversity for r in C.case_features(*data).collect()} == {c: kinds[c] / uses[c] for c in (0, 1)}
    monkeypatch.setattr(C, "POSTS_PER_PART", 7)
    assert features() == whole and first() == whole_v1


def test_tokens_are_moved_once(spark):
    """One row per post and key leaves the join, and none per post and token."""
    posts = [(i, 1, i % 5, i, i == 1, None, " ".join(f"word{i}x{k}" for k in range(50))) for i in range(1, 21)]
    met = frames(spark, posts)[0].selectExpr("*", "transform(split(content, ' '), w -> xxhash64(w)) AS tokens", "0 AS __salt", "1 AS __salts")
    long = C._part_rows(met, {"account": ("account_id", "true")}, {"reply": "reply_to_post_id IS NOT NULL"}, "NOT is_case_root", {}, "tokens")
    got = {(r.kind, r.key): r.n for r in C._summed(long).collect()}
    assert long.count() == 20 + 3 and got[C.KINDS.index("token_kinds"), 0] == 1000 and got[C.KINDS.index("account"), 0] == 4


def test_common_tokens_are_moved_as_two_bytes_without_loss(spark):
    low = [7, 7 + 2**16, -5, 2**40]  # the first two share a slot
    df = spark.createDataFrame([(1, low), (2, [7, 7 + 2**20, 0, 1]), (3, []), (4, None)], "id int, tokens array<bigint>")
    common = C.common_tokens(F.col("tokens"), df.where("id = 1"))
    got = {r.id: (r.s.common, r.s.rare) for r in df.select("id", C.split_tokens(F.col("tokens"), common).alias("s")).collect()}
    assert got[3] == ([], []) and got[4] == (None, None)
    decode = lambda codes: [common[c + C.COMMON_TOKENS // 2] for c in codes]
    assert all(sorted(decode(got[i][0]) + got[i][1]) == sorted(r) for i, r in ((1, low), (2, [7, 7 + 2**20, 0, 1])))
    assert len(got[1][0]) == 3  # one of the two in a slot keeps its id
    posts = [(i, 1, i, i, i == 1, None, " ".join(f"word{(i * k) % 90}" for k in range(60))) for i in range(1, 9)]
    f = C.case_features(*frames(spark, posts)).first()
    sets = [set(p[6].split()) for p in posts]
    shared = [len(s & sets[0]) / len(s | sets[0]) for s in sets[1:]]
    assert f.root_jaccard_max == pytest.approx(max(shared)) and f.root_jaccard_mean == pytest.approx(sum(shared) / 7)
    assert f.lexical_diversity == pytest.approx(len(set().union(*sets)) / sum(map(len, sets)))
    assert "smallint" in dict(df.select(C.split_tokens(F.col("tokens"), common).alias("s")).dtypes)["s"]


def test_frequent_tokens_of_all_posts_take_two_bytes(spark):
    five = [7 + k * 2**16 for k in range(5)]  # one slot
    df = spark.createDataFrame([(i, five[: 6 - i]) for i in range(1, 6)] + [(6, []), (7, None)], "id int, tokens array<bigint>")
    pages = C.token_pages(F.col("tokens"), df)
    assert [page[7] for page in pages] == five[:4]
    got = {r.id: r.s for r in df.select("id", C.split_tokens(F.col("tokens"), *pages).alias("s")).collect()}
    codes = lambda r: [page[c + C.COMMON_TOKENS // 2] for page, name in zip(pages, C.page_names(len(pages))) for c in r[name]]
    assert all(codes(got[i]) + got[i].rare == five[: 6 - i] for i in range(1, 6)) and got[1].rare == five[4:]
    assert got[6].rare == [] and got[7].rare is None and got[7].common_4 is None
    posts = [(i, 1, i, i, i == 1, None, "root words" if i == 1 else f"reaction words number{i}") for i in range(1, 9)]
    frame = frames(spark, posts)[0]
    read = C._with_root_texts(frame, C.root_posts(frame))
    assert read.where("in_roots").count() == 1 and read.where("sampled").count() == 8
    ids = read.where("sampled").selectExpr("explode(root_tokens) AS t").distinct().collect()
    found = C.token_pages(F.col("root_tokens"), read.where("sampled"))
    assert len(ids) == 10 and all(any(page[t % C.COMMON_TOKENS] == t for page in found) for (t,) in ids)
