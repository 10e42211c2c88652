"""Reports and queues by name, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scores import risk_level
from tidemark.operators import reports as R
from tidemark.operators.filters import CaseFilter, not_blank, score_source, where_chosen, where_equal
from tidemark.plans.registry import big, query, r6, stamp
from tidemark.plans.tables import SCORERS, Tables
from tidemark.plans.tables_sql import STAMP

S = STAMP
CASE_COLS = "c.case_id, c.source_name, c.dataset_split, c.external_case_id, c.label, c.title, c.event_name, c.status"
CASE_LIST = ["case_id", "source_name", "dataset_split", "external_case_id", "label", "title", "event_name", "status"]
COUNTS = "SELECT case_id, count(*) AS post_count FROM posts GROUP BY 1"


def active(t: Tables):
    return score_source(t.case_scores(), t.case_model_scores())


def stored(t: Tables, key: str):
    return score_source(t.case_scores(), t.case_model_scores(), key)


def base(t: Tables, **f):
    return R.scored_base(t.cases(), active(t), CaseFilter(**f))


def _queue(df):
    return df.select(*CASE_LIST, stamp("first_event_at").alias("first_event_at"), big("post_count").alias("post_count"),
                     "scorer_key", r6("risk_score").alias("risk_score"), "risk_level")


@query("w1_case_queue", views="posts cases case_scores", sql=f"""
SELECT {CASE_COLS}, strftime(c.first_event_at, {S}) AS first_event_at, coalesce(n.post_count, 0) AS post_count,
       CASE WHEN s.case_id IS NOT NULL THEN 'case_scores' END AS scorer_key, round(s.risk_score, 6) AS risk_score, s.risk_level
FROM cases c LEFT JOIN case_scores s USING (case_id) LEFT JOIN ({COUNTS}) n USING (case_id)
ORDER BY s.risk_score DESC NULLS LAST, c.first_event_at DESC NULLS LAST, c.case_id DESC LIMIT 50""")
def w1(t: Tables):
    return _queue(R.case_queue(t.cases(), t.posts(False), active(t), limit=50))


@query("w1_case_queue_by_scorer", views="posts cases case_model_scores", sql=f"""
SELECT {CASE_COLS}, strftime(c.first_event_at, {S}) AS first_event_at, coalesce(n.post_count, 0) AS post_count,
       s.scorer_key, round(s.risk_score, 6) AS risk_score, s.risk_level
FROM cases c LEFT JOIN (SELECT * FROM case_model_scores WHERE scorer_key = 'case_text_oof') s USING (case_id)
LEFT JOIN ({COUNTS}) n USING (case_id)
WHERE c.status = 'open' AND c.label = 'rumour' AND s.risk_level = 'high'
ORDER BY s.risk_score DESC NULLS LAST, c.first_event_at DESC NULLS LAST, c.case_id DESC LIMIT 20 OFFSET 5""")
def w1_by_scorer(t: Tables):
    f = CaseFilter(status="open", label="rumour", risk_level="high")
    return _queue(R.case_queue(t.cases(), t.posts(False), stored(t, SCORERS[2]), f, limit=20, offset=5))


@query("j6_unscored_cases", views="cases case_scores", sql="""
SELECT case_id, external_case_id FROM cases c WHERE NOT EXISTS (SELECT 1 FROM case_scores s WHERE s.case_id = c.case_id)""")
def j6(t: Tables):
    return R.unscored_cases(t.cases(), t.case_scores()).select("case_id", "external_case_id")


@query("j5_cases_missing_a_scorer", views="cases case_model_scores", sql="""
SELECT case_id, external_case_id FROM cases c
WHERE NOT EXISTS (SELECT 1 FROM case_model_scores m WHERE m.case_id = c.case_id AND m.scorer_key = 'case_gbt_oof')
   OR NOT EXISTS (SELECT 1 FROM case_model_scores m WHERE m.case_id = c.case_id AND m.scorer_key = 'case_text_oof')""")
def j5(t: Tables):
    return R.missing_any_scorer(t.cases(), t.case_model_scores(), SCORERS[1:]).select("case_id", "external_case_id")


@query("w3_scoring_worklist", views="cases case_scores", sql=f"""
SELECT case_id, strftime(first_event_at, {S}) AS first_event_at FROM cases c
WHERE NOT EXISTS (SELECT 1 FROM case_scores s WHERE s.case_id = c.case_id)
ORDER BY c.first_event_at NULLS LAST, case_id LIMIT 20""")
def w3(t: Tables):
    return R.scoring_worklist(t.cases(), t.case_scores(), t.case_model_scores()).select(
        "case_id", stamp("first_event_at").alias("first_event_at"))


@query("w2_scored_cases", views="posts cases case_scores", sql=f"""
SELECT c.case_id, c.label, s.score_version, round(s.risk_score, 6) AS risk_score, s.risk_level,
       coalesce(n.post_count, 0) AS post_count
FROM cases c JOIN case_scores s USING (case_id) LEFT JOIN ({COUNTS}) n USING (case_id)
ORDER BY s.risk_score DESC, c.first_event_at DESC NULLS LAST, c.case_id DESC LIMIT 100""")
def w2(t: Tables):
    return R.scored_cases(t.cases(), t.posts(False), t.case_scores()).select(
        "case_id", "label", "score_version", r6("risk_score").alias("risk_score"), "risk_level",
        big("post_count").alias("post_count"))


@query("s13_top_case_export", views="cases case_scores", sql="""
SELECT * FROM (SELECT c.case_id, round(s.risk_score, 6) AS risk_score FROM cases c JOIN case_scores s USING (case_id)
  ORDER BY s.risk_score DESC, c.first_event_at DESC, c.case_id DESC LIMIT 100) WHERE risk_score >= 0.9""")
def s13(t: Tables):
    scored = t.cases().join(t.case_scores(), "case_id")
    return R.top_cases_export(scored, 100, 0.9).select("case_id", r6("risk_score").alias("risk_score"))


LEVEL_SQL = """count(*) FILTER (WHERE s.risk_level = 'high') AS high_risk,
       count(*) FILTER (WHERE s.risk_level = 'medium') AS medium_risk,
       count(*) FILTER (WHERE s.risk_level = 'low') AS low_risk"""


@query("a2_cases_summary", views="cases case_scores", sql=f"""
SELECT count(*) AS total_cases, {LEVEL_SQL}, round(coalesce(avg(s.risk_score), 0), 6) AS mean_risk,
       CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM cases c LEFT JOIN case_scores s USING (case_id)""")
def a2(t: Tables):
    return R.cases_summary(base(t)).withColumn("mean_risk", r6("mean_risk"))


@query("a2_cases_summary_filtered", views="cases case_model_scores", sql=f"""
SELECT count(*) AS total_cases, {LEVEL_SQL}, round(coalesce(avg(s.risk_score), 0), 6) AS mean_risk,
       CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM cases c LEFT JOIN (SELECT * FROM case_model_scores WHERE scorer_key = 'case_gbt_oof') s USING (case_id)
WHERE c.source_name = 'src1' AND c.dataset_split = 'train' AND s.risk_level = 'medium'""")
def a2_filtered(t: Tables):
    f = CaseFilter(source_name="src1", dataset_split="train", risk_level="medium")
    return R.cases_summary(R.scored_base(t.cases(), stored(t, SCORERS[1]), f)).withColumn("mean_risk", r6("mean_risk"))


@query("a4_dashboard_summary", views="posts cases case_scores", sql="""
WITH m AS (SELECT c.*, s.risk_score FROM cases c LEFT JOIN case_scores s USING (case_id))
SELECT count(*) AS total_cases, round(coalesce(avg(risk_score), 0), 6) AS mean_risk,
  (SELECT count(*) FROM posts p JOIN m USING (case_id)) AS total_posts,
  round((SELECT count(*) FROM posts p JOIN m USING (case_id)) / nullif(count(*), 0), 6) AS avg_posts_per_case,
  count(*) FILTER (WHERE status = 'open') AS open_cases, count(*) FILTER (WHERE status = 'closed') AS closed_cases,
  count(*) FILTER (WHERE status = 'finalized') AS finalized_cases,
  count(*) FILTER (WHERE label IN ('rumour', 'rumor')) AS rumour_cases,
  count(*) FILTER (WHERE label IN ('non_rumour', 'non-rumour')) AS non_rumour_cases FROM m""")
def a4(t: Tables):
    return R.dashboard_summary(base(t), t.posts(False)).withColumn("mean_risk", r6("mean_risk")).withColumn(
        "avg_posts_per_case", r6("avg_posts_per_case"))


@query("a5_risk_distribution", views="cases case_scores", sql=f"""
SELECT {LEVEL_SQL}, round(count(*) FILTER (WHERE s.risk_level = 'high') / nullif(count(*), 0), 6) AS high_risk_share
FROM cases c LEFT JOIN case_scores s USING (case_id)""")
def a5(t: Tables):
    return R.risk_distribution(base(t)).withColumn("high_risk_share", r6("high_risk_share"))


ENGAGEMENT_SQL = """
SELECT count(*) AS post_count, sum(likes_count)::BIGINT AS total_likes, sum(reposts_count)::BIGINT AS total_reposts,
  sum(replies_count)::BIGINT AS total_replies, sum(likes_count + reposts_count + replies_count)::BIGINT AS total_engagement,
  count(DISTINCT account_id) AS unique_accounts, count(DISTINCT account_id) FILTER (WHERE is_verified) AS verified_accounts
FROM posts JOIN cases USING (case_id) LEFT JOIN accounts USING (account_id)"""


@query("a6_engagement", views="posts cases accounts", sql=ENGAGEMENT_SQL + " WHERE cases.event_name = 'NATION_3'")
def a6(t: Tables):
    kept = where_chosen(t.cases(), event_name="NATION_3", status="all")
    return R.engagement_totals(kept, t.posts(False), t.accounts())


@query("a6_engagement_of_all", views="posts cases accounts", sql=ENGAGEMENT_SQL)
def a6_all(t: Tables):
    return R.engagement_totals(t.cases(), t.posts(False), t.accounts())


@query("a7_cases_over_time", views="cases case_scores", sql=f"""
SELECT strftime(first_event_at, '%Y-%m-%d') AS day, count(*) AS total, {LEVEL_SQL}
FROM cases c LEFT JOIN case_scores s USING (case_id) GROUP BY 1""")
def a7(t: Tables):
    return R.cases_over_time(base(t)).withColumn("day", F.col("day").cast("string"))


@query("a8_top_events", views="cases case_scores", sql="""
SELECT event_name, count(*) AS case_count, round(coalesce(avg(risk_score), 0), 6) AS avg_risk
FROM cases LEFT JOIN case_scores USING (case_id) GROUP BY 1
ORDER BY case_count DESC, coalesce(avg(risk_score), 0) DESC, event_name LIMIT 12""")
def a8(t: Tables):
    return R.top_events(base(t)).withColumn("avg_risk", r6("avg_risk"))


@query("a9_breakdowns", views="cases case_scores", sql="""
WITH m AS (SELECT c.*, s.risk_score FROM cases c LEFT JOIN case_scores s USING (case_id)), l AS (
  SELECT 'status' AS dimension, coalesce(nullif(status, ''), 'unknown') AS name, risk_score FROM m
  UNION ALL SELECT 'label', coalesce(nullif(label, ''), 'unknown'), risk_score FROM m
  UNION ALL SELECT 'source', coalesce(nullif(source_name, ''), 'unknown'), risk_score FROM m
  UNION ALL SELECT 'dataset', coalesce(nullif(dataset_name || '/' || dataset_split, '/'), 'unknown'), risk_score FROM m)
SELECT dimension, name, count(*) AS case_count, round(coalesce(avg(risk_score), 0), 6) AS avg_risk FROM l GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, avg(risk_score) DESC, name) <= 12""")
def a9(t: Tables):
    return R.breakdowns(base(t)).withColumn("avg_risk", r6("avg_risk"))


PERFORMANCE_SQL = """
SELECT scorer_key, round(coalesce(avg(risk_score), 0), 6) AS avg_risk_score, count(DISTINCT case_id) AS cases_analyzed
FROM (SELECT 'case_scores' AS scorer_key, case_id, risk_score FROM case_scores
      UNION ALL SELECT scorer_key, case_id, risk_score FROM case_model_scores)
WHERE case_id IN (SELECT case_id FROM cases{where}) GROUP BY 1"""


@query("a10_scorer_performance", views="cases case_scores case_model_scores", sql=PERFORMANCE_SQL.format(where=" WHERE label = 'rumour'"))
def a10(t: Tables):
    kept = where_chosen(t.cases(), label="rumour")
    return R.scorer_performance(kept, t.case_scores(), t.case_model_scores()).withColumn(
        "avg_risk_score", r6("avg_risk_score"))


@query("a10_scorer_performance_of_all", views="cases case_scores case_model_scores", sql=PERFORMANCE_SQL.format(where=""))
def a10_all(t: Tables):
    return R.scorer_performance(t.cases(), t.case_scores(), t.case_model_scores()).withColumn(
        "avg_risk_score", r6("avg_risk_score"))


@query("x1_all_scores", views="case_scores case_model_scores", sql="""
SELECT 'case_scores' AS scorer_key, case_id, round(risk_score, 6) AS risk_score FROM case_scores
UNION ALL SELECT scorer_key, case_id, round(risk_score, 6) FROM case_model_scores""")
def x1(t: Tables):
    a = t.case_scores().select(F.lit("case_scores").alias("scorer_key"), "case_id", r6("risk_score").alias("risk_score"))
    return a.unionByName(t.case_model_scores().select("scorer_key", "case_id", r6("risk_score").alias("risk_score")))


@query("c24_radar_points", views="case_scores case_model_scores", sql="""
WITH m AS (SELECT * FROM case_model_scores WHERE scorer_key = 'case_text_oof'), w AS (
  SELECT coalesce(m.case_id, a.case_id) AS case_id,
    CASE WHEN m.case_id IS NOT NULL THEN m.coordination_score ELSE a.coordination_score END AS coordination,
    CASE WHEN m.case_id IS NOT NULL THEN m.temporal_score ELSE a.temporal_score END AS temporal,
    CASE WHEN m.case_id IS NOT NULL THEN m.content_score ELSE a.content_score END AS content
  FROM m FULL JOIN case_scores a ON a.case_id = m.case_id)
SELECT case_id, 'coordination' AS branch, round(coordination, 6) AS value FROM w
UNION ALL SELECT case_id, 'temporal', round(temporal, 6) FROM w UNION ALL SELECT case_id, 'content', round(content, 6) FROM w""")
def c24(t: Tables):
    return R.radar_points(t.case_scores(), t.case_model_scores(), SCORERS[2]).withColumn("value", r6("value"))


@query("c25_score_evidence", views="case_scores", sql="""
WITH l AS (SELECT case_id, 0 AS i, 'temporal' AS name, temporal_score AS value FROM case_scores
  UNION ALL SELECT case_id, 1, 'coordination', coordination_score FROM case_scores
  UNION ALL SELECT case_id, 2, 'content', content_score FROM case_scores)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, i)::INTEGER AS position, name, round(value, 6) AS value FROM l""")
def c25_scores(t: Tables):
    return R.score_evidence(t.case_scores()).withColumn("value", r6("value"))


@query("a14_post_stats", views="posts analysis_results", sql="""
SELECT (SELECT count(*) FROM events) AS total_posts,
  count(*) FILTER (WHERE escalation_priority = 1) AS high_priority_count,
  count(*) FILTER (WHERE escalation_priority = 2) AS medium_priority_count,
  count(*) FILTER (WHERE escalation_priority = 3) AS low_priority_count,
  round(avg(manipulation_score), 6) AS avg_manipulation_score, round(avg(confidence_score), 6) AS avg_confidence
FROM analysis_results""")
def a14(t: Tables):
    out = R.post_stats(t.posts(False), t.analysis_results())
    return out.withColumn("avg_manipulation_score", r6("avg_manipulation_score")).withColumn("avg_confidence", r6("avg_confidence"))


SUMMARY_SQL = """
SELECT count(*) AS total_analyzed, count(*) FILTER (WHERE escalation_priority = 1) AS high_risk,
  count(*) FILTER (WHERE escalation_priority = 2) AS medium_risk, count(*) FILTER (WHERE escalation_priority = 3) AS low_risk,
  round(coalesce(avg(manipulation_score), 0), 6) AS average_score
FROM analysis_results JOIN posts USING (post_id)"""


@query("a1_analysis_summary", views="posts analysis_results", sql=SUMMARY_SQL + " WHERE source_type = 'dataset' AND dataset_split = 'train'")
def a1(t: Tables):
    return R.analysis_summary(t.posts(False), t.analysis_results(), dataset_split="train").withColumn(
        "average_score", r6("average_score"))


@query("a1_analysis_summary_of_all", views="posts analysis_results", sql=SUMMARY_SQL)
def a1_all(t: Tables):
    return R.analysis_summary(t.posts(False), t.analysis_results(), source_type="all").withColumn("average_score", r6("average_score"))


LINKED = "FROM analysis_results r JOIN posts p USING (post_id) JOIN cases c USING (case_id)"


def linked(t: Tables, **f):
    return R.results_of_cases(where_equal(t.cases(), **f), t.posts(False), t.analysis_results())


STATS_SQL = f"""
SELECT round(avg(manipulation_score), 6) AS avg_manipulation, round(avg(coordination_contribution), 6) AS avg_coordination,
  round(avg(temporal_contribution), 6) AS avg_temporal, round(avg(narrative_contribution), 6) AS avg_narrative,
  round(avg(confidence_score), 6) AS avg_confidence, count(*) AS total_analyzed,
  count(*) FILTER (WHERE manipulation_score >= 0.7) AS high_manipulation {LINKED}"""


def stats_of(rows):
    out = R.manipulation_stats(rows)
    return out.select(*[r6(c).alias(c) if c.startswith("avg") else c for c in out.columns])


@query("a11_manipulation_stats", views="posts cases analysis_results", sql=STATS_SQL + " WHERE c.status = 'closed'")
def a11(t: Tables):
    return stats_of(linked(t, status="closed"))


@query("a11_manipulation_stats_of_all", views="posts cases analysis_results", sql=STATS_SQL)
def a11_all(t: Tables):
    return stats_of(linked(t))


@query("a12_branch_time_series", views="posts cases analysis_results", sql=f"""
SELECT strftime(r.created_at, '%Y-%m-%d') AS day, round(avg(coordination_contribution), 6) AS coordination,
  round(avg(temporal_contribution), 6) AS temporal, round(avg(narrative_contribution), 6) AS narrative, count(*) AS cnt
{LINKED} GROUP BY 1 HAVING day >= '2024-01-16'""")
def a12(t: Tables):
    out = R.branch_time_series(linked(t), 14, F.lit("2024-01-30").cast("date"))
    return out.select(F.col("day").cast("string").alias("day"), r6("coordination").alias("coordination"),
                      r6("temporal").alias("temporal"), r6("narrative").alias("narrative"), "cnt")


@query("a13_manipulation_trend", views="posts cases analysis_results", sql=f"""
SELECT strftime(r.created_at, '%Y-%m-%d') AS day, round(avg(manipulation_score), 6) AS avg_score,
  round(avg(coordination_contribution), 6) AS coordination, round(avg(temporal_contribution), 6) AS temporal,
  round(avg(narrative_contribution), 6) AS narrative, count(DISTINCT case_id) AS cases_count {LINKED} GROUP BY 1""")
def a13(t: Tables):
    out = R.manipulation_trend(linked(t))
    return out.select(F.col("day").cast("string").alias("day"), *[
        r6(c).alias(c) for c in ("avg_score", "coordination", "temporal", "narrative")], "cases_count")


TITLE = "coalesce(nullif(c.title, ''), nullif(c.event_name, ''), c.external_case_id, 'case #' || c.case_id)"


@query("w5_recent_evidence", views="posts cases analysis_results", sql=f"""
SELECT c.case_id, {TITLE} AS case_title, round(manipulation_score, 6) AS manipulation_score, confidence_note AS summary,
  strftime(r.created_at, {S}) AS created_at {LINKED} ORDER BY manipulation_score DESC, r.created_at DESC, post_id LIMIT 12""")
def w5(t: Tables):
    out = R.recent_evidence(t.cases(), t.posts(False), t.analysis_results())
    return out.select("case_id", "case_title", r6("manipulation_score").alias("manipulation_score"),
                      F.col("confidence_note").alias("summary"), stamp("created_at").alias("created_at"))


@query("w4_top_risk_cases", views="posts cases case_scores", sql=f"""
SELECT c.case_id, c.external_case_id, {TITLE} AS title, c.event_name, c.status, c.label,
  coalesce(n.post_count, 0) AS post_count, round(coalesce(s.risk_score, 0), 6) AS risk_score, coalesce(s.risk_level, 'low') AS risk_level
FROM cases c LEFT JOIN case_scores s USING (case_id) LEFT JOIN ({COUNTS}) n USING (case_id)
ORDER BY coalesce(s.risk_score, 0) DESC, post_count DESC, c.case_id LIMIT 12""")
def w4(t: Tables):
    return R.top_risk_cases(base(t), t.posts(False)).withColumn("risk_score", r6("risk_score"))


@query("w6_top_results", views="posts accounts analysis_results", sql="""
SELECT r.post_id, round(manipulation_score, 6) AS manipulation_score, round(confidence_score, 6) AS confidence_score,
  escalation_priority, confidence_note, p.content, p.likes_count, p.reposts_count, a.username, a.display_name
FROM analysis_results r JOIN posts p USING (post_id) JOIN accounts a USING (account_id)
ORDER BY r.manipulation_score DESC, r.post_id LIMIT 20""")
def w6(t: Tables):
    out = R.top_results(t.posts(), t.accounts(), t.analysis_results())
    return out.select("post_id", r6("manipulation_score").alias("manipulation_score"), r6("confidence_score").alias("confidence_score"),
                      "escalation_priority", "confidence_note", "content", "likes_count", "reposts_count", "username", "display_name")


@query("a18_ingestion_runs", views="posts ingestion_runs", sql=f"""
SELECT i.run_id, i.source_name, i.status, strftime(i.started_at, {S}) AS started_at, count(p.post_id) AS posts_ingested
FROM ingestion_runs i LEFT JOIN posts p ON p.ingestion_run_id = i.run_id
GROUP BY i.run_id, i.source_name, i.status, i.started_at ORDER BY i.started_at DESC, i.run_id LIMIT 20""")
def a18(t: Tables):
    return R.runs_with_counts(t.ingestion_runs(), t.posts(False)).select(
        "run_id", "source_name", "status", stamp("started_at").alias("started_at"), "posts_ingested")


BOARD = """SELECT a.account_id, a.username, a.followers_count, a.is_verified, count(*) AS dataset_post_count,
  count(DISTINCT p.case_id) AS case_count, count(*) FILTER (WHERE p.is_case_root) AS root_post_count,
  sum(likes_count + reposts_count + replies_count)::BIGINT AS total_engagement,
  coalesce(avg(r.manipulation_score), 0) AS avg_manipulation, coalesce(max(r.manipulation_score), 0) AS max_manipulation,
  coalesce(avg(s.risk_score), 0) AS avg_risk_score,
  count(DISTINCT p.case_id) FILTER (WHERE s.risk_level = 'high') AS high_risk_case_count,
  min(published_at) AS first_seen_at, max(published_at) AS last_seen_at
FROM accounts a JOIN posts p USING (account_id) LEFT JOIN analysis_results r USING (post_id)
LEFT JOIN case_scores s USING (case_id)"""
BOARD_OUT = f"""account_id, username, followers_count, dataset_post_count, case_count, root_post_count, total_engagement,
  round(avg_manipulation, 6) AS avg_manipulation, round(max_manipulation, 6) AS max_manipulation,
  round(avg_risk_score, 6) AS avg_risk_score, high_risk_case_count,
  strftime(first_seen_at, {S}) AS first_seen_at, strftime(last_seen_at, {S}) AS last_seen_at"""
BOARD_VIEWS = "posts accounts analysis_results case_scores"


def board(t: Tables, **kw):
    return R.account_leaderboard(t.accounts(), t.posts(False), t.analysis_results(), t.case_scores(), **kw)


def _board_out(df):
    return df.select(
        "account_id", "username", "followers_count", "dataset_post_count", "case_count", "root_post_count", "total_engagement",
        *[r6(c).alias(c) for c in ("avg_manipulation", "max_manipulation", "avg_risk_score")], "high_risk_case_count",
        stamp("first_seen_at").alias("first_seen_at"), stamp("last_seen_at").alias("last_seen_at"))


@query("a17_account_leaderboard", views=BOARD_VIEWS, sql=f"""
SELECT {BOARD_OUT} FROM ({BOARD} GROUP BY ALL) ORDER BY total_engagement DESC, dataset_post_count DESC, account_id LIMIT 50""")
def a17(t: Tables):
    return _board_out(R.leaderboard_page(board(t)))


for _sort, _keys in R.LEADERBOARD_SORTS.items():
    if _sort == "engagement":
        continue
    _tie = ", ".join(f"round({k}, 9) DESC NULLS LAST" for k in _keys)

    @query(f"a17_account_leaderboard_by_{_sort}", views=BOARD_VIEWS, sql=f"""
SELECT {BOARD_OUT} FROM ({BOARD} WHERE a.is_verified AND p.dataset_split = 'train' GROUP BY ALL)
ORDER BY {_tie}, account_id LIMIT 10 OFFSET 2""")
    def a17_sorted(t: Tables, sort=_sort, keys=_keys):
        rows = board(t, only_verified=True, dataset_split="train")
        for k in keys:
            rows = rows.withColumn(k, F.round(k, 9) if k.startswith(("avg", "max")) else F.col(k))
        return _board_out(R.leaderboard_page(rows, sort, 10, 2))


@query("p4_account_search", views=BOARD_VIEWS, sql=f"""
SELECT {BOARD_OUT} FROM ({BOARD} WHERE (contains(lower(a.username), 'user_1') OR contains(lower(coalesce(a.display_name, '')), 'user_1')
  OR contains(lower(a.external_id), 'user_1')) AND a.is_bot GROUP BY ALL)""")
def p4(t: Tables):
    return _board_out(board(t, search=" USER_1 ", only_bots=True))


@query("a20_account_totals", views=BOARD_VIEWS, sql=f"""
SELECT count(*) AS accounts, sum(dataset_post_count)::BIGINT AS posts, sum(case_count)::BIGINT AS cases,
  sum(total_engagement)::BIGINT AS engagement, count(*) FILTER (WHERE is_verified) AS verified,
  round(max(max_manipulation), 6) AS max_manipulation FROM ({BOARD} GROUP BY ALL)""")
def a20(t: Tables):
    return R.leaderboard_totals(board(t)).withColumn("max_manipulation", r6("max_manipulation"))


NEWEST = "row_number() OVER (PARTITION BY account_id ORDER BY published_at DESC, post_id DESC)"


@query("w8_newest_posts", views="posts", sql=f"""
SELECT account_id, post_id, recency::INTEGER AS recency FROM (SELECT account_id, post_id, {NEWEST} AS recency FROM posts) WHERE recency <= 10""")
def w8(t: Tables):
    return R.newest_posts(t.posts(False), 10).select("account_id", "post_id", "recency")


@query("a19_account_recent_results", views="posts analysis_results", sql=f"""
SELECT account_id, count(*) AS total_posts_analyzed, round(avg(manipulation_score), 3) AS average_manipulation_score,
  count(*) FILTER (WHERE manipulation_score > 0.6) AS high_manipulation_posts
FROM (SELECT *, {NEWEST} AS rn FROM posts) JOIN analysis_results USING (post_id) WHERE rn <= 50 GROUP BY 1""")
def a19(t: Tables):
    newest = R.newest_posts(t.posts(False).select("account_id", "post_id", "published_at"), 50)
    return R.account_recent_results(newest, t.analysis_results())


@query("a15_case_accounts", views="posts accounts", sql=f"""
SELECT case_id, account_id, username, is_bot, is_verified, count(*) AS case_post_count,
  strftime(min(published_at), {S}) AS first_post_at, strftime(max(published_at), {S}) AS last_post_at,
  bool_or(is_case_root) AS has_root_post FROM posts JOIN accounts USING (account_id) GROUP BY ALL""")
def a15(t: Tables):
    return R.case_accounts(t.posts(False), t.accounts()).select(
        "case_id", "account_id", "username", "is_bot", "is_verified", "case_post_count",
        stamp("first_post_at").alias("first_post_at"), stamp("last_post_at").alias("last_post_at"), "has_root_post")


@query("a16_case_artifacts", views="posts post_tags post_links", sql="""
WITH child AS (SELECT post_id, 'tag' AS kind, tag AS value FROM post_tags
  UNION ALL SELECT post_id, 'url', coalesce(nullif(expanded_url, ''), url) FROM post_links
  UNION ALL SELECT post_id, 'domain', coalesce(nullif(domain, ''), nullif(expanded_url, ''), url) FROM post_links)
SELECT case_id, child.kind AS kind, value, count(*) AS count FROM child JOIN posts USING (post_id) WHERE trim(value) <> '' GROUP BY 1, 2, 3
QUALIFY row_number() OVER (PARTITION BY case_id, child.kind ORDER BY count(*) DESC, value) <= 20""")
def a16(t: Tables):
    return R.artifact_counts(t.posts(False), t.post_tags(), t.post_links()).select("case_id", "kind", "value", "count")


@query("a21_case_totals", views="posts cases accounts", sql="""
WITH pa AS (SELECT case_id, account_id, any_value(is_verified) AS v, count(*) AS n, sum(likes_count + reposts_count + replies_count) AS e
            FROM posts JOIN accounts USING (account_id) GROUP BY 1, 2)
SELECT case_id, sum(n)::BIGINT AS post_count, sum(e)::BIGINT AS total_engagement, count(*) FILTER (WHERE v) AS verified_accounts,
  count(*) AS accounts, round(max(n) / sum(n), 6) AS top_account_share,
  any_value(greatest(1, floor(epoch_us(last_event_at - first_event_at) / 60000000.0 + 0.5)))::BIGINT AS duration_min
FROM pa JOIN cases USING (case_id) GROUP BY 1""")
def a21(t: Tables):
    return R.case_totals(t.posts(False), t.accounts(), t.cases()).select(
        "case_id", "post_count", "total_engagement", "verified_accounts", "accounts",
        r6("top_account_share").alias("top_account_share"), big("duration_min").alias("duration_min"))


OFFSETS = """SELECT p.*, greatest(0, floor((epoch_us(p.published_at) // 1000 - epoch_us(c.first_event_at) // 1000) / 1000.0 + 0.5))::BIGINT AS t_offset_sec
  FROM posts p JOIN cases c USING (case_id)"""


@query("w12_post_offsets", views="posts cases", sql=f"""
SELECT case_id, post_id, t_offset_sec, CASE WHEN is_case_root THEN 'root' WHEN reply_to_post_id IS NOT NULL THEN 'reply'
  ELSE 'repost' END AS kind_of_post FROM ({OFFSETS})""")
def w12(t: Tables):
    return R.post_offsets(t.posts(False), t.cases()).select("case_id", "post_id", "t_offset_sec", "kind_of_post")


@query("a22_activity_timeline", views="posts cases", sql=f"""
WITH o AS ({OFFSETS}), s AS (SELECT case_id, greatest(max(t_offset_sec), 1) AS span FROM o GROUP BY 1),
b AS (SELECT case_id, least(39, floor(t_offset_sec / span * 39))::INTEGER AS bucket, count(*) AS n FROM o JOIN s USING (case_id) GROUP BY 1, 2)
SELECT s.case_id, g.bucket, coalesce(b.n, 0) AS posts FROM s CROSS JOIN (SELECT unnest(range(40))::INTEGER AS bucket) g
LEFT JOIN b ON b.case_id = s.case_id AND b.bucket = g.bucket""")
def a22(t: Tables):
    return R.activity_timeline(t.posts(False), t.cases()).select("case_id", "bucket", big("posts").alias("posts"))


@query("j12_posts_with_children", views="posts post_tags post_links", sql="""
SELECT post_id, coalesce((SELECT string_agg(tag, ' ' ORDER BY tag) FROM post_tags x WHERE x.post_id = p.post_id), '') AS tags,
  coalesce((SELECT string_agg(coalesce(nullif(expanded_url, ''), url), ' ' ORDER BY coalesce(nullif(expanded_url, ''), url))
            FROM post_links x WHERE x.post_id = p.post_id), '') AS links FROM posts p""")
def j12(t: Tables):
    out = R.posts_with_children(t.posts(False), t.post_tags(), t.post_links())
    return out.select("post_id", F.array_join("tags", " ").alias("tags"), F.array_join("links", " ").alias("links"))


@query("j7_children_of_open_cases", views="posts cases post_tags", sql="""
SELECT post_id, tag FROM post_tags WHERE post_id IN
  (SELECT post_id FROM posts WHERE case_id IN (SELECT case_id FROM cases WHERE status = 'open'))""")
def j7(t: Tables):
    wanted = where_equal(t.cases(), status="open").select("case_id")
    kept = t.posts(False).join(wanted, "case_id", "left_semi").select("post_id")
    return t.post_tags().join(kept, "post_id", "left_semi")


@query("j4_unanalysed_posts", views="posts analysis_results", sql=f"""
SELECT post_id, account_id, strftime(published_at, {S}) AS published_at FROM posts p
WHERE NOT EXISTS (SELECT 1 FROM analysis_results r WHERE r.post_id = p.post_id)""")
def j4(t: Tables):
    out = t.posts(False).join(t.analysis_results(), "post_id", "left_anti")
    return out.select("post_id", "account_id", stamp("published_at").alias("published_at"))


@query("j1_posts_with_authors", views="posts accounts", sql="""
SELECT post_id, case_id, username, followers_count, is_verified, is_case_root, likes_count FROM posts JOIN accounts USING (account_id)""")
def j1(t: Tables):
    return t.posts(False).join(t.accounts(), "account_id").select(
        "post_id", "case_id", "username", "followers_count", "is_verified", "is_case_root", "likes_count")


@query("j2_post_counts_per_case", views="posts cases case_scores", sql=f"""
SELECT c.case_id, coalesce(n.post_count, 0) AS post_count, s.risk_level FROM cases c
LEFT JOIN ({COUNTS}) n USING (case_id) LEFT JOIN case_scores s USING (case_id)""")
def j2(t: Tables):
    return R.with_post_counts(base(t), t.posts(False)).select("case_id", big("post_count").alias("post_count"), "risk_level")


@query("j10_post_scores_by_account", views="posts accounts analysis_results case_scores", sql="""
SELECT post_id, username, round(manipulation_score, 6) AS manipulation_score, round(risk_score, 6) AS risk_score
FROM accounts JOIN posts USING (account_id) LEFT JOIN analysis_results USING (post_id) LEFT JOIN case_scores USING (case_id)""")
def j10(t: Tables):
    out = (t.posts(False).join(t.accounts(), "account_id").join(t.analysis_results(), "post_id", "left")
           .join(t.case_scores(), "case_id", "left"))
    return out.select("post_id", "username", r6("manipulation_score").alias("manipulation_score"), r6("risk_score").alias("risk_score"))


@query("p6_posts_in_range", views="posts accounts", sql=f"""
SELECT post_id, username, followers_count, strftime(published_at, {S}) AS published_at FROM posts JOIN accounts USING (account_id)
WHERE published_at BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'""")
def p6(t: Tables):
    at = lambda s: F.lit(s).cast("timestamp")
    out = R.posts_in_range(t.posts(False), t.accounts(), at("2024-01-10 06:00:00"), at("2024-01-20 18:30:00"))
    return out.select("post_id", "username", "followers_count", stamp("published_at").alias("published_at"))


@query("p8_labelled_cases", views="cases", sql="SELECT case_id, label, " + TITLE + """ AS title FROM cases c
WHERE coalesce(label, '') <> '' AND status IN ('open', 'closed')""")
def p8(t: Tables):
    return t.cases().where(not_blank("label") & F.col("status").isin("open", "closed")).select(
        "case_id", "label", R.display_title().alias("title"))


@query("x3_distinct_active_accounts", views="posts cases", sql="""
SELECT DISTINCT account_id FROM posts WHERE case_id IN (SELECT case_id FROM cases WHERE source_name = 'src2')""")
def x3(t: Tables):
    wanted = where_equal(t.cases(), source_name="src2").select("case_id")
    return t.posts(False).join(wanted, "case_id", "left_semi").select("account_id").distinct()


@query("x3_distinct_active_accounts_of_all", views="posts cases", sql="""
SELECT DISTINCT account_id FROM posts WHERE case_id IN (SELECT case_id FROM cases)""")
def x3_all(t: Tables):
    return t.posts(False).join(t.cases().select("case_id"), "case_id", "left_semi").select("account_id").distinct()


@query("w11_model_score_list", views="case_model_scores", sql="""
SELECT case_id, scorer_key, model_version, round(risk_score, 6) AS risk_score, risk_level, round(confidence_score, 6) AS confidence_score,
  row_number() OVER (PARTITION BY case_id ORDER BY case_model_scores.risk_score DESC, scorer_key)::INTEGER AS position FROM case_model_scores""")
def w11(t: Tables):
    return R.model_score_list(t.case_model_scores()).select(
        "case_id", "scorer_key", "model_version", r6("risk_score").alias("risk_score"), "risk_level",
        r6("confidence_score").alias("confidence_score"), "position")


@query("w7_trending_tags", views="posts post_tags", sql="""
SELECT tag, count(DISTINCT account_id) AS today_accounts, count(*) AS today_uses FROM post_tags JOIN posts USING (post_id)
WHERE published_at >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1 ORDER BY today_uses DESC, tag LIMIT 20""")
def w7(t: Tables):
    day = t.posts(False).where(F.col("published_at") >= F.lit("2024-01-30").cast("timestamp"))
    per_account = t.post_tags().join(day, "post_id").groupBy("tag", "account_id").agg(F.count("*").alias("n"))
    uses = per_account.groupBy("tag").agg(F.count("*").alias("today_accounts"), F.sum("n").alias("today_uses"))
    return R.trending(uses, 20)


@query("a24_most_common_version", views="case_model_scores", sql="""
SELECT scorer_key, model_version FROM case_model_scores GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY scorer_key ORDER BY count(*) DESC, model_version) = 1""")
def a24(t: Tables):
    return R.most_common(t.case_model_scores(), ["scorer_key"], "model_version")


@query("a25_common_or_mixed", views="cases case_scores", sql="""
SELECT status, CASE WHEN count(DISTINCT score_version) = 1 THEN max(score_version) ELSE 'mixed' END AS score_version,
  CASE WHEN count(DISTINCT pipeline_hash) = 1 THEN max(pipeline_hash) ELSE 'mixed' END AS pipeline_hash
FROM cases JOIN case_scores USING (case_id) GROUP BY 1""")
def a25(t: Tables):
    return t.cases().join(t.case_scores(), "case_id").groupBy("status").agg(
        R.common_or_mixed("score_version").alias("score_version"), R.common_or_mixed("pipeline_hash").alias("pipeline_hash"))


@query("n7_risk_levels", views="case_model_scores", sql="""
SELECT case_id, scorer_key, CASE WHEN risk_score >= 0.8 THEN 'high' WHEN risk_score >= 0.5 THEN 'medium' ELSE 'low' END AS card_level,
  risk_level FROM case_model_scores""")
def n7(t: Tables):
    return t.case_model_scores().select("case_id", "scorer_key", risk_level(F.col("risk_score"), 0.8, 0.5).alias("card_level"),
                                        risk_level(F.col("risk_score")).alias("risk_level"))


@query("heavy_order_queue", sql=f"""
SELECT o.o_orderkey AS case_id, o.o_orderstatus AS status, n.n_name AS event_name, count(l.l_orderkey) AS post_count,
  round(o.o_totalprice, 2) AS risk_score FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_orderstatus, n.n_name, o.o_totalprice ORDER BY o.o_totalprice DESC, o.o_orderkey DESC LIMIT 100""")
def heavy_queue(t: Tables):
    nation = t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("event_name"))
    people = t.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nation, "c_nationkey")
    cases = t.raw("orders").join(people, "o_custkey").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), "event_name",
        F.col("o_orderdate").alias("first_event_at"))
    scores = t.raw("orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_totalprice").alias("risk_score"))
    page = cases.join(scores, "case_id").orderBy(F.desc("risk_score"), F.desc("case_id")).limit(100)
    posts = t.raw("lineitem").select(F.col("l_orderkey").alias("case_id"))
    return R.page_with_post_counts(page, posts).select(
        "case_id", "status", "event_name", big("post_count").alias("post_count"), F.round("risk_score", 2).alias("risk_score"))
