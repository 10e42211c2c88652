"""Metrics, comparison, ensembles and table maintenance by name, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import metrics as M, upsert as U
from tidemark.plans.registry import big, query, r6, stamp
from tidemark.plans.tables import SCORERS, Tables
from tidemark.plans.tables_sql import STAMP
from tidemark.sources.live import trending_tags
from tidemark.session import shared_folder

WEIGHTS = {SCORERS[0]: 0.0, SCORERS[1]: 0.35, SCORERS[2]: 0.65}

ITEMS_SQL = """items AS (SELECT m.scorer_key, m.case_id, m.model_version, c.external_case_id, c.event_name, c.label, m.risk_score AS score,
  (replace(replace(lower(trim(c.label)), '-', '_'), ' ', '_') IN ('rumour', 'rumor'))::INT AS y
  FROM case_model_scores m JOIN cases c USING (case_id) WHERE coalesce(c.label, '') <> '')"""
EVAL_SQL = """items AS (SELECT 'toxic' AS scorer_key, doc_id AS case_id, toxic AS y, (n_chars % 1000) / 1000.0::DOUBLE AS score, quality, source
  FROM labels JOIN documents USING (doc_id))"""
CURVE = """curve AS (SELECT scorer_key, t / 100.0::DOUBLE AS threshold, sum((score >= t / 100.0::DOUBLE)::INT * y) AS tp,
  sum((score >= t / 100.0::DOUBLE)::INT * (1 - y)) AS fp, sum(y) AS p, sum(1 - y) AS n FROM items CROSS JOIN range(101) r(t) GROUP BY 1, 2),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END AS recall FROM curve),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates),
best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY scorer_key ORDER BY f1 DESC, threshold) = 1)"""
RANKS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY scorer_key ORDER BY score DESC, case_id) AS rn,
  sum(y) OVER (PARTITION BY scorer_key ORDER BY score DESC, case_id ROWS UNBOUNDED PRECEDING) AS seen,
  rank() OVER (PARTITION BY scorer_key ORDER BY score) + (count(*) OVER (PARTITION BY scorer_key, score) - 1) / 2.0::DOUBLE AS midrank FROM items),
rank_metrics AS (SELECT scorer_key, avg(y) FILTER (WHERE rn <= 10) AS precision_at_10, avg(y) FILTER (WHERE rn <= 20) AS precision_at_20,
  avg(y) FILTER (WHERE rn <= 100) AS precision_at_100, avg(y) FILTER (WHERE rn <= 500) AS precision_at_500,
  CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(midrank) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)) END AS roc_auc,
  sum(seen::DOUBLE / rn) FILTER (WHERE y = 1) / nullif(sum(y), 0) AS pr_auc FROM ranked GROUP BY 1)"""
TIED_AP = """cells AS (SELECT scorer_key, score, sum(y) AS pos, count(*) AS n FROM items GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM cells WINDOW w AS (PARTITION BY scorer_key ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
tied AS (SELECT scorer_key, sum(pos * cp::DOUBLE / cn) / nullif(sum(pos), 0) AS tied_pr_auc FROM cum GROUP BY 1)"""
ITEM_VIEWS = "cases case_model_scores"


def items(t: Tables):
    return M.labelled_scores(t.case_model_scores(), t.cases())


def toxic_items(t: Tables):
    documents = t.raw("documents").select("doc_id", "n_chars", "source")
    return t.raw("labels").join(documents, "doc_id").select(
        F.lit("toxic").alias("scorer_key"), F.col("doc_id").alias("case_id"), F.col("toxic").alias("y"),
        (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("score"), "quality", "source")


@query("e1_label_classes", views="cases", sql="""
SELECT replace(replace(lower(trim(label)), '-', '_'), ' ', '_') AS label,
  replace(replace(lower(trim(label)), '-', '_'), ' ', '_') IN ('rumour', 'rumor') AS positive, count(*) AS cases FROM cases GROUP BY 1, 2""")
def e1(t: Tables):
    label = M.normalise_label(F.col("label"))
    return t.cases().groupBy(label.alias("label"), M.is_positive(F.col("label")).alias("positive")).agg(F.count("*").alias("cases"))


@query("e2_precision_at_k", views=ITEM_VIEWS, sql=f"""WITH {ITEMS_SQL}, {RANKS}
SELECT scorer_key, round(precision_at_10, 6) AS precision_at_10, round(precision_at_20, 6) AS precision_at_20, round(precision_at_500, 6) AS precision_at_500 FROM rank_metrics""")
def e2(t: Tables):
    out = M.precision_at(items(t), 10, 20, 500)
    return out.select("scorer_key", *[r6(f"precision_at_{k}").alias(f"precision_at_{k}") for k in (10, 20, 500)])


@query("e3_confusion_at_threshold", views=ITEM_VIEWS, sql=f"""WITH {ITEMS_SQL}
SELECT scorer_key, sum((score >= 0.6)::INT * y)::BIGINT AS tp, sum((score >= 0.6)::INT * (1 - y))::BIGINT AS fp, sum((score < 0.6)::INT * (1 - y))::BIGINT AS tn,
  sum((score < 0.6)::INT * y)::BIGINT AS fn, round(sum((score >= 0.6)::INT * y)::DOUBLE / sum((score >= 0.6)::INT), 6) AS precision,
  round(sum((score >= 0.6)::INT * y)::DOUBLE / sum(y), 6) AS recall,
  round(2.0::DOUBLE * sum((score >= 0.6)::INT * y) / (sum((score >= 0.6)::INT) + sum(y)), 6) AS f1 FROM items GROUP BY 1""")
def e3(t: Tables):
    out = M.confusion_at(items(t), 0.6)
    return out.select("scorer_key", *[big(c).alias(c) for c in ("tp", "fp", "tn", "fn")], *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("e4_threshold_curve", views=ITEM_VIEWS, sql=f"""WITH {ITEMS_SQL}, {CURVE}
SELECT scorer_key, round(threshold, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def e4(t: Tables):
    out = M.threshold_curve(items(t))
    return out.select("scorer_key", r6("threshold").alias("threshold"), big("tp").alias("tp"), big("fp").alias("fp"),
                      *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


METRIC_COLS = ["precision_at_10", "precision_at_20", "precision", "recall", "f1", "roc_auc", "pr_auc", "best_threshold"]
METRICS_SELECT = "round(best.threshold, 6) AS best_threshold, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in METRIC_COLS if c != "best_threshold")


@query("e5_e6_rank_metrics_on_labels", sql=f"""WITH {EVAL_SQL}, {CURVE}, {RANKS}
SELECT scorer_key, {METRICS_SELECT} FROM best JOIN rank_metrics USING (scorer_key)""")
def e5(t: Tables):
    out = M.model_metrics(toxic_items(t))
    return out.select("scorer_key", *[r6(c).alias(c) for c in METRIC_COLS])


@query("e8_model_comparison", views=ITEM_VIEWS, sql=f"""WITH {ITEMS_SQL}, {CURVE}, {RANKS},
v AS (SELECT scorer_key, model_version FROM items GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY scorer_key ORDER BY count(*) DESC, model_version) = 1),
k AS (SELECT scorer_key, count(*) AS case_count, sum(y)::BIGINT AS positive_cases, sum(1 - y)::BIGINT AS negative_cases FROM items GROUP BY 1)
SELECT scorer_key, case_count, positive_cases, negative_cases, model_version, {METRICS_SELECT}
FROM k JOIN v USING (scorer_key) JOIN best USING (scorer_key) JOIN rank_metrics USING (scorer_key)""")
def e8(t: Tables):
    out = M.model_comparison(items(t))
    return out.select("scorer_key", "case_count", big("positive_cases").alias("positive_cases"), big("negative_cases").alias("negative_cases"),
                      "model_version", *[r6(c).alias(c) for c in METRIC_COLS])


@query("e8_top_compared_cases", views=ITEM_VIEWS, sql=f"""WITH {ITEMS_SQL},
b AS (SELECT case_id, score FROM items WHERE scorer_key = 'case_text_oof' ORDER BY score DESC, case_id LIMIT 20)
SELECT i.case_id, any_value(label) AS label, round(any_value(b.score), 6) AS ranking_score,
  string_agg(scorer_key || '=' || format('{{:.3f}}', i.score), ', ' ORDER BY scorer_key) AS component_scores FROM items i JOIN b USING (case_id) GROUP BY 1""")
def e8_top(t: Tables):
    out = M.top_compared_cases(items(t), SCORERS[2], 20)
    parts = F.transform(F.map_entries("component_scores"), lambda e: F.concat(e["key"], F.lit("="), M.fixed(e["value"], 3)))
    return out.select("case_id", "label", r6("ranking_score").alias("ranking_score"), F.array_join(parts, ", ").alias("component_scores"))


@query("e9_wide_scores", views=ITEM_VIEWS, sql=f"""WITH {ITEMS_SQL}
SELECT case_id, label, round(max(score) FILTER (WHERE scorer_key = 'case_logreg_oof'), 6) AS case_logreg_oof,
  round(max(score) FILTER (WHERE scorer_key = 'case_gbt_oof'), 6) AS case_gbt_oof, round(max(score) FILTER (WHERE scorer_key = 'case_text_oof'), 6) AS case_text_oof
FROM items GROUP BY 1, 2 HAVING count(DISTINCT scorer_key) = 3""")
def e9(t: Tables):
    return M.wide_scores(items(t), SCORERS).select("case_id", "label", *[r6(k).alias(k) for k in SCORERS])


ENSEMBLE = f"""WITH {ITEMS_SQL}, w AS (SELECT case_id, any_value(event_name) AS event_name, any_value(y) AS y, max(score) FILTER (WHERE scorer_key = 'case_logreg_oof') AS a,
  max(score) FILTER (WHERE scorer_key = 'case_gbt_oof') AS b, max(score) FILTER (WHERE scorer_key = 'case_text_oof') AS c FROM items GROUP BY 1 HAVING count(DISTINCT scorer_key) = 3),
e AS (SELECT *, greatest(0.0, least(1.0, 0.0 + a * 0.0::DOUBLE + b * 0.35::DOUBLE + c * 0.65::DOUBLE)) AS s FROM w)"""


def ensemble(t: Tables):
    return M.ensemble_scores(M.wide_scores(items(t), SCORERS), M.normalised_weights(WEIGHTS, SCORERS))


@query("e10_ensemble_scores", views=ITEM_VIEWS, sql=ENSEMBLE + """
SELECT case_id, round(s, 6) AS risk_score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
  round(greatest(s, 1 - s), 6) AS confidence_score, format('Weighted ensemble score={:.4f}. Components: case_logreg_oof={:.4f}*0.00, case_gbt_oof={:.4f}*0.35, case_text_oof={:.4f}*0.65', round(s, 9), a, b, c) AS evidence FROM e""")
def e10(t: Tables):
    wide = M.wide_scores(items(t), SCORERS)
    out = M.ensemble_scores(wide, M.normalised_weights(WEIGHTS, SCORERS))
    evidence = F.concat(F.lit("Weighted ensemble score="), M.fixed(F.round("risk_score", 9), 4), F.lit(". "), F.element_at("evidence", 2))
    return out.select("case_id", r6("risk_score").alias("risk_score"), "risk_level", r6("confidence_score").alias("confidence_score"), evidence.alias("evidence"))


@query("e10_ensemble_metrics", views=ITEM_VIEWS, sql=ENSEMBLE.replace("WITH items", "WITH raw_items").replace("FROM items", "FROM raw_items") + f""",
items AS (SELECT 'case_ensemble_v1' AS scorer_key, case_id, y, round(s, 9) AS score FROM e), {CURVE}, {RANKS}, {TIED_AP}
SELECT scorer_key, {METRICS_SELECT.replace("round(pr_auc, 6) AS pr_auc", "round(tied_pr_auc, 6) AS pr_auc")} FROM best JOIN rank_metrics USING (scorer_key) JOIN tied USING (scorer_key)""")
def e10_metrics(t: Tables):
    rows = ensemble(t).select("scorer_key", "case_id", "y", F.round("risk_score", 9).alias("score"))
    return M.model_metrics(rows, tied_scores=True).select("scorer_key", *[r6(c).alias(c) for c in METRIC_COLS])


@query("e11_fold_metrics", views=ITEM_VIEWS, sql=f"""WITH raw_{ITEMS_SQL},
items AS (SELECT event_name AS scorer_key, case_id, y, score FROM raw_items WHERE scorer_key = 'case_gbt_oof'), {RANKS}, {TIED_AP},
c AS (SELECT scorer_key, count(*) AS rows, sum(y)::BIGINT AS positive_rows, sum((score >= 0.5)::INT * y) AS tp, sum((score >= 0.5)::INT) AS pp FROM items GROUP BY 1)
SELECT scorer_key AS test_event, rows, positive_rows, round(CASE WHEN pp > 0 THEN tp::DOUBLE / pp ELSE 0 END, 6) AS precision,
  round(CASE WHEN positive_rows > 0 THEN tp::DOUBLE / positive_rows ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (pp + positive_rows) ELSE 0 END, 6) AS f1,
  round(roc_auc, 6) AS roc_auc, round(tied_pr_auc, 6) AS pr_auc FROM c JOIN rank_metrics USING (scorer_key) JOIN tied USING (scorer_key)""")
def e11(t: Tables):
    rows = items(t).where(F.col("scorer_key") == SCORERS[1]).select("event_name", "case_id", "y", "score")
    out = M.fold_metrics(rows)
    return out.select("test_event", big("rows").alias("rows"), big("positive_rows").alias("positive_rows"),
                      *[r6(c).alias(c) for c in ("precision", "recall", "f1", "roc_auc", "pr_auc")])


@query("e12_best_scorers", views=ITEM_VIEWS, sql=f"""WITH {ITEMS_SQL}, {CURVE}, {RANKS},
m AS (SELECT scorer_key, precision_at_10, f1, roc_auc, pr_auc FROM best JOIN rank_metrics USING (scorer_key)),
l AS (SELECT scorer_key, pr_auc AS pr, 'precision_at_10' AS metric, precision_at_10 AS value FROM m UNION ALL SELECT scorer_key, pr_auc, 'f1', f1 FROM m
  UNION ALL SELECT scorer_key, pr_auc, 'roc_auc', roc_auc FROM m UNION ALL SELECT scorer_key, pr_auc, 'pr_auc', pr_auc FROM m)
SELECT metric, scorer_key, round(value, 6) AS value FROM l QUALIFY row_number() OVER (PARTITION BY metric ORDER BY l.value DESC, pr DESC, scorer_key) = 1""")
def e12(t: Tables):
    return M.best_scorers(M.model_metrics(items(t)), ["precision_at_10", "f1", "roc_auc", "pr_auc"]).withColumn("value", r6("value"))


@query("e13_text_metrics", sql=f"""WITH {EVAL_SQL}, {RANKS}, {TIED_AP},
c AS (SELECT scorer_key, count(*) AS rows, sum(y)::BIGINT AS positive_rows, sum((score >= 0.5)::INT * y)::BIGINT AS tp, sum((score >= 0.5)::INT * (1 - y))::BIGINT AS fp FROM items GROUP BY 1)
SELECT rows, positive_rows, tp, fp, round((tp + rows - positive_rows - fp)::DOUBLE / rows, 6) AS accuracy, round(positive_rows::DOUBLE / rows, 6) AS positive_rate,
  round(precision_at_100, 6) AS precision_at_100, round(precision_at_500, 6) AS precision_at_500, round(roc_auc, 6) AS roc_auc, round(tied_pr_auc, 6) AS pr_auc
FROM c JOIN rank_metrics USING (scorer_key) JOIN tied USING (scorer_key)""")
def e13(t: Tables):
    out = M.text_metrics(toxic_items(t))
    return out.select("rows", "positive_rows", "tp", "fp", *[r6(c).alias(c) for c in (
        "accuracy", "positive_rate", "precision_at_100", "precision_at_500", "roc_auc", "pr_auc")])


@query("e7_evaluation_report", views="cases case_scores", sql=f"""WITH scored AS (SELECT * FROM cases JOIN case_scores USING (case_id) WHERE trim(label) <> ''),
items AS (SELECT 'active' AS scorer_key, case_id, (label IN ('rumour', 'rumor'))::INT AS y, risk_score AS score FROM scored), {RANKS}
SELECT count(*) AS labeled_cases, sum(y)::BIGINT AS positive_cases, sum(1 - y)::BIGINT AS negative_cases, 'mixed' AS scorer_version, 'h0' AS pipeline_hash,
  sum((score >= 0.5)::INT * y)::BIGINT AS tp, sum((score >= 0.5)::INT * (1 - y))::BIGINT AS fp,
  round(any_value(precision_at_10), 6) AS precision_at_10, round(any_value(roc_auc), 6) AS roc_auc, round(any_value(pr_auc), 6) AS pr_auc
FROM items JOIN rank_metrics USING (scorer_key)""")
def e7(t: Tables):
    out = M.evaluation_report(t.cases().join(t.case_scores(), "case_id"))
    return out.select("labeled_cases", big("positive_cases").alias("positive_cases"), big("negative_cases").alias("negative_cases"), "scorer_version",
                      "pipeline_hash", "tp", "fp", *[r6(c).alias(c) for c in ("precision_at_10", "roc_auc", "pr_auc")])


@query("u11_evaluation_runs", views="cases case_scores", sql="""WITH s AS (SELECT *, (label IN ('rumour', 'rumor'))::INT AS y FROM cases JOIN case_scores USING (case_id) WHERE trim(label) <> '')
SELECT t.threshold, count(*) AS labeled_cases, sum((risk_score >= t.threshold)::INT * y)::BIGINT AS tp, sum((risk_score >= t.threshold)::INT * (1 - y))::BIGINT AS fp
FROM s CROSS JOIN (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) t(threshold) GROUP BY 1""")
def u11(t: Tables):
    """Two evaluation runs are appended to a run log and read back."""
    log = f"{shared_folder(t.spark)}/evaluation-runs-{uuid.uuid4().hex}"
    scored = t.cases().join(t.case_scores(), "case_id")
    for threshold in (0.25, 0.75):
        U.append_run(M.evaluation_report(scored, threshold), log)
    return t.spark.read.parquet(log).select("threshold", "labeled_cases", "tp", "fp")


# -- table maintenance ------------------------------------------------------------------------------

HALF = "2024-01-15 12:00:00"


def _halves(t: Tables):
    """The events before the middle of the month and those without a time, and the ones after it: what is stored and what arrives."""
    posts = t.posts(False)
    newer = F.coalesce(F.col("published_at") >= F.lit(HALF).cast("timestamp"), F.lit(False))
    return posts.where(~newer), posts.where(newer)


def _account_rows(posts):
    return posts.select(
        F.lit(1).alias("source_id"), F.concat(F.lit("a"), F.col("account_id").cast("string")).alias("external_id"),
        F.concat(F.lit("user_"), F.col("account_id").cast("string")).alias("username"), F.col("kind").alias("display_name"),
        F.col("likes_count").alias("followers_count"), F.col("reposts_count").alias("following_count"),
        F.col("replies_count").alias("posts_count"), (F.col("kind") == "purchase").alias("is_verified"),
        F.lit(False).alias("is_bot"), F.col("published_at").alias("created_at"), F.col("post_id").alias("seq"))


ACC_ROWS = f"""r AS (SELECT account_id, 'a' || account_id AS external_id, kind, likes_count, reposts_count, replies_count, published_at, post_id,
  coalesce(published_at < TIMESTAMP '{HALF}', true) AS old FROM posts),
b AS (SELECT external_id, arg_max((kind, likes_count, reposts_count, replies_count, kind = 'purchase'), post_id) AS l,
  arg_min((kind, replies_count, kind = 'purchase', published_at), post_id) AS f FROM r WHERE old GROUP BY 1),
u AS (SELECT external_id, arg_max((kind, likes_count, reposts_count, replies_count, kind = 'purchase'), post_id) AS l,
  arg_min((kind, replies_count, kind = 'purchase', published_at), post_id) AS f FROM r WHERE NOT old GROUP BY 1)"""


def _accounts_after(t: Tables, rules):
    old, new = (_account_rows(p) for p in _halves(t))
    rules = {c: rules.get(c, "old") for c in old.columns if c not in ("source_id", "external_id", "seq")}
    keys = ["source_id", "external_id"]
    base = U.collapse_batch(old, keys, rules, "seq")
    return U.upsert(base, new, keys, rules, "seq")


@query("u3_accounts_live", views="posts", sql=f"""WITH {ACC_ROWS}
SELECT coalesce(b.external_id, u.external_id) AS external_id, coalesce(b.f[1], u.f[1]) AS display_name, coalesce(u.l[2], b.l[2]) AS followers_count,
  coalesce(u.l[3], b.l[3]) AS following_count, coalesce(u.l[4], b.l[4]) AS posts_count, coalesce(b.f[3], u.f[3]) AS is_verified
FROM b FULL JOIN u ON b.external_id = u.external_id""")
def u3_live(t: Tables):
    out = _accounts_after(t, U.LIVE_ACCOUNT_RULES)
    return out.select("external_id", "display_name", "followers_count", "following_count", "posts_count", "is_verified")


@query("u3_accounts_dataset", views="posts", sql=f"""WITH {ACC_ROWS}
SELECT coalesce(b.external_id, u.external_id) AS external_id, coalesce(u.l[1], b.l[1]) AS display_name, coalesce(u.l[2], b.l[2]) AS followers_count,
  coalesce(u.l[3], b.l[3]) AS following_count, coalesce(b.f[2], u.f[2]) AS posts_count, coalesce(u.l[5], b.l[5]) AS is_verified
FROM b FULL JOIN u ON b.external_id = u.external_id""")
def u3_dataset(t: Tables):
    out = _accounts_after(t, U.DATASET_ACCOUNT_RULES)
    return out.select("external_id", "display_name", "followers_count", "following_count", "posts_count", "is_verified")


def _case_rows(posts):
    """Many rows per case key: the 'case' is the hour of the day here, so that both halves share keys."""
    hour = F.hour("published_at")
    return posts.select(
        F.concat(F.lit("h"), hour.cast("string")).alias("external_case_id"),
        F.when(F.col("kind") == "view", "").otherwise(F.col("kind")).alias("label"),
        F.when(F.col("kind") == "click", F.col("external_id")).otherwise("").alias("title"),
        F.col("source_type").alias("status"), F.col("published_at").alias("first_event_at"),
        F.when(F.col("kind") != "error", F.col("published_at")).alias("last_event_at"),
        F.when(F.col("kind") == "signup", F.col("published_at")).alias("closed_at"),
        F.create_map(F.col("kind"), F.col("external_id")).alias("metadata"), F.col("post_id").alias("seq"))


@query("u2_cases", views="posts", sql=f"""
WITH p AS (SELECT 'h' || hour(published_at) AS external_case_id, * FROM posts)
SELECT external_case_id, coalesce(arg_max(kind, post_id) FILTER (WHERE kind <> 'view'), '') AS label,
  coalesce(arg_max(external_id, post_id) FILTER (WHERE kind = 'click'), '') AS title, arg_max(source_type, post_id) AS status,
  strftime(min(published_at), {STAMP}) AS first_event_at, strftime(max(published_at) FILTER (WHERE kind <> 'error'), {STAMP}) AS last_event_at,
  strftime(arg_max(published_at, post_id) FILTER (WHERE kind = 'signup'), {STAMP}) AS closed_at,
  concat_ws(',', 'click=' || arg_max(external_id, post_id) FILTER (WHERE kind = 'click'), 'error=' || arg_max(external_id, post_id) FILTER (WHERE kind = 'error'),
    'purchase=' || arg_max(external_id, post_id) FILTER (WHERE kind = 'purchase'), 'signup=' || arg_max(external_id, post_id) FILTER (WHERE kind = 'signup'),
    'view=' || arg_max(external_id, post_id) FILTER (WHERE kind = 'view')) AS metadata FROM p GROUP BY 1""")
def u2(t: Tables):
    old, new = (_case_rows(p) for p in _halves(t))
    rules = {c: r for c, r in U.CASE_RULES.items() if c in old.columns}
    base = U.collapse_batch(old, ["external_case_id"], rules, "seq")
    out = U.upsert(base, new, ["external_case_id"], rules, "seq")
    entries = F.transform(F.sort_array(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("external_case_id", "label", "title", "status", *[stamp(c).alias(c) for c in (
        "first_event_at", "last_event_at", "closed_at")], F.array_join(entries, ",").alias("metadata"))


@query("u2_case_metadata", views="posts", sql="""
WITH e AS (SELECT 'h' || hour(published_at) AS external_case_id, post_id, unnest([
    {'k': kind, 'v': '{"at":{"id":"' || external_id || '","likes":' || likes_count || '}}'},
    {'k': 'last', 'v': CASE WHEN post_id % 3 = 0 THEN 'null' ELSE '[' || post_id || ',true]' END}]) AS x FROM posts WHERE kind <> 'view'),
l AS (SELECT external_case_id, x.k AS k, arg_max(x.v, post_id) AS v FROM e GROUP BY 1, 2)
SELECT external_case_id, '{' || string_agg('"' || k || '":' || v, ',' ORDER BY k) || '}' AS metadata FROM l GROUP BY 1""")
def u2_metadata(t: Tables):
    """Open-ended metadata: objects of any shape; entries of the newer half go over those of the older one, nested values as a whole."""
    c = F.col

    def rows(posts):
        detail = F.to_json(F.struct(F.struct(c("external_id").alias("id"), c("likes_count").alias("likes")).alias("at")))
        last = F.when(c("post_id") % 3 == 0, "null").otherwise(F.concat(F.lit("["), c("post_id").cast("string"), F.lit(",true]")))
        text = F.when(c("kind") == "view", "17").otherwise(F.concat(F.lit('{"'), "kind", F.lit('":'), detail, F.lit(',"last":'), last, F.lit("}")))
        return posts.select(F.concat(F.lit("h"), F.hour("published_at").cast("string")).alias("external_case_id"), F.parse_json(text).alias("metadata"), c("post_id").alias("seq"))

    old, new = (rows(p) for p in _halves(t))
    empty = old.where(F.lit(False)).drop("seq")
    rules = {"metadata": "merged"}
    base = U.upsert(empty, old, ["external_case_id"], rules, "seq")
    out = U.upsert(base, new, ["external_case_id"], rules, "seq")
    return out.where(c("metadata").isNotNull()).select("external_case_id", F.to_json("metadata").alias("metadata"))


@query("u1_sources", views="posts", sql="""
SELECT kind AS name, coalesce(arg_max(external_id, post_id) FILTER (WHERE post_id % 2 = 0), arg_min('', post_id)) AS api_endpoint, true AS is_active FROM posts GROUP BY 1""")
def u1(t: Tables):
    rows = lambda p: p.select(
        F.col("kind").alias("name"), F.when(F.col("post_id") % 2 == 0, F.col("external_id")).otherwise("").alias("api_endpoint"),
        F.lit(True).alias("is_active"), F.col("post_id").alias("seq"))
    old, new = (rows(p) for p in _halves(t))
    base = U.collapse_batch(old, ["name"], U.SOURCE_RULES, "seq")
    return U.upsert(base, new, ["name"], U.SOURCE_RULES, "seq")


def _user_posts(posts):
    """Posts keyed by account and day, so that keys repeat within and across batches."""
    return posts.select(
        "source_id", F.concat_ws("-", F.col("account_id").cast("string"), F.hour("published_at").cast("string")).alias("external_id"),
        "account_id", "published_at", "likes_count", F.when(F.col("kind") != "view", F.col("case_id")).alias("case_id"), "is_case_root",
        F.col("post_id").alias("seq"))


POST_KEYS = "'' || account_id || '-' || hour(published_at)"


@query("u4_posts_dataset", views="posts", sql=f"""
SELECT {POST_KEYS} AS external_id, strftime(arg_max(published_at, post_id), {STAMP}) AS published_at, arg_max(likes_count, post_id) AS likes_count,
  arg_max(case_id, post_id) FILTER (WHERE kind <> 'view') AS case_id, bool_or(is_case_root) AS is_case_root FROM posts GROUP BY 1""")
def u4(t: Tables):
    old, new = (_user_posts(p) for p in _halves(t))
    keys = ["source_id", "external_id"]
    base = U.collapse_batch(old, keys, U.DATASET_POST_RULES, "seq")
    out = U.upsert(base, new, keys, U.DATASET_POST_RULES, "seq")
    return out.select("external_id", stamp("published_at").alias("published_at"), "likes_count", "case_id", "is_case_root")


@query("u5_posts_live", views="posts", sql=f"""
SELECT {POST_KEYS} AS external_id, strftime(arg_min(published_at, post_id), {STAMP}) AS published_at, arg_min(likes_count, post_id) AS likes_count FROM posts GROUP BY 1""")
def u5(t: Tables):
    old, new = (_user_posts(p).drop("case_id") for p in _halves(t))
    keys = ["source_id", "external_id"]
    empty = old.where(F.lit(False)).drop("seq")
    out = U.insert_new(U.insert_new(empty, old, keys, "seq"), new, keys, "seq")
    return out.select("external_id", stamp("published_at").alias("published_at"), "likes_count")


@query("u6_replaced_tags", views="posts post_tags", sql=f"""
SELECT post_id, tag FROM post_tags JOIN posts USING (post_id) WHERE coalesce(published_at < TIMESTAMP '{HALF}', true)
UNION ALL SELECT post_id, kind FROM posts WHERE published_at >= TIMESTAMP '{HALF}' AND kind <> 'view'""")
def u6(t: Tables):
    _, new = _halves(t)
    padded = F.when(F.col("kind") == "view", " ").otherwise(F.concat(F.lit(" "), F.col("kind")))
    twice = new.select("post_id", F.explode(F.array(padded, F.col("kind"))).alias("tag")).where(
        (F.col("tag") != "view"))
    return U.replace_children(t.post_tags(), twice, new, "tag")


@query("u6_replaced_links", views="posts post_links", sql=f"""
SELECT post_id, url FROM post_links JOIN posts USING (post_id) WHERE published_at < TIMESTAMP '{HALF}'
UNION ALL SELECT post_id, 'https://live.example/' || external_id FROM posts WHERE published_at >= TIMESTAMP '{HALF}' AND kind <> 'view'""")
def u6_links(t: Tables):
    _, new = _halves(t)
    url = F.concat(F.lit(" https://live.example/"), "external_id")
    twice = new.select("post_id", F.explode(F.array(F.when(F.col("kind") != "view", url), F.trim(F.when(F.col("kind") != "view", url)), F.lit(" "))).alias("url"))
    return U.replace_children(t.post_links().select("post_id", "url"), twice, new, "url")


@query("u11_ingestion_runs", views="ingestion_runs", sql=f"""
SELECT run_id, source_name, CASE WHEN run_id = 4 THEN 'running' ELSE 'completed' END AS status, strftime(started_at, {STAMP}) AS started_at,
  CASE WHEN run_id <> 4 THEN strftime(finished_at, {STAMP}) END AS finished_at FROM ingestion_runs""")
def u11_runs(t: Tables):
    runs = t.ingestion_runs()
    ended = runs.where("run_id <> 4").select("run_id", F.lit("completed").alias("status"), "finished_at")
    out = U.finish_runs(U.start_runs(runs), ended)
    return out.select("run_id", "source_name", "status", stamp("started_at").alias("started_at"), stamp("finished_at").alias("finished_at"))


TRENDS_SQL = """
SELECT tag, count(DISTINCT account_id)::INT AS today_accounts, count(*)::INT AS today_uses FROM post_tags JOIN posts USING (post_id)
GROUP BY tag, published_at::DATE QUALIFY row_number() OVER (PARTITION BY tag ORDER BY published_at::DATE DESC) = 1"""


@query("u7_stored_trends", views="posts post_tags", sql=TRENDS_SQL)
def u7_stored(t: Tables):
    """Tags as they stood in the first half, then all of them: the newest payload wins."""
    before, now = (trending_tags(tag_history(t, posts)) for posts in (_halves(t)[0], t.posts(False)))
    out = U.upsert(before, now, ["source_id", "tag"], U.TREND_RULES)
    return out.select("tag", "today_accounts", "today_uses")


@query("u7_trending_counts", views="posts post_tags", sql=TRENDS_SQL)
def u7(t: Tables):
    return U.with_today(tag_history(t, t.posts(False))).select("name", "today_accounts", "today_uses").withColumnRenamed("name", "tag")


def tag_history(t: Tables, posts):
    days = t.post_tags().join(posts, "post_id").groupBy("tag", F.to_date("published_at").alias("day"), "account_id").agg(
        F.count("*").alias("n")).groupBy("tag", "day").agg(F.count("*").alias("accounts"), F.sum("n").alias("uses"))
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" times")).alias(c)
    entry = F.struct(F.col("day").cast("string").alias("day"), text("accounts"), text("uses"))
    return days.groupBy(F.col("tag").alias("name")).agg(F.sort_array(F.collect_list(entry), asc=False).alias("history"))


@query("u8_result_cards", views="analysis_results", sql="""
SELECT post_id, round(coordination_contribution, 6) AS coordination, round(temporal_contribution, 6) AS temporal, round(narrative_contribution, 6) AS narrative,
  confidence_note AS summary FROM analysis_results""")
def u8(t: Tables):
    results = t.analysis_results()
    merged = U.upsert(results.where(F.col("escalation_priority") != 1), results, ["post_id"], U.RESULT_RULES)
    cards = U.result_cards(merged.withColumn("key_evidence", F.array("confidence_note")))
    return cards.select("post_id", *[r6(F.col("radar_data")[k]).alias(k) for k in ("coordination", "temporal", "narrative")], "summary")


@query("u9_stored_ensemble", views=ITEM_VIEWS, sql=ENSEMBLE + """
SELECT case_id, scorer_key, round(risk_score, 6) AS risk_score FROM case_model_scores UNION ALL SELECT case_id, 'case_ensemble_v1', round(s, 6) FROM e""")
def u9(t: Tables):
    stored = t.case_model_scores()
    fresh = ensemble(t).select("case_id", "scorer_key", "model_version", "risk_score", "risk_level", "confidence_score",
                               *[F.lit(None).cast("double").alias(c) for c in ("temporal_score", "coordination_score", "content_score")])
    again = stored.where(F.col("scorer_key") == SCORERS[0])
    out = U.upsert(stored, fresh.unionByName(again), ["case_id", "scorer_key"], U.SCORE_RULES)
    return out.select("case_id", "scorer_key", r6("risk_score").alias("risk_score"))


@query("u10_backfilled_scores", views="case_scores case_model_scores", sql="""
SELECT case_id, scorer_key, model_version, round(risk_score, 6) AS risk_score FROM case_model_scores
UNION ALL SELECT case_id, 'case_feature', score_version, round(risk_score, 6) FROM case_scores""")
def u10(t: Tables):
    out = U.backfill_model_scores(U.backfill_model_scores(t.case_model_scores(), t.case_scores()), t.case_scores())
    return out.select("case_id", "scorer_key", "model_version", r6("risk_score").alias("risk_score"))


@query("u12_decisions", views="posts cases", sql="""
WITH d AS (SELECT case_id, arg_max(CASE kind WHEN 'purchase' THEN 'suspicious' WHEN 'click' THEN 'not_suspicious' ELSE 'unclear' END, published_at) AS decision
  FROM posts WHERE kind IN ('purchase', 'click', 'view') GROUP BY 1) SELECT case_id, status, decision FROM cases LEFT JOIN d USING (case_id)""")
def u12(t: Tables):
    return U.apply_decisions(t.cases(), recorded_decisions(t)).select("case_id", "status", "decision")


@query("u12_refused_decisions", views="posts", sql="""
SELECT '' || case_id AS key, 'decision is not allowed' AS rule, 'looks odd' AS value FROM posts WHERE kind NOT IN ('purchase', 'click', 'view')""")
def u12_refused(t: Tables):
    return U.refused_decisions(recorded_decisions(t))


def recorded_decisions(t: Tables):
    decision = F.when(F.col("kind") == "purchase", "suspicious").when(F.col("kind") == "click", " not_suspicious").when(
        F.col("kind") == "view", "").otherwise("looks odd")
    return t.posts(False).select("case_id", decision.alias("decision"), F.col("published_at").alias("recorded_at"))


@query("j8_resolved_replies", views="posts", sql="SELECT post_id, reply_to_post_id FROM posts")
def j8(t: Tables):
    posts = t.posts(False)
    known = posts.withColumn("reply_to_external_id", F.concat(F.lit("p"), F.col("reply_to_post_id").cast("string")))
    return U.resolve_replies(known).select("post_id", "reply_to_post_id")


@query("x4_unknown_cases", views="cases case_model_scores", sql="""
SELECT DISTINCT case_id FROM case_model_scores WHERE case_id NOT IN (SELECT case_id FROM cases WHERE status = 'finalized')""")
def x4(t: Tables):
    known = t.cases().where(F.col("status") == "finalized").select("case_id")
    return t.case_model_scores().select("case_id").distinct().join(known, "case_id", "left_anti")
