"""Thread features and scores by name, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicons as L
from tidemark.operators import case_features as C
from tidemark.operators import reports as R
from tidemark.plans.registry import big, query, r6, stamp
from tidemark.plans.report_queries import active
from tidemark.plans.tables import Tables

NS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def any_of(column: str, values) -> str:
    return "(" + " OR ".join(f"contains({column}, '{v.replace(chr(39), chr(39) * 2)}')" for v in values) + ")"


def lead_of(column: str, values) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{v}')" for v in values) + ")"


def weighted_sql(terms: dict[str, float]) -> str:
    return "greatest(0.0, least(1.0, " + " + ".join(f"({w}::DOUBLE) * {n}" for n, w in terms.items()) + "))"


def share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN greatest(0.0, least(1.0, ({a})::DOUBLE / ({b}))) ELSE 0.0 END"


SPAN = """greatest(0.0, least(1.0, event_count / (greatest(time_span_seconds / 3600.0::DOUBLE, 1.0::DOUBLE / 60.0) * 10.0))) AS activity_density,
  greatest(0.0, least(1.0, 1800.0::DOUBLE / greatest(CASE WHEN event_count > 1 AND time_span_seconds > 0
    THEN time_span_seconds / (event_count - 1) ELSE 3600.0 END, 60.0))) AS gap_intensity"""

MARKED = ", ".join(f"{any_of('lo', words)} AS {m}" for m, words in C.MARKERS.items())

V4_SQL = rf"""
WITH a0 AS (SELECT p.*, epoch_us(published_at) AS us, lower(content) AS lo FROM posts p),
a AS (SELECT *, {MARKED}, {lead_of("trim(lo, E' \\t\\n\\r')", L.RETWEET_PREFIXES)} AS retweet,
  trim(regexp_replace(lo, '(?:https?://{NS}+|[^\p{{L}}\p{{N}}_@])+', ' ', 'g')) AS norm FROM a0),
t AS (SELECT * EXCLUDE (content, lo), list_distinct(list_filter(string_split(norm, ' '),
  lambda w: length(w) > 2 AND NOT starts_with(w, '@'))) AS tok FROM a),
root AS (SELECT case_id, post_id AS root_id, us AS root_us, account_id AS root_account, tok AS root_tok, question AS rq,
  uncertainty AS ru, claim AS rc, denial AS rd FROM t
  QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY is_case_root DESC, us, post_id) = 1),
first AS (SELECT case_id, arg_min(post_id, (us, post_id)) AS first_id, min(us) AS first_us, max(us) AS last_us FROM t GROUP BY 1),
m AS (SELECT t.*, NOT is_case_root AS reaction, root_id, root_us, root_account, len(root_tok) AS nr, first_id, first_us, last_us, rq, ru, rc, rd,
    len(tok) AS nt, len(list_intersect(tok, root_tok)) AS shared FROM t JOIN root USING (case_id) JOIN first USING (case_id)),
j AS (SELECT *, CASE WHEN nt > 0 AND nr > 0 THEN shared::DOUBLE / (nt + nr - shared) ELSE 0 END AS jac,
    CASE WHEN nt > 0 AND nr > 0 THEN shared::DOUBLE / least(nt, nr) ELSE 0 END AS ovl FROM m),
g AS (SELECT case_id, count(*) AS event_count, any_value(root_id) AS root_post_id, count(DISTINCT account_id) AS unique_account_count,
    count(DISTINCT reply_to_post_id) AS unique_reply_parent_count, count(reply_to_post_id) AS replies,
    count(*) FILTER (WHERE reply_to_post_id = root_id) AS to_root, count(*) FILTER (WHERE reply_to_post_id <> root_id) AS deep,
    count(*) FILTER (WHERE norm <> '') - count(DISTINCT nullif(norm, '')) AS dup,
    count(*) FILTER (WHERE us - first_us <= 600000000) AS f10, count(*) FILTER (WHERE us - first_us <= 1800000000) AS f30,
    count(*) FILTER (WHERE us - first_us <= 3600000000) AS f60,
    count(DISTINCT account_id) FILTER (WHERE account_id <> 0 AND us <= root_us + 1800000000) AS early,
    count(*) FILTER (WHERE reaction AND account_id <> 0 AND account_id = root_account) AS by_root,
    count(*) FILTER (WHERE retweet) AS rt, any_value((last_us - first_us) / 1000000.0::DOUBLE) AS time_span_seconds,
    coalesce(quantile_cont(greatest(us - root_us, 0)::DOUBLE, 0.5) FILTER (WHERE reaction) / 1000000.0::DOUBLE, 0) AS median_reaction_delay_seconds,
    coalesce(avg(jac) FILTER (WHERE reaction AND nr > 0), 0) AS root_jaccard_mean, coalesce(max(jac) FILTER (WHERE reaction AND nr > 0), 0) AS root_jaccard_max,
    coalesce(avg(ovl) FILTER (WHERE reaction AND nr > 0), 0) AS root_overlap_mean, coalesce(max(ovl) FILTER (WHERE reaction AND nr > 0), 0) AS root_overlap_max,
    count(*) FILTER (WHERE reaction AND nr > 0 AND ovl >= 0.6) AS copies,
    count(*) FILTER (WHERE nr > 0 AND post_id <> first_id AND jac >= 0.4) AS lexical,
    {", ".join(f"count(*) FILTER (WHERE {m}) AS n_{m}, count(*) FILTER (WHERE {m} AND reaction) AS r_{m}" for m in C.MARKERS)},
    sum(nt)::BIGINT AS token_uses, any_value(nr)::DOUBLE AS root_token_count,
    any_value(rq)::INT::DOUBLE AS root_question_flag, any_value(ru)::INT::DOUBLE AS root_uncertainty_flag,
    any_value(rc)::INT::DOUBLE AS root_claim_flag, any_value(rd)::INT::DOUBLE AS root_denial_flag FROM j GROUP BY 1),
au AS (SELECT case_id, max(n) AS max_author, count(*) FILTER (WHERE n = 1) AS singles FROM (SELECT case_id, account_id, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
pa AS (SELECT case_id, max(n) AS max_parent FROM (SELECT case_id, count(*) AS n FROM t WHERE reply_to_post_id IS NOT NULL GROUP BY case_id, reply_to_post_id) GROUP BY 1),
tk AS (SELECT case_id, count(DISTINCT w) AS kinds FROM (SELECT case_id, unnest(tok) AS w FROM t) GROUP BY 1),
li AS (SELECT case_id, lower(trim(coalesce(nullif(expanded_url, ''), url))) AS link FROM post_links JOIN posts USING (post_id)),
lk AS (SELECT case_id, count(*) AS url_refs, count(DISTINCT link) AS unique_url_count,
    count(nullif(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1), '')) AS domain_refs,
    count(DISTINCT nullif(regexp_extract(link, '^[a-z]+://([^/?#]*)', 1), '')) AS unique_domain_count FROM li WHERE link <> '' GROUP BY 1),
tg AS (SELECT case_id, count(DISTINCT lower(trim(tag))) AS unique_hashtag_count FROM post_tags JOIN posts USING (post_id) WHERE trim(tag) <> '' GROUP BY 1),
pk AS (SELECT case_id, max(a) AS peak10, max(b) AS peak30 FROM (SELECT case_id,
    count(*) OVER (PARTITION BY case_id ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS a,
    count(*) OVER (PARTITION BY case_id ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS b FROM t) GROUP BY 1),
h AS (SELECT *, greatest(event_count - 1, 1) AS others FROM g LEFT JOIN au USING (case_id) LEFT JOIN pa USING (case_id)
    LEFT JOIN tk USING (case_id) LEFT JOIN lk USING (case_id) LEFT JOIN tg USING (case_id) LEFT JOIN pk USING (case_id)),
f AS (SELECT case_id, root_post_id, event_count, unique_account_count, coalesce(unique_url_count, 0) AS unique_url_count,
    coalesce(unique_domain_count, 0) AS unique_domain_count, coalesce(unique_hashtag_count, 0) AS unique_hashtag_count,
    unique_reply_parent_count, time_span_seconds, median_reaction_delay_seconds,
    {share('f60', 'event_count')} AS first_window_share, {share('f10', 'event_count')} AS first_10m_share, {share('f30', 'event_count')} AS first_30m_share,
    {share('peak10', 'event_count')} AS peak_10m_share, {share('peak30', 'event_count')} AS peak_30m_share, {SPAN},
    greatest(0.0, least(1.0, 3600.0::DOUBLE / greatest(median_reaction_delay_seconds, 60.0))) AS median_reaction_delay_score,
    {share('early', 'unique_account_count')} AS early_actor_share, {share('replies', 'others')} AS reply_ratio,
    {share('max_author', 'event_count')} AS author_concentration, {share('singles', 'unique_account_count')} AS author_singleton_share,
    {share('unique_account_count - singles', 'unique_account_count')} AS repeated_author_share,
    {share('to_root', 'others')} AS direct_reply_ratio, {share('deep', 'others')} AS deep_reply_ratio, {share('to_root', 'replies')} AS root_reply_share,
    {share('coalesce(max_parent, 0)', 'replies')} AS reply_parent_concentration, {share('unique_reply_parent_count', 'others')} AS thread_branching_factor,
    {share('by_root', 'others')} AS root_author_reaction_share, {share('dup', 'event_count')} AS duplicate_text_ratio,
    {share('dup', 'event_count')} AS lexical_repetition_ratio, {share('lexical', 'others')} AS lexical_similarity_ratio,
    root_jaccard_mean, root_jaccard_max, root_overlap_mean, root_overlap_max, {share('copies', 'others')} AS root_copy_ratio,
    {share('rt', 'others')} AS retweet_style_ratio, {share('coalesce(url_refs - unique_url_count, 0)', 'coalesce(url_refs, 0)')} AS repeated_url_ratio,
    {share('coalesce(domain_refs - unique_domain_count, 0)', 'coalesce(url_refs, 0)')} AS repeated_domain_ratio,
    {", ".join(f"{share(f'n_{m}', 'event_count')} AS {m}_marker_ratio" for m in C.MARKERS)},
    {", ".join(f"{share(f'r_{m}', 'others')} AS reaction_{m}_ratio" for m in ('question', 'uncertainty', 'denial'))},
    token_uses::DOUBLE / event_count AS avg_token_count, root_token_count, {share('coalesce(kinds, 0)', 'token_uses')} AS lexical_diversity,
    root_question_flag, root_uncertainty_flag, root_claim_flag, root_denial_flag,
    CASE WHEN unique_reply_parent_count > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reply_tree_available FROM h),
sc AS (SELECT *, {", ".join(f"{weighted_sql(w)} AS {n}" for n, w in C.V4_WEIGHTS.items())} FROM f),
v4 AS (SELECT *, {weighted_sql(C.V4_RISK)} AS risk_score, least(0.95, 0.5::DOUBLE + 0.18::DOUBLE * least(1.0, event_count / 12.0::DOUBLE)
    + 0.27::DOUBLE * greatest(content_score, discussion_score, coordination_score)) AS confidence_score FROM sc)"""
V4_VIEWS = "posts post_tags post_links"


def v4(t: Tables):
    return C.case_features(t.posts_table(), t.post_tags(), t.post_links())


def _features_query(name: str, columns: list[str], counts: list[str] = ()):
    sql = V4_SQL + " SELECT case_id, " + ", ".join([*counts, *[f"round({c}, 6) AS {c}" for c in columns]]) + " FROM v4"

    @query(name, views=V4_VIEWS, sql=sql)
    def run(t: Tables):
        return v4(t).select("case_id", *[big(c).alias(c) for c in counts], *[r6(c).alias(c) for c in columns])


_features_query("c1_c6_temporal_features", C.TEMPORAL_FEATURES)
_features_query("c7_c14_coordination_features", C.COORDINATION_FEATURES)
_features_query("c15_c17_content_features", C.CONTENT_FEATURES)
_features_query("c12_case_counts", ["reply_tree_available"], [
    "root_post_id", "event_count", "unique_account_count", "unique_url_count", "unique_domain_count", "unique_hashtag_count",
    "unique_reply_parent_count"])

_EV = " UNION ALL ".join(f"SELECT case_id, {i} AS i, '{n}' AS name, {n} AS value FROM v4" for i, n in enumerate(C.V4_EVIDENCE))


@query("c18_case_scores", views=V4_VIEWS, sql=V4_SQL + """ SELECT case_id, round(risk_score, 6) AS risk_score,
  CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
  round(confidence_score, 6) AS confidence_score, round(temporal_score, 6) AS temporal_score,
  round(coordination_score, 6) AS coordination_score, round(content_score, 6) AS content_score,
  round(discussion_score, 6) AS discussion_score, round(broadcast_relief, 6) AS broadcast_relief FROM v4""")
def c18(t: Tables):
    return v4(t).select("case_id", r6("risk_score").alias("risk_score"), "risk_level", *[
        r6(c).alias(c) for c in ("confidence_score", *C.SCORES, "discussion_score", "broadcast_relief")])


@query("c20_case_evidence", views=V4_VIEWS, sql=V4_SQL + f""", ev AS ({_EV}),
rk AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, i) AS r, name, value FROM ev),
li2 AS (SELECT case_id, r, name || '=' || format('{{:.3f}}', value) AS line FROM rk WHERE r <= 4 AND value >= 0.18
  UNION ALL SELECT case_id, 9, 'broadcast_relief=' || format('{{:.3f}}', broadcast_relief) FROM v4 WHERE broadcast_relief >= 0.3)
SELECT case_id, coalesce(string_agg(line, '; ' ORDER BY r) FILTER (WHERE line IS NOT NULL), '') AS evidence
FROM v4 LEFT JOIN li2 USING (case_id) GROUP BY 1""")
def c20(t: Tables):
    return v4(t).select("case_id", F.array_join("evidence", "; ").alias("evidence"))


_ALL = [(g, n) for g, names in C.FEATURE_GROUPS.items() for n in names]
_TOP = " UNION ALL ".join(f"SELECT case_id, {i} AS i, '{g}' AS feature_group, '{n}' AS name, {n}::DOUBLE AS value FROM v4" for i, (g, n) in enumerate(_ALL))


@query("c25_top_features", views=V4_VIEWS, sql=V4_SQL + f""", l AS ({_TOP})
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY abs(round(value, 9)) DESC, i)::INTEGER AS position, feature_group, name,
  round(value, 6) AS value FROM l QUALIFY position <= 8""")
def c25(t: Tables):
    rounded = v4(t).withColumns({n: F.round(n, 9) for _, n in _ALL})
    return C.top_features(rounded).withColumn("value", r6("value"))


_FLAT = sorted(set(C.MODEL_FEATURES) - set(C.BOT_FEATURES))


@query("c23_feature_rows", views=V4_VIEWS, sql=V4_SQL + ", l AS (" + " UNION ALL ".join(
    f"SELECT case_id, '{n}' AS name, {n}::DOUBLE AS value FROM v4" for n in _FLAT) + ") SELECT case_id, name, round(value, 6) AS value FROM l")
def c23(t: Tables):
    return C.feature_rows(v4(t), _FLAT).withColumn("value", r6("value"))


@query("w14_evidence_cards", views=V4_VIEWS + " case_model_scores", sql=V4_SQL + f""", k AS (
SELECT v4.*, m.risk_score AS p FROM case_model_scores m LEFT JOIN v4 USING (case_id) WHERE m.scorer_key = 'case_text_oof'), l AS (
{" UNION ALL ".join(f"SELECT case_id, {i} AS i, CASE WHEN {n} >= {v} THEN '{label}: {n}=' || format('{{:.3f}}', {n}::DOUBLE) END AS line FROM k" for i, (n, v, label) in enumerate(C.SIGNALS))}),
s AS (SELECT case_id, line, row_number() OVER (PARTITION BY case_id ORDER BY i) AS r FROM l WHERE line IS NOT NULL),
x AS (SELECT case_id, string_agg(line, '; ' ORDER BY r) AS main FROM s WHERE r <= 8 GROUP BY 1)
SELECT k.case_id, round(p, 6) AS risk_score, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level,
  coalesce(main, 'no single strong threshold signal; ranked by combined model weights') AS main_signals,
  CASE WHEN event_count < 5 OR lexical_diversity >= 0.75 OR root_overlap_mean < 0.1 THEN concat_ws('; ',
    CASE WHEN event_count < 5 THEN 'small case size: post_count=' || event_count END,
    CASE WHEN lexical_diversity >= 0.75 THEN 'high lexical diversity: lexical_diversity=' || format('{{:.3f}}', lexical_diversity) END,
    CASE WHEN root_overlap_mean < 0.1 THEN 'low direct root overlap: root_overlap_mean=' || format('{{:.3f}}', root_overlap_mean) END)
  ELSE 'no strong counter-signal in exported feature snapshot' END AS counter_signals, 'available' AS feature_snapshot_status
FROM k LEFT JOIN x USING (case_id)""")
def w14(t: Tables):
    scores = t.case_model_scores().where(F.col("scorer_key") == "case_text_oof").select(
        "case_id", F.col("risk_score").alias("oof_probability"))
    scored = scores.join(v4(t).withColumn("post_count", F.col("event_count")), "case_id", "left")
    return C.evidence_cards(scored).withColumn("main_signals", F.array_join("main_signals", "; ")).withColumn(
        "counter_signals", F.array_join("counter_signals", "; ")).withColumn("risk_score", r6("risk_score"))


V1_SQL = rf"""
WITH a0 AS (SELECT p.*, epoch_us(published_at) AS us, lower(content) AS lo FROM posts p),
a AS (SELECT case_id, post_id, account_id, reply_to_post_id, us, {any_of('lo', L.URGENCY_MARKERS)} AS urgency,
  {any_of('lo', L.CLAIM_MARKERS)} AS claim, {any_of('lo', L.DENIAL_MARKERS)} AS denial,
  trim(regexp_replace(regexp_replace(lo, '[^\p{{L}}\p{{Nd}}\t-\r\x1c-\x20\x{{85}}\p{{Z}}]', '', 'g'), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g')) AS norm FROM a0),
m AS (SELECT *, min(us) OVER (PARTITION BY case_id) AS first_us, max(us) OVER (PARTITION BY case_id) AS last_us FROM a),
g AS (SELECT case_id, count(*) AS event_count, count(DISTINCT account_id) AS unique_account_count, count(reply_to_post_id) AS replies,
  count(*) FILTER (WHERE norm <> '') - count(DISTINCT nullif(norm, '')) AS dup, count(*) FILTER (WHERE us - first_us <= 3600000000) AS f60,
  any_value((last_us - first_us) / 1000000.0::DOUBLE) AS time_span_seconds,
  count(*) FILTER (WHERE urgency) AS n_urgency, count(*) FILTER (WHERE claim) AS n_claim, count(*) FILTER (WHERE denial) AS n_denial FROM m GROUP BY 1),
au AS (SELECT case_id, max(n) AS max_author FROM (SELECT case_id, account_id, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1),
lk AS (SELECT case_id, count(*) AS url_refs, count(DISTINCT link) AS unique_url_count FROM (
  SELECT case_id, lower(trim(coalesce(nullif(expanded_url, ''), url))) AS link FROM post_links JOIN posts USING (post_id)) WHERE link <> '' GROUP BY 1),
tg AS (SELECT case_id, count(DISTINCT lower(trim(tag))) AS unique_hashtag_count FROM post_tags JOIN posts USING (post_id) GROUP BY 1),
h AS (SELECT *, greatest(event_count - 1, 1) AS others FROM g LEFT JOIN au USING (case_id) LEFT JOIN lk USING (case_id) LEFT JOIN tg USING (case_id)),
f AS (SELECT case_id, event_count, unique_account_count, coalesce(unique_url_count, 0) AS unique_url_count,
  coalesce(unique_hashtag_count, 0) AS unique_hashtag_count, time_span_seconds, {share('f60', 'event_count')} AS first_window_share, {SPAN},
  {share('max_author', 'event_count')} AS author_concentration, {share('replies', 'others')} AS reply_ratio,
  {share('dup', 'event_count')} AS duplicate_text_ratio, {share('dup', 'event_count')} AS lexical_repetition_ratio,
  {share('coalesce(url_refs - unique_url_count, 0)', 'coalesce(url_refs, 0)')} AS repeated_url_ratio,
  {", ".join(f"{share(f'n_{m}', 'event_count')} AS {m}_marker_ratio" for m in ('urgency', 'claim', 'denial'))} FROM h),
sc AS (SELECT *, {", ".join(f"{weighted_sql(w)} AS {n}" for n, w in C.V1_WEIGHTS.items())} FROM f),
v1 AS (SELECT *, {weighted_sql(C.V1_RISK)} AS risk_score FROM sc)"""
_EV1 = " UNION ALL ".join(f"SELECT case_id, {i} AS i, '{n}' AS name, {n} AS value FROM v1" for i, n in enumerate(C.V1_EVIDENCE))


@query("c19_case_scores_v1", views=V4_VIEWS, sql=V1_SQL + f""", ev AS ({_EV1}),
rk AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY value DESC, i) AS r, name, value FROM ev),
x AS (SELECT case_id, string_agg(name || '=' || format('{{:.3f}}', value), '; ' ORDER BY r) AS evidence FROM rk WHERE r <= 3 AND value >= 0.2 GROUP BY 1)
SELECT case_id, event_count, unique_account_count, unique_url_count, unique_hashtag_count,
  {", ".join(f"round({n}, 6) AS {n}" for n in ['time_span_seconds', *C.V1_EVIDENCE, *C.SCORES, 'risk_score'])},
  CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
  coalesce(evidence, '') AS evidence FROM v1 LEFT JOIN x USING (case_id)""")
def c19(t: Tables):
    out = C.case_features_v1(t.posts_table(), t.post_tags(), t.post_links())
    counts = ["event_count", "unique_account_count", "unique_url_count", "unique_hashtag_count"]
    return out.select("case_id", *counts, *[r6(c).alias(c) for c in ["time_span_seconds", *C.V1_EVIDENCE, *C.SCORES, "risk_score"]],
                      "risk_level", F.array_join("evidence", "; ").alias("evidence"))


@query("c22_pipeline_hash", views="case_scores", sql=f"""
SELECT score_version, count(*) AS cases, sha256('{C.SCORE_VERSION}|' || '{"|".join(
    f"{n}=" + ",".join(f"{w:.2f}*{f}" for f, w in t.items()) for n, t in {**C.V4_WEIGHTS, "risk": C.V4_RISK}.items())}') AS pipeline_hash
FROM case_scores GROUP BY 1""")
def c22(t: Tables):
    return t.case_scores().groupBy("score_version").agg(F.count("*").alias("cases")).withColumn(
        "pipeline_hash", C.pipeline_hash(C.SCORE_VERSION, C.V4_WEIGHTS, C.V4_RISK))


@query("c2_peak_windows", views="posts", sql="""
SELECT case_id, max(a) AS peak_10m, max(b) AS peak_30m, max(c) AS peak_6h FROM (SELECT case_id,
  count(*) OVER (PARTITION BY case_id ORDER BY epoch_us(published_at) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS a,
  count(*) OVER (PARTITION BY case_id ORDER BY epoch_us(published_at) RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS b,
  count(*) OVER (PARTITION BY case_id ORDER BY epoch_us(published_at) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS c FROM posts) GROUP BY 1""")
def c2(t: Tables):
    posts = t.posts(False)
    out = C.time_profile(posts, C.root_posts(posts), {"peak_10m": 10 * C.MINUTE, "peak_30m": 30 * C.MINUTE, "peak_6h": 360 * C.MINUTE})
    return out.select("case_id", "peak_10m", "peak_30m", "peak_6h")


@query("c2_account_bursts", views="posts", sql="""
WITH p AS (SELECT account_id, epoch_us(published_at) AS us FROM posts),
w AS (SELECT account_id, us, count(*) OVER (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM p),
m AS (SELECT account_id, min(us) AS first_us, quantile_cont(us::DOUBLE, 0.5) AS mid FROM p GROUP BY 1)
SELECT account_id AS case_id, max(n) AS peak_day, any_value(round((mid - first_us) / 1000000.0::DOUBLE, 6)) AS median_delay FROM w JOIN m USING (account_id) GROUP BY 1""")
def c2_accounts(t: Tables):
    posts = t.posts(False).select(F.col("account_id").alias("case_id"), "post_id", "account_id", F.lit(False).alias("is_case_root"), "published_at")
    out = C.time_profile(posts, C.root_posts(posts), {"peak_day": 1440 * C.MINUTE})
    return out.select("case_id", "peak_day", r6("median_reaction_delay_seconds").alias("median_delay"))


@query("c5_roots", views="posts", sql="""
SELECT case_id, arg_min(post_id, (NOT is_case_root, published_at, post_id)) AS root_post_id, count(*) AS event_count,
  arg_min(account_id, (NOT is_case_root, published_at, post_id)) AS root_account_id, epoch_us(min(published_at)) AS first_us FROM posts GROUP BY 1""")
def c5_roots(t: Tables):
    return C.root_posts(t.posts(False)).select("case_id", "root_post_id", "event_count", "root_account_id", "first_us")


@query("j3_scored_case_table", views="posts cases case_scores post_tags post_links", sql=V1_SQL + """
SELECT c.case_id, c.label, round(s.risk_score, 6) AS risk_score, s.score_version, 'case-features-v1' AS feature_version,
  v1.unique_account_count, coalesce(n.post_count, 0) AS post_count FROM cases c JOIN case_scores s USING (case_id)
LEFT JOIN v1 USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS post_count FROM posts GROUP BY 1) n USING (case_id)""")
def j3(t: Tables):
    features = C.case_features_v1(t.posts_table(), t.post_tags(), t.post_links()).select("case_id", "feature_version", "unique_account_count")
    out = R.scored_case_table(t.cases(), t.posts(False), t.case_scores(), features)
    return out.select("case_id", "label", r6("risk_score").alias("risk_score"), "score_version", "feature_version",
                      "unique_account_count", big("post_count").alias("post_count"))


@query("w13_case_bundle", views="posts cases accounts case_scores post_tags post_links", sql=V1_SQL + """,
child AS (SELECT post_id, 'tag' AS ck, tag AS value FROM post_tags
  UNION ALL SELECT post_id, 'url', coalesce(nullif(expanded_url, ''), url) FROM post_links
  UNION ALL SELECT post_id, 'domain', coalesce(nullif(domain, ''), nullif(expanded_url, ''), url) FROM post_links),
arts AS (SELECT case_id, ck, value, count(*) AS n FROM child JOIN posts USING (post_id) GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY case_id, ck ORDER BY count(*) DESC, value) <= 20)
SELECT c.case_id, 'summary' AS section, c.external_case_id AS name, event_count::DOUBLE AS amount FROM cases c JOIN v1 USING (case_id)
UNION ALL SELECT c.case_id, 'risk', coalesce(s.risk_level, ''), round(s.risk_score, 6) FROM cases c LEFT JOIN case_scores s USING (case_id)
UNION ALL SELECT case_id, 'root', CAST(arg_min(post_id, (NOT is_case_root, published_at, post_id)) AS VARCHAR), 1.0 FROM posts GROUP BY case_id
UNION ALL SELECT case_id, 'post', external_id, (likes_count + reposts_count + replies_count)::DOUBLE FROM posts
UNION ALL SELECT case_id, 'account', username, count(*)::DOUBLE FROM posts JOIN accounts USING (account_id) GROUP BY case_id, username
UNION ALL SELECT case_id, 'artifact', ck || ':' || value, n::DOUBLE FROM arts
UNION ALL SELECT case_id, 'feature', 'activity_density', round(activity_density, 6) FROM v1
UNION ALL SELECT case_id, 'feature', 'duplicate_text_ratio', round(duplicate_text_ratio, 6) FROM v1""")
def w13(t: Tables):
    posts = t.posts(False)
    features = C.feature_rows(C.case_features_v1(t.posts_table(), t.post_tags(), t.post_links()), ["activity_density", "duplicate_text_ratio"])
    out = R.case_bundle(t.cases(), posts, t.accounts(), t.post_tags(), t.post_links(), active(t), C.root_posts(posts), features)
    return out.withColumn("amount", r6("amount"))
