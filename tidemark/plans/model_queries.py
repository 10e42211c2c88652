"""Model training and scoring by name. Learned scores differ between engines, so those have no SQL twin; stored models score alike in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import lexicons as X
from tidemark.operators import account_features as AF, case_features as C, metrics as M, models as L
from tidemark.operators.case_text import case_texts
from tidemark.operators.filters import not_blank, where_equal
from tidemark.operators.linear import LinearModel
from tidemark.plans.feature_queries import V4_SQL, V4_VIEWS, lead_of
from tidemark.plans.registry import query, r6
from tidemark.plans.source_queries import AS_OF, account_dataset, comment_rows, labelled_rows
from tidemark.plans.tables import Tables
from tidemark.session import staged
from tidemark.sources import labelled as B


def training_slice(cases: DataFrame, features: DataFrame, case_scores: DataFrame, **where: str) -> DataFrame:
    """Labelled cases of a slice with features and active component scores; label is 1 for a positive one."""
    kept = where_equal(cases, dataset_name="demo", **where).where(not_blank("label") & (F.trim("event_name") != ""))
    named = kept.select("case_id", "event_name", "event_group", M.is_positive(F.col("label")).cast("int").alias("label"))
    scores = case_scores.select("case_id", *[c for c in C.SCORES if c not in features.columns])
    return named.join(features, "case_id").join(scores, "case_id")


def case_frame(t: Tables) -> DataFrame:
    """Features of all cases, written once as every fit reads them again; the label is null where there is none."""
    features = C.case_features(t.posts_table(), t.post_tags(), t.post_links())
    return staged(features.join(labels_of(t), "case_id"), "case-features")


def labels_of(t: Tables) -> DataFrame:
    label = F.when(not_blank("label"), M.is_positive(F.col("label")).cast("int"))
    return t.cases().select("case_id", "event_name", "event_group", label.alias("label"))


def labelled(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("label").isNotNull())


NUMERIC = [c for c in C.MODEL_FEATURES if c not in C.BOT_FEATURES]

ACCOUNT_SQL = rf"""
WITH tw AS (SELECT account_id, count(*)::DOUBLE AS n, 1.0::DOUBLE AS avg_num_hashtags, avg((kind IN ('click', 'purchase'))::INT) AS avg_num_urls,
  avg((kind = 'click')::INT) AS avg_num_mentions, avg(reposts_count) AS rt, avg(replies_count) AS rp, avg(likes_count) AS fv, avg(length(content)) AS ln,
  avg((kind = 'click')::INT) AS retweet_post_ratio, avg((coalesce(reply_to_post_id, 0) <> 0)::INT) AS reply_post_ratio, count(DISTINCT kind) AS src,
  count(DISTINCT trim(regexp_replace(lower(content), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))) AS texts FROM posts GROUP BY 1),
ag AS (SELECT *, CASE WHEN account_id % 11 <> 0 THEN (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000.0::DOUBLE END AS age FROM accounts)
SELECT '' || account_id AS user_id, round(ln(1 + following_count), 6) AS friends_count, round(avg_num_urls, 6) AS avg_num_urls,
  round(avg_num_mentions, 6) AS avg_num_mentions, 1.0::DOUBLE AS hashtag_tweet_ratio, round(avg_num_urls, 6) AS url_tweet_ratio, round(ln(1 + posts_count), 6) AS statuses_count, round(ln(1 + followers_count), 6) AS followers_count,
  round(followers_count / (following_count + 1.0::DOUBLE), 6) AS followers_friends_ratio, CASE WHEN account_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS default_profile,
  is_verified::INT::DOUBLE AS verified, (display_name IS NOT NULL)::INT::DOUBLE AS has_description, 0.0::DOUBLE AS has_url, 1.0::DOUBLE AS has_location,
  round(ln(1 + coalesce(age, (SELECT quantile_cont(age, 0.5) FROM ag))), 6) AS account_age_days, round(ln(1 + n), 6) AS tweet_count,
  avg_num_hashtags, round(ln(1 + rt), 6) AS avg_retweet_count, round(ln(1 + rp), 6) AS avg_reply_count, round(ln(1 + fv), 6) AS avg_favorite_count,
  round(ln(1 + ln), 6) AS avg_text_length, round(retweet_post_ratio, 6) AS retweet_post_ratio, round(reply_post_ratio, 6) AS reply_post_ratio,
  round(avg_num_mentions, 6) AS mention_tweet_ratio, round(src / n, 6) AS source_diversity, round(1 - texts / n, 6) AS text_duplication_ratio
FROM ag JOIN tw USING (account_id)"""
ACCOUNT_COLS = [
    "friends_count", "avg_num_urls", "avg_num_mentions", "hashtag_tweet_ratio", "url_tweet_ratio", "statuses_count", "followers_count", "followers_friends_ratio", "default_profile", "verified", "has_description", "has_url", "has_location",
    "account_age_days", "tweet_count", "avg_num_hashtags", "avg_retweet_count", "avg_reply_count", "avg_favorite_count", "avg_text_length",
    "retweet_post_ratio", "reply_post_ratio", "mention_tweet_ratio", "source_diversity", "text_duplication_ratio"]


def account_frame(t: Tables) -> DataFrame:
    users, tweets = account_dataset(t)
    return AF.account_features(users, tweets, keep=("subset_name", "label"))


@query("m1_account_features", views="posts accounts", sql=ACCOUNT_SQL + " ORDER BY 1")
def m1(t: Tables):
    return account_frame(t).select("user_id", *[r6(c).alias(c) for c in ACCOUNT_COLS])


@query("m2_portable_features", views="posts accounts", sql=ACCOUNT_SQL.replace("\nSELECT '' || account_id", ", feats AS (\nSELECT '' || account_id") + ")"
       + f" SELECT user_id, {', '.join(AF.feature_columns(AF.PORTABLE))} FROM feats")
def m2(t: Tables):
    return account_frame(t).select("user_id", *[r6(c).alias(c) for c in AF.feature_columns(AF.PORTABLE)])


def _rounded(metrics: DataFrame) -> DataFrame:
    return metrics.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in metrics.schema.fields])


@query("m3_bot_classifier")
def m3(t: Tables):
    frame = staged(account_frame(t), "accounts")
    features = AF.feature_columns()
    seen, unseen = L.split(frame, "user_id")
    model = L.train(seen, L.usable(seen, features))
    return _rounded(M.text_metrics(L.as_items(L.with_probability(model, unseen), "user_id")))


@query("m4_cross_dataset")
def m4(t: Tables):
    frame = account_frame(t).withColumn("dataset_source", F.when(F.xxhash64("user_id") % 2 == 0, "left").otherwise("right"))
    items = L.cross_source(staged(frame, "accounts"), AF.feature_columns(AF.PORTABLE))
    return _rounded(M.text_metrics(items))


@query("m5_account_contributors")
def m5(t: Tables):
    frame = staged(account_frame(t), "accounts")
    model = L.train(frame, L.usable(frame, AF.feature_columns(AF.PORTABLE)))
    return L.contributors(model, frame, "user_id")


# -- stored models ----------------------------------------------------------------------------------

# Models fitted on the given tables at scale 0.01, rounded to four decimals.
STORED_ACCOUNT_MODEL = LinearModel(
    ["statuses_count", "followers_count", "friends_count", "followers_friends_ratio", "verified", "tweet_count", "avg_num_urls", "retweet_post_ratio",
     "reply_post_ratio", "text_duplication_ratio"],
    fill=[3.2189, 6.1696, 5.5013, 2.5767, 0.0, 4.2047, 0.4, 0.2, 0.9552, 0.0], center=[2.9696, 5.9007, 5.1812, 3.831, 0.1, 4.2069, 0.3985, 0.2, 0.9584, 0.0076],
    scale=[0.8832, 0.9737, 1.0451, 6.3839, 0.301, 0.1247, 0.0563, 0.0484, 0.023, 0.0114],
    weights=[0.2855, -0.1398, -0.2619, -0.4065, 0.0552, -0.0477, -0.2336, 0.1772, -0.0794, 0.043], intercept=-0.0793)
STORED_CASE_MODEL = LinearModel(
    ["unique_account_count", "time_span_seconds", "author_concentration", "lexical_diversity", "root_overlap_mean", "reply_parent_concentration", "temporal_score",
     "coordination_score", "content_score"],
    fill=[23.0, 6070.0891, 0.08, 0.7922, 0.0694, 0.6667, 0.696, 0.2109, 0.1768], center=[23.125, 6230.5441, 0.0792, 0.7906, 0.0744, 0.6806, 0.6976, 0.2106, 0.2015],
    scale=[1.1888, 1272.5919, 0.0185, 0.0317, 0.0487, 0.0197, 0.0571, 0.017, 0.0774],
    weights=[0.0662, -0.2748, 0.0159, -0.1912, -0.0056, 0.0287, -0.1661, -0.0535, 0.1249], intercept=0.0048)


def exported(frame: DataFrame, model: LinearModel, *keys: str) -> DataFrame:
    """The model's features with six decimals, as they are exported."""
    return frame.select(*keys, *[r6(c).alias(c) for c in model.features])


def moved_sql(model: LinearModel, source: str, key: str) -> str:
    """What each feature adds to the logit, as rows (key, feature, m)."""
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS feature, {term} AS m FROM {source}" for n, term in zip(model.features, model.terms()))


FEATS = ACCOUNT_SQL.replace("\nSELECT '' || account_id", ", feats AS (\nSELECT '' || account_id") + ")"


@query("m3_stored_account_scores", views="posts accounts", sql=FEATS + f""", s AS (SELECT user_id, {STORED_ACCOUNT_MODEL.expression()} AS p FROM feats)
SELECT user_id, format('{{:.6f}}', p)::DOUBLE AS bot_score, CASE WHEN p >= 0.5 THEN 'bot' ELSE 'human' END AS predicted_label FROM s""")
def m3_stored(t: Tables):
    frame = exported(account_frame(t), STORED_ACCOUNT_MODEL, "user_id")
    return L.account_scores(STORED_ACCOUNT_MODEL, frame).select("user_id", "bot_score", "predicted_label")


@query("m5_stored_account_contributors", views="posts accounts", sql=FEATS + f""", l AS ({moved_sql(STORED_ACCOUNT_MODEL, "feats", "user_id")})
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY abs(m) DESC, feature)::INTEGER AS position, feature,
  format('{{:.6f}}', m)::DOUBLE AS contribution FROM l QUALIFY position <= 5""")
def m5_stored(t: Tables):
    return L.contributors(STORED_ACCOUNT_MODEL, exported(account_frame(t), STORED_ACCOUNT_MODEL, "user_id"), "user_id")


@query("m8_stored_case_scores", views=V4_VIEWS, sql=V4_SQL + f""", s AS (SELECT case_id, {STORED_CASE_MODEL.expression()} AS p FROM v4),
l AS ({moved_sql(STORED_CASE_MODEL, "v4", "case_id")}),
k AS (SELECT case_id, format('{{:.6f}}', m)::DOUBLE AS m, feature, row_number() OVER (PARTITION BY case_id ORDER BY abs(l.m) DESC, feature) AS r FROM l QUALIFY r <= 3),
e AS (SELECT case_id, string_agg('model:' || feature || '=' || CASE WHEN m < 0 THEN '' ELSE '+' END || format('{{:.3f}}', m), '; ' ORDER BY r) AS evidence FROM k GROUP BY 1)
SELECT case_id, format('{{:.6f}}', p)::DOUBLE AS risk_score, CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level,
  format('{{:.6f}}', least(0.99::DOUBLE, 0.55::DOUBLE + abs(p - 0.5::DOUBLE)))::DOUBLE AS confidence_score, evidence FROM s JOIN e USING (case_id)""")
def m8_stored(t: Tables):
    out = L.trained_case_scores(STORED_CASE_MODEL, C.case_features(t.posts_table(), t.post_tags(), t.post_links()), "stored")
    return out.select("case_id", "risk_score", "risk_level", "confidence_score", F.array_join(F.slice("evidence", 1, 3), "; ").alias("evidence"))


def account_scores_in_cases(t: Tables) -> DataFrame:
    """Every account of every case judged by its posts there: (case_id, account_id, bot_score)."""
    tags = t.post_tags().groupBy("post_id").agg(F.count("*").alias("n_tags"))
    links = t.post_links().groupBy("post_id").agg(F.count("*").alias("n_links"))
    users, tweets = AF.thread_accounts(t.posts_table(), t.accounts(), links, tags)
    users = users.withColumn("updated", F.lit(AS_OF))
    frame = exported(AF.account_features(users, tweets, keep=("case_id", "account_id")), STORED_ACCOUNT_MODEL, "case_id", "account_id")
    return L.account_scores(STORED_ACCOUNT_MODEL, frame).select("case_id", "account_id", "bot_score")


@query("c21_bot_scores_in_cases", views="posts accounts post_tags post_links", sql=rf"""
WITH n AS (SELECT post_id, count(*) AS links FROM post_links GROUP BY 1),
tw AS (SELECT case_id, account_id, count(*) AS n, avg(coalesce(links, 0)) AS avg_num_urls,
  avg(({lead_of("trim(lower(content), E' \\t\\n\\r')", X.RETWEET_PREFIXES)})::INT) AS retweets, avg((coalesce(reply_to_post_id, 0) <> 0)::INT) AS replies,
  count(DISTINCT trim(regexp_replace(lower(content), '[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))) AS texts FROM posts LEFT JOIN n USING (post_id) GROUP BY 1, 2),
feats AS (SELECT case_id, account_id, round(ln(1 + CASE WHEN posts_count > 0 THEN posts_count ELSE n END), 6) AS statuses_count, round(ln(1 + followers_count), 6) AS followers_count,
  round(ln(1 + following_count), 6) AS friends_count, round(followers_count / (following_count + 1.0::DOUBLE), 6) AS followers_friends_ratio, is_verified::INT::DOUBLE AS verified,
  round(ln(1 + n), 6) AS tweet_count, round(avg_num_urls, 6) AS avg_num_urls, round(retweets, 6) AS retweet_post_ratio, round(replies, 6) AS reply_post_ratio,
  round(1 - texts / n, 6) AS text_duplication_ratio FROM tw JOIN accounts USING (account_id)),
s AS (SELECT case_id, account_id, format('{{:.6f}}', {STORED_ACCOUNT_MODEL.expression()})::DOUBLE AS b FROM feats),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY b DESC, account_id) AS rn FROM s),
f AS (SELECT case_id, count(*) AS n, avg(b) AS mean, max(b) AS top, avg((b >= 0.5)::INT) AS high, coalesce(max(b) FILTER (WHERE rn = 2), 0) AS b2,
  coalesce(max(b) FILTER (WHERE rn = 3), 0) AS b3 FROM k GROUP BY 1),
r AS (SELECT DISTINCT s.case_id, s.b FROM s JOIN posts p ON p.case_id = s.case_id AND p.account_id = s.account_id AND p.is_case_root)
SELECT case_id, n::DOUBLE AS bot_account_count, floor(format('{{:.6f}}', mean)::DOUBLE * 1000 + 0.5::DOUBLE) / 1000 AS bot_score_mean, top AS bot_score_max, format('{{:.6f}}', high)::DOUBLE AS bot_high_share,
  top AS bot_top_score_1, b2::DOUBLE AS bot_top_score_2, b3::DOUBLE AS bot_top_score_3, coalesce(r.b, 0) AS root_author_bot_score,
  concat_ws('; ', CASE WHEN top >= 0.6 THEN 'bot_score_max=' || format('{{:.3f}}', top) END,
    CASE WHEN format('{{:.6f}}', high)::DOUBLE >= 0.3 THEN 'bot_high_share=' || format('{{:.3f}}', format('{{:.6f}}', high)::DOUBLE) END) AS bot_evidence FROM f LEFT JOIN r USING (case_id)""")
def c21_chain(t: Tables):
    """From posts to account features, stored model, bot scores and the features and evidence of a case."""
    features = C.case_features(t.posts_table(), t.post_tags(), t.post_links(), account_scores_in_cases(t))
    bots = F.filter("evidence", lambda e: e.startswith("bot_"))
    # a mean of six-decimal scores may lie just between two of them: three decimals are compared
    mean = F.floor(F.col("bot_score_mean") * 1000 + 0.5) / 1000
    return features.withColumn("bot_score_mean", mean).select("case_id", *C.BOT_FEATURES, F.array_join(bots, "; ").alias("bot_evidence"))


@query("m6_leave_one_event_out")
def m6(t: Tables):
    out = L.leave_one_out(labelled(case_frame(t)), NUMERIC)
    items = out.select("event_name", F.lit("case_logreg_oof").alias("scorer_key"), "case_id", F.col("label").alias("y"), F.col("oof_probability").alias("score"))
    return _rounded(M.fold_metrics(items, "event_name"))


@query("m7_boosted_importances")
def m7(t: Tables):
    frame = labelled(case_frame(t))
    model = L.train(frame, L.usable(frame, NUMERIC), "boosted")
    rows = [(n, float(v)) for n, v in L.importances(model)]  # one per feature column
    return t.spark.createDataFrame(rows, "feature string, importance double")


@query("m7_forest_out_of_fold")
def m7_forest(t: Tables):
    out = L.leave_one_out(labelled(case_frame(t)), NUMERIC, kind="forest")
    items = out.select(F.lit("case_forest_oof").alias("scorer_key"), "case_id", F.col("label").alias("y"), F.col("oof_probability").alias("score"))
    return _rounded(M.model_metrics(items, M.GRID_MID, tied_scores=True))


@query("m8_trained_case_scores")
def m8(t: Tables):
    frame = case_frame(t)
    seen = labelled(frame)
    return L.trained_case_scores(L.train(seen, L.usable(seen, NUMERIC)), frame)


@query("m9_title_classifier")
def m9(t: Tables):
    return _text_quality(labelled_rows(t), "text")


@query("m9_title_and_comments_classifier")
def m9_comments(t: Tables):
    posts = B.attach_comments(labelled_rows(t), B.top_comments(comment_rows(t), labelled_rows(t)))
    return _text_quality(posts, "text_with_comments")


def _text_quality(posts: DataFrame, text: str) -> DataFrame:
    frame = staged(posts.select("id", "label", text), "texts")
    seen, unseen = L.split(frame, "id")
    model = L.TextModel.fit(seen, text)
    return _rounded(M.text_metrics(L.as_items(model.predict(unseen), "id")))


@query("m11_vocabulary", sql="""
WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents), c AS (SELECT token, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 2)
SELECT token, n, (row_number() OVER (ORDER BY n DESC, token) + 1)::INTEGER AS token_id FROM c ORDER BY n DESC, token LIMIT 4998""")
def m11(t: Tables):
    return L.vocabulary(t.raw("documents"), "text", 5_000)


@query("m12_text_case_scores")
def m12(t: Tables):
    frame, counts = L.counted_texts(case_texts(t.posts_table(), t.cases()).join(labels_of(t), "case_id"))
    return L.text_case_scores(L.TextModel.fit(labelled(frame), counts=counts), frame, counts=counts)
