"""Dashboard, queue and account reports as aggregations over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.filters import (
    CaseFilter, apply_case_filter, display_title, flag_is_set, score_source, search_accounts, trailing_days, where_chosen,
)
from tidemark.operators.skew import salted_join

LEVELS = ("high", "medium", "low")


def _level_counts(column: str = "risk_level") -> list[Column]:
    return [F.count_if(F.col(column) == level).alias(f"{level}_risk") for level in LEVELS]


def _mean(column: str) -> Column:
    return F.coalesce(F.avg(column), F.lit(0.0))


def engagement() -> Column:
    return F.col("likes_count") + F.col("reposts_count") + F.col("replies_count")


def posts_per_case(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.count("*").alias("post_count"))


def scored_base(cases: DataFrame, scores: DataFrame, f: CaseFilter | None = None, dashboard: bool = False) -> DataFrame:
    """Filtered cases with their score, if any: what every case report starts from."""
    f = f or CaseFilter()
    base = apply_case_filter(cases, f, dashboard).join(scores, "case_id", "left")
    if f.risk_level and not (dashboard and f.risk_level.strip() in ("", "all")):
        base = base.where(F.col("risk_level") == f.risk_level)
    return base


def with_post_counts(cases: DataFrame, posts: DataFrame) -> DataFrame:
    """Counts are formed per case before the join, so cases never fan out."""
    return cases.join(posts_per_case(posts), "case_id", "left").withColumn(
        "post_count", F.coalesce("post_count", F.lit(0))
    )


def page_with_post_counts(page: DataFrame, posts: DataFrame) -> DataFrame:
    """Counts for a limited page of cases: other cases are not counted. Spark sends the ids to the posts if they are few."""
    wanted = page.select("case_id")
    return with_post_counts(page, posts.join(wanted, "case_id", "left_semi"))


# -- case lists ---------------------------------------------------------------------------------

def case_queue(cases, posts, scores, f: CaseFilter | None = None, only_unscored=False, limit=20, offset=0) -> DataFrame:
    limit = 20 if limit <= 0 else limit
    base = scored_base(cases, scores, f)
    if only_unscored:
        base = base.where(F.col("risk_score").isNull())
    page = base.orderBy(
        F.desc_nulls_last("risk_score"), F.desc_nulls_last("first_event_at"), F.desc("case_id")
    ).offset(max(offset, 0)).limit(limit)
    return page_with_post_counts(page, posts)


def unscored_cases(cases: DataFrame, scores: DataFrame) -> DataFrame:
    return cases.join(scores, "case_id", "left_anti")


def scored_cases(cases, posts, case_scores, features=None, f: CaseFilter | None = None, limit=100) -> DataFrame:
    limit = 100 if limit <= 0 else limit
    base = apply_case_filter(cases, f or CaseFilter()).join(case_scores, "case_id")
    if features is not None:
        base = base.join(features.select("case_id", "feature_version"), "case_id", "left")
    page = base.orderBy(F.desc("risk_score"), F.desc_nulls_last("first_event_at"), F.desc("case_id")).limit(limit)
    return page_with_post_counts(page, posts)


def scored_case_table(cases, posts, case_scores, features) -> DataFrame:
    """Active scores with features and post counts, all cases: the un-paged form of `scored_cases`."""
    base = cases.join(case_scores, "case_id").join(features, "case_id", "left")
    return with_post_counts(base, posts)


def scoring_worklist(cases, case_scores, model_scores, missing_keys: list[str] | None = None, limit=20) -> DataFrame:
    """Oldest cases without an active score, or lacking any of the given scorers."""
    limit = 20 if limit <= 0 else limit
    keys = sorted({k.strip() for k in missing_keys or [] if k.strip()})
    todo = missing_any_scorer(cases, model_scores, keys) if keys else unscored_cases(cases, case_scores)
    return todo.orderBy(F.asc_nulls_last("first_event_at"), F.asc("case_id")).limit(limit)


def missing_any_scorer(cases: DataFrame, model_scores: DataFrame, keys: list[str]) -> DataFrame:
    """(case, scorer) is unique, so a case is complete when it has one row per wanted key."""
    complete = (
        model_scores.where(F.col("scorer_key").isin(keys))
        .groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") >= len(keys))
    )
    return cases.join(complete, "case_id", "left_anti")


def top_risk_cases(base: DataFrame, posts: DataFrame, limit=12) -> DataFrame:
    score = F.coalesce("risk_score", F.lit(0.0))
    return (
        with_post_counts(base, posts)
        .select(
            "case_id", "external_case_id", display_title().alias("title"), "event_name", "status", "label",
            "post_count", score.alias("risk_score"),
            F.coalesce(F.when(F.col("risk_level") != "", F.col("risk_level")), F.lit("low")).alias("risk_level"),
        )
        .orderBy(F.desc("risk_score"), F.desc("post_count"), F.asc("case_id"))
        .limit(limit)
    )


def top_cases_export(scored: DataFrame, limit: int, min_risk: float) -> DataFrame:
    """The limit applies before the risk filter."""
    top = scored.orderBy(F.desc("risk_score"), F.desc_nulls_last("first_event_at"), F.desc("case_id")).limit(limit)
    return top.where(F.col("risk_score") >= min_risk)


# -- case summaries -----------------------------------------------------------------------------

def cases_summary(base: DataFrame, page_size: int = 20) -> DataFrame:
    total = F.count("*")
    return base.agg(
        total.alias("total_cases"), *_level_counts(), _mean("risk_score").alias("mean_risk"),
        F.ceil(total / page_size).alias("pages"),
    )


def dashboard_summary(base: DataFrame, posts: DataFrame) -> DataFrame:
    label = F.col("label")
    per_case = base.join(posts_per_case(posts), "case_id", "left")
    total_posts = F.coalesce(F.sum("post_count"), F.lit(0))
    return per_case.agg(
        F.count("*").alias("total_cases"),
        _mean("risk_score").alias("mean_risk"),
        total_posts.alias("total_posts"),
        F.coalesce(total_posts / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avg_posts_per_case"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_cases") for s in ("open", "closed", "finalized")],
        F.count_if(label.isin("rumour", "rumor")).alias("rumour_cases"),
        F.count_if(label.isin("non_rumour", "non-rumour")).alias("non_rumour_cases"),
    )


def risk_distribution(base: DataFrame) -> DataFrame:
    high = F.count_if(F.col("risk_level") == "high")
    return base.agg(*_level_counts(), F.coalesce(high / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("high_risk_share"))


def engagement_totals(base: DataFrame, posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Sums are formed per account first, so the distinct counts need no second pass over posts."""
    matched = posts.join(base.select("case_id"), "case_id", "left_semi")
    per_account = matched.groupBy("account_id").agg(
        F.count("*").alias("posts"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("likes_count", "reposts_count", "replies_count")],
        F.sum(engagement()).alias("engagement"),
    )
    joined = per_account.join(accounts.select("account_id", "is_verified"), "account_id", "left")
    zero = F.lit(0)
    return joined.agg(
        F.coalesce(F.sum("posts"), zero).alias("post_count"),
        F.coalesce(F.sum("likes_count"), zero).alias("total_likes"),
        F.coalesce(F.sum("reposts_count"), zero).alias("total_reposts"),
        F.coalesce(F.sum("replies_count"), zero).alias("total_replies"),
        F.coalesce(F.sum("engagement"), zero).alias("total_engagement"),
        F.count("account_id").alias("unique_accounts"),
        F.count_if(flag_is_set("is_verified")).alias("verified_accounts"),
    )


def cases_over_time(base: DataFrame, *fallbacks: str) -> DataFrame:
    day = F.to_date(F.coalesce("first_event_at", "opened_at", *fallbacks))
    return base.groupBy(day.alias("day")).agg(F.count("*").alias("total"), *_level_counts())


def top_events(base: DataFrame, limit=12) -> DataFrame:
    name = F.coalesce(F.when(F.col("event_name") != "", F.col("event_name")), F.lit("unknown"))
    return (
        base.groupBy(name.alias("event_name"))
        .agg(F.count("*").alias("case_count"), _mean("risk_score").alias("avg_risk"))
        .orderBy(F.desc("case_count"), F.desc("avg_risk"), F.asc("event_name"))
        .limit(limit)
    )


def breakdowns(base: DataFrame, limit=12) -> DataFrame:
    """Four group-bys in one pass over the cases."""
    known = lambda c: F.coalesce(F.when(c != "", c), F.lit("unknown"))
    pair = F.concat("dataset_name", F.lit("/"), "dataset_split")
    dims = ["status", "label", "source", "dataset"]
    named = base.select(
        known(F.col("status")).alias("status"), known(F.col("label")).alias("label"),
        known(F.col("source_name")).alias("source"),
        F.coalesce(F.when(pair != "/", pair), F.lit("unknown")).alias("dataset"), "risk_score",
    )
    grouped = named.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.count("*").alias("case_count"), _mean("risk_score").alias("avg_risk")
    )
    long = grouped.select(
        F.when(F.col("status").isNotNull(), "status").when(F.col("label").isNotNull(), "label")
        .when(F.col("source").isNotNull(), "source").otherwise("dataset").alias("dimension"),
        F.coalesce(*dims).alias("name"), "case_count", "avg_risk",
    )
    w = Window.partitionBy("dimension").orderBy(F.desc("case_count"), F.desc("avg_risk"), F.asc("name"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")


def scorer_performance(cases: DataFrame, case_scores: DataFrame, model_scores: DataFrame) -> DataFrame:
    columns = ["scorer_key", "case_id", "risk_score"]
    both = case_scores.select(F.lit("case_scores").alias("scorer_key"), "case_id", "risk_score").unionByName(
        model_scores.select(*columns)
    )
    per_case = both.join(cases.select("case_id"), "case_id", "left_semi").groupBy("scorer_key", "case_id").agg(
        F.sum("risk_score").alias("s"), F.count("risk_score").alias("n")
    )
    return per_case.groupBy("scorer_key").agg(
        F.coalesce(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("avg_risk_score"),
        F.count("*").alias("cases_analyzed"),
    )


def radar_points(case_scores: DataFrame, model_scores: DataFrame, scorer_key: str) -> DataFrame:
    """Three branches per case; the stored scorer's values if it scored the case, else the active ones."""
    chosen = score_source(case_scores, model_scores, scorer_key).alias("m")
    active = score_source(case_scores, model_scores).alias("a")
    joined = chosen.join(active, "case_id", "full")
    branch = lambda c: F.when(F.col("m.scorer_key").isNotNull(), F.coalesce(f"m.{c}", F.lit(0.0))).otherwise(
        F.coalesce(f"a.{c}", F.lit(0.0)))
    wide = joined.select(
        "case_id", branch("coordination_score").alias("coordination"), branch("temporal_score").alias("temporal"),
        branch("content_score").alias("content"),
    )
    return wide.unpivot("case_id", ["coordination", "temporal", "content"], "branch", "value")


# -- post-level results -------------------------------------------------------------------------

def post_stats(posts: DataFrame, results: DataFrame) -> DataFrame:
    """Posts and results meet as two partial counts, not in a join."""
    rows = posts.select(F.lit(1).alias("is_post"), *[F.lit(None).alias(c) for c in (
        "escalation_priority", "manipulation_score", "confidence_score")]).unionByName(
        results.select(F.lit(0).alias("is_post"), "escalation_priority", "manipulation_score", "confidence_score"))
    p = F.col("escalation_priority")
    return rows.agg(
        F.sum("is_post").alias("total_posts"),
        *[F.count_if(p == i).alias(f"{n}_priority_count") for i, n in enumerate(LEVELS, 1)],
        _mean("manipulation_score").alias("avg_manipulation_score"), _mean("confidence_score").alias("avg_confidence"),
    )


def analysis_summary(posts: DataFrame, results: DataFrame, source_type="dataset", **where: str) -> DataFrame:
    kept = where_chosen(posts, source_type=source_type, **where).select("post_id")
    p = F.col("escalation_priority")
    return results.join(kept, "post_id", "left_semi").agg(
        F.count("*").alias("total_analyzed"),
        *[F.count_if(p == i).alias(f"{n}_risk") for i, n in enumerate(LEVELS, 1)],
        _mean("manipulation_score").alias("average_score"),
    )


def results_of_cases(base: DataFrame, posts: DataFrame, results: DataFrame) -> DataFrame:
    """Post results that belong to the matched cases."""
    linked = results.join(posts.select("post_id", "case_id"), "post_id")
    return linked.join(base.select("case_id"), "case_id", "left_semi")


def manipulation_stats(linked: DataFrame) -> DataFrame:
    return linked.agg(
        _mean("manipulation_score").alias("avg_manipulation"), _mean("coordination_contribution").alias("avg_coordination"),
        _mean("temporal_contribution").alias("avg_temporal"), _mean("narrative_contribution").alias("avg_narrative"),
        _mean("confidence_score").alias("avg_confidence"), F.count("*").alias("total_analyzed"),
        F.count_if(F.col("manipulation_score") >= 0.7).alias("high_manipulation"),
    )


def branch_time_series(linked: DataFrame, days: int = 0, as_of: Column | None = None) -> DataFrame:
    series = linked.groupBy(F.to_date("created_at").alias("day")).agg(
        _mean("coordination_contribution").alias("coordination"), _mean("temporal_contribution").alias("temporal"),
        _mean("narrative_contribution").alias("narrative"), F.count("*").alias("cnt"),
    )
    return trailing_days(series, "day", days, as_of)


def manipulation_trend(linked: DataFrame, days: int = 0, as_of: Column | None = None) -> DataFrame:
    """Per (day, case) sums first, so distinct cases are a plain count."""
    sums = ("manipulation_score", "coordination_contribution", "temporal_contribution", "narrative_contribution")
    per_case = linked.groupBy(F.to_date("created_at").alias("day"), "case_id").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]
    )
    mean = lambda c: F.sum(c) / F.sum("n")
    series = per_case.groupBy("day").agg(
        mean(sums[0]).alias("avg_score"), mean(sums[1]).alias("coordination"), mean(sums[2]).alias("temporal"),
        mean(sums[3]).alias("narrative"), F.count("case_id").alias("cases_count"),
    )
    return trailing_days(series, "day", days, as_of)


def recent_evidence(base: DataFrame, posts: DataFrame, results: DataFrame, limit=12) -> DataFrame:
    top = results_of_cases(base, posts, results).orderBy(
        F.desc("manipulation_score"), F.desc("created_at"), F.asc("post_id")
    ).limit(limit)
    titles = base.select("case_id", display_title().alias("case_title"))
    return top.join(top_cases(titles, top), "case_id")


def top_cases(cases: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of `cases` named by a limited result; at most its limit."""
    return cases.join(few.select("case_id").distinct(), "case_id", "left_semi")


def top_results(posts: DataFrame, accounts: DataFrame, results: DataFrame, limit=20) -> DataFrame:
    """The limit comes before the joins with content and author: both are 1:1."""
    top = results.orderBy(F.desc("manipulation_score"), F.asc("post_id")).limit(limit)
    rows = posts.join(top, "post_id")
    return accounts.select("account_id", "username", "display_name").join(rows, "account_id")


def runs_with_counts(runs: DataFrame, posts: DataFrame, limit=20) -> DataFrame:
    counts = posts.groupBy(F.col("ingestion_run_id").alias("run_id")).agg(F.count("*").alias("posts_ingested"))
    listed = runs.orderBy(F.desc("started_at"), F.asc("run_id")).limit(20 if limit <= 0 else limit)
    return listed.join(counts, "run_id", "left").withColumn("posts_ingested", F.coalesce("posts_ingested", F.lit(0)))


# -- accounts -----------------------------------------------------------------------------------

LEADERBOARD_SORTS = {
    "engagement": ["total_engagement", "dataset_post_count"],
    "posts": ["dataset_post_count", "total_engagement"],
    "followers": ["followers_count", "dataset_post_count"],
    "risk": ["avg_risk_score", "max_manipulation"],
    "manipulation": ["max_manipulation", "avg_manipulation"],
}


def account_activity(posts: DataFrame, results: DataFrame, case_scores: DataFrame) -> DataFrame:
    """One row per account. Everything is summed per (account, case) before scores are looked up."""
    with_result = posts.join(results.select("post_id", "manipulation_score"), "post_id", "left")
    per_pair = with_result.groupBy("account_id", "case_id").agg(
        F.count("*").alias("posts"),
        F.count_if("is_case_root").alias("roots"),
        F.sum(engagement()).alias("engagement"),
        F.sum("manipulation_score").alias("manipulation_sum"),
        F.count("manipulation_score").alias("manipulation_n"),
        F.max("manipulation_score").alias("manipulation_max"),
        F.min("published_at").alias("first_seen_at"),
        F.max("published_at").alias("last_seen_at"),
    )
    scored = salted_join(
        per_pair, case_scores.select("case_id", "risk_score", "risk_level"), ["case_id"], "account_id", "left"
    )
    posts_with_score = F.when(F.col("risk_score").isNotNull(), F.col("posts"))
    zero = F.lit(0.0)
    return scored.groupBy("account_id").agg(
        F.sum("posts").alias("dataset_post_count"),
        F.count("case_id").alias("case_count"),
        F.sum("roots").alias("root_post_count"),
        F.coalesce(F.sum("engagement"), F.lit(0)).alias("total_engagement"),
        F.coalesce(F.sum("manipulation_sum") / F.nullif(F.sum("manipulation_n"), F.lit(0)), zero).alias("avg_manipulation"),
        F.coalesce(F.max("manipulation_max"), zero).alias("max_manipulation"),
        F.coalesce(
            F.sum(F.col("risk_score") * F.col("posts")) / F.nullif(F.sum(posts_with_score), F.lit(0)), zero
        ).alias("avg_risk_score"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_case_count"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def account_leaderboard(
    accounts, posts, results, case_scores, *, search="", dataset_name="", dataset_split="",
    only_verified=False, only_bots=False,
) -> DataFrame:
    people = search_accounts(accounts, search)
    if only_verified:
        people = people.where(flag_is_set("is_verified"))
    if only_bots:
        people = people.where(flag_is_set("is_bot"))
    kept = where_chosen(posts, dataset_name=dataset_name, dataset_split=dataset_split)
    if search.strip() or only_verified or only_bots:
        kept = kept.join(people.select("account_id"), "account_id", "left_semi")
    return people.join(account_activity(kept, results, case_scores), "account_id")


def leaderboard_page(board: DataFrame, sort: str = "engagement", limit=50, offset=0) -> DataFrame:
    limit = 50 if limit <= 0 else limit
    keys = LEADERBOARD_SORTS.get(sort, LEADERBOARD_SORTS["engagement"])
    return board.orderBy(*[F.desc_nulls_last(k) for k in keys], F.asc("account_id")).offset(max(offset, 0)).limit(limit)


def leaderboard_totals(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count("*").alias("accounts"), F.sum("dataset_post_count").alias("posts"), F.sum("case_count").alias("cases"),
        F.sum("total_engagement").alias("engagement"), F.count_if(flag_is_set("is_verified")).alias("verified"),
        F.max("max_manipulation").alias("max_manipulation"),
    )


def account_recent_results(newest: DataFrame, results: DataFrame) -> DataFrame:
    """Mean score and high scores over each account's newest posts (`newest` from `newest_posts`)."""
    joined = newest.join(results.select("post_id", "manipulation_score"), "post_id")
    return joined.groupBy("account_id").agg(
        F.count("*").alias("total_posts_analyzed"),
        F.round(F.avg("manipulation_score"), 3).alias("average_manipulation_score"),
        F.count_if(F.col("manipulation_score") > 0.6).alias("high_manipulation_posts"),
    )


def newest_posts(posts: DataFrame, per_account: int | None = None) -> DataFrame:
    """All posts, or the newest of each account by a row-number filter, which works on each map task before the shuffle."""
    if per_account is None:
        return posts
    w = Window.partitionBy("account_id").orderBy(F.desc("published_at"), F.desc("post_id"))
    return posts.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= per_account)


# -- case detail --------------------------------------------------------------------------------

def case_accounts(posts: DataFrame, accounts: DataFrame) -> DataFrame:
    per_pair = posts.groupBy("case_id", "account_id").agg(
        F.count("*").alias("case_post_count"), F.min("published_at").alias("first_post_at"),
        F.max("published_at").alias("last_post_at"), F.bool_or("is_case_root").alias("has_root_post"),
    )
    return salted_join(per_pair, accounts, ["account_id"], "case_id")


def case_totals(posts: DataFrame, accounts: DataFrame, cases: DataFrame) -> DataFrame:
    """Engagement, verified accounts, the top account's share and the duration in minutes."""
    per_pair = posts.groupBy("case_id", "account_id").agg(
        F.count("*").alias("posts"), F.sum(engagement()).alias("engagement")
    )
    joined = salted_join(per_pair, accounts.select("account_id", "is_verified"), ["account_id"], "case_id")
    totals = joined.groupBy("case_id").agg(
        F.sum("posts").alias("post_count"), F.sum("engagement").alias("total_engagement"),
        F.count_if(flag_is_set("is_verified")).alias("verified_accounts"), F.count("*").alias("accounts"),
        (F.max("posts") / F.sum("posts")).alias("top_account_share"),
    )
    minutes = (F.unix_micros("last_event_at") - F.unix_micros("first_event_at")) / 60_000_000
    duration = F.when(minutes >= 0, F.greatest(F.lit(1), F.floor(minutes + 0.5)))
    return cases.select("case_id", duration.alias("duration_min")).join(totals, "case_id")


def artifact_counts(posts: DataFrame, tags: DataFrame, links: DataFrame, limit=20) -> DataFrame:
    """Most frequent tags, links and domains of every case, in one pass."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    resolved = F.coalesce(blank("expanded_url"), F.col("url"))
    child = tags.select("post_id", F.lit("tag").alias("kind"), F.col("tag").alias("value")).unionByName(
        links.select("post_id", F.explode(F.array(
            F.struct(F.lit("url").alias("kind"), resolved.alias("value")),
            F.struct(F.lit("domain").alias("kind"), F.coalesce(blank("domain"), resolved).alias("value")),
        )).alias("v")).select("post_id", "v.*")
    ).where(F.trim("value") != "")
    counts = child.join(posts.select("post_id", "case_id"), "post_id").groupBy("case_id", "kind", "value").agg(
        F.count("*").alias("count")
    )
    w = Window.partitionBy("case_id", "kind").orderBy(F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def resolved_links(links: DataFrame) -> DataFrame:
    blank = F.when(F.col("expanded_url") != "", F.col("expanded_url"))
    return links.select("post_id", F.coalesce(blank, F.col("url")).alias("link"))


def posts_with_children(posts: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """Tag and link arrays per post. A post's own children are few: the group is one post."""
    tag_lists = tags.groupBy("post_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    link_lists = resolved_links(links).groupBy("post_id").agg(F.sort_array(F.collect_list("link")).alias("links"))
    empty = F.array().cast("array<string>")
    return (
        posts.join(tag_lists, "post_id", "left").join(link_lists, "post_id", "left")
        .withColumn("tags", F.coalesce("tags", empty)).withColumn("links", F.coalesce("links", empty))
    )


def post_offsets(posts: DataFrame, cases: DataFrame) -> DataFrame:
    """Seconds since the case began, and whether a post is root, reply or repost."""
    joined = salted_join(posts, cases.select("case_id", "first_event_at"), ["case_id"], "post_id")
    millis = F.unix_millis("published_at") - F.unix_millis("first_event_at")
    return joined.withColumn(
        "t_offset_sec", F.greatest(F.lit(0), F.floor(millis / 1000 + 0.5)).cast("bigint")
    ).withColumn(
        "kind_of_post",
        F.when(F.col("is_case_root"), "root").when(F.col("reply_to_post_id").isNotNull(), "reply").otherwise("repost"),
    )


def activity_timeline(posts: DataFrame, cases: DataFrame, buckets: int = 40) -> DataFrame:
    """Posts per bucket of the case's own span, with empty buckets kept.

    Offsets are counted per (case, second) first: the bucket needs the longest
    offset of the case, and that lookup then runs over seconds, not posts.
    """
    last = buckets - 1
    seconds = post_offsets(posts, cases).groupBy("case_id", "t_offset_sec").agg(F.count("*").alias("n"))
    longest = seconds.groupBy("case_id").agg(F.greatest(F.max("t_offset_sec"), F.lit(1)).alias("span"))
    placed = salted_join(seconds, longest, ["case_id"], "t_offset_sec").withColumn(
        "bucket", F.least(F.lit(last), F.floor(F.col("t_offset_sec") / F.col("span") * last)).cast("int")
    )
    counts = placed.groupBy("case_id", "bucket").agg(F.sum("n").alias("posts"))
    frame = longest.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bucket"))
    return frame.join(counts, ["case_id", "bucket"], "left").withColumn("posts", F.coalesce("posts", F.lit(0)))


def case_bundle(cases, posts, accounts, tags, links, scores, roots, features) -> DataFrame:
    """Everything a case page shows, as rows (case, section, name, amount).

    Rows instead of nested arrays: a giant thread is as many rows as it has posts
    and never one value. `roots` has case_id, root_post_id; `features` is long
    (case_id, name, value).
    """
    summary = with_post_counts(cases.join(scores, "case_id", "left"), posts)
    row = lambda section, name, amount: (
        F.lit(section).alias("section"), name.cast("string").alias("name"), amount.cast("double").alias("amount"))
    parts = [
        summary.select("case_id", *row("summary", F.col("external_case_id"), F.col("post_count"))),
        summary.select("case_id", *row("risk", F.coalesce("risk_level", F.lit("")), F.col("risk_score"))),
        roots.select("case_id", *row("root", F.col("root_post_id"), F.lit(1))),
        posts.select("case_id", *row("post", F.col("external_id"), engagement())),
        case_accounts(posts, accounts).select("case_id", *row("account", F.col("username"), F.col("case_post_count"))),
        artifact_counts(posts, tags, links).select(
            "case_id", *row("artifact", F.concat_ws(":", "kind", "value"), F.col("count"))),
        features.select("case_id", *row("feature", F.col("name"), F.col("value"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def model_score_list(model_scores: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Every stored scorer of each case, best risk first."""
    rows = model_scores if cases is None else model_scores.join(cases.select("case_id"), "case_id", "left_semi")
    w = Window.partitionBy("case_id").orderBy(F.desc("risk_score"), F.asc("scorer_key"))
    return rows.withColumn("position", F.row_number().over(w))


def score_evidence(scores: DataFrame) -> DataFrame:
    """Component scores as evidence, best first, for cases without features."""
    parts = F.array(*[
        F.struct((-F.col(f"{g}_score")).alias("order"), F.lit(i).alias("i"), F.lit(g).alias("name"),
                 F.col(f"{g}_score").alias("value"))
        for i, g in enumerate(("temporal", "coordination", "content"))
    ])
    items = F.sort_array(F.filter(parts, lambda p: p["value"].isNotNull()))
    return scores.select("case_id", F.posexplode(items).alias("position", "e")).select(
        "case_id", F.col("position") + 1, F.col("e.name").alias("name"), F.col("e.value").alias("value")
    ).toDF("case_id", "position", "name", "value")


# -- ranked lists -------------------------------------------------------------------------------

def trending(rows: DataFrame, limit: int, key: str = "tag") -> DataFrame:
    return rows.orderBy(F.desc("today_uses"), F.asc(key)).limit(limit)


def most_common(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per group, ties to the smaller value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == 1).drop("rank", "n")


def common_or_mixed(column: str) -> Column:
    return F.when(F.min(column) == F.max(column), F.min(column)).when(F.count(column) > 0, "mixed").otherwise("")


def posts_in_range(posts: DataFrame, accounts: DataFrame, start: Column, end: Column) -> DataFrame:
    kept = posts.where(F.col("published_at").between(start, end))
    return kept.join(accounts.select("account_id", "username", "followers_count"), "account_id")
