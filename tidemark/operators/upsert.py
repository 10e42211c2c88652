"""Table maintenance by snapshots: merge a batch into a base with a rule per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.operators.skew import salted_join
from tidemark.schema import violations

# What a column becomes when the key exists already:
#   new      the batch wins                     old      the base wins
#   filled   the batch wins unless blank        known    the batch wins unless null
#   least / greatest   smaller / larger, nulls ignored
#   either   true if either is true             merged   entries of the batch over the base's, of a map or of a VARIANT
#                                                        object: values may be nested and are taken or kept as a whole
RULES = ("new", "old", "filled", "known", "least", "greatest", "either", "merged")

SOURCE_RULES = {"api_endpoint": "filled", "is_active": "new"}
CASE_RULES = {
    "case_type": "new", "status": "new", "label": "filled", "title": "filled", "description": "filled", "event_name": "filled",
    "root_post_external_id": "filled", "closed_at": "known", "opened_at": "old", "first_event_at": "least",
    "last_event_at": "greatest", "metadata": "merged",
}
LIVE_ACCOUNT_RULES = {
    "followers_count": "new", "following_count": "new", "posts_count": "new", "username": "old", "display_name": "old",
    "is_verified": "old", "is_bot": "old", "created_at": "old", "collected_at": "new",
}
DATASET_ACCOUNT_RULES = {
    "username": "new", "display_name": "new", "followers_count": "new", "following_count": "new", "is_verified": "new",
    "posts_count": "old", "is_bot": "old", "created_at": "old", "last_seen_at": "new",
}
DATASET_POST_RULES = {
    **{c: "new" for c in ("account_id", "content", "language", "published_at", "post_url", "likes_count", "reposts_count",
                          "replies_count", "source_type", "raw_payload_ref", "raw_payload_hash", "dataset_name",
                          "dataset_split", "dataset_record_id", "ingestion_run_id")},
    "case_id": "known", "is_case_root": "either",
}
RESULT_RULES = {c: "new" for c in (
    "manipulation_score", "confidence_score", "coordination_contribution", "temporal_contribution", "narrative_contribution",
    "escalation_priority", "confidence_note")} | {"created_at": "old"}
TREND_RULES = {c: "new" for c in ("history", "today_accounts", "today_uses", "last_seen_at", "title", "description")} | {
    "provider_name": "old", "image_url": "old"}
SCORE_RULES = {c: "new" for c in (
    "model_version", "score_version", "risk_score", "risk_level", "confidence_score", "temporal_score", "coordination_score",
    "content_score", "evidence", "pipeline_hash", "source_endpoint", "computed_at")}

FEATURE_RULES = {c: "new" for c in ("feature_version", "features", "computed_at")}

RUN_RULES = {"source_type": "old", "source_name": "old", "started_at": "old", "status": "new", "finished_at": "known"}


def _is_filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _combine(rule: str, old: Column, new: Column) -> Column:
    if rule == "new":
        return new
    if rule == "old":
        return old
    if rule == "filled":
        return F.when(_is_filled(new), new).otherwise(old)
    if rule == "known":
        return F.coalesce(new, old)
    if rule == "least":
        return F.least(old, new)
    if rule == "greatest":
        return F.greatest(old, new)
    if rule == "either":
        return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
    if rule == "merged":
        return F.when(new.isNull() | (F.size(new) == 0), old).when(old.isNull(), new).otherwise(F.map_concat(old, new))
    raise ValueError(f"unknown rule {rule}")


def collapse_batch(batch: DataFrame, keys: list[str], rules: dict[str, str], order: str) -> DataFrame:
    """One row per key, as if the rows of the batch had been merged one after the other by `order`.

    Aggregates per rule, summed up before the shuffle: a key repeated in a third of
    the batch costs one row per map task.
    """
    at = F.col(order)
    columns = [c for c in batch.columns if c not in keys and c != order]
    last = [c for c in columns if rules[c] == "new"]
    first = [c for c in columns if rules[c] == "old"]
    aggs: list[Column] = []
    if last:
        aggs.append(F.max_by(F.struct(*last), at).alias("__last"))
    if first:
        aggs.append(F.min_by(F.struct(*first), at).alias("__first"))
    for c in columns:
        rule, col = rules[c], F.col(c)
        if rule == "filled":
            # nothing filled at all: what the first row brought
            aggs.append(F.coalesce(F.max_by(col, F.when(_is_filled(col), at)), F.min_by(col, at)).alias(c))
        elif rule == "known":
            aggs.append(F.max_by(col, F.when(col.isNotNull(), at)).alias(c))
        elif rule in ("least", "greatest", "either"):
            aggs.append({"least": F.min, "greatest": F.max, "either": F.bool_or}[rule](col).alias(c))
    out = batch.groupBy(*keys).agg(*aggs) if aggs else batch.select(*keys).distinct()
    for c in (c for c in columns if rules[c] == "merged"):
        entries = batch.select(*keys, order, F.explode_outer(c).alias("__k", "__v"))
        kept = entries.where(F.col("__k").isNotNull()).groupBy(*keys, "__k").agg(F.max_by("__v", at).alias("__v"))
        maps = kept.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias(c))
        out = out.join(maps, keys, "left")
    picked = {c: F.col(f"__last.{c}") for c in last} | {c: F.col(f"__first.{c}") for c in first}
    return out.select(*keys, *[picked.get(c, F.col(c)).alias(c) for c in columns])


def _open(df: DataFrame, columns: list[str]) -> DataFrame:
    """VARIANT objects as maps of their entries; what is no object has none."""
    return df.withColumns({c: F.expr(f"CASE WHEN schema_of_variant(`{c}`) LIKE 'OBJECT%' THEN try_cast(`{c}` AS MAP<STRING, VARIANT>) END") for c in columns})


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], rules: dict[str, str], order: str | None = None) -> DataFrame:
    """Base with the batch merged in. Without `order` the batch must hold each key once."""
    objects = [c for c in base.columns if rules.get(c) == "merged" and isinstance(base.schema[c].dataType, T.VariantType)]
    if objects:
        out = upsert(_open(base, objects), _open(batch, objects), keys, rules, order)
        return out.withColumns({c: F.expr(f"to_variant_object(`{c}`)") for c in objects})
    columns = [c for c in base.columns if c not in keys]
    unknown = [c for c in columns if c not in rules]
    if unknown:
        raise ValueError(f"no rule for {unknown}")
    new = collapse_batch(batch, keys, rules, order) if order else batch
    b, n = base.withColumn("__in_base", F.lit(True)).alias("b"), new.withColumn("__in_batch", F.lit(True)).alias("n")
    joined = b.join(n, keys, "full")
    pick = lambda c: (
        F.when(F.col("__in_base").isNull(), F.col(f"n.{c}")).when(F.col("__in_batch").isNull(), F.col(f"b.{c}"))
        .otherwise(_combine(rules[c], F.col(f"b.{c}"), F.col(f"n.{c}"))).alias(c)
    )
    return joined.select(*keys, *[pick(c) for c in columns])


def insert_new(base: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First writer wins: rows of unknown keys, the first of each key, are added."""
    rules = {c: "old" for c in batch.columns if c not in keys and c != order}
    fresh = collapse_batch(batch.join(base.select(*keys), keys, "left_anti"), keys, rules, order)
    return base.unionByName(fresh.select(*base.columns))


def replace_children(children: DataFrame, incoming: DataFrame, touched: DataFrame, value: str, parent: str = "post_id", distinct: bool = True) -> DataFrame:
    """Children of touched parents are replaced; blank values are dropped, and repeated ones if `distinct`."""
    kept = children.join(touched.select(parent).distinct(), parent, "left_anti")
    fresh = incoming.join(touched.select(parent).distinct(), parent, "left_semi").where(F.trim(F.coalesce(value, F.lit(""))) != "")
    if distinct:
        fresh = fresh.withColumn(value, F.trim(value)).dropDuplicates([parent, value])
    return kept.unionByName(fresh.select(*children.columns))


def with_today(trends: DataFrame) -> DataFrame:
    """Counts of the newest history entry: the leading integer of its text, 0 if there is none."""
    lead = lambda c: F.coalesce(
        F.expr(f"try_cast(nullif(regexp_extract(get(history, 0).{c}, '^\\\\s*([+-]?\\\\d+)', 1), '') AS int)"), F.lit(0))
    return trends.withColumns({"today_accounts": lead("accounts"), "today_uses": lead("uses")})


def result_cards(results: DataFrame) -> DataFrame:
    """Evidence cards of post results: three radar values, the evidence and a summary."""
    radar = F.create_map(
        F.lit("coordination"), F.col("coordination_contribution"), F.lit("temporal"), F.col("temporal_contribution"),
        F.lit("narrative"), F.col("narrative_contribution"))
    return results.select("post_id", radar.alias("radar_data"), "key_evidence", F.col("confidence_note").alias("summary"))


def backfill_model_scores(model_scores: DataFrame, case_scores: DataFrame, key: str = "case_feature") -> DataFrame:
    """Active scores become rows of one scorer; rows that exist are kept."""
    rows = case_scores.withColumn("scorer_key", F.lit(key)).withColumnRenamed("score_version", "model_version")
    fresh = rows.join(model_scores.select("case_id", "scorer_key"), ["case_id", "scorer_key"], "left_anti")
    return model_scores.unionByName(fresh.select(*[c for c in fresh.columns if c in model_scores.columns]), allowMissingColumns=True)


DECISIONS = ("open", "suspicious", "not_suspicious", "unclear")  # fixed values


def apply_decisions(cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision of every case as a column of its own; blank means unclear. `refused_decisions` has the others."""
    last = _read_decisions(decisions).where(F.col("decision").isin(*DECISIONS))
    last = last.groupBy("case_id").agg(F.max_by("decision", "recorded_at").alias("decision"))
    return cases.join(last, "case_id", "left")


def _read_decisions(decisions: DataFrame) -> DataFrame:
    clean = F.trim(F.coalesce("decision", F.lit("")))
    return decisions.withColumn("decision", F.when(clean == "", "unclear").otherwise(clean))


def refused_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions that are not in the list, as rows (key, rule, value)."""
    return violations(_read_decisions(decisions), "case_id", {"decision": list(DECISIONS)})


def resolve_replies(posts: DataFrame) -> DataFrame:
    """Parent ids of replies by the parent's external id within the source, wherever the parent is in the batch."""
    parents = posts.select("source_id", F.col("external_id").alias("reply_to_external_id"), F.col("post_id").alias("reply_to_post_id"))
    return salted_join(posts.drop("reply_to_post_id"), parents, ["source_id", "reply_to_external_id"], "post_id", "left")


# -- runs ------------------------------------------------------------------------------------------


def start_runs(runs: DataFrame) -> DataFrame:
    """New ingestion runs: running and without an end."""
    return runs.withColumns({"status": F.lit("running"), "finished_at": F.lit(None).cast("timestamp")})


def finish_runs(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """Runs with the status and time of those that ended (run_id, status, finished_at); others go on."""
    batch = ended.join(runs.drop("status", "finished_at"), "run_id")
    return upsert(runs, batch.select(*runs.columns), ["run_id"], RUN_RULES)


def append_run(df: DataFrame, table: str) -> None:
    """Evaluation and ingestion runs are only ever added."""
    df.write.mode("append").parquet(table)
