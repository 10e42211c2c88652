"""Optional filters and the choice of the score table."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

ACTIVE_KEYS = {"", "case_scores", "active", "default"}  # fixed values


@dataclass
class CaseFilter:
    source_name: str = ""
    dataset_name: str = ""
    dataset_split: str = ""
    event_name: str = ""
    status: str = ""
    label: str = ""
    risk_level: str = ""


def where_equal(df: DataFrame, **wanted: str) -> DataFrame:
    """AND of the equality filters that are given; '' means no filter."""
    for column, value in wanted.items():
        if value not in (None, ""):
            df = df.where(F.col(column) == value)
    return df


def where_chosen(df: DataFrame, **wanted: str) -> DataFrame:
    """Like `where_equal` for dashboard choices: blank and 'all' mean no filter."""
    chosen = {k: v for k, v in wanted.items() if (v or "").strip() not in ("", "all")}
    return where_equal(df, **chosen)


def apply_case_filter(cases: DataFrame, f: CaseFilter, dashboard: bool = False) -> DataFrame:
    wanted = {k: v for k, v in asdict(f).items() if k != "risk_level"}
    return where_chosen(cases, **wanted) if dashboard else where_equal(cases, **wanted)


def uses_model_score(scorer_key: str | None) -> bool:
    return (scorer_key or "").strip() not in ACTIVE_KEYS


def score_source(case_scores: DataFrame, model_scores: DataFrame, scorer_key: str = "") -> DataFrame:
    """One row per scored case, from the active table or from one stored scorer."""
    columns = ["case_id", "scorer_key", "model_version", "risk_score", "risk_level",
               "temporal_score", "coordination_score", "content_score"]
    if uses_model_score(scorer_key):
        return model_scores.where(F.col("scorer_key") == scorer_key.strip()).select(*columns)
    return case_scores.select(
        "case_id", F.lit("case_scores").alias("scorer_key"), F.col("score_version").alias("model_version"),
        *columns[3:],
    )


def search_accounts(accounts: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring of username, display name or external id."""
    needle = needle.strip().lower()
    if not needle:
        return accounts
    hit = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle))
           for c in ("username", "display_name", "external_id")]
    return accounts.where(hit[0] | hit[1] | hit[2])


def flag_is_set(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def not_blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def display_title() -> Column:
    """title, else event, else external id, else 'case #id'."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(
        blank("title"), blank("event_name"), F.col("external_case_id"),
        F.concat(F.lit("case #"), F.col("case_id").cast("string")),
    )


def trailing_days(df: DataFrame, day: str, days: int, as_of: Column) -> DataFrame:
    return df if days <= 0 else df.where(F.col(day) >= F.date_sub(as_of, days))
