"""Rank and threshold metrics of scorers, and how scorers compare.

Input rows are (scorer_key, case_id, y, score): y is 1 for a positive label and
0 otherwise, scores lie in [0, 1]. There are few scorers and many cases, so no
step sorts all cases of a scorer in one task: curves come from histograms, ranks
from running totals by score cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.lexicons import POSITIVE_LABELS
from tidemark.functions.scores import clamp, fixed, normalise_label, risk_level
from tidemark.operators.skew import totals_before

#: Cells of scores between two powers of two, counted from 0 up to 1/2 and from 1 down to it.
GRID = 16_384
ID_CHUNK = 1 << 20
KEY = "scorer_key"
RANKING_KEY = "case_ensemble_v1"


def is_positive(label: Column, positive: list[str] | None = None) -> Column:
    wanted = sorted({p.strip().lower().replace("-", "_").replace(" ", "_") for p in positive or POSITIVE_LABELS} - {""})
    return normalise_label(label).isin(wanted)


def labelled_scores(scores: DataFrame, cases: DataFrame, positive: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Scores of cases that have a label."""
    rows = scores if keys is None else scores.where(F.col(KEY).isin(keys))
    labelled = cases.where(F.coalesce("label", F.lit("")) != "").select(
        "case_id", "label", "event_name", "external_case_id", is_positive(F.col("label"), positive).cast("int").alias("y"))
    return rows.join(labelled, "case_id").withColumnRenamed("risk_score", "score")


def _grid(score: Column) -> Column:
    """A cell number that never falls as the score grows. Cells are as fine near 0 and 1 as doubles are, so
    saturated scores spread over many cells."""
    def from_zero(x):
        power = F.floor(F.log2(x))
        return F.when(x > 0, (power + 1_100) * GRID + F.floor((x / F.pow(F.lit(2.0), power) - 1) * GRID)).otherwise(0)

    return F.when(score < 0.5, from_zero(score)).otherwise(2_400 * GRID - from_zero(1 - score))


def _cells(items: DataFrame, *more: str) -> DataFrame:
    return items.select(KEY, "case_id", "y", "score", _grid(F.col("score")).alias("grid"), *more)


# -- thresholds -----------------------------------------------------------------------------------

GRID_100 = [i / 100.0 for i in range(101)]
GRID_MID = [0.05 + i * (0.95 - 0.05) / 90 for i in range(91)]


def threshold_curve(items: DataFrame, thresholds: list[float] = GRID_100) -> DataFrame:
    """Confusion counts, precision, recall and F1 of every scorer at every threshold.

    Each score is reduced to the number of thresholds it reaches; the counts at a
    threshold are then sums over a histogram of that number.
    """
    steps = F.lit(thresholds)
    width = (thresholds[-1] - thresholds[0]) / (len(thresholds) - 1)
    guess = F.least(F.greatest(F.floor((F.col("score") - thresholds[0]) / width), F.lit(0)), F.lit(len(thresholds) - 1)).cast("int")
    at = lambda i: F.element_at(steps, i)
    reached = (
        F.when(F.col("score") < at(F.col("guess") + 1), F.col("guess"))
        .when((F.col("guess") + 2 <= len(thresholds)) & (F.col("score") >= at(F.least(F.col("guess") + 2, F.lit(len(thresholds))))), F.col("guess") + 2)
        .otherwise(F.col("guess") + 1)
    )
    hist = items.withColumn("guess", guess).groupBy(KEY, reached.alias("reached")).agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    frame = hist.select(KEY).distinct().select(KEY, F.explode(F.sequence(F.lit(0), F.lit(len(thresholds)))).alias("reached"))
    filled = frame.join(hist, [KEY, "reached"], "left").na.fill(0, ["pos", "neg"])
    above = Window.partitionBy(KEY).orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(KEY)
    counts = filled.select(
        KEY, "reached", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("positives"), F.sum("neg").over(whole).alias("negatives"),
    ).where("reached > 0")
    c = F.col
    some = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rates = counts.select(
        KEY, F.element_at(steps, c("reached")).alias("threshold"), "tp", "fp", (c("positives") - c("tp")).alias("fn"),
        (c("negatives") - c("fp")).alias("tn"), some(c("tp"), c("tp") + c("fp")).alias("precision"),
        some(c("tp"), c("positives")).alias("recall"),
    )
    return rates.withColumn("f1", some(2 * c("precision") * c("recall"), c("precision") + c("recall")))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The lowest threshold with the highest F1."""
    w = Window.partitionBy(KEY).orderBy(F.desc("f1"), F.asc("threshold"))
    return curve.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def confusion_at(items: DataFrame, threshold: float) -> DataFrame:
    """Counts and rates at one threshold. A rate is null where it is undefined: recall and F1
    without positives, precision without both positives and predictions."""
    c, hit = F.col, F.col("score") >= threshold
    pos = F.col("y") == 1
    counts = items.groupBy(KEY).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"),
    )
    positives = c("tp") + c("fn")
    rates = counts.withColumns({
        "precision": F.when(c("tp") + c("fp") > 0, c("tp") / (c("tp") + c("fp"))).when(positives > 0, 0.0),
        "recall": F.when(positives > 0, c("tp") / positives),
    })
    total = c("precision") + c("recall")
    return rates.withColumn("f1", F.when(total > 0, 2 * c("precision") * c("recall") / total).when(total == 0, 0.0))


# -- ranks ----------------------------------------------------------------------------------------


def precision_at(items: DataFrame, *ks: int, ties: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Positives among the best k, or among all where there are fewer. The row-number
    filter keeps k rows per map task before anything is shuffled."""
    w = Window.partitionBy(KEY).orderBy(F.desc("score"), *[F.asc(t) for t in ties])
    top = items.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(ks))
    return top.groupBy(KEY).agg(*[F.avg(F.when(F.col("rn") <= k, F.col("y"))).alias(f"precision_at_{k}") for k in ks])


def roc_auc(items: DataFrame) -> DataFrame:
    """Area under the ROC curve with ties at half weight; null for a single class."""
    cells = _cells(items).groupBy(KEY, "grid", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = totals_before(cells, [KEY], [["grid"], ["score"]], ["pos"], descending=("grid", "score"))
    c = F.col
    won = F.sum(c("neg").cast("double") * (c("pos__before") + c("pos") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(KEY).agg(F.when(pairs > 0, won / pairs).alias("roc_auc"))


def pr_auc(items: DataFrame) -> DataFrame:
    """Average precision over single cases, best score first and smaller id first among equals."""
    rows = _cells(items).withColumns({"chunk": F.floor(F.col("case_id") / ID_CHUNK), "one": F.lit(1)})
    ranked = totals_before(rows, [KEY], [["grid"], ["score", "chunk"], ["case_id"]], ["one", "y"], descending=("grid", "score"))
    c = F.col
    gain = F.when(c("y") == 1, (c("y__before") + 1) / (c("one__before") + 1))
    return ranked.groupBy(KEY).agg((F.sum(gain) / F.nullif(F.sum("y"), F.lit(0))).alias("pr_auc"))


def pr_auc_by_score(items: DataFrame) -> DataFrame:
    """Average precision where equal scores enter together."""
    cells = _cells(items).groupBy(KEY, "grid", "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ranked = totals_before(cells, [KEY], [["grid"], ["score"]], ["pos", "n"], descending=("grid", "score"))
    c = F.col
    gain = c("pos") * (c("pos__before") + c("pos")) / (c("n__before") + c("n"))
    return ranked.groupBy(KEY).agg((F.sum(gain) / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))


def model_metrics(items: DataFrame, thresholds: list[float] = GRID_100, tied_scores: bool = False) -> DataFrame:
    best = best_threshold(threshold_curve(items, thresholds)).select(
        KEY, F.col("threshold").alias("best_threshold"), "precision", "recall", "f1")
    return (
        best.join(precision_at(items, 10, 20), KEY).join(roc_auc(items), KEY)
        .join(pr_auc_by_score(items) if tied_scores else pr_auc(items), KEY)
    )


def text_metrics(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics of a text split: accuracy, confusion, precision at 100 and 500."""
    c = F.col
    at = confusion_at(items, threshold).na.fill(0.0, ["precision", "recall", "f1"])
    return (
        at.withColumns({"rows": c("tp") + c("fp") + c("tn") + c("fn"), "positive_rows": c("tp") + c("fn")})
        .withColumns({"accuracy": (c("tp") + c("tn")) / c("rows"), "positive_rate": c("positive_rows") / c("rows")})
        .join(precision_at(items, 100, 500), KEY).join(roc_auc(items), KEY).join(pr_auc_by_score(items), KEY)
    )


# -- comparison -----------------------------------------------------------------------------------


def model_comparison(items: DataFrame) -> DataFrame:
    """One row per scorer: cases, classes, most common version, metrics."""
    counts = items.groupBy(KEY).agg(
        F.count("*").alias("case_count"), F.sum("y").alias("positive_cases"), F.sum(1 - F.col("y")).alias("negative_cases"))
    versions = items.groupBy(KEY, "model_version").agg(F.count("*").alias("n"))
    w = Window.partitionBy(KEY).orderBy(F.desc("n"), F.asc("model_version"))
    version = versions.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(KEY, "model_version")
    return counts.join(version, KEY).join(model_metrics(items), KEY)


def top_compared_cases(items: DataFrame, ranking_key: str, top_k: int = 20) -> DataFrame:
    """Best cases of one scorer with what every scorer says about them."""
    top_k = 20 if top_k <= 0 else top_k
    best = items.where(F.col(KEY) == ranking_key).orderBy(F.desc("score"), F.asc("case_id")).limit(top_k).select(
        "case_id", "external_case_id", "event_name", "label", F.col("score").alias("ranking_score"))
    others = items.select("case_id", KEY, "score").join(best, "case_id")
    return others.groupBy("case_id", "external_case_id", "event_name", "label", "ranking_score").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(KEY, "score")))).alias("component_scores"))


def best_scorers(metrics: DataFrame, names: list[str]) -> DataFrame:
    """The best scorer of every metric; missing values count as 0, the better PR-AUC goes first among equals."""
    long = metrics.withColumn("__pr", F.coalesce("pr_auc", F.lit(0.0))).unpivot([KEY, "__pr"], names, "metric", "value")
    w = Window.partitionBy("metric").orderBy(F.desc(F.coalesce("value", F.lit(0.0))), F.desc("__pr"), F.asc(KEY))
    return long.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("metric", KEY, "value")


def fold_metrics(predictions: DataFrame, fold: str = "event_name", threshold: float = 0.5) -> DataFrame:
    """Metrics of every held-out event."""
    items = predictions.withColumn(KEY, F.col(fold))
    out = confusion_at(items, threshold).na.fill(0.0, ["precision", "recall", "f1"])
    out = out.join(roc_auc(items), KEY).join(pr_auc_by_score(items), KEY)
    c = F.col
    return out.select(c(KEY).alias("test_event"), (c("tp") + c("fp") + c("tn") + c("fn")).alias("rows"),
                      (c("tp") + c("fn")).alias("positive_rows"), "precision", "recall", "f1", "roc_auc", "pr_auc")


def evaluation_report(scored: DataFrame, threshold: float = 0.5, positive: list[str] | None = None) -> DataFrame:
    """One row for the active scores: who scored, classes, rank and threshold metrics.

    `scored` has case_id, label, risk_score, score_version, pipeline_hash.
    """
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("mixed")
    labelled = scored.where(F.trim(F.coalesce("label", F.lit(""))) != "").select(
        F.lit("active").alias(KEY), "case_id", is_positive(F.col("label"), positive).cast("int").alias("y"),
        F.col("risk_score").alias("score"), "score_version", "pipeline_hash")
    heads = labelled.groupBy(KEY).agg(
        F.count("*").alias("labeled_cases"), F.sum("y").alias("positive_cases"), F.sum(1 - F.col("y")).alias("negative_cases"),
        same("score_version").alias("scorer_version"), same("pipeline_hash").alias("pipeline_hash"))
    return (
        heads.join(confusion_at(labelled, threshold), KEY).join(precision_at(labelled, 10, 20), KEY)
        .join(roc_auc(labelled), KEY).join(pr_auc(labelled), KEY).withColumn("threshold", F.lit(threshold)).drop(KEY)
    )


# -- ensemble -------------------------------------------------------------------------------------


def wide_scores(items: DataFrame, keys: list[str], complete: bool = True) -> DataFrame:
    """One row per case with a column per scorer; only cases all scorers know, if `complete`."""
    wide = items.groupBy("case_id", "external_case_id", "event_name", "label", "y").pivot(KEY, keys).agg(F.max("score"))
    return wide.dropna(subset=keys) if complete else wide


def normalised_weights(weights: dict[str, float], keys: list[str]) -> dict[str, float]:
    weights = weights or {k: 1.0 for k in keys}
    if set(weights) != set(keys):
        raise ValueError(f"weights and scorers differ: {sorted(set(weights) ^ set(keys))}")
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must sum to a positive value")
    return {k: weights[k] / total for k in keys}


def ensemble_scores(wide: DataFrame, weights: dict[str, float], key: str = RANKING_KEY, version: str = "case-ensemble-v1") -> DataFrame:
    """Weighted mean of the scorers as rows for the table of model scores."""
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + F.coalesce(name, F.lit(0.0)) * weight
    rows = wide.withColumn("risk_score", clamp(score))
    s = F.col("risk_score")
    parts = F.concat_ws(", ", *[
        F.concat(F.lit(f"{k}="), fixed(F.coalesce(k, F.lit(0.0)), 4), F.lit(f"*{w:.2f}")) for k, w in weights.items()])
    return rows.select(
        "case_id", "event_name", "label", "y", F.lit(key).alias(KEY), F.lit(version).alias("model_version"), "risk_score",
        risk_level(s).alias("risk_level"), F.greatest(s, 1 - s).alias("confidence_score"),
        F.array(F.concat(F.lit("Weighted ensemble score="), fixed(s, 4), F.lit(".")), F.concat(F.lit("Components: "), parts)).alias("evidence"),
        F.lit("offline_weighted_ensemble").alias("source_endpoint"),
    )
