"""Joins and running totals that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

# A key is hot when it holds more rows than one task should take and more than 1/MAX_HOT_KEYS of all rows.
ROWS_PER_SALT = 200_000
MAX_HOT_KEYS = 100_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """keys + __salts for hot keys only.

    Fewer than MAX_HOT_KEYS keys can hold more than 1/MAX_HOT_KEYS of the total, so the result is a few MB whatever
    the size of the data and may be broadcast. A key that is not hot has rows_per_salt rows at most below 2 * 10**10
    rows in all, and ten million at 10**12.
    """
    total = counts.agg(F.sum(n).cast("double")).scalar()
    share = F.greatest(F.lit(float(rows_per_salt)), F.coalesce(total, F.lit(0.0)) / MAX_HOT_KEYS)
    return (
        counts.withColumn("__share", share)
        .where(F.col(n) > F.col("__share"))
        .select(*keys, F.ceil(F.col(n) / F.col("__share")).cast("int").alias("__salts"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "inner",
    counts: DataFrame | None = None,
    n: str = "__n",
    rows_per_salt: int = ROWS_PER_SALT,
    *,
    keep_salts: bool = False,
) -> DataFrame:
    """Join a large `left` whose keys may be hot with a `right` that has few rows per key.

    Hot keys are cut into salts by a hash of `spread`, a column of `left` (a hash,
    not a random number, so that a recomputed task sends rows to the same place). Rows with a null key
    have no partner: a left join keeps them where they are. `keep_salts` leaves __salt and __salts (how many the key has)
    in an inner join, whose rows lie together by key and __salt.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if counts is None:
        counts = left.where(keyed).groupBy(*keys).agg(F.count("*").alias(n))
    hot = F.broadcast(hot_keys(counts, keys, n, rows_per_salt))
    if keep_salts and how != "inner":
        raise ValueError("keep_salts needs an inner join")
    salted_left = left.where(keyed).join(hot, keys, "left").withColumn(
        "__salt",
        F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(spread), F.col("__salts").cast("long")).cast("int")
        ),
    ).drop("__salts")
    salted_right = right.join(hot, keys, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    ).withColumn("__salts", F.coalesce("__salts", F.lit(1)))
    if keep_salts:
        return salted_left.join(salted_right, keys + ["__salt"], how)
    joined = salted_left.join(salted_right.drop("__salts"), keys + ["__salt"], how).drop("__salt")
    if how == "inner" or not any(left.schema[k].nullable for k in keys):
        return joined
    return joined.unionByName(left.where(~keyed), allowMissingColumns=True)


def totals_before(
    df: DataFrame,
    part: list[str],
    levels: list[list[str]],
    measures: list[str],
    descending: tuple[str, ...] = (),
) -> DataFrame:
    """Add `<m>__before`: the sum of m over the rows of the same part that precede this row.

    The order is given by `levels`, coarse to fine. Every level but the last is
    summed up first and gets its own prefix sums, so one sort only ever holds the
    rows of one fine group instead of a whole part.
    """

    def order(cols):
        return [F.desc(c) if c in descending else F.asc(c) for c in cols]

    keys = list(part)
    bases: list[list[str]] = []
    out = df
    for depth, level in enumerate(levels[:-1]):
        inner = keys + level
        sums = df.groupBy(*inner).agg(*[F.sum(m).alias(m) for m in measures])
        w = Window.partitionBy(*keys).orderBy(*order(level)).rowsBetween(Window.unboundedPreceding, -1)
        names = [f"__{m}_{depth}" for m in measures]
        sums = sums.select(
            *inner, *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(b) for m, b in zip(measures, names)]
        )
        out = out.join(sums, inner)
        bases.append(names)
        keys = inner
    w = Window.partitionBy(*keys).orderBy(*order(levels[-1])).rowsBetween(Window.unboundedPreceding, -1)
    for i, m in enumerate(measures):
        own = F.coalesce(F.sum(m).over(w), F.lit(0))
        out = out.withColumn(f"{m}__before", reduce(lambda a, b: a + b, [F.col(b[i]) for b in bases], own))
    return out.drop(*[name for names in bases for name in names])


def exact_median(df: DataFrame, part: list[str], value: str, grid: float, name: str = "median") -> DataFrame:
    """Exact median of `value` per part; equal values are counted first, then ranked grid cell by grid cell."""
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*part, F.floor(F.col(value) / grid).alias("__cell"), F.col(value).alias("__value"))
        .agg(F.count("*").alias("__n"))
    )
    totals = cells.groupBy(*part).agg(F.sum("__n").alias("__total"))
    ranked = totals_before(cells, part, [["__cell"], ["__value"]], ["__n"])
    placed = salted_join(ranked, totals, part, "__value") if part else ranked.withColumn("__total", totals.select("__total").scalar())
    before, reached, total = F.col("__n__before"), F.col("__n__before") + F.col("__n"), F.col("__total")
    holds = lambda k: F.max(F.when((before < k) & (reached >= k), F.col("__value")))
    middle = (holds(F.floor((total + 1) / 2)) + holds(F.floor(total / 2) + 1)) / 2
    return placed.groupBy(*part).agg(middle.alias(name))
