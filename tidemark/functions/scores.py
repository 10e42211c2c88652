"""Small numeric rules shared by all scorers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole within [0, 1]; 0 where there is no whole."""
    return F.when(whole > 0, clamp(part.cast("double") / whole.cast("double"))).otherwise(F.lit(0.0))


def weighted(terms: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(name) for name, w in terms.items()])


def risk_level(score: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def escalation(score: Column, confidence: Column, second: float = 0.4) -> Column:
    return (
        F.when((score > 0.7) & (confidence > 0.7), 1).when(score > second, 2).otherwise(3)
    )


def normalise_label(label: Column) -> Column:
    return F.translate(F.lower(F.trim(label)), "- ", "__")


def _units_sql(value: str, digits: int) -> str:
    """|value| in units of 10^-digits, rounded on the exact binary value, ties to even.

    Spark's own round() looks at the shortest decimal text of a double, which turns
    0.0375 (really a little less) into 0.038. The fraction times 2^62 is an exact
    long; the rest is integer arithmetic on two 31-bit halves. The inner arrays
    only give names to intermediate values.
    """
    unit, mask, half = 10**digits, 2**31 - 1, 2**61
    parts = f"array(struct(floor(abs({value})) AS whole, cast((abs({value}) - floor(abs({value}))) * {float(2**62)!r}D AS bigint) AS bits))"
    low = f"transform({parts}, x -> struct(x.whole AS whole, shiftright(x.bits, 31) AS hi, (x.bits & {mask}L) * {unit} AS lo))"
    high = f"transform({low}, x -> struct(x.whole AS whole, x.hi * {unit} + shiftright(x.lo, 31) AS hi, x.lo & {mask}L AS lo))"
    split = (f"transform({high}, x -> struct(x.whole * {unit} + shiftright(x.hi, 31) AS units, "
             f"shiftleft(x.hi & {mask}L, 31) + x.lo AS rest))")
    up = f"CASE WHEN x.rest > {half}L THEN 1 WHEN x.rest = {half}L THEN x.units % 2 ELSE 0 END"
    return f"transform({split}, x -> x.units + {up})[0]"


def fixed3_sql(value: str) -> str:
    units = f"array({_units_sql(value, 3)})"
    return (f"transform({units}, u -> concat(CASE WHEN {value} < 0 THEN '-' ELSE '' END, "
            f"cast(u div 1000 AS string), '.', lpad(cast(u % 1000 AS string), 3, '0')))[0]")


def _units(value: Column, digits: int) -> Column:
    """`_units_sql` on a Column: the column gets a name inside a one-element array."""
    return F.transform(F.array(value.cast("double")), lambda v: _units_of(v, digits))[0]


def _units_of(v: Column, digits: int) -> Column:
    v = F.abs(v)
    whole = F.floor(v)
    bits = ((v - whole) * float(2**62)).cast("bigint")
    mask, unit = F.lit(2**31 - 1).cast("bigint"), 10**digits
    low = bits.bitwiseAND(mask) * unit
    high = F.shiftright(bits, 31) * unit + F.shiftright(low, 31)
    rest = F.shiftleft(high.bitwiseAND(mask), 31) + low.bitwiseAND(mask)
    half = F.lit(2**61).cast("bigint")
    total = whole * unit + F.shiftright(high, 31)
    return total + F.when(rest > half, 1).when(rest == half, total % 2).otherwise(0)


def round_exact(value: Column, digits: int) -> Column:
    units = _units(value, digits) / float(10**digits)
    return F.when(value < 0, -units).otherwise(units)


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, as printf gives it."""
    units = _units(value, digits)
    sign = F.when(value < 0, "-").otherwise("")
    if digits == 0:
        return F.concat(sign, units.cast("string"))
    scale = 10**digits
    return F.concat(sign, F.floor(units / scale).cast("string"), F.lit("."),
                    F.lpad((units % scale).cast("string"), digits, "0"))


def percent(share: Column) -> Column:
    return F.concat(fixed(share * 100, 0), F.lit("%"))


# The same rules as SQL text. A job with hundreds of columns builds its plan many
# times faster from a few expressions than from thousands of Column calls.

def clamp_sql(value: str) -> str:
    return f"greatest(0D, least(1D, {value}))"


def ratio_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {clamp_sql(f'cast({part} AS double) / ({whole})')} ELSE 0D END"


def weighted_sql(terms: dict[str, float]) -> str:
    return " + ".join(f"({weight!r}D) * {name}" for name, weight in terms.items())


def level_sql(score: str, high: float = 0.7, medium: float = 0.4) -> str:
    return f"CASE WHEN {score} >= {high!r}D THEN 'high' WHEN {score} >= {medium!r}D THEN 'medium' ELSE 'low' END"
