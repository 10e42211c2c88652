"""Text columns: normal forms, tokens, markers, hosts, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Whitespace as a Unicode-aware engine sees it; spelled out because Java's \s is ASCII only.
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
# The same without a test of every range for each letter, which none of them is.
_SPACES = rf"[\P{{L}}&&[{SPACE}]]+"
_URL_OR_NON_WORD = rf"https?://[^{SPACE}]+|[\P{{L}}&&[^\p{{N}}_@]]+"
_NON_WORDS = r"[\P{L}&&[^\p{N}]]+"


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def words_of_lowered(lowered: Column) -> Column:
    """Words of a lowered text; links and everything but letters, digits, _ and @ separate them."""
    return F.filter(F.split(F.regexp_replace(lowered, _URL_OR_NON_WORD, " "), " ", -1), lambda w: w != "")


def words(text: Column) -> Column:
    return words_of_lowered(F.lower(F.coalesce(text, F.lit(""))))


def normalise(text: Column) -> Column:
    return F.array_join(words(text), " ")


def strict_of_lowered(lowered: Column) -> Column:
    return collapse_spaces(F.regexp_replace(lowered, rf"[\P{{L}}&&[^\p{{Nd}}{SPACE}]]+", ""))


def normalise_strict(text: Column) -> Column:
    """Lower case, letters and digits only, other characters deleted, spaces collapsed."""
    return strict_of_lowered(F.lower(F.coalesce(text, F.lit(""))))


def _is_token(w: Column) -> Column:
    return (F.length(w) > 2) & ~F.startswith(w, F.lit("@"))


def tokens(word_list: Column) -> Column:
    """Distinct words longer than two characters that are not mentions."""
    return F.array_distinct(F.filter(word_list, _is_token))


def token_ids(word_list: Column) -> Column:
    """`tokens` as 64-bit ids: half the shuffle bytes, and set operations on longs."""
    return F.array_distinct(F.transform(F.filter(word_list, _is_token), lambda w: F.xxhash64(w)))


def contains_any(lowered: Column, markers: list[str]) -> Column:
    # a marker with another one inside finds nothing that the other does not find
    least = [m for m in dict.fromkeys(markers) if not any(o != m and o in m for o in markers)]
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(m)) for m in least])


def marker_hits(lowered: Column, markers: list[str]) -> Column:
    """How many of the markers occur at least once."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(m)).cast("int") for m in markers])


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def leads_with(lowered: Column, prefixes: list[str]) -> Column:
    """Whether the stripped text starts with one of the prefixes, without stripping its end.

    A prefix that ends in a space needs something after it, or stripping would have cut it.
    """
    tests = [rf"\Q{p}\E" + (f"[{SPACE}]*[^{SPACE}]" if p.endswith(" ") else "") for p in prefixes]
    return lowered.rlike(rf"\A[{SPACE}]*(?:{'|'.join(tests)})")


def strip_tags(text: Column) -> Column:
    """Drop everything from '<' to the next '>' (or the end), then stray '>'."""
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>?", ""), ">", "")


def strip_space(text: Column) -> Column:
    # looked for from both ends, not at every space inside
    return F.regexp_extract(text, rf"(?s)\A[{SPACE}]*(.*[^{SPACE}])?[{SPACE}]*\z", 1)


def has_text(text: Column) -> Column:
    """Whether something is left when the white space is stripped."""
    return text.rlike(f"[^{SPACE}]")


def net_location(url: Column) -> Column:
    """What stands between '//' and the path: host, port and user part; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def host_name(url: Column) -> Column:
    """Host without user part and port."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def mention_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("@[A-Za-z0-9_]+"))


def is_present(value: Column) -> Column:
    """Identifier columns: neither null nor one of the spellings of 'nothing'."""
    return F.coalesce(~F.lower(F.trim(value.cast("string"))).isin("", "0", "null", "nan"), F.lit(False))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "t", "yes"), F.lit(False))


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def title_of(text: Column, limit: int = 240) -> Column:
    return F.substring(strip_space(text), 1, limit)


def upper_share(text: Column) -> Column:
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    return letters / F.greatest(F.lit(1), F.length(text))


def trigrams(text: Column) -> Column:
    """Distinct padded three-letter pieces of every word."""
    words = F.array_distinct(
        F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ", -1), lambda w: w != "")
    )
    padded = F.concat(F.lit("  "), F.array_join(words, "  "), F.lit(" "))
    # the pieces of "  word ": its first letter after two spaces, and each letter between its neighbours
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=(  [^ ]|.[^ ].))"), F.lit(1)))
