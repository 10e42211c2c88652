"""Allow and block rules for URLs: a trie over reversed host labels and path segments, the longest matching rule decides."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import query, table

#: UTF-8 bytes of all rules together up to which they are broadcast as a trie (about 15 times that in a worker's memory).
TRIE_BYTES = 8_000_000
#: Verdict on a URL that no rule fits.
OTHERWISE = "allow"

#: Fixed rules of the query: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty if there is none."""
    start = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, start + 3), "^[^/?#]*", 0)
    return F.coalesce(F.when(start > 0, lower(rest)), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to `?`, `#` or the end; empty if there is none."""
    start = F.instr(url, "://")
    return F.coalesce(F.when(start > 0, F.regexp_extract(F.substr(url, start + 3), "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class PathNode:
    """Rules whose path goes on here: whole segments lead to `parts`; `ends` has the beginning of a segment where a rule ends."""

    __slots__ = ("parts", "ends", "lengths")

    def __init__(self) -> None:
        self.parts: dict[str, PathNode] = {}
        self.ends: dict[str, tuple] = {}
        self.lengths: list[int] = []


class HostNode:
    __slots__ = ("labels", "paths")

    def __init__(self) -> None:
        self.labels: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


def build_trie(rules: list[tuple[str, str, str]]) -> HostNode:
    """Rules are distinct in (host, path). Each ends as (length, length of its host, rule, verdict)."""
    root = HostNode()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".") if host else []):
            node = node.labels.setdefault(label, HostNode())
        node.paths = node.paths or PathNode()
        *whole, last = path.split("/")
        at = node.paths
        for segment in whole:
            at = at.parts.setdefault(segment, PathNode())
        at.ends[last] = (len(host) + len(path), len(host), host + path, verdict)
        if len(last) not in at.lengths:
            at.lengths.append(len(last))
    return root


def longest_match(root: HostNode, host: str, path: str) -> tuple | None:
    """The rule with the greatest (length, length of its host) among those on the way down."""
    segments, best, node = path.split("/"), None, root
    labels = iter(reversed(host.split(".")))
    while node is not None:
        at = node.paths
        for segment in segments if at is not None else ():
            for n in at.lengths:
                rule = at.ends.get(segment[:n]) if n <= len(segment) else None
                if rule is not None and (best is None or rule[:2] > best[:2]):
                    best = rule
            at = at.parts.get(segment)
            if at is None:
                break
        label = next(labels, None)
        node = None if label is None else node.labels.get(label)
    return best


def matcher(spark, rules: list[tuple[str, str, str]]):
    shared = spark.sparkContext.broadcast(rules)
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        trie = build_trie(shared.value)
        for hosts, paths in batches:
            found = [longest_match(trie, h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            yield pa.array([None if f is None else {"rule": f[2], "verdict": f[3]} for f in found], kind)

    return match


def match_by_joins(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (host, path, distinct) with a struct `found` (rule, verdict; null if none fits), for rules of any number.

    A host meets the rules of its suffixes, first only the lengths of their paths, then the rules themselves by the
    path's beginning of that length. One side of each join has one row a key, so Spark may split the other one.
    """
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(labels, k + 1, n), "."))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).withColumnRenamed("host", "suffix")
    met = urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(lengths, "suffix")
    met = met.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda k: k <= F.length("path"))).alias("k"))
    met = met.withColumn("start", F.substr("path", F.lit(1), F.col("k")))
    fits = met.join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict"), ["suffix", "start"])
    rule = F.struct(F.concat("suffix", "start").alias("rule"), "verdict")
    order = F.struct(F.length(F.concat("suffix", "start")), F.length("suffix"))
    best = fits.groupBy("host", "path").agg(F.max_by(rule, order).alias("found"))
    return urls.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", into: str = "judged", otherwise: str = OTHERWISE,
               trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """`pages` with a struct column `into`: host, path, rule (host and path of the rule that decides, null if none fits), verdict.

    `rules` has the columns host, path and verdict (allow or block; anything else is refused). A rule fits its host
    and all subdomains if the URL's path starts with the rule's; an empty host fits every host. The longest rule
    (host and path in characters) wins, at equal length the one with the longer host; block wins if a rule is there twice. Rules' hosts
    count in lower case; a null host or path is empty. URLs without `://` and null ones have an empty host and path; only a rule
    without a host may fit them. What no rule fits gets the verdict `otherwise`.

    Rules of `trie_bytes` at most are broadcast as one trie and every URL walks it where it lies: no shuffle. More rules
    than that are never collected: distinct URLs are joined with them (`match_by_joins`), with the same results. Rows are independent:
    repeated rows get equal verdicts, an empty table gives no rows, long URLs are read whole. Columns may have any name but `into`.
    """
    spark = pages.sparkSession
    plain = rules.select(lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    known = F.col("verdict").isin("allow", "block")
    size, odd = plain.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 8), F.count_if(~F.coalesce(known, F.lit(False)))).first()
    if odd:
        raise ValueError(f"{odd} rules are neither allow nor block")
    plain = plain.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    if (size or 0) <= trie_bytes:
        found = matcher(spark, [tuple(r) for r in plain.collect()])(host, path)
        rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"), found.alias("found"))
    else:
        rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
        rows = rows.join(match_by_joins(rows.select("host", "path").distinct(), plain), ["host", "path"])
    verdict = F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict")
    return rows.select("row.*", F.struct("host", "path", "found.rule", verdict).alias(into))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """The rows whose URL is allowed, with their columns."""
    return judge_urls(pages, rules, url, "__judged", otherwise).where("__judged.verdict = 'allow'").drop("__judged")


SQL = f"""
WITH rule (rh, rp, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
cut AS (SELECT row_number() OVER () AS r, page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
page AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM page, rule WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, '{OTHERWISE}') AS verdict FROM page LEFT JOIN fits USING (r)
"""


@query("op13_url_filters", SQL)
def op13(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "judged.*")
