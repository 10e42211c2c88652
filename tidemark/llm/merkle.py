"""Merkle manifest of a dataset: trees of digests per group and over the groups, with a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import query, scratch, staged, table

FANOUT = 3
#: Levels that are climbed between two shuffles; FANOUT ** PASS nodes of a group stay together in a task.
PASS = 4
STEP = "struct<before:string,after:string>"


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated UTF-8 texts."""
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, step: digest(step["before"], node, step["after"]))


def siblings(path: Column) -> Column:
    """The digests of a path level by level, from left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with pos (0, 1, … within `grp`, by `order`) and n (rows of `grp`).

    Rows are dealt by ranges of (grp, order), so that a large group spreads over many tasks, and written; a row's
    place is its place in its part and the number of the group's rows in the parts before. Rows that are equal in the order
    are told apart by where they were read, so that they spread too.
    """
    by = [F.col("grp"), *order, F.col("read")]
    dealt = rows.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("read")
    dealt = staged(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "dealt")
    here = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")
    earlier = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    start = here.select("grp", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return dealt.join(start, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def climb(nodes: DataFrame, fanout: int) -> DataFrame:
    """PASS levels up from `nodes` (grp, pos, n, node, …): for every row the node above it, n of that level, and its path so far.

    At each level the conditional aggregates of a window over a parent's children spread these into `fanout` columns, one a
    slot. All columns concatenated are hashed to the parent; the columns before and after the own slot are the siblings.
    A parent's children lie in one block, so that all levels of a pass need one shuffle.
    """
    rows = nodes.withColumn("block", F.expr(f"pos div {fanout ** PASS}")).repartition("grp", "block")
    steps = []
    for level in range(PASS):
        slot = F.expr(f"(pos div {fanout ** level}) % {fanout}")
        parent = Window.partitionBy("grp", "block", F.expr(f"pos div {fanout ** (level + 1)}"))
        names = [f"slot_{k}" for k in range(fanout)]
        rows = rows.select("*", *[F.coalesce(F.max(F.when(slot == k, F.col("node"))).over(parent), F.lit("")).alias(c)
                                  for k, c in enumerate(names)])
        before = F.concat(*[F.when(slot > k, F.col(c)).otherwise("") for k, c in enumerate(names)])
        after = F.concat(*[F.when(slot < k, F.col(c)).otherwise("") for k, c in enumerate(names)])
        more = F.col("n") > fanout ** level  # else the only node is the root of its group
        steps.append(f"step_{level}")
        rows = rows.withColumns({
            steps[-1]: F.when(more, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(F.array().cast(f"array<{STEP}>")),
            "node": F.when(more, digest(*map(F.col, names))).otherwise(F.col("node")),
        }).drop(*names)
    above = F.expr(f"(n + {fanout ** PASS - 1}) div {fanout ** PASS}")
    return rows.withColumns({"path": F.concat(*steps), "n": above}).drop(*steps)


def grown(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Written passes from the leaves up to the roots of all groups; the last one has one node a group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    passes = [staged(climb(nodes, fanout), "pass")]
    while most > fanout ** PASS:
        most = -(-most // fanout ** PASS)
        heads = passes[-1].where(F.col("pos") % fanout ** PASS == 0)
        passes.append(staged(climb(heads.select("grp", F.col("block").alias("pos"), "n", "node"), fanout), "pass"))
    return passes


def manifest(docs: DataFrame, carry: list[str], columns: list[str], group: str, order: str, into: str = "merkle",
             fanout: int = FANOUT) -> DataFrame:
    """The columns `carry` of every row with a struct `into`: leaf, subroot, root, path (array of before, after).

    A row's leaf is the digest of its `columns`, nulls told from empty texts. The leaves of a group (equal values of
    `group`, null is a group of its own) stand by `order` (null first; ties by the leaf, so that repeated rows give one result in
    whatever order they come). Of `fanout` consecutive nodes the digests in a row are hashed to their parent until one node is
    left, the group's subroot; a lone leaf is that itself. The subroots, by the UTF-8 bytes of the group's name (null first), lead
    to the root in the same way. `path` has a leaf's siblings on every level: `folded(leaf, path)` is the root again. Texts are
    hashed whole, whatever their length; an empty table gives no rows; columns of `docs` may have any name but `into`.

    A leaf's text is read once; what is dealt, sorted and joined are digests. A group spreads over tasks in blocks of
    fanout ** PASS nodes; each pass up leaves that fraction of the rows, and each join down has as many rows a key. Two written
    stages stay, for the result reads them.
    """
    name = F.col(group).cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(order).alias("key"),
                       F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("grp"), leaf(*[F.col(f"`{c}`") for c in columns]).alias("node"))
    with scratch() as keep:
        leaves = numbered(rows, [F.col("key").asc_nulls_first(), F.col("node")])
        first, *later = grown(leaves.select("row", "grp", "pos", "n", "node", F.col("node").alias("leaf")), fanout)
        top = later[-1] if later else first
        # the groups are the leaves of the tree above, in which all belong to one group
        groups = top.where("pos = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node", F.col("node").alias("subroot"))
        tops = grown(numbered(groups, [F.col("name")]), fanout)
        above = tops[-1].select("*", F.col("node").alias("root"))
        for lower in reversed(tops[:-1]):
            above = down(lower, above, "root")
        above = above.select(F.col("name").alias("grp"), F.col("path").alias("upper"), F.struct("subroot", "root").alias("ends"))
        if not later:
            ends = keep(staged(above, "roots"))
        else:
            above = top.join(above, "grp").withColumn("path", F.concat("path", "upper"))
            for lower in reversed(later[:-1]):
                above = down(lower, above, "ends")
            ends = keep(staged(above.select("grp", "pos", "path", "ends"), "blocks"))
        keep(first)
    out = down(first, ends, "ends") if later else first.join(ends, "grp").withColumn("path", F.concat("path", "upper"))
    return out.select("row.*", F.struct("leaf", "ends.subroot", "ends.root", "path").alias(into))


def down(lower: DataFrame, above: DataFrame, ends: str) -> DataFrame:
    """Every row of `lower` with the path of its block's node appended to its own."""
    heads = above.select("grp", F.col("pos").alias("block"), F.col("path").alias("upper"), ends)
    return lower.join(heads, ["grp", "block"]).withColumn("path", F.concat("path", "upper"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sql_leaf(columns: list[str]) -> str:
    texts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in texts) + ")"


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    steps = f"flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split({text}, '') IF c <> ''])"
    return (f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), "
            "lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))")


SQL = f"""
WITH RECURSIVE doc AS (SELECT *, row_number() OVER () AS r,
  CASE WHEN {sql_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
leaf AS (SELECT r, doc_id, source, {sql_leaf(FIELDS)} AS leaf, {sql_leaf(FIELDS[:-1] + ["changed"])} AS tampered FROM doc),
place AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaf),
low AS (SELECT source, CAST(0 AS BIGINT) AS lvl, pos, n, leaf AS d FROM place
  UNION ALL SELECT source, lvl + 1, pos // {FANOUT}, (max(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY source, lvl, pos // {FANOUT}),
sub AS (SELECT source, lvl, d AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS spos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT CAST(0 AS BIGINT) AS lvl, spos AS pos, n, subroot AS d FROM sub
  UNION ALL SELECT lvl + 1, pos // {FANOUT}, (max(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // {FANOUT}),
low_step AS (SELECT source, lvl, pos, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM low WHERE n > 1 WINDOW w AS (PARTITION BY source, lvl, pos // {FANOUT} ORDER BY pos)),
high_step AS (SELECT lvl, pos, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // {FANOUT} ORDER BY pos)),
low_path AS (SELECT r, list(struct_pack(a := a, b := b) ORDER BY lvl) AS p FROM place JOIN low_step s
  ON place.source IS NOT DISTINCT FROM s.source AND s.pos = place.pos // CAST(pow({FANOUT}, s.lvl) AS BIGINT) GROUP BY r),
high_path AS (SELECT source, list(struct_pack(a := a, b := b) ORDER BY s.lvl) AS p FROM sub JOIN high_step s ON s.pos = sub.spos // CAST(pow({FANOUT}, s.lvl) AS BIGINT) GROUP BY source),
whole AS (SELECT place.*, subroot, (SELECT d FROM high WHERE n = 1) AS root,
  list_concat(coalesce(low_path.p, []), coalesce(high_path.p, [])) AS path FROM place LEFT JOIN low_path USING (r)
  JOIN sub ON place.source IS NOT DISTINCT FROM sub.source LEFT JOIN high_path ON place.source IS NOT DISTINCT FROM high_path.source),
fold AS (SELECT *, (list_reduce(list_concat([struct_pack(a := tampered, b := '')], path), lambda x, s: struct_pack(a := sha256(s.a || x.a || s.b), b := ''))).a AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s.a || s.b FOR s IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM fold
"""


@query("op12_merkle", SQL)
def op12(spark, sf_dir):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    docs = docs.withColumn("tampered", leaf(*map(F.col, FIELDS[:-1]), text))
    known = manifest(docs, ["doc_id", "tampered"], FIELDS, "source", "doc_id")
    return known.select(
        "doc_id", "merkle.leaf", "merkle.subroot", "merkle.root", F.sha2(siblings(F.col("merkle.path")), 256).alias("proof_sha256"),
        folded(F.col("tampered"), F.col("merkle.path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
