"""Merkle manifests against trees built node by node."""

import hashlib
import zlib

import pytest
from llm_cases import CLASHING, TEXTS, documents, key, none
from pyspark.sql import functions as F

from conftest import SMALL
from tidemark.llm import common, merkle


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.configure(spark)


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout=3):
    """The root and every node's siblings, level by level."""
    above = [[i] for i in range(len(nodes))]  # the leaves below a node
    path = [[] for _ in nodes]
    while len(nodes) > 1:
        grown, over = [], []
        for k in range(0, len(nodes), fanout):
            run = nodes[k:k + fanout]
            for j in range(len(run)):
                for i in above[k + j]:
                    path[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            grown.append(h(*run))
            over.append(sum(above[k:k + fanout], []))
        nodes, above = grown, over
    return (nodes or [None])[0], path


def plain_manifest(rows, columns, group, order, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[group], []).append((r[order] is not None, r[order] or 0, plain_leaf([r[c] for c in columns])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for *_, leaf in sorted(groups[g])], fanout) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops):
        for (known, place, leaf), path in zip(sorted(groups[g]), trees[g][1]):
            out.append((place if known else None, leaf, trees[g][0], root, path + top))
    return out


def got(docs, columns, group, order="doc_id", **options):
    out = merkle.manifest(docs, [order, "row"] if "row" in docs.columns else [order], columns, group, order, **options)
    assert out.columns[-1] == "merkle"
    return [(r[order], r.merkle.leaf, r.merkle.subroot, r.merkle.root, [tuple(s) for s in r.merkle.path])
            for r in out.collect()], out


@pytest.mark.parametrize("levels, fanout", [(4, 3), (1, 3), (2, 2), (1, 7)])
def test_odd_rows(spark, monkeypatch, levels, fanout):
    monkeypatch.setattr(merkle, "PASS", levels)
    docs = documents(spark, TEXTS * 3).withColumn("source", F.element_at(F.array(F.lit(None), F.lit(""), F.lit("é"), F.lit("=")), (F.coalesce("doc_id", F.lit(0)) % 4 + 1).cast("int")))
    rows = docs.collect()
    for columns, group in ((["doc_id", "text", "uid"], "source"), (["text"], "row")):
        found, out = got(docs, columns, group, fanout=fanout)
        assert sorted(found, key=key) == sorted(plain_manifest(rows, columns, group, "doc_id", fanout), key=key)
        checked = out.select(merkle.folded(F.col("merkle.leaf"), F.col("merkle.path")).alias("r"), "merkle.root").collect()
        assert all(r.r == r.root for r in checked)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 28, 82])
def test_sizes(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source")).repartition(3)
    assert sorted(got(docs, ["doc_id"], "source")[0]) == sorted(plain_manifest(docs.collect(), ["doc_id"], "source", "doc_id"))


def test_many_groups(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 100).cast("string").alias("source"))
    assert sorted(got(docs, ["doc_id"], "source")[0]) == sorted(plain_manifest(docs.collect(), ["doc_id"], "source", "doc_id"))


def test_a_null_is_no_empty_text_and_no_rows_are_no_rows(spark):
    two = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string").select(merkle.leaf(F.col("doc_id"), F.col("text"))).collect()
    assert two[0] != two[1] and two[1][0] == h("1:1", "0:")
    assert merkle.manifest(none(spark), ["doc_id", *CLASHING], ["text"], "row", "doc_id").count() == 0


def test_the_query_finds_what_was_tampered_with(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in common.QUERIES["op12_merkle"](spark, SMALL).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (docs[r.doc_id] or "")
        assert r.verified is not changed


def test_a_group_spreads_over_tasks(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source")).repartition(4)
    leaves = merkle.numbered(docs.select(F.lit("").alias("grp"), "doc_id"), [F.col("doc_id")])
    assert [r.pos for r in leaves.orderBy("doc_id").collect()] == list(range(30_000))
    here = merkle.climb(leaves.withColumn("node", merkle.leaf(F.col("doc_id"))), 3)
    assert here._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in here.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and sizes[-1] < 10_000
