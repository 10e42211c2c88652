"""Sharding, exact, near, substring and line dedup against plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_cases import LONG_LINE, TEXTS, documents, key, none
from pyspark.sql import functions as F

from conftest import SMALL
from tidemark.llm import catalog, common, exact_dedup, line_dedup, sharding, simhash, substring_dedup


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.configure(spark)


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


# --- sharding


def test_shards_differ_by_one_row_at_most_and_slots_have_no_gaps(spark):
    docs = documents(spark, TEXTS * 20)
    out = sharding.shard(docs, F.octet_length("text"), 7, bucket_bytes=20_000)
    assert out.columns == [*docs.columns, "place"]
    rows = out.select("doc_id", "text", "place.shard", "place.slot").collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(TEXTS * 20)
    # equal rows spread over the shards
    assert len({r.shard for r in rows if r.text == "Hello world"}) >= 5


def test_a_task_holds_few_buckets_however_many_there_are(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    rows, n, buckets = sharding.shuffled(docs, F.octet_length("text"), bucket_bytes=4_000)
    assert (n, buckets) == (4_000, 100) and rows.select("bucket").distinct().count() == 100
    held = rows.groupBy(F.input_file_name().alias("file")).agg(F.countDistinct("bucket").alias("n")).collect()
    assert len(held) > 40 and max(r.n for r in held) <= 8  # 4 partitions are the session's default


def test_shards_of_nothing_and_of_few_rows(spark):
    assert sharding.shard(none(spark), F.octet_length("text"), 5).count() == 0
    few = sharding.shard(documents(spark, TEXTS[:3]), F.octet_length("text"), 5).select("place.shard", "place.slot").collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_sharding_joins_offsets_where_they_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", 0)
    rows = sharding.shard(documents(spark), F.octet_length("text"), 4, bucket_bytes=5_000).select("place.*").collect()
    assert len({tuple(r) for r in rows}) == len(TEXTS)


def test_shards_are_written_as_folders(spark, tmp_path):
    sharding.write_shards(documents(spark).select("doc_id", "text"), str(tmp_path / "out"), F.octet_length("text"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3} and back.count() == len(TEXTS)


def test_sharding_query(spark, small):
    rows = catalog.QUERIES["op1_sharding"](spark, SMALL).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == \
        sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in small)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert {n for n in Counter(r.shard for r in rows).values()} == {len(small) // 40}


# --- exact copies


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(g)[3], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, _, i in g), key=key)


@pytest.mark.parametrize("cases", ["odd", "table"])
def test_exact_copies(spark, small, cases):
    rows = TEXTS if cases == "odd" else small
    out = exact_dedup.mark_copies(documents(spark, rows), ["doc_id", "uid", "digest"])
    assert out.columns == ["doc_id", "uid", "digest", "copy"]
    got = out.select("doc_id", "copy.*").collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=key) == plain_exact(rows)
    kept = Counter(r.digest for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.digest for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_copies_of_nothing(spark):
    assert exact_dedup.mark_copies(none(spark), ["doc_id"]).count() == 0
    assert exact_dedup.drop_copies(none(spark)).columns == none(spark).columns


def test_cuckoo_index_inserts_deletes_and_grows():
    index, rng = exact_dedup.CuckooIndex(buckets=2), random.Random(1)
    live = {}
    for step in range(6_000):
        digest = hashlib.sha256(str(rng.randrange(2_500)).encode()).hexdigest()
        found = index.find(digest)
        assert (found and found[1]) == live.get(digest)
        if found is None:
            index.insert(digest, step)
            live[digest] = step
        elif step % 3 == 0:
            assert index.delete(digest)
            del live[digest]
    assert {d: p for d, p in index.entries()} == live and index.live == len(live) and index.mask > 256
    assert not index.delete("0" * 64)


def test_cuckoo_index_verifies_digests_with_one_fingerprint():
    index = exact_dedup.CuckooIndex()
    index.insert("a" * 64, 1)
    assert index.find("a" * 16 + "b" * 48) is None


def test_index_takes_later_changes(spark):
    first = lambda i: (-5, False, i, i)
    kind = exact_dedup.DIGEST.format(id="bigint")
    index = exact_dedup.update_index(spark.createDataFrame([("aa" * 32, 2, first(1)), ("bb" * 32, 1, first(3))], kind))
    index = exact_dedup.update_index(spark.createDataFrame([("aa" * 32, -1, None), ("bb" * 32, -1, None), ("cc" * 32, 1, first(4))], kind), index)
    assert sorted((r.digest[:2], r.n, r["first"]["id"]) for r in index.collect()) == [("aa", 1, 1), ("cc", 1, 4)]


# --- near copies


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, distance):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return root


def plain_near(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps, 4)
    small = {r: min((i for (i, _), s in zip(rows, root) if s == r and i is not None), default=None) for r in root}
    return sorted(((i, f"{fp:016x}", small[r]) for (i, _), fp, r in zip(rows, fps, root)), key=key)


@pytest.mark.parametrize("cases", ["odd", "table"])
def test_near_copies(spark, small, cases):
    words = "the quick brown fox jumps over a lazy dog and runs away from all of this noise here tonight".split() * 9
    near = [(100 + k, " ".join([*words[:k], "changed", *words[k + 1:]])) for k in range(0, 160, 9)]
    rows = TEXTS + near if cases == "odd" else small
    out = simhash.mark_near_copies(documents(spark, rows), ["doc_id", "fp"])
    assert out.columns == ["doc_id", "fp", "near"]
    got = out.select("doc_id", F.lpad(F.lower(F.hex("near.fp")), 16, "0").alias("x"), "near.component_id", "near.kept").collect()
    want = plain_near(rows)
    assert sorted(((r.doc_id, r.x, r.component_id) for r in got), key=key) == want
    assert cases == "table" or len({w[2] for w in want if w[0] and w[0] >= 100}) < len(near)
    assert sum(r.kept for r in got) == len({w[2] if w[2] is not None else w[1] for w in want})


def test_near_copies_of_nothing(spark):
    assert simhash.mark_near_copies(none(spark), ["doc_id"]).count() == 0


@pytest.mark.parametrize("chunk,mean", [(4_096, 64), (8, 64), (4_096, 0.001)])
def test_links_connect_what_near_pairs_connect(spark, monkeypatch, chunk, mean):
    monkeypatch.setattr(simhash, "CHUNK", chunk)  # buckets compared chunk by chunk
    if mean < 1:
        monkeypatch.setattr(simhash, "masks", lambda n, d, own=simhash.masks: own(7, d))  # more and longer keys
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 30)]
    for x in list(fps):
        for _ in range(rng.integers(0, 9)):
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    links = simhash.near_links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"))
    roots = {r.node: r.root for r in common.components(links).collect()}
    got = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    want = plain_components(fps, 4)
    assert len(set(want)) < len(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, k) for k in range(200, 260)] + [(7, 7), (200, 7)]
    out = common.components(spark.createDataFrame(chain + star, "a long, b long")).collect()
    assert {r.node: r.root for r in out} == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}
    assert len(out) == 61 + 61
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated strings


def plain_cut(rows, length=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k:k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone, until = [], 0
        for k in range(len(b)):
            if k + length <= len(b) and times[b[k:k + length]] > 1:
                until = k + length
            gone.append(k < until)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def cut(docs):
    out = substring_dedup.cut_repeats(docs, ["doc_id", "h"])
    assert out.columns == ["doc_id", "h", "cut"]
    rows = out.select("doc_id", "cut.n_bytes", "cut.n_removed", F.size("cut.spans").alias("s"), F.sha2("cut.kept", 256).alias("k")).collect()
    return sorted((tuple(r) for r in rows), key=key)


def overlapping():
    """Passages that overlap, at the ends of texts, with small changes, and texts made of one passage."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2_000))
    rows = [(1, base)]
    for k in range(2, 40):
        a, n = rng.randrange(1_700), rng.randrange(150, 320)
        rows.append((k, "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + base[a:a + n] + "".join(rng.choice("uvw") for _ in range(rng.randrange(90)))))
    return [*rows, (40, base[:200]), (41, base[-200:]), (42, base[100:299]), (43, base[300:700] + base[500:900])]


@pytest.mark.parametrize("cases", ["odd", "table", "overlapping"])
def test_repeated_strings(spark, small, cases):
    rows = {"odd": TEXTS, "table": small, "overlapping": overlapping()}[cases]
    assert cut(documents(spark, rows)) == plain_cut(rows)


def test_repeated_strings_in_large_buckets_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 2)
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    rows = TEXTS + [(100 + i, t) for i, t in overlapping()]
    assert cut(documents(spark, rows)) == plain_cut(rows)


def test_repeated_strings_of_nothing(spark):
    assert cut(none(spark)) == []


# --- repeated lines


def plain_lines(rows):
    keys = lambda t: [re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x) for x in (t or "").split("\n")]
    lower = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x)
    held = defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            held[lower(k)].add(i)
    out = []
    for i, t in rows:
        drop = lambda k: len(k) >= 20 and len(held[k]) >= 3 and i != max((x for x in held[k] if x is not None))
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if not drop(lower(k))]
        n = len((t or "").split("\n"))
        out.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("cases,batches", [("odd", 4), ("odd", 1), ("table", 5)])
def test_repeated_lines(spark, small, cases, batches):
    more = [(None, f"{LONG_LINE}\nand its own line of this one"), (30, "É" * 25), (31, "É" * 25 + "\n"), (32, "é" * 25), (33, " " + "É" * 25),
            (34, f"{LONG_LINE}"), (34, f"{LONG_LINE}\nanother text of one id")]
    rows = TEXTS + more if cases == "odd" else small
    out = line_dedup.drop_repeated_lines(documents(spark, rows), ["doc_id", "pos", "key"], batches=batches)
    assert out.columns == ["doc_id", "pos", "key", "lines"]
    got = out.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256)).collect()
    assert sorted((tuple(r) for r in got), key=key) == plain_lines(rows)


def test_repeated_lines_of_nothing(spark):
    assert line_dedup.drop_repeated_lines(none(spark), ["doc_id"]).count() == 0


def test_runs_tell_new_hashes_and_compact(spark):
    runs = line_dedup.Runs(spark, fanout=2)
    batch = lambda *rows: spark.createDataFrame(list(rows), "ha long, hb long, n_docs long, keeper long")
    assert runs.add(batch((1, 1, 2, 50), (2, 2, 1, 51))).count() == 2
    assert [tuple(r) for r in runs.add(batch((1, 1, 1, 40), (3, 3, 1, 41))).collect()] == [(3, 3, 1, 41)]
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.add(batch((3, 3, 5, 30)))
    total = sorted(tuple(r) for r in runs.merged(runs.all()).collect())
    assert total == [(1, 1, 3, 50), (2, 2, 1, 51), (3, 3, 6, 41)]


def test_indexes_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "INDEX_ROWS", 100)
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), (F.col("id") % 1_500).cast("string").alias("text"))
    marked = exact_dedup.mark_copies(docs, ["doc_id"])
    assert sum(r.copy.kept for r in marked.collect()) == 1_500
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 20)" in plan
