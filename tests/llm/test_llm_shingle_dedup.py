"""Near copies by the similarity of five-word shingles against all pairs."""

import random

import pytest
from llm_cases import TEXTS, documents, key, none

import corpus_pipeline
from tidemark.llm import common, shingle_dedup, simhash


def plain_sets(texts):
    out = []
    for text in texts:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        out.append({b" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    return out


def plain_similar(rows):
    """(doc_id, smallest doc_id of what similar pairs connect)."""
    sets = plain_sets([t for _, t in rows])
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    small = {r: min((i for (i, _), s in zip(rows, root) if s == r and i is not None), default=None) for r in root}
    return sorted(((i, small[r]) for (i, _), r in zip(rows, root)), key=key), len(set(root))


def edited():
    """Texts of 100 words with one to five words changed: similarities on both sides of 0.8."""
    dice = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{dice.randrange(10_000)}" for _ in range(100)]
        for k in range(6):
            own = list(words)
            for at in dice.sample(range(100), k):
                own[at] = f"new{dice.randrange(10_000)}"
            rows.append((1000 + len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("part", [4_000_000, 2_000])
def test_similar_texts(spark, monkeypatch, part):
    monkeypatch.setattr(shingle_dedup, "PART_BYTES", part)
    common.configure(spark)
    rows = TEXTS + edited()
    out = shingle_dedup.mark_similar(documents(spark, rows), ["doc_id", "fp"])
    assert out.columns == ["doc_id", "fp", "near"]
    got = out.select("doc_id", "near.component_id", "near.kept").collect()
    want, groups = plain_similar(rows)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == want
    assert sum(r.kept for r in got) == groups


def test_the_stage_drops_copies_beyond_four_bits(spark):
    rows = edited()
    sets = plain_sets([t for _, t in rows])
    far = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
           and ((simhash.fingerprint(rows[i][1].encode()) ^ simhash.fingerprint(rows[j][1].encode())) & (2**64 - 1)).bit_count() > simhash.DISTANCE]
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, documents(spark, rows), "").collect()}
    assert far and not any(rows[i][0] in kept and rows[j][0] in kept for i, j in far)
    assert len(kept) == plain_similar(rows)[1]


def test_similar_texts_of_nothing(spark):
    assert shingle_dedup.mark_similar(none(spark), ["doc_id"]).count() == 0


def group(n, changed):
    """Copies of one text, each with other words changed: none is in the table itself."""
    dice = random.Random(n + changed)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(n):
        own = list(words)
        for at in dice.sample(range(150), changed):
            own[at] = f"new{dice.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("changed", [1, 2, 3])
def test_rows_grow_with_a_group_not_with_its_pairs(spark, monkeypatch, changed):
    """Links that leave the tasks, over all bands and pairs of parts, for groups of which some, many or no pairs are similar."""
    made = []
    plain = shingle_dedup.connecting
    for n in (60, 240):
        rows = group(n, changed)
        sets = [shingle_dedup.shingles(t.encode()) for _, t in rows]
        links = plain(sets, list(range(n)), range(n), range(n), 0.8)
        made.append(len(links))
        groups = {i: i for i in range(n)}
        for i, j in links:
            a, b = groups[i], groups[j]
            assert a != b  # connects what was apart
            groups = {k: a if g == b else g for k, g in groups.items()}
        want = dict(plain_similar(rows)[0])
        assert {frozenset(k for k in groups if groups[k] == g) for g in groups.values()} == {frozenset(k for k in want if want[k] == c) for c in want.values()}
    assert made[0] < 60 and made[1] < 240
    out = shingle_dedup.mark_similar(documents(spark, rows), ["doc_id"]).collect()
    assert {r.doc_id: r.near.component_id for r in out} == want


def test_stages_are_removed(spark):
    import os

    common.configure(spark)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    out = shingle_dedup.mark_similar(documents(spark, edited()), ["doc_id"])
    assert sorted(n.split("-")[0] for n in set(os.listdir(folder)) - before) == ["decided", "sketches"]
    assert out.count() == 72
