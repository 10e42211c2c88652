import datetime as dt

import pytest

from pyspark.sql import functions as F

from tidemark.operators import post_analysis as P, similarity as S
from tidemark.functions import text as X
from tidemark.functions.scores import escalation


def test_sample_texts_fire(spark):
    texts = [
        (1, "Срочно! Распространите эту новость, все должны узнать правду прямо сейчас!"),
        (2, "Городские службы сообщили о плановом ремонте дороги на центральной улице."),
        (3, "Срочно! Репост, скрывают правду, расскажите всем пока не удалили."),
    ]
    rows = {r.post_id: r for r in P.lexicon_scores(spark.createDataFrame(texts, "post_id int, content string")).collect()}
    assert rows[1].temporal_contribution == 1.0 and rows[2].manipulation_score == 0.0
    assert rows[3].coordination_contribution == 0.667 and rows[2].confidence_score == 0.5
    assert rows[2].key_evidence == ["Выраженных манипулятивных маркеров не обнаружено"]


def test_escalation_is_strict(spark):
    rows = [(0.7, 0.9), (0.71, 0.7), (0.71, 0.71), (0.4, 0.9), (0.41, 0.1)]
    got = [r[0] for r in spark.createDataFrame(rows, "s double, c double").select(escalation(F.col("s"), F.col("c"))).collect()]
    assert got == [2, 2, 1, 3, 2]


def test_tags_are_stripped(spark):
    rows = [("a<b>c</b>d",), ("x < y",), ("p>q",), ("a<b<c>d",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.strip_tags(F.col("t"))).collect()]
    assert got == ["acd", "x ", "pq", "ad"]


def test_long_runs_of_punctuation(spark):
    df = spark.createDataFrame([("a" + "!" * 200_000 + "b http://x.example/" + "y" * 100_000,)], "t string")
    assert df.select(X.normalise(F.col("t"))).first()[0] == "a b"


def test_similar_posts_against_brute_force(spark):
    base = dt.datetime(2024, 1, 1)
    texts = ["red green blue sky over water", "red green blue sky over water today", "nothing in common here at all", "red green blue sky over water"]
    posts = spark.createDataFrame([(i, i % 3, base + dt.timedelta(minutes=i), t) for i, t in enumerate(texts)],
                                  "post_id bigint, account_id bigint, published_at timestamp, content string")
    got = {(r.post_id, r.similar_post_id) for r in S.similar_posts(posts).collect()}
    assert (0, 3) in got and (3, 0) in got and (0, 0) not in got
    assert not any(2 in pair for pair in got)
    network = {r.post_id: r.unique_accounts for r in S.coordination_network(S.similar_posts(posts), posts).collect()}
    assert network[0] >= 1


def test_similar_posts_in_clusters_against_all_pairs(spark):
    """500 texts: two clusters of near-equal ones, chains, copies and texts on their own, with every cosine worked out plainly."""
    import math
    import random
    from collections import Counter

    dice = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for size, changed in ((120, 1), (120, 6), (60, 3)):
        base = dice.choices(words, k=40)
        for _ in range(size):
            own = list(base)
            for at in dice.sample(range(40), changed):
                own[at] = dice.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(dice.choices(words, k=dice.randrange(2, 30))) for _ in range(170)] + texts[:30]
    base = dt.datetime(2024, 1, 1)
    posts = spark.createDataFrame([(i, i % 7, base, t) for i, t in enumerate(texts)], "post_id bigint, account_id bigint, published_at timestamp, content string")
    grams = []
    for t in texts:
        w = t.split()
        grams.append(Counter(w + [" ".join(w[i:i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]))
    df = Counter(g for c in grams for g in c)
    vectors = []
    for c in grams:
        raw = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors.append({g: v / norm for g, v in raw.items()})
    got = {}
    for r in S.similar_posts(posts).collect():
        got.setdefault(r.post_id, []).append((r.rank, r.similar_post_id, r.similarity))
    for i, v in enumerate(vectors):
        near = []
        for j, u in enumerate(vectors):
            cosine = 1.0 if texts[i] == texts[j] else round(sum(w * u.get(g, 0) for g, w in v.items()), 6)
            if i != j and cosine > 0.7:
                near.append((-cosine, -j))
        want = [(-c, -j) for c, j in sorted(near)[:10]]
        found = [(c, j) for _, j, c in sorted(got.get(i, []))]
        assert [c for c, _ in found] == pytest.approx([c for c, _ in want], abs=2e-6)
        least = want[-1][0] if want else 0
        assert {j for c, j in found if c > least + 2e-6} == {j for c, j in want if c > least + 2e-6}


def test_trigrams_of_a_word(spark):
    df = spark.createDataFrame([("Cat, cat!",)], "t string")
    assert sorted(df.select(X.trigrams(F.col("t"))).first()[0]) == sorted(["  c", " ca", "cat", "at "])


def test_trigram_matches_of_many_targets(spark):
    import random

    dice = random.Random(8)
    words = ["cat", "dogs", "bird", "a", "mouse", "elephant", "catfish", ""]
    texts = [" ".join(dice.choices(words, k=dice.randrange(5))) for _ in range(60)] + [None, "!!"]
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, content string")
    targets = posts.where("post_id % 3 = 0 OR content IS NULL").withColumnRenamed("post_id", "target_id")

    def grams(text):
        return {f"  {w} "[i:i + 3] for w in (text or "").split() for i in range(len(w) + 1)} if text != "!!" else set()

    want = {}
    for i, t in enumerate(texts):
        if (i % 3 == 0 or t is None) and grams(t):
            near = sorted((-len(grams(t) & grams(u)) / len(grams(t) | grams(u)), j) for j, u in enumerate(texts) if grams(u))
            want[i] = [(j, -s) for s, j in near if -s >= 0.4][:7]
    for block in (256, 4):
        got = {}
        for r in S.trigram_matches(posts, targets, 0.4, 7, block).orderBy("target_id", "rank").collect():
            got.setdefault(r.target_id, []).append((r.post_id, r.similarity))
        assert {k: [j for j, _ in v] for k, v in got.items()} == {k: [j for j, _ in v] for k, v in want.items()}
        assert all(s == pytest.approx(w) for k in got for (_, s), (_, w) in zip(got[k], want[k]))
    assert S.trigram_matches(posts, targets.limit(0)).isEmpty()


def test_retweet_prefixes(spark):
    from tidemark.functions.lexicons import RETWEET_PREFIXES

    texts = ["rt @a hi", "  rt @a", "rt ", "rt", "via@x", " \u00a0mt b", "art @", "“@you", "via  \n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.leads_with(F.col("t"), RETWEET_PREFIXES)).collect()]
    assert got == [t.strip().startswith(tuple(RETWEET_PREFIXES)) for t in texts]


def test_text_helpers_search_a_text_once(spark):
    def plan(column):
        return spark.createDataFrame([("x",)], "t string").select(column.alias("o"))._jdf.queryExecution().optimizedPlan().toString()

    t = F.col("t")
    leads = plan(X.leads_with(t, ["rt ", "rt@", "via "]))
    assert leads.lower().count("rlike") == 1 and "replace" not in leads
    assert plan(X.contains_any(t, ["claim", "claims", "unclaimed", "hoax"])).count("Contains") == 2
    texts = ["", " ", "\u2003 a\n b \u0085\n", "rt", "a\tb", "\n\n", "x\u2028", "\U0001f600 b "]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", X.strip_space(t).alias("s"), X.has_text(t).alias("h"), X.trigrams(t).alias("g")).collect()
    for r in rows:
        assert r.s == r.t.strip() and r.h == (r.t.strip() != "")
        words = {w for w in "".join(c if c.isalnum() else " " for c in r.t).split()}
        assert sorted(r.g) == sorted({f"  {w} "[i:i + 3] for w in words for i in range(len(w) + 1)})


def test_one_block_of_targets_is_looked_up_without_writing(spark, monkeypatch):
    posts = spark.createDataFrame([(i, f"some words about case {i % 3}") for i in range(12)], "post_id bigint, content string")
    targets = posts.where("post_id < 3").select(F.col("post_id").alias("target_id"), "content")
    written = []
    monkeypatch.setattr(S, "staged", lambda df, name: written.append(name) or df.localCheckpoint())
    rows = lambda block: [tuple(r) for r in S.trigram_matches(posts, targets, block=block).orderBy("target_id", "rank").collect()]
    whole = rows(256)
    assert written == ["targets"] and rows(1) == whole and "trigrams" in written


def test_trigrams_are_cut_once_per_post(spark):
    posts = spark.createDataFrame([(1, "some words"), (2, "some word"), (3, None), (4, "else")], "post_id bigint, content string")
    target = spark.createDataFrame([("some words",)], "c string").select(X.trigrams(F.col("c"))).scalar()
    found = S.trigram_lookup(posts, target)
    assert [r.post_id for r in found.collect()] == [1, 2]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(coalesce(content") == 1


def test_lighter_classes_are_the_plain_ones(spark):
    """the classes that ask for letters first match the same characters as those that do not."""
    from tidemark.functions import text as X

    df = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    pairs = [(X._SPACES, f"[{X.SPACE}]+"), (r"[\P{L}&&[^\p{N}_@]]+", r"[^\p{L}\p{N}_@]+"),
             (rf"[\P{{L}}&&[^\p{{Nd}}{X.SPACE}]]+", rf"[^\p{{L}}\p{{Nd}}{X.SPACE}]+")]
    for light, plain in pairs:
        assert df.where(F.col("c").rlike(light) != F.col("c").rlike(plain)).count() == 0
        assert 0 < df.where(F.col("c").rlike(light)).count() < 0x110000 - 2048
    assert "&&" in X._URL_OR_NON_WORD


def test_a_post_meets_all_targets_of_a_block_at_once(spark):
    """no pair of post and target is made before it is known to be similar, and a post's trigrams are cut once."""
    texts = ["Жар-птица летит", "жар птица", "x", "", None, "𝐀𝐁 c", "a a a b", "١٢ three", "…"]
    posts = spark.createDataFrame([*enumerate(texts), (0, "жар птица"), (None, "x")], "post_id bigint, content string")
    targets = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(2, "x")], "target_id bigint, content string")
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    grams = lambda t: {f"  {w} "[i:i + 3] for w in words(t) for i in range(len(w) + 1)}
    want = sorted((t.target_id, str(p.post_id), round(s, 9)) for t in targets.collect() for p in posts.collect() for a, b in [(grams(t.content), grams(p.content))]
                  if a and b for s in [len(a & b) / len(a | b)] if s >= 0.25)
    for block in (256, 3):
        found = S.trigram_matches(posts, targets, 0.25, 100, block)
        assert sorted((r.target_id, str(r.post_id), round(r.similarity, 9)) for r in found.collect()) == want
    plan = S.trigram_matches(posts, targets, 0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.count("lower(coalesce(content") == 1


def test_terms_of_posts_are_hashed_pieces_of_their_words(spark):
    """a text's 1- to 3-grams are counted where it lies, as SQL counts them one by one."""
    texts = ["one two two one two", "Жар-птица ЛЕТИТ x летит", "", "a b", "𝐀𝐁 cc dd", "one\ttwo…three_four  five", "x" * 70 + " yy"]
    df = spark.createDataFrame([*enumerate(texts)], "text_id bigint, content string")
    rows = df.select("text_id", S.word_list(F.col("content"))).collect()
    grams = [(i, " ".join(ws[k:k + n])) for i, ws in rows for n in (1, 2, 3) for k in range(len(ws) - n + 1)]
    plain = spark.createDataFrame(grams, "text_id bigint, gram string").groupBy("text_id", F.xxhash64("gram").alias("term")).count()
    spaced = F.concat(F.lit(" "), F.array_join(S.word_list(F.col("content")), " "))
    got = df.select("text_id", S._term_lists(3)(spaced).alias("t")).select("text_id", F.explode(F.arrays_zip("t.terms", "t.uses")).alias("t")).select("text_id", "t.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_pairs_are_proposed_once_for_all_terms_of_the_same_texts(spark):
    """terms of the same texts propose their pairs together, and the pairs found are those of a comparison of all."""
    import random

    dice = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = dice.sample(words, 60)
        rows += [(group * 100 + i, " ".join(base[:k] + dice.sample(words, 2) + base[k:])) for i, k in enumerate(dice.sample(range(60), 25))]
    texts = spark.createDataFrame(rows, "text_id bigint, content string")
    vectors = S.term_vectors(texts, texts.select("text_id", F.lit(1).cast("bigint").alias("n"))).localCheckpoint()
    v = {r.text_id: {e.term: e.w for e in r.entries} for r in vectors.collect()}
    want = {(a, b): s for a in v for b in v if a < b for s in [sum(w * v[b].get(t, 0) for t, w in v[a].items())] if round(s, 6) > 0.5}
    assert len(want) > 1000
    assert {(r.a, r.b): r.similarity for r in S.similar_texts(vectors, 0.5).collect()} == pytest.approx(want, abs=1e-6)
    proposed = S.proposed_pairs(vectors, 0.5)
    plan = proposed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len({tuple(r) for r in proposed.collect()}) == proposed.count()
    same = spark.createDataFrame([(i, " ".join(words[:30])) for i in range(40)], "text_id bigint, content string")
    alike = S.term_vectors(same, same.select("text_id", F.lit(1).cast("bigint").alias("n"))).localCheckpoint()
    assert S.proposed_pairs(alike, 0.7).count() == 40 * 39 // 2


def test_ids_of_a_term_go_on_in_the_next_batch(spark):
    import pyarrow as pa

    terms, ids = [1, 1, 2, 3, 3, 3, 3, 4, 4], ["a", "b", "a", "a", "b", "c", "d", "x", "y"]
    for size in (1, 2, 4, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array(terms[k:k + size]), pa.array(ids[k:k + size])], names=["term", "text_id"]) for k in range(0, 9, size)]
        assert [x for b in S._lists_of_terms()(iter(batches)) for x in b.column("ids").to_pylist()] == [["a", "b"], ["a", "b", "c", "d"], ["x", "y"]]
    assert list(S._lists_of_terms()(iter([]))) == []


def test_posts_that_come_twice_have_one_vector(spark):
    """rows of one post count together, in the document frequencies as well."""
    rows = [(1, "one two three"), (1, "one two three"), (2, "one two four"), (3, "five six"), (3, "five seven")]
    texts = spark.createDataFrame(rows, "text_id bigint, content string")
    copies = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "text_id bigint, n bigint")
    vectors = {r.text_id: r.entries for r in S.term_vectors(texts, copies).collect()}
    hashed = lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]
    assert sorted(len(v) for v in vectors.values()) == [5, 6, 6] and len(vectors) == 3
    assert {e.df for v in vectors.values() for e in v if e.term == hashed("one")} == {3}
    five = {e.term: e.w for e in vectors[3]}
    assert five[hashed("five")] == pytest.approx(2 * five[hashed("six")])
