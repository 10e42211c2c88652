"""Decontamination, archives, toxicity, page text and pieces against plain versions, round trips and held-out labels."""

import hashlib
import random
import re
import struct
import zipfile
from collections import defaultdict

import numpy as np
import pyarrow.fs
import pytest
import sentencepiece
from llm_cases import SENTENCE, TEXTS, documents, key, none
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import verify
from conftest import SMALL
from tidemark.llm import catalog, common, decontaminate, html_text, pieces, toxicity, warc

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.configure(spark)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twins(spark, name):
    ok, note, _ = verify.compare(spark, verify.connect(SMALL), name, catalog.QUERIES[name], catalog.SQL[name], SMALL)
    assert ok and "TYPES" not in note, note


# --- benchmark passages


ITEMS = [(1, SENTENCE), (2, "More, of IT!"), (3, None), (4, ""), (5, "?!"), (None, "hello WORLD"), (6, SENTENCE.replace("ten", "TEN;")), (1, SENTENCE),
         (7, " ".join(f"w{k}" for k in range(40))), (8, "日本語 日本語")]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain_scan(text, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = [(m.group(), m.start(), m.end()) for m in word.finditer(lower(text))]
    plain, hits, found = [w for w, _, _ in words], set(), set()
    for item, t in rows:
        w = word.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k:k + 10]
            for at in range(len(plain) - len(window) + 1):
                if plain[at:at + len(window)] == window:
                    hits.update(range(at, at + len(window)))
                    found.add("" if item is None else str(item))
    return len(words), [(h, words[h][1], words[h][2]) for h in sorted(hits)], sorted(found)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 600])
def test_passages_are_found_with_their_places(spark, block_bytes):
    more = [(40, f"é, {SENTENCE}... {SENTENCE}!"), (41, " ".join(f"W{k}" for k in range(5, 33))), (42, "日本語、日本語 日本語 日本語"), (43, "w1 w2"), (44, None)]
    docs = documents(spark, TEXTS + more)
    out = decontaminate.find_passages(docs.drop("found"), items(spark), block_bytes=block_bytes)
    got = [(r.doc_id, r.text, r.found.n_words, [tuple(h) for h in r.found.hits], r.found.items)
           for r in out.select("doc_id", "text", "found").collect()]
    want = [(i, t, *plain_scan(t, ITEMS)) for i, t in TEXTS + more]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(bool(w[3]) for w in want) > 6
    kept = decontaminate.drop_contaminated(docs, items(spark))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted(((w[0], w[1]) for w in want if not w[3]), key=key)


def test_passages_of_nothing(spark):
    assert decontaminate.drop_contaminated(none(spark), items(spark)).count() == 0
    assert decontaminate.drop_contaminated(documents(spark), items(spark, [])).count() == len(TEXTS)


# --- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id string, sha1 string, path string").repartition(2)


PAGES = [(i, u, h, None, "x", "y") for i, u, h in [
    (5, "http://a/", "<p>one"), (3, "http://b/ c\n", "<p>one"), (3, "http://b/2", "<p>one"), (4, None, None), (6, "http://e", ""), (None, "http://n", "<p>one"),
    (None, "http://n", "only null ids"), (8, "http://é", "é\r\n\r\nWARC/1.1\r\n日本"), (9, "http://l", "long " * 50_000), (10, "http://l", "long " * 50_000)]]


@pytest.mark.parametrize("package_bytes", [warc.PACKAGE_BYTES, 100])
def test_archives_hold_pages_and_revisits(spark, package_bytes):
    listed = warc.write_archive(pages(spark, PAGES), common.new_folder(spark, "warc"), package_bytes=package_bytes)
    assert listed.agg(F.sum("records")).first()[0] == len(PAGES) and (package_bytes > 100 or listed.count() == len(PAGES))
    records = warc.read_archive(listed)
    rows = records.collect()
    assert sorted((r.id, r.type, r.refers_to) for r in rows if r.id) == \
        [("10", "revisit", "9"), ("3", "response", None), ("3", "response", None), ("4", "response", None), ("5", "revisit", "3"),
         ("6", "revisit", "4"), ("8", "response", None), ("9", "response", None)]
    assert sorted((r.type, r.refers_to) for r in rows if not r.id) == [("response", None), ("revisit", "3")]
    texts = {str(i): (h or "").encode() for i, _, h, *_ in PAGES}
    assert all(r.payload == texts[r.id] for r in rows if r.id and r.type == "response")
    assert {r.uri for r in rows if r.id == "3"} == {"http://b/%20c%0A", "http://b/2"}
    sizes = warc.resolved(records).collect()
    assert sorted((r.id, r.payload_bytes) for r in sizes if r.id) == sorted((str(i), len((h or "").encode())) for i, _, h, *_ in PAGES if i)
    assert all(r.digest == warc.base32(hashlib.sha1(texts[r.id]).digest()) for r in sizes if r.id)


def test_small_payloads_are_not_revisited(spark):
    listed = warc.write_archive(pages(spark, PAGES), common.new_folder(spark, "warc"), revisit_bytes=7)
    assert {(r.id, r.type) for r in warc.read_archive(listed).where("refers_to is not null").collect()} == {("10", "revisit")}


def test_archives_of_nothing(spark):
    listed = warc.write_archive(pages(spark, []), common.new_folder(spark, "warc"))
    assert listed.count() == 0 and warc.resolved(warc.read_archive(listed)).count() == 0


def test_directories_with_64_bit_fields(tmp_path):
    path = tmp_path / "many.zip"  # more members than 16 bits count: a 64-bit end record
    with zipfile.ZipFile(path, "w") as z:
        for k in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{k}"), b"")
        z.writestr(zipfile.ZipInfo("last"), b"here")
        z.writestr("packed", b"a" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as f:
        members = {m.name: m for m in warc.directory(f, f.size())}
        assert len(members) == 66_002
        f.seek(warc.data_start(f, members["last"]))
        assert f.read(members["last"].size) == b"here"
        with pytest.raises(ValueError):
            warc.data_start(f, members["packed"])
    # an entry whose sizes and offset are in its 64-bit extra field, after a field of another kind
    extra = struct.pack("<HH3s", 9, 3, b"abc") + struct.pack("<HHQQQ", 1, 24, 5_000_000_001, 5_000_000_002, 5_000_000_003)
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 3, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"big" + extra
    end = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), 0, 0)
    (tmp_path / "big.zip").write_bytes(entry + end)
    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "big.zip")) as f:
        assert warc.directory(f, f.size()) == [warc.Member("big", True, 5_000_000_003, 5_000_000_002)]


# --- toxicity


def test_factors_learn_pairs():
    rng = random.Random(4)
    insult, group = toxicity.terms_of("idiots")[0], toxicity.terms_of("they")[0]
    rows = []
    for _ in range(3_000):
        has = {t for t in (insult, group) if rng.random() < 0.5}
        noise = {toxicity.terms_of(f"w{rng.randrange(60)}")[0] for _ in range(8)}
        rows.append((int(len(has) == 2), np.array(sorted(has | noise), np.int32)))
    model = toxicity.fit(np.array([y for y, _ in rows]), [t for _, t in rows])
    at = [model.place[insult], model.place[group]]
    assert model.score(at) > 0.9 and model.score(at[:1]) < 0.2 and model.score(at[1:]) < 0.2
    assert model.factors[at[0]] @ model.factors[at[1]] > 0.5  # the pair itself


def test_pairs_of_terms_that_are_neutral_alone():
    """Toxic if both or neither of two terms occur, among noise and copies: no term has an effect of its own."""
    rng = random.Random(7)
    rows = []
    for _ in range(4_000):
        has = [k for k in (1, 2) if rng.random() < 0.5]
        rows.append((int(len(has) != 1), np.array(sorted({*has, *(10 + rng.randrange(80) for _ in range(8))}), np.int32)))
    rows += [(1, rows[0][1])] * 300
    model = toxicity.fit(np.array([y for y, _ in rows]), [t for _, t in rows])
    assert {1, 2} <= set(model.place) and len(model.place) <= 12
    at = [model.place[1], model.place[2]]
    assert model.score(at) > 0.8 and model.score([]) > 0.8 and model.score(at[:1]) < 0.2 and model.score(at[1:]) < 0.2


def plain_fit(labels, terms, chosen):
    """The same machine with a matrix of documents and terms, every pair of factors multiplied out, one document after the other."""
    x = np.array([[float(t in set(d.tolist())) for t in chosen] for d in terms])
    n, k = x.shape
    rng = np.random.default_rng(6)
    rate = (labels.sum() + 1) / (n + 3)
    b, w, v = np.log(rate / (1 - rate)), np.zeros(k), rng.normal(0, 0.01, (k, toxicity.FACTORS))
    gb, gw, gv = 1e-6, np.full(k, 1e-6), np.full(v.shape, 1e-6)
    for _ in range(toxicity.EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, toxicity.BATCH):
            part = order[low:low + toxicity.BATCH]
            db, dw, dv = 0.0, np.zeros(k), np.zeros(v.shape)
            for d in part:
                logit = b + x[d] @ w + sum(x[d, i] * x[d, j] * (v[i] @ v[j]) for i in range(k) for j in range(i))
                g = (1 / (1 + np.exp(-logit)) - labels[d]) / len(part)
                db += g
                dw += g * x[d]
                dv += g * np.outer(x[d], x[d] @ v) - g * x[d][:, None] * v
            seen = x[part].any(axis=0)
            dw[seen] += toxicity.DECAY * w[seen]
            dv[seen] += toxicity.DECAY * v[seen]
            gb, gw, gv = gb + db ** 2, gw + dw ** 2, gv + dv ** 2
            b -= toxicity.RATE * db / np.sqrt(gb)
            w -= toxicity.RATE * dw / np.sqrt(gw)
            v -= toxicity.RATE * dv / np.sqrt(gv)
    return b, w, v


def test_the_machine_equals_a_plain_one(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    rng = random.Random(11)
    rows = []
    for _ in range(400):
        found = {t for t in range(1, 13) if rng.random() < 0.35}
        rows.append((int({1, 2} <= found or 3 in found and rng.random() < 0.7), np.array(sorted(found), np.int32)))
    labels, terms = np.array([y for y, _ in rows]), [t for _, t in rows]
    model = toxicity.fit(labels, terms)
    assert {1, 2, 3} <= set(model.place)
    b, w, v = plain_fit(labels, terms, sorted(model.place, key=model.place.get))
    assert model.bias == pytest.approx(b, abs=1e-8) and model.weights == pytest.approx(w, abs=1e-8) and model.factors == pytest.approx(v, abs=1e-8)


def test_models_of_no_labels_and_of_one_class(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 0), (None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels.limit(0), labels):
        out = toxicity.score(docs, toxicity.train(docs, known)).select("toxicity").distinct().collect()
        assert len(out) == 1 and 0 < out[0][0] < 0.5
    assert toxicity.drop_toxic(none(spark), labels).columns == docs.columns


def test_held_out_toxic_documents(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    out = catalog.QUERIES["op6_toxicity"](spark, MIDDLE)
    assert out.count() == 1_000
    rows = out.join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted and not r.toxic for r in held) <= 2 and sum(r.predicted and r.toxic for r in held) >= 3
    toxic, clean = [[r.score for r in held if r.toxic == y] for y in (1, 0)]
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.95  # area under the curve


def test_scores_do_not_depend_on_other_columns_or_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"), max_rows=200)
    odd = documents(spark, [*TEXTS, (50, "you idiot moron scum"), (51, "you idiot moron scum"), (52, "idiot " * 30_000)])
    scores = defaultdict(set)
    for r in toxicity.score(odd, model).collect():
        scores[r.text or ""].add(r.toxicity)
    assert all(len(s) == 1 for s in scores.values())
    assert min(scores["you idiot moron scum"]) > 0.5 > max(scores[""])


# --- page text


TOLD = ["A day to remember", "It was a fine day and the long paragraph goes on with many words for the reader to see here.", "Another paragraph follows, and it has enough words to be read as well."]
STORY = f"<h1>{TOLD[0]}</h1><p>{TOLD[1]}</p><p>{TOLD[2]}</p>"
MAIN = [
    ("<html><head><title>No</title></head><body><header><h1>Site</h1><ul><li><a href=x>Home</a></li></ul></header><div class='cookie-notice'>We use cookies. "
     "<button>OK</button></div><div id='main'><h1>The big story of the day</h1><p>It was a fine day and the long paragraph goes on with many words for the reader "
     "to see here.</p><p>Short one.</p><p>Another long paragraph that has many words in it, and goes on and on for the pleasure of reading.</p></div><div class="
     "\"sidebar\"><p>This sidebar has many words also and is as long as any paragraph of the article, but it must go away.</p></div><section id=comments><p>Nice "
     "article, I liked it so much that I wrote a long comment here with many words.</p></section><footer>&copy; 2020</footer></body></html>",
     ["The big story of the day", "It was a fine day and the long paragraph goes on with many words for the reader to see here.", "Short one.",
      "Another long paragraph that has many words in it, and goes on and on for the pleasure of reading."]),
    ("<nav><a>x</a></nav><main><article><header><h1>Title &amp; more</h1></header><p>Hello&nbsp;\n world <a href=\"a>b\">link</a>.<script>var x='<p>no</p>'</script>"
     "<aside>buy now</aside><p>Ti.<br>x&#233;<form><label>mail</label><input></form><div class=comments><article>me too I think so</article></div></article></main>",
     ["Title & more", "Hello world link.", "Ti. xé"]),
    ("<article><p>open <b>never closed<p>second<!-- <p>no --><style>p{}", ["open never closed", "second"]),
    ("<article><div class='share-bar'>Share this with friends</div><ul><li>point one<li>point two</ul><table><tr><td>a<td>b</table></article><div class=ad>Buy it.</div>",
     ["point one", "point two", "a", "b"]),
    *[(page, TOLD) for page in (
        f"<body class='has-sidebar'>{STORY}", f"<body class='has-sidebar'><article>{STORY}</article>", f"<div class='with-sidebar'><article>{STORY}</article></div>",
        f"<article class='no-comments'>{STORY}</article>", f"<form id=page>{STORY}</form>", f"<form><article>{STORY}</article></form>",
        f"<body id=search><div class='sidebar-left layout'><main>{STORY}</main></div>", f"<svg><article>{STORY}</article>", f"<canvas>{STORY}",
        f"<article><svg><text>no</text></svg>{STORY}<select><option>a</select></article>")],
    ("<article><h2 id='search-results'>Results of the search</h2><p id='ad-hoc-query'>The query was made by hand and it took a long time to run.</p>"
     "<div class='related-work'><p>Others have looked at the same question before and found some of the answers.</p></div></article>",
     ["Results of the search", "The query was made by hand and it took a long time to run.", "Others have looked at the same question before and found some of the answers."]),
    ("<article><p>The area is <math><mi>a</mi><mo>+</mo><mn>2</mn></math> for every one of them.</p><p>After that the text goes on for some time.<ul><li><a href=1>one</a>"
     "<li><a href=2>two of them</a><li><a href=3>three</a></ul></article>", ["The area is a+2 for every one of them.", "After that the text goes on for some time."]),
    ("", []), (None, []), ("   ", []), ("<article></article>", []), ("<article>5 < 6 &lt;b&gt; &unknown; a</article>", ["5 < 6 <b> &unknown; a"]),
    ("<article>" + "<p>word</p>" * 3_000 + "</article>", ["word"] * 3_000),
]


def test_main_text(spark):
    rows = [(k, html, "t", "u") for k, (html, _) in enumerate(MAIN * 2)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, blocks string, tree string"))
    assert out.columns == ["page_id", "html", "blocks", "tree", "text"]
    for r in out.collect():
        assert r.text == "\n\n".join(MAIN[r.page_id % len(MAIN)][1]), r.page_id


def test_main_text_of_nothing(spark):
    assert html_text.extract_text(spark.createDataFrame([], "html string")).count() == 0


def test_the_tree_looks_at_words_and_links_within_an_article(spark):
    tree = html_text.trained_tree(spark)

    def features(node, article):
        if isinstance(node, float):
            return set()
        k, at, below, above = node
        if html_text.FEATURES[k] == "article":
            return features(above if article else below, article)
        return {html_text.FEATURES[k]} | features(below, article) | features(above, article)

    assert {"words", "named", "asides"} <= features(tree, True) and features(tree, True) & {"links", "links_before", "links_after"}


def test_broken_markup_takes_linear_time():
    for html in ("<svg>" * 20_000, "<svg>" * 10_000 + "</svg>" * 10_000, "<a href=\"" * 20_000, "<!--" * 20_000, "<script>" * 20_000, "<div>" * 20_000, "<p" * 50_000, "</b>" * 20_000):
        html_text.blocks(html)


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def plain_paths(word, vocabulary):
    """All segmentations (score, ids) of a word of known characters."""
    out = []

    def go(at, score, ids):
        if at == len(word):
            out.append((score, ids))
        for end in range(at + 1, len(word) + 1):
            known = vocabulary["pieces"].get(word[at:end])
            if known:
                go(end, score + known[1], [*ids, known[0]])

    go(0, 0.0, [])
    return sorted(out, key=lambda p: -p[0])


def test_n_best_are_the_best_of_all(vocabulary):
    for word in ["▁the", "▁internationally", "onandther", "▁▁a", "x", "▁éèç", "1234"]:
        every = plain_paths(word, vocabulary)
        for n in (1, 2, 7, 5_000):
            got = pieces.n_best(word, n, vocabulary)
            assert [s for s, _ in got] == [s for s, _ in every[:n]]
            assert len({tuple(i) for _, i in got}) == len(got) and all((s, i) in every for s, i in got)
        best = pieces.best_two(word, vocabulary)
        assert (best[1], best[2]) == (every[0][0], every[1][0] if len(every) > 1 else -np.inf) and (best[1], best[0]) in every


def test_n_best_agree_with_the_library(spark, vocabulary):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # segment by scores
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = sorted({w for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for w in r.text.split()})
    for word in random.Random(9).sample(words, 400):
        mine = [s for s, _ in pieces.n_best(pieces.BLANK + word, 4, vocabulary) if s > -1e8]
        theirs = [sum(map(library.get_score, ids)) for ids in library.nbest_encode_as_ids(word, 4)]
        assert mine == [s for s in theirs if s > -1e8], word


def test_others_are_the_n_best_of_whole_texts(vocabulary):
    for text in ["the inter", "on the other", "a b", "then, the", "ab", "x", "the the the"]:
        words = pieces.words_of(text, vocabulary)
        assert "".join(words) == pieces.normalised(text)
        every = plain_paths("".join(words), vocabulary)
        ids, score, others = next(pieces.Encoder(vocabulary, 4).encode([text]))
        assert [score, *[o["score"] for o in others]] == [s for s, _ in every[:4]]
        best = [pieces.best_two(w, vocabulary)[0] for w in words]
        built = [list(ids)]
        for other in others:
            changed = {w["word"]: w["ids"] for w in other["words"]}
            built.append([i for k, b in enumerate(best) for i in changed.get(k, b)])
        assert all((s, b) in every for s, b in zip([score, *[o["score"] for o in others]], built)) and len(set(map(tuple, built))) == len(built)


def test_round_trip_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    rows = [*TEXTS, (60, " lead and trail  "), (61, "▁ ▁▁x"), (62, "².5 ². a."), (63, "no" * 20_000), (64, " " * 5_000), (65, "\n\n\t\r"), (66, "🙂" * 30)]
    out = pieces.decode(pieces.encode(documents(spark, rows)).withColumn("ids", F.col("pieces.ids")), "ids")
    got = out.select("doc_id", "text", "decoded", F.col("pieces.score").alias("score"), F.size("ids").alias("k"), F.size("pieces.others").alias("n")).collect()
    assert sorted(((r.doc_id, r.decoded) for r in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert all((r.k, r.score, r.n) == (0, 0.0, 0) for r in got if not r.text) and all(r.k and r.n == 3 for r in got if r.doc_id in (1, 9, 60))
    assert pieces.encode(none(spark)).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), "ids").select("decoded").distinct().collect()[0][0] == ""
