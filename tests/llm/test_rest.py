import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cubeframe.llm import _text, html_extract, langid, license_scan, mixing, packing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Extraction.


@pytest.fixture(scope="module")
def field():
    return html_extract.standard_field()


@pytest.mark.parametrize(("html", "wanted"), [
    (None, ""), ("", ""), ("<nav><a href=/>Home</a></nav>", ""),
    ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this now.</div>"
     "<article><h1>Title here</h1><p><b>First &amp; second\n  words of it.<br>more<p>Second one ends.</p></article><footer>&copy; someone &middot; words</footer></body></html>", "Title here First & second words of it. more Second one ends."),
    ("<body><header><p>Site name</p></header><article><p>The text of the article stands here, and it is long enough.</p></article><section class='comments'><h3>Comments</h3><p>I liked it very much, thank you.</p></section>"
     "<form class='newsletter'><label>Mail</label><input></form><footer>All rights reserved.</footer>", "The text of the article stands here, and it is long enough."),
])
def test_extract_pages(field, html, wanted):
    assert html_extract.main_text(html, field) == wanted


def test_field_on_unseen_layouts(field):
    pages = html_extract.labelled_pages(150, seed=77)
    right = [a == b for page in pages for a, (_, b) in zip(field.decode([own for own, _ in page]), page, strict=True)]
    assert np.mean(right) > 0.96


def test_viterbi_is_the_best_of_all():
    import itertools

    f = html_extract.Field({"a": 1.2, "b": -0.7, "c": 0.1}, [[0.4, -0.3], [-0.6, 0.5]], -0.2)
    for own in itertools.product("abc", repeat=5):
        page = [[x] for x in own]

        def score(labels, page=page):
            s = f.start * labels[0] + sum(f.weights[x[0]] * y for x, y in zip(page, labels, strict=True))
            return s + sum(f.steps[a][b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product([0, 1], repeat=5), key=score)
        assert score(tuple(map(int, f.decode(page)))) == pytest.approx(score(best))


@pytest.mark.parametrize(("html", "wanted"), [
    ("<article><p>The identity <math>a+b</math> holds for all of them.</p></article>", "The identity a+b holds for all of them."),
    ("<article><p>Before it <select><option>one<option>two stands the text.</p><p>After it the text goes on.</p></article>", "Before it After it the text goes on."),
    ("<article><p>Before it <button>Share</button>stands the text, <svg/>and here.</p><object>old<p>player</object><p>After it the text goes on.</p></article>", "Before it stands the text, and here. After it the text goes on."),
    ('<article><p title="it is>One long sentence stands here for all.</p><p>And another one, too.</p></article>', "One long sentence stands here for all. And another one, too."),
    ("<article><p>Text that stands here, 1 < 2 and <3.</p></foo></div><p>And more of it.</p><script>var x = '<p>';", "Text that stands here, 1 < 2 and <3. And more of it."),
    ("<article><p data-x='a > b' title = \"c > d\">Quoted signs end no tag.</p></article><!-- > -->", "Quoted signs end no tag."),
    ("<article><ul><li>One item of the list.<li>Two items of the list.</ul><p>The end of it<br>is here.</article>", "One item of the list. Two items of the list. The end of it is here."),
])
def test_extract_broken_pages(field, html, wanted):
    assert html_extract.main_text(html, field) == wanted


@pytest.mark.parametrize("html", ["<a " * 350_000, "<div>" * 100_000 + "x", "<div>x" * 100_000, "<div>" * 50_000 + "<li>a</li>" * 50_000, "<i>" * 50_000 + "t<hr>" * 50_000, "<div>" * 50_000 + "</foo>" * 100_000, "<a b='" * 150_000, "<!-- " * 200_000, "<a " + "= " * 300_000])
def test_extract_in_linear_time(field, html):
    import time

    start = time.perf_counter()
    html_extract.main_text(html, field)
    assert time.perf_counter() - start < 10


def test_blocks_by_a_plain_walk():
    """The scanner against the standard library's parser, on pages without broken markup."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [[]], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in html_extract.RAW
            if tag in html_extract.BLOCKS:
                self.out.append([])
            elif tag == "br":
                self.out[-1].append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in html_extract.RAW
            if tag in html_extract.BLOCKS:
                self.out.append([])

        def handle_data(self, data):
            if not self.skip:
                self.out[-1].append(data)

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        walk = Walk()
        walk.feed(page)
        walk.close()
        assert [t for _, t in html_extract.blocks(page)] == [t for t in (" ".join("".join(b).split()) for b in walk.out) if t]


def test_extract_table(spark, field):
    rows = [(1, "u", "<article><p>A text that is here, for all to read.</p></article>", "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "u", "plain < 3 text", "z")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), field).collect()
    assert len(got) == 4 and got[0]["text"] == "A text that is here, for all to read." and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), field).count() == 0
    assert html_extract.main_text("<article><p>" + "Long words stand here. " * 20000 + "</p></article>", field).count("Long") == 20000


# Shards.


def test_hilbert_steps_are_neighbours(spark):
    points = spark.range(16**2).select((F.col("id") % 16).alias("x"), F.expr("id div 16").alias("y"))
    path = points.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y")], 4)).orderBy("h").collect()
    assert [r["h"] for r in path] == list(range(256))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(path, path[1:], strict=False))


def test_shards(edge_docs, edge_rows, near_docs, near_rows, no_docs):
    for docs, rows in ((edge_docs, edge_rows), (near_docs, near_rows)):
        got = sharding.shard_documents(docs).collect()
        texts = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
        counts = [sum(r["shard"] == s for r in got) for s in range(24)]
        assert max(counts) - min(counts) <= 1 and {r["law"] for r in got} == {"rows"}
        assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in range(24))
    assert sharding.shard_documents(no_docs).count() == 0


def test_shards_split_a_hot_cell(monkeypatch, spark):
    monkeypatch.setattr(sharding, "LEAST_BUCKET_ROWS", 16)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"), F.lit("l").alias("lang"))
    got = sharding.shard_documents(docs, 7).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("m")).collect()
    assert sorted(r["n"] for r in got) == [285] * 2 + [286] * 5 and all(r["m"] == r["n"] - 1 for r in got)


# Classifiers.


def rated(spark):
    good, bad, rude = "the river runs by the old town and its mill", "BUY!! NOW!! CHEAP!! DEAL!!", "you are a total idiot and a moron, shut up"
    rows = [(i, f"{(bad, rude, good)[i % 3]} {i % 17}", i % 3) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_quality(spark, edge_docs, no_docs):
    docs = rated(spark)
    model = quality.train(docs.select("doc_id", "text"), docs.where("doc_id < 400").select("doc_id", "grade"))
    assert (np.diff(model[1]) > 0).all()
    got = quality.graded(docs, model, ["doc_id", "grade"]).where("doc_id >= 400").collect()
    assert np.mean([abs(r["expected_grade"] - r["grade"]) < 0.5 for r in got]) > 0.95
    assert all((r["p_top"] > 0.5) == (r["grade"] == 2) for r in got)
    kept = quality.selected(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.where("grade < 2").count() == 0 and kept.count() == 200
    assert quality.graded(edge_docs, model, ["doc_id"]).count() == edge_docs.count()
    assert quality.selected(edge_docs, model, 0.0).count() == edge_docs.count()
    assert quality.graded(no_docs, model, ["doc_id"]).count() == 0


def sparse(texts, grades):
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(grades, pa.int32()), pa.array([1] * n, pa.int64()), pa.array(texts, pa.string())], names=["key", "grade", "weight", "text"])
    return pa.Table.from_batches(list(quality._sparse(iter([batch]))))


def test_quality_scores_by_hand(edge_rows):
    """Words and trigrams counted one by one, with the hashes of words alone."""
    weights = np.random.default_rng(2).normal(size=(2 << quality.BITS) + 1)
    texts, by_hand = [r[1] for r in edge_rows], []
    for text in texts:
        words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
        data, score = (text or "").encode(), 0.0
        buckets = Counter(int(_text.words(pa.array([w])).hashes[0] >> np.uint64(64 - quality.BITS)) for w in words)
        score += sum(weights[b] * math.log1p(n) * quality.WORD_SCALE / math.sqrt(len(words)) for b, n in buckets.items())
        grams = [data[i] | data[i + 1] << 8 | data[i + 2] << 16 for i in range(len(data) - 2)]
        score += sum(weights[(1 << quality.BITS) + ((g * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality.BITS)] for g in grams) * quality.TRIGRAM_SCALE / max(len(grams), 1)
        score += weights[-1] * sum(a == b for a, b in zip(words, words[1:], strict=False)) * quality.REPEAT_SCALE / max(len(words), 1)
        by_hand.append(score)
    assert np.allclose(quality.scores(pa.array(texts), weights), by_hand, atol=1e-4)
    _, _, bounds, at, values = quality._arrays(sparse(texts, [0] * len(texts)))
    assert np.allclose(np.add.reduceat(weights[at] * values, bounds[:-1]), by_hand, atol=0.05)


def test_quality_scores_are_the_same_in_any_batch(edge_rows):
    """To the last bit, as the threshold is the score of a document."""
    dice = np.random.default_rng(4)
    texts = [r[1] for r in edge_rows] + ["".join(dice.choice(list("abcd ef  "), size=n)) for n in dice.integers(0, 3000, 200)]
    weights = dice.normal(size=(2 << quality.BITS) + 1)
    alone = np.concatenate([quality.scores(pa.array([t], pa.string()), weights) for t in texts])
    for _ in range(3):
        order = dice.permutation(len(texts))
        assert (quality.scores(pa.array([texts[i] for i in order], pa.string()), weights) == alone[order]).all()


def test_quality_gradient():
    """The fit's direction is that of finite differences of the likelihood."""
    random = np.random.default_rng(8)
    n, cuts = 60, np.array([-0.4, 0.9])
    scores, grades, counts = random.normal(size=n), random.integers(0, 3, n), random.integers(1, 4, n)

    def loss(scores, cuts):
        above = 1 / (1 + np.exp(-(scores[:, None] - np.concatenate([[-40.0], cuts, [40.0]])[None, :])))
        return -(np.log(above[np.arange(n), grades] - above[np.arange(n), grades + 1]) * counts).sum() / counts.sum()

    by_score, by_cut = quality.slopes(scores, cuts, grades, counts / counts.sum())
    e = 1e-6
    for i in range(n):
        moved = scores.copy()
        moved[i] += e
        assert (loss(moved, cuts) - loss(scores, cuts)) / e == pytest.approx(by_score[i], abs=1e-5)
    for k in range(2):
        moved = cuts.copy()
        moved[k] += e
        assert (loss(scores, moved) - loss(scores, cuts)) / e == pytest.approx(by_cut[k], abs=1e-5)


def test_quality_counts_are_repeats():
    """A row with a count is as many rows."""
    texts, grades = ["good plain words", "bad words", "rude words here"], [2, 0, 1]
    _, _, *once = quality._arrays(sparse(texts, grades))
    _, _, *many = quality._arrays(sparse([t for t, n in zip(texts, (3, 1, 2), strict=True) for _ in range(n)], [2, 2, 2, 0, 1, 1]))
    a = quality.fit(np.array(grades), *once, 2, np.array([3, 1, 2]))
    b = quality.fit(np.array([2, 2, 2, 0, 1, 1]), *many, 2)
    assert np.allclose(a[0], b[0], atol=1e-3) and np.allclose(a[1], b[1], atol=1e-3)


def test_quality_threshold():
    values, counts = np.array([0.9, 0.1, 0.5, 0.7]), np.array([1, 1, 2, 6])
    assert quality._quantile(values, counts, 0.1, 0.3) == 0.5 and quality._quantile(values, counts, 0.05, 0.3) == 0.1
    assert quality._quantile(values[:0], counts[:0], 0.1, 0.3) == 0.3
    assert quality._shares(10) == pytest.approx((0.8, 0.2)) and sum(quality._shares(10**6)) == pytest.approx(0.016)


def test_quality_learns_from_rare_words():
    """Words that fewer than 20 rated documents have still tell."""
    marks, plain = ["achkeiter", "bomenteí", "qwzkjx"], "the river runs by the old town and its mill"
    texts = [f"{plain} {marks[i % 3]}" if i < 18 else plain for i in range(400)]
    grades, _, *found = quality._arrays(sparse(texts, [1 if i < 18 else 2 for i in range(400)]))
    weights, cuts = quality.fit(grades, *found, 2)
    top = 1 / (1 + np.exp(cuts[-1] - quality.scores(pa.array([plain, *(f"{plain} {m}" for m in marks)]), weights)))
    assert top[0] > 0.9 and (top[1:] < 0.4).all()


def test_quality_sample_is_bounded(monkeypatch, spark):
    """An id with very many ratings and very many rows is one row per grade; texts with many features are fewer."""
    docs = rated(spark).select("doc_id", "text").unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit("BUY!! NOW!! CHEAP!! DEAL!! 7").alias("text")))
    ratings = rated(spark).select("doc_id", "grade").unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("grade")))
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: seen.append(a) or fit(*a))
    quality.train(docs, ratings)
    assert len(seen[0][0]) < 600
    monkeypatch.setattr(quality, "RATED_FEATURES", 500)
    quality.train(docs, ratings)
    assert len(seen[1][0]) < len(seen[0][0]) / 2


def test_quality_learns_from_all_ratings(monkeypatch, spark):
    """The start has no rating of the words that mark a grade, and the threshold is that of all ratings which are not fitted."""
    monkeypatch.setattr(quality, "RATED", 40)
    monkeypatch.setattr(quality, "CALIBRATED", 10)
    monkeypatch.setattr(quality, "MOST_VALUES", 7)
    dice, plain = np.random.default_rng(5), "the river runs by the old town and its mill"
    start = {r["id"] for r in spark.range(2000).where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30) < 0.02).collect()}
    rows = [(i, f"{plain} {'moron' if bad and i not in start else ''} {dice.integers(500)}", 0 if bad else 1) for i, bad in enumerate((dice.random(2000) < 0.2).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int").repartition(3)
    model = quality.train(docs.select("doc_id", "text"), docs.select("doc_id", "grade"))
    top = 1 / (1 + np.exp(model.cuts[-1] - quality.scores(pa.array([plain, f"{plain} moron"]), model.weights)))
    assert 0 < len(start) < 100 and top[0] > 0.9 and top[1] < 0.1
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    held = sorted(r["p_top"] for r in quality.graded(docs.where((F.col("grade") == 1) & (place >= 0.8)), model, ["doc_id"]).collect())
    assert len(held) > 200 and model.least == held[int(quality.CLEAN_LOSS * len(held))]


def test_quality_sums_are_the_same_in_any_order(spark):
    """Loss and gradient over all rows are those of ``slopes``, whatever the partitions."""
    texts = [f"{a} {b} w{a * b % 13}" for a in range(20) for b in range(15)]
    grades = [i * 7 % 3 for i in range(len(texts))]
    table = spark.createDataFrame(sparse(texts, grades).to_pandas())
    theta = np.concatenate([np.random.default_rng(1).normal(size=(2 << quality.BITS) + 1), [-0.5, 0.3]])
    value, gradient = quality._objective(table.repartition(3))(theta)
    again = quality._objective(table.orderBy(F.rand(2)).repartition(2))(theta)
    assert value == again[0] and (gradient == again[1]).all()
    for i in (int(np.abs(gradient[:-2]).argmax()), len(theta) - 2, len(theta) - 1):
        moved = theta.copy()
        moved[i] += 1e-3
        assert (quality._objective(table)(moved)[0] - value) / 1e-3 == pytest.approx(gradient[i], abs=2e-3)


def test_quality_without_ratings(spark, edge_docs):
    model = quality.train(edge_docs, spark.createDataFrame([(4, None), (None, 1)], "doc_id long, grade int"))
    assert quality.selected(edge_docs, model, 0.5).count() == edge_docs.count()


def test_language(spark, edge_docs, no_docs):
    texts = {"en": "the house and the garden of their father", "de": "das Haus und der Garten von ihrem Vater", "fr": "la maison et le jardin de leur père"}
    rows = [(i, f"{texts[lang]} {i}", lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, docs.where(langid.fold(F.col("doc_id")) != 1)).join(docs, "doc_id").collect()
    assert len(got) == 120 and all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    edge = {r["doc_id"]: r for r in langid.identify(edge_docs, docs).collect()}
    assert len(edge) == 14 and [edge[i]["lang_pred"] for i in (1, 2, 3, 11)] == ["und"] * 4 and edge[8]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in langid.identify(edge_docs, no_docs).collect()} == {"und"}
    assert langid.identify(no_docs, docs).count() == 0


def test_language_by_hand():
    column = pa.array(["Abc", None, "", "é日", "xy zé"])
    buckets, starts, known = langid.grams(column)
    assert starts.tolist() == [0, 3, 3, 3, 5, 10] and known.tolist() == [True, False, False, True, True]
    none = 1 << langid.BUCKET_BITS
    assert [int((b == none).sum()) for b in buckets] == [0, 3, 6]
    again, _, _ = langid.grams(pa.array(["aBC"]))
    assert all((a[:3] == b).all() for a, b in zip(buckets, again, strict=True))


def test_language_against_naive_bayes_by_hand(monkeypatch, spark):
    """Each n-gram's probability looked up and multiplied one by one, also where long texts are cut into pieces."""
    monkeypatch.setattr(langid, "PIECE", 7)
    monkeypatch.setattr(langid, "STEP", 5)
    texts = {"en": ["the house and the garden", "of their father"], "de": ["das Haus und der Garten", "ÄÖ ihrem Vater"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in texts.items() for t in v)]
    languages, matrix, prior = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    bucket = lambda gram: int(langid.grams(pa.array([gram]))[0][len(gram) - 1][0])
    grams = lambda t: [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    assert languages == ["de", "en"] and np.allclose(prior, np.log([0.5, 0.5]))
    for k, lang in enumerate(languages):
        counts = Counter(bucket(g) for t in texts[lang] for g in grams(t.lower()))
        total = sum(counts.values()) + 0.5 * (1 << langid.BUCKET_BITS)
        assert np.allclose(matrix[list(counts), k], [math.log((n + 0.5) / total) for n in counts.values()], atol=1e-5)
    asked = ["The Vater of das house", "x", "", "garden " * 30]
    for cut in (False, True):
        total = np.tile(prior, (len(asked), 1))
        for i, text in enumerate(asked):
            batch = pa.record_batch([pa.array([i]), pa.array([text * 1])], names=["id", "text"])
            for buckets, starts, _ in langid._parts(batch, 1) if cut else [langid.grams(batch.column(1))]:
                langid._summed(matrix, buckets, starts, total[i : i + 1])
        by_hand = [prior + sum(matrix[bucket(g)] for g in grams(t.lower())) if t else prior for t in asked]
        assert np.allclose(total, by_hand, atol=1e-3)


# Mixing.


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == pytest.approx([0, 5])
    sizes = [3, 50, 7, 900, 0, 41]
    wanted = mixing.targets(sizes)
    assert sum(wanted) == pytest.approx(sum(sizes)) and all(w <= 3 * s + 1e-9 for w, s in zip(wanted, sizes, strict=True))


def test_slots_of_runs_add_up(monkeypatch):
    """Every source gets its slots, however many runs the driver draws; a large plan stays small."""
    total = np.array([70_000, 0, 5, 123_456, 1_000_000])
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 4096)
    for planned in (5, 100, 1 << 20):
        monkeypatch.setattr(mixing, "MOST_PLANNED", planned)
        runs = list(mixing.planned(total, 7))
        assert (sum(own for *_, own in runs) == total).all() and len(runs) * len(total) <= max(planned, 5)
        shards = [(first + i, counts) for first, rooms, _, own in runs for i, counts in enumerate(mixing.drawn(own, rooms, [7, first]))]
        assert (sum(c for _, c in shards) == total).all() and [s for s, _ in shards] == list(range(len(shards)))
        assert max(int(c.sum()) for _, c in shards) <= 4096 and np.std([c[4] / max(1, c.sum()) for _, c in shards[:-1]]) < 0.05
    monkeypatch.setattr(mixing, "MOST_PLANNED", 1 << 20)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 65536)
    assert sum(len(own) for *_, own in mixing.planned(np.full(10_000, 50_000), 7)) <= 1 << 20


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutation(n):
    a, b = (mixing.permuted(np.arange(n), n, key) for key in (5, 6))
    assert sorted(a) == sorted(b) == list(range(n)) and (n < 60 or (a != b).any())


def test_mix(edge_docs, edge_rows, near_docs, near_rows, no_docs):
    for docs, rows in ((edge_docs, edge_rows), (near_docs, near_rows)):
        got = mixing.mix(docs, block_words=16).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5), block_words=16).collect()))
        source = {r[0]: r[3] for r in rows}
        sizes, taken, target = Counter(), Counter(), {}
        for r in got:
            s = source[r["doc_id"]]
            sizes[s] += r["size"]
            taken[s] += r["taken"]
            target[s] = r["target"]
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        assert [target[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order]))
        assert all(abs(taken[s] - target[s]) <= 64 for s in order)
        if docs is near_docs:
            texts = mixing.mixed_documents(docs, block_words=16)
            assert texts.columns == docs.columns
            words = Counter()
            for r in texts.collect():
                words[r["doc_id"]] += len(WORD.findall(r["text"]))
            assert words == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    assert mixing.mixed_documents(edge_docs).columns == edge_docs.columns


# Licences.


def test_licences(spark, edge_docs, no_docs):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.py", "hello"), (3, "a/b/c/y.py", "# Released under the MIT License.\nfoo"), (4, "z/q", "nothing"), (5, None, None), (6, "a/b/COPYING.txt", "All rights reserved."), (7, "a/b/c/d/e", ""), (7, "a/b/c/d/e", ""), (8, "top", "we license the things that people like to do together on their sundays")]
    got = {r["doc_id"]: (r["license"], r["evidence"], r["license_from"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", "file", "a/LICENSE"), 2: ("Proprietary", "inherited", "a/b/COPYING.txt"), 3: ("MIT", "header", "a/b/c/y.py"), 4: (None, None, None), 5: (None, None, None), 6: ("Proprietary", "file", "a/b/COPYING.txt"), 7: ("Proprietary", "inherited", "a/b/COPYING.txt"), 8: (None, None, None)}
    paths = edge_docs.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    assert license_scan.scan(paths).count() == edge_docs.count()
    assert license_scan.scan(no_docs.withColumn("path", F.lit("x"))).count() == 0


def test_licences_over_lines_and_spdx(spark):
    gpl = " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License{} as published by\n * the Free Software Foundation{}\n */\nint x;"
    mit = "Copyright 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice"
    rows = [
        ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"), ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"), ("# SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("SPDX-License-Identifier: (MIT OR Apache-2.0)\n", "(MIT OR Apache-2.0)"),
        (gpl.format(" version 2", "."), "GPL-2.0"), (gpl.format("", ", either version 2 of the License, or\n * (at your option) any later version."), "GPL-2.0"), (gpl.format("", ", either version 3 of the License, or\n * (at your option) any later version."), "GPL-3.0"),
        (gpl.format("", ", either version 3 of the License, or\n * (at your option) any later version.").replace("GNU General", "GNU Affero General"), "AGPL-3.0"), (mit, "MIT"), ("                 Apache License\n           Version 2.0, January 2004\n\n   TERMS AND CONDITIONS FOR USE", "Apache-2.0"),
    ]
    prose = [(100 + i, f"p{i}/a", "plain words of a text that is about other things") for i in range(200)]
    files = spark.createDataFrame([(i, f"d{i}/f", text) for i, (text, _) in enumerate(rows)] + prose, "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(files).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows] and all(got[100 + i] is None for i in range(200))


@pytest.mark.parametrize(("line", "wanted"), [("Released under the MIT License today", "MIT"), ("the work, the whole work: this work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("The MIT license the mit License THE (MIT)", "MIT")])
def test_cosine_by_hand(spark, line, wanted):
    total, frequency = 50, {"the": 40, "license": 3}
    known = {w for texts in license_scan.TEMPLATES.values() for t in texts for w in re.findall("[a-z0-9]+", t.lower())}
    idf = lambda w: math.log((total + 1) / ((frequency.get(w, 0) if w in known else 0) + 1)) + 1

    def vector(text):
        return {w: (1 + math.log(n)) * idf(w) for w, n in Counter(re.findall("[a-z0-9]+", text.lower())).items()}

    def cosine(a, b):
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    best, name = max((cosine(vector(line), vector(t)), name) for name, texts in license_scan.TEMPLATES.items() for t in texts)
    got = spark.range(1).select(license_scan._best(license_scan._words(F.lit(line)), total, frequency).alias("b")).first()["b"]
    assert got["licence"] == name == wanted and got["similarity"] == pytest.approx(best)


# Packing.


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_pack(edge_docs, edge_rows, near_docs, near_rows, no_docs, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    for docs, rows, length in ((edge_docs, edge_rows, 4096), (near_docs, near_rows, 64)):
        got = packing.pack(docs, tokenizer, length=length, window=4).collect()
        ids = {r[0]: [*plain.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
        total = sum(len(ids[r[0]]) for r in rows)
        assert sum(r["length"] for r in got) == total
        places, seen = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got), 0
        for sequence, offset, n in places:
            assert divmod(seen, length) == (sequence, offset) and offset + n <= length
            seen += n
        pieces = {}
        for r in got:
            own = ids[r["doc_id"]]
            cut = np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["doc_tokens"] == len(own) and zlib.crc32(cut) == r["ids_crc32"]
            assert np.frombuffer(r["ids"], "<u2").tolist() == own[r["start"] : r["start"] + r["length"]]
            pieces.setdefault(r["doc_id"], Counter()).update(range(r["start"], r["start"] + r["length"]))
        times = Counter(r[0] for r in rows)
        assert all(pieces[i] == Counter({k: times[i] for k in range(len(ids[i]))}) for i in times)
    assert packing.pack(no_docs, tokenizer).count() == 0


def test_windows_have_the_mixture():
    sizes = [100_000, 3_000, 41_234, 1]
    plan = packing.Schedule(sizes, 128, 8)
    for w in range(plan.windows):
        own = [plan.served(q, w + 1) - plan.served(q, w) for q in range(4)]
        assert all(abs(n - s / plan.windows) < 1 for n, s in zip(own, sizes, strict=True))
    assert [plan.served(q, plan.windows) for q in range(4)] == sizes
    places = sorted((s, o, n) for q, size in enumerate(sizes) for first in range(0, size, 777) for _, n, s, o in plan.pieces(q, first, min(777, size - first)))
    at = 0
    for s, o, n in places:
        assert s * 128 + o == at
        at += n
    assert at == sum(sizes)


def test_encoder_is_the_tokenizer(tokenizer, edge_rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    texts = [r[1] or "" for r in edge_rows] + ["It's 3.14, isn't it? ÀÉ×÷ß ªº µ²", "x y\x85z\x1cw", "'s 's' d'accord İstanbul ΣΑΣ ΟΔΟΣ", "a" * 300, "!?.,-()[]{}|~`^_ @#$%&* ab,cd e.f.", "é ́e"]
    encode = packing.encoder(tokenizer)
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
