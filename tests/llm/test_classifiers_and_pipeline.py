"""Toxicity, quality, language and the pipeline: held-out accuracy, brute force for stages, every odd case."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cipherfolio.llm import bag_minhash, cotraining, language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_unseen_misspellings_are_toxic():
    chance = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(300)]
    bad = ["blockhead", "nitwit", "scoundrel"]

    def text(extra):
        return " ".join([*chance.choice(plain, 30), *extra])

    sample = [(text([]), 0) for _ in range(150)] + [(text(chance.choice(bad, 2)), 1) for _ in range(150)]
    model = toxicity.fit(sample)

    def score(words):
        return model.bias + toxicity.mean_scores([words], model.weights.astype(np.float32))[0]

    assert score(text(["blockheed", "scoundrell"])) > 0 > max(score(text([])) for _ in range(20))


def test_toxicity_of_held_out_rows(larger):
    docs, labels = larger
    sample = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 5)
    assert len(sample) == 10 and sum(label for _, label in sample) == 5
    rows = toxicity.score_documents(docs, toxicity.train(docs, labels)).join(labels, "doc_id").withColumn("out", toxicity.held_out()).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    taught = [r for r in rows if not r.out]
    clean = [r.score < 0.5 for r in rows if not r.toxic]
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in taught]) > 0.97 and np.mean(clean) > 0.96


def test_toxic_rows_held_out_are_caught(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = labels.filter(toxicity.held_out() & F.col("toxic").isNotNull())
    rows = toxicity.score_documents(docs.join(unseen.select("doc_id"), "doc_id", "left_semi"), toxicity.train(docs, labels)).join(unseen, "doc_id").collect()
    toxic, clean = ([r.score >= 0.5 for r in rows if r.toxic == label] for label in (1, 0))
    # 282 toxic rows to learn from; on ten times as many labels the recall is 0.99.
    assert len(toxic) > 60 and np.mean(toxic) > 0.6 and np.mean(clean) < 0.03


def test_a_repeated_drawn_id_reaches_the_driver_once(spark):
    rows = [(1, f"text {i}") for i in range(50)] + [(2, "b"), (4, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    assert len(toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", 5)) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 4))


def test_grams_of_many_words_are_those_of_each():
    from cipherfolio.llm import subwords

    words = ["", "a", "ab", "Straße", "x" * 40, "漢字🙂", "BUY!!"]
    word_of, bucket = subwords.grams_of(words)
    for i, word in enumerate(words):
        marked = f"<{word}>"
        own = bucket[word_of == i].tolist()
        assert own == subwords.grams(word) and len(own) == 1 + sum(max(0, len(marked) - n + 1) for n in (3, 4, 5))
    counts = subwords.WordCounts.of([["a", "b", "a"], [], ["b"]])
    assert counts.sums(np.array([10.0, 1.0])).tolist() == [21.0, 0.0, 1.0]
    weights = np.random.default_rng(1).standard_normal((2, subwords.BUCKETS))
    every = subwords.grams("a") * 2 + subwords.grams("b")
    assert np.allclose(counts.mean_weights(weights)[0], weights[:, every].mean(axis=1)) and (counts.mean_weights(weights)[1] == 0).all()


def test_toxicity_of_odd_rows(spark, odd_docs, empty_docs, larger):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (7, 0), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score_documents(odd_docs, model, keep=("kept",)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.kept == "?" for r in rows)
    none = toxicity.train(odd_docs, labels.limit(0))
    assert {r.score for r in toxicity.score_documents(odd_docs, none).collect()} == {0.5}
    assert toxicity.score_documents(empty_docs, model).count() == 0
    assert toxicity.train(empty_docs, labels).bias == 0.0


def test_quality_by_two_views(larger):
    docs, labels = larger
    taught = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 0)
    views = cotraining.train(docs, taught)
    rows = cotraining.score_documents(docs, views).join(labels.filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 0), "doc_id").collect()
    assert np.mean([r.score >= 0.5 for r in rows if r.quality]) > 0.97
    assert np.mean([r.score < 0.5 for r in rows if not r.quality]) > 0.8


def test_pseudo_labels_teach_the_other_view():
    chance = np.random.default_rng(2)

    def page(good):
        words = chance.choice(["alpha", "beta", "gamma"] if good else ["SPAM!!", "BUY%%%", "NOW!!"], 40)
        return (" ".join(words), "en", "good.host" if good else "bad.host")

    labelled = [page(i % 2) for i in range(20)]
    pool = [page(i % 2) for i in range(200)]
    views = cotraining.cotrain(labelled, [i % 2 for i in range(20)], pool)
    scores = [views.meta.logit(cotraining.prepare([page(g)], cotraining.BUCKETS).meta)[0] for g in (0, 1)]
    assert scores[0] < 0 < scores[1]


def test_quality_scores_mean_the_same_when_classes_are_sampled(larger):
    docs, labels = larger
    whole, sampled = cotraining.train(docs, labels), cotraining.train(docs, labels, per_class=58)
    assert whole.prior == sampled.prior > 1.5
    truth = {r.doc_id: r.quality for r in labels.collect()}
    scores = [{r.doc_id: r.score for r in cotraining.score_documents(docs, v).collect() if r.doc_id in truth} for v in (whole, sampled)]
    assert all(np.mean([(s[i] >= 0.5) == bool(truth[i]) for i in s]) > 0.95 for s in scores)


def test_class_weights_undo_a_sample_by_class():
    chance = np.random.default_rng(3)
    labels = (np.arange(4000) % 8 != 0).astype(int)
    rows = (chance.standard_normal(4000) + labels)[:, None]
    few = np.concatenate([np.nonzero(labels == 0)[0], np.nonzero(labels == 1)[0][:500]])
    whole, sampled = cotraining.Logistic.fit(rows, labels), cotraining.Logistic.fit(rows[few], labels[few], (500, 3500))
    assert abs(whole.logit(np.zeros((1, 1)))[0] - sampled.logit(np.zeros((1, 1)))[0]) < 0.3


def test_rare_unlabelled_pages_teach_the_content_view(spark):
    plain = [(i, f"alpha beta gamma x{i % 50}" if i % 2 else f"SPAM!! BUY%%% x{i % 50}", "en", "good.host" if i % 2 else "bad.host") for i in range(3000)]
    order = spark.range(10_000, 20_000).orderBy(F.xxhash64("id").desc()).limit(3).collect()  # last in the order of the hash
    rare = [(r.id, f"QUILLOP!! ZYX%%% x{n}", "en", "bad.host") for n, r in enumerate(order)]
    docs = spark.createDataFrame(plain + rare, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    views = cotraining.train(docs, labels)
    assert views.buckets[cotraining.grams("QUILLOP!!")].min() < 0 and views.buckets[cotraining.grams("QUILLOP!!")].max() <= 0


def test_sources_have_buckets_of_their_own():
    rows = cotraining.prepare([("a", "en", f"src{i}") for i in range(20)], cotraining.BUCKETS).meta
    assert len(np.unique(rows, axis=0)) == 20


def test_slim_texts_say_what_texts_say(spark, odd_docs, documents):
    for docs in (odd_docs, documents):
        slim = cotraining.slim_texts(docs, "doc_id", "text", "lang", "source")
        views = cotraining.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), slim=slim)
        left, right = cotraining.score_slim(slim, views).collect(), cotraining.score_documents(docs, views).collect()
        assert len(left) == len(right) == docs.count()
        assert sorted((r.doc_id or -1, round(r.score, 9)) for r in left) == sorted((r.doc_id or -1, round(r.score, 9)) for r in right)


def test_layout_of_words():
    looks = cotraining.looks_of(["ABC", "aB!", "", "🙂x", "A", "É9%"])
    assert looks.tolist() == [[3, 3, 0, 1], [2, 1, 0, 0], [0, 0, 0, 0], [1, 0, 1, 0], [1, 1, 0, 0], [1, 1, 1, 0]]


def test_quality_of_odd_rows(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (7, 0), (999, 1)], "doc_id long, quality int")
    views = cotraining.train(odd_docs, labels)
    rows = cotraining.score_documents(odd_docs, views, keep=("score_kept",) if "score_kept" in odd_docs.columns else ()).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = cotraining.train(odd_docs, labels.limit(0))
    assert {round(r.score, 6) for r in cotraining.score_documents(odd_docs, none).collect()} == {0.5}
    assert cotraining.score_documents(empty_docs, views).count() == 0
    assert cotraining.score_documents(odd_docs, cotraining.train(empty_docs, labels)).count() == odd_docs.count()


@pytest.fixture(scope="module")
def model(larger):
    return language_id.text_model(larger[0])


def test_language_without_declaration(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace("html", "<html lang=\"..\">", "<html>"))
    rows = language_id.identify(bare, model).join(pages.select("page_id", F.regexp_extract("url", "/(..)/\\d+", 1).alias("true")), "page_id").collect()
    assert np.mean([r.lang == r.true for r in rows]) > 0.97 and {r.declared for r in rows} == {"none"}


def test_host_and_declaration_decide_for_pages_without_text(spark, model, larger):
    text = {r.lang: r.text for r in larger[0].filter("n_chars > 400").select("lang", "text").dropDuplicates(["lang"]).collect()}
    rows = [(i, f"http://a.fr.example/{i}", f"<html lang=fr><p>{text['fr']}</p></html>") for i in range(30)]
    rows += [(100 + i, f"http://b.de.example/{i}", f"<html lang=de><p>{text['de']}</p></html>") for i in range(30)]
    rows += [(200, "http://a.fr.example/x", None), (201, "http://b.de.example/x", ""), (202, None, "<html lang='fr'></html>"), (None, "http://[broken", f"<p>{text['es']}"), (203, "", "<html lang=zz>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("?"), "own": F.lit("?"), "chances": F.lit("?")})
    found = language_id.identify(pages, model).collect()
    by_id = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    assert by_id[200].lang == "fr" and by_id[201].lang == "de" and by_id[202].lang == "fr" and by_id[None].lang == "es" and by_id[203].declared == "other"
    assert all(abs(sum(r.chances) - 1) < 1e-9 for r in found)
    assert language_id.identify(pages.limit(0), model).count() == 0


def test_language_without_labels(spark, empty_docs):
    nothing = language_id.text_model(empty_docs)
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id long, url string, html string")
    assert [r.lang for r in language_id.identify(pages, nothing).collect()] == [None]


def test_pipeline_stages_one_by_one(spark, larger, tmp_path):
    docs = larger[0]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    columns, frames = docs.columns, [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    ids = [{r.doc_id for r in f.select("doc_id").distinct().collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and all(f.columns == columns for f in frames[1:-1])
    labels = {r.doc_id: r for r in larger[1].collect()}
    clean = [i for i, r in labels.items() if not r.toxic and r.quality]
    assert sum(i in ids[2] for i in clean) > 0.96 * len(clean)
    texts = {r.doc_id: " ".join((r.text or "").split(" ")) for r in frames[2].collect()}
    import re
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", texts[i]), i)
    assert ids[3] == set(first.values())
    kept = frames[4].collect()
    bags = [bag_minhash.shingles(r.text) for r in kept]
    holds: dict[int, list[int]] = {}
    for i, (hashes, _) in enumerate(bags):
        for h in hashes.tolist():
            holds.setdefault(h, []).append(i)
    pairs = {(x[j], x[i]) for x in holds.values() for i in range(len(x)) for j in range(i)}
    assert not [1 for i, j in pairs if bag_minhash.overlap(kept[i].text, kept[j].text) >= 0.8]
    assert ids[5] == ids[4]


def test_pipeline_stages_on_odd_and_empty_rows(spark, odd_docs, empty_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert name == "packing" or stage(spark, odd_docs, SF).count() <= odd_docs.count()
        assert stage(spark, empty_docs, SF).count() == 0
    assert stage(spark, odd_docs, SF).select("doc_id").distinct().count() == odd_docs.count()


def test_one_row_of_each_group_stays_when_ids_repeat(spark):
    near = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, near), (2, near + " end"), (2, other), (2, other), (3, "a b c"), (3, "a b c"), (3, "a  b c"), (None, "a b c"), (None, "d e f"), (None, "d e f"), (None, "g h i"), (-4, "g h i")]
    docs = spark.createDataFrame([(i, text, "en", None, len(text)) for i, text in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def found(frame):
        return sorted(((r.doc_id, (r.text or "").replace("  ", " ")) for r in frame.collect()), key=str)

    exact = corpus_pipeline.without_copies(spark, docs, SF)
    assert found(exact) == sorted([(1, near), (2, near + " end"), (2, other), (3, "a b c"), (None, "d e f"), (-4, "g h i")], key=str)
    want = sorted([(1, near), (2, other), (3, "a b c"), (None, "d e f"), (-4, "g h i")], key=str)
    assert found(corpus_pipeline.without_near_copies(spark, docs, SF)) == found(corpus_pipeline.without_near_copies(spark, exact, SF)) == want


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 11))


def test_fitting_the_toxicity_model_holds_little_more_than_its_entries():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnop"))
    words = ["".join(rng.choice(letters, 7)) for _ in range(900)]
    sample = [(" ".join(rng.choice(words, 250)) + (" toxin" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(600)]
    entries = len(toxicity.bags([text for text, _ in sample], toxicity.BUCKETS)[0])
    tracemalloc.start()
    model = toxicity.fit(sample, epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any()
    assert peak < 16 * entries + 24_000_000, (peak, entries)  # arrays of all buckets and of one part do not grow with the sample


def test_weighing_a_large_dictionary_holds_few_of_its_grams():
    from cipherfolio.llm import subwords

    words = [f"w{i * 7919}ä{i}" for i in range(60_000)]
    weights = np.random.default_rng(3).standard_normal((4, subwords.BUCKETS)).astype(np.float32)
    counts = subwords.WordCounts.of([words[:40_000], words[20_000:], []])
    word_of, bucket = subwords.grams_of(words)
    sums = np.stack([np.bincount(word_of, model[bucket], len(words)) for model in weights])
    each = np.bincount(word_of, minlength=len(words))
    tracemalloc.start()
    try:
        got = counts.mean_weights(weights)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24e6, peak
    want = [sums[:, own].sum(axis=1) / each[own].sum() for own in (slice(0, 40_000), slice(20_000, None))]
    assert np.allclose(got[:2], want) and (got[2] == 0).all()


def test_a_scored_text_travels_once_and_long_texts_in_small_pieces(spark, odd_docs):
    import pyarrow as pa

    calibrated = (cotraining.Logistic(), cotraining.Logistic())
    views = cotraining.Views(np.zeros(cotraining.BUCKETS, np.float32), cotraining.Logistic(), cotraining.Metadata.fit(np.zeros((0, cotraining.LAYOUT + 2)), np.zeros(0)), calibrated, 0.0)
    keep = ("n_chars", "text", "source", "kept")
    for scored in (cotraining.score_documents(odd_docs, views, keep=keep), toxicity.score_documents(odd_docs, toxicity.Model(np.zeros(cotraining.BUCKETS), 0.0), keep=keep)):
        sent = scored._jdf.queryExecution().optimizedPlan().toString()
        sent = [line for line in sent[sent.index("MapInArrow"):].splitlines() if "Project" in line][0]
        assert sent.count("text#") == 1, sent
        assert sorted(map(str, scored.select("doc_id", *keep).collect())) == sorted(map(str, odd_docs.select("doc_id", *keep).collect()))
    long = "x" * (cotraining.TOGETHER_CHARS // 2)
    assert list(cotraining.pieces(pa.array([long, long, None, "a", long * 3, "b"]))) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert list(cotraining.pieces(pa.array(["a"] * 1500))) == [(0, 1024), (1024, 1500)] and not list(cotraining.pieces(pa.array([], pa.string())))
