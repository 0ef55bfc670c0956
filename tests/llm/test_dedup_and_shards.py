"""Sharding, exact and near duplicates, fingerprints: against brute force, with every odd case."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherfolio.llm import bag_minhash, exact_dedup, fingerprints, queries, sharding


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected_copies(rows):
    groups = defaultdict(list)
    for number, text in rows:
        groups[normal(text)].append(number)
    return {(number, normal(text)): (min((x for x in groups[normal(text)] if x is not None), default=None), len(groups[normal(text)])) for number, text in rows}


@pytest.mark.parametrize("hash_rest", [False, True])
def test_exact_copies_with_odd_rows(odd_docs, hash_rest):
    docs = odd_docs.union(odd_docs.filter("doc_id = 6"))  # a repeated row
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected_copies(rows)
    got = exact_dedup.exact_dedup(docs, hash_rest=hash_rest).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for (number, text), (keep, size) in want.items():
        assert {(r.keep_id, r.group_size) for r in by_id[number]} == {(keep, size)}
        assert sum(r.kept for r in by_id[number]) == (number == keep)
        if hash_rest:
            assert bytes(by_id[number][0].full_hash) == hashlib.sha256(text.encode()).digest()
    assert len(by_id[6]) == 2


def test_exact_copies_with_null_ids_only(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a  b")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert [r.keep_id for r in rows] == [None, None] and sum(r.kept for r in rows) == 1


def test_empty_tables_give_no_rows(empty_docs):
    assert exact_dedup.exact_dedup(empty_docs).count() == 0
    assert sharding.shard_by_bytes(empty_docs).count() == 0
    assert bag_minhash.near_duplicates(empty_docs).count() == 0
    assert fingerprints.fingerprint_documents(empty_docs).count() == 0
    assert fingerprints.next_in_descending_order(empty_docs).count() == 0


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_documents(documents):
    rows = sharding.shard_by_bytes(documents, shards=4).collect()
    assert len(rows) == documents.count() and gapless(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.2 * min(sizes.values())
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(x) == 1 for x in where.values())  # equal texts stay together


def test_shards_with_odd_rows_and_a_hot_group(spark, odd_docs):
    rows = sharding.shard_by_bytes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and gapless(rows)
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {1}
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard_by_bytes(hot, shards=8, ranges=256, sample_rows=4096).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert gapless(rows) and len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())  # the hot group is subdivided


def test_rows_that_repeat_id_and_text_are_cut(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("the same text " * 20)).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = sharding.shard_by_bytes(rows.repartition(5), shards=16).collect()
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert len(found) == 3000 and gapless(found) and len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values())


def test_ranges_that_a_sample_leaves_overfull_are_subdivided(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("_group"), F.col("id").alias("_tie"), F.col("id").alias("_row"), F.lit(10).cast("long").alias("size"))
    cuts = sharding.counted_cuts(keys, 200_000, 64, 40)  # far too few sample rows for 64 ranges
    few = sharding.splitters(sharding.weighted_sample(keys, 200_000, 40), 64)
    heaviest = [sharding.with_range(keys, c).groupBy("_range").count().agg(F.max("count")).first()[0] for c in (few, cuts)]
    assert set(few) <= set(cuts) and heaviest[1] < heaviest[0]


def test_written_shards_hold_every_row(spark, documents, tmp_path):
    placed = sharding.shard_by_bytes(documents, shards=4)
    sharding.write_shards(documents, placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 4
    assert spark.read.parquet(str(tmp_path / "shards")).count() == documents.count()


def test_signatures_estimate_weighted_jaccard():
    chance = np.random.default_rng(7)
    off = []
    for _ in range(60):
        base = int(chance.integers(1 << 40))
        left = {base + k: int(chance.integers(1, 7)) for k in range(int(chance.integers(2, 120)))}
        right = {k: (v if chance.random() < 0.8 else int(chance.integers(1, 12))) for k, v in left.items() if chance.random() < 0.9} or dict(left)
        bags = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (left, right)]
        true = sum(min(left[k], right.get(k, 0)) for k in left) / sum(max(left.get(k, 0), right.get(k, 0)) for k in left | right)
        signed = bag_minhash.signatures(bags, 512)
        off.append((signed[0] == signed[1]).mean() - true)
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.04


def brute_classes(rows):
    bags = [bag_minhash.shingles(text) for _, text in rows]
    holds = defaultdict(list)
    for i, (hashes, _) in enumerate(bags):
        for h in hashes.tolist():
            holds[h].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(x[j], x[i]) for x in holds.values() for i in range(len(x)) for j in range(i)}
    none = [i for i, b in enumerate(bags) if not len(b[0])]
    pairs |= {(none[0], i) for i in none[1:]}
    for i, j in pairs:
        if bag_minhash.overlap(rows[i][1], rows[j][1]) >= bag_minhash.SIMILARITY:
            a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
            parent[b] = a
    return {number: rows[find(i)][0] for i, (number, _) in enumerate(rows)}


def test_near_copies_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = bag_minhash.near_duplicates(documents).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)


def test_near_copies_in_one_large_family(spark):
    chance = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):  # each differs from the first in up to two words, so many pairs fall below the threshold
        text = list(words)
        for at in chance.integers(0, 200, 2):
            text[at] = f"v{i}x{at}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, f"alone {i} with words of its own {i * i} and more {i}") for i in range(20)]
    got = bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    sizes = Counter(brute_classes(rows).values())
    assert max(sizes.values()) > 75 and all(r.class_size == sizes[r.class_id] for r in got)


def test_near_copies_with_odd_rows(odd_docs):
    docs = odd_docs.union(odd_docs.filter("doc_id = 6"))
    got = bag_minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    assert {k: r.class_id for k, r in known.items()} == brute_classes(rows)
    assert known[3].class_id == known[4].class_id == known[5].class_id == 3 and known[6].class_size == 3
    assert sum(r.kept for r in got if r.doc_id == 6) == 1
    assert [(r.class_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_copies_of_ids_with_several_texts(spark):
    a, b = ("one two three four five six seven", "quite another text with words of its own here")
    rows = [(5, a), (5, b), (7, a), (9, b), (5, a), (-3, "alone"), (None, a)]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(None if i is None else i if kind == "long" else str(i), t) for i, t in rows], f"doc_id {kind}, text string")
        got = Counter((None if r.doc_id is None else int(r.doc_id), None if r.class_id is None else int(r.class_id), r.class_size, r.kept) for r in bag_minhash.near_duplicates(docs).collect())
        assert got == Counter({(5, 5, 3, True): 1, (5, 5, 3, False): 1, (7, 5, 3, False): 1, (5, 5, 2, True): 1, (9, 5, 2, False): 1, (-3, -3, 1, True): 1, (None, None, 1, True): 1})


def shingle_set(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_sketches_against_sets(spark, documents):
    rows = fingerprints.fingerprint_documents(documents).alias("a")
    texts = {r.doc_id: r.text for r in documents.collect()}
    after = fingerprints.next_in_descending_order(documents)
    assert {(r.doc_id, r.next_id) for r in after.collect()} == {(i, i - 1 if i else max(texts)) for i in texts}
    half = documents.select("doc_id", F.expr("substring(text, 1, int(length(text) * 3 / 4))").alias("text"))
    other = fingerprints.fingerprint_documents(half).select("doc_id", F.col("sketch").alias("half"))
    met = rows.join(other, "doc_id").select(
        "doc_id", "shingles", fingerprints.resemblance(F.col("sketch"), F.col("half")).alias("near"), fingerprints.containment(F.col("half"), F.col("sketch")).alias("inside"),
        (fingerprints.merge(F.col("sketch"), F.col("half")) == fingerprints.sketch(F.col("text"))).alias("same")).collect()
    for r in met:
        whole, part = shingle_set(texts[r.doc_id]), shingle_set(texts[r.doc_id][: len(texts[r.doc_id]) * 3 // 4])
        true = len(whole & part) / len(whole | part) if whole | part else 1
        assert abs(r.near - true) < 0.2 and r.inside >= 0.6 * len(whole & part) / max(len(part), 1)
        assert abs(r.shingles - len(whole)) <= 0.4 * len(whole)
        if len(whole) < 100:
            assert r.near == pytest.approx(true) and r.shingles == len(whole)


def test_sketches_with_odd_rows_and_groups(odd_docs):
    rows = fingerprints.fingerprint_documents(odd_docs)
    found = {r.doc_id: r for r in rows.collect()}
    assert len(found) == odd_docs.count()
    assert found[3].sketch == [] and found[3].n_chars == 0 and found[1].sketch == found[2].sketch and len(found[10].sketch) == 1
    both = rows.filter("doc_id in (8, 9)").withColumn("all", F.lit(1))
    merged = fingerprints.merge_groups(both, ["all"]).first().sketch
    assert merged == sorted({*found[8].sketch, *found[9].sketch})[: fingerprints.SKETCH]
    empty = rows.filter("doc_id in (3)").select(fingerprints.resemblance(F.col("sketch"), F.col("sketch")).alias("x"), fingerprints.distinct_shingles(F.col("sketch")).alias("n")).first()
    assert (empty.x, empty.n) == (1.0, 0.0)


def test_fingerprint_query_with_odd_and_repeated_rows(odd_docs, empty_docs):
    docs = odd_docs.union(odd_docs.filter("doc_id in (6, 14)")).union(odd_docs.filter("doc_id = 6")).union(odd_docs.filter("doc_id = 2").withColumn("text", F.lit("other text")))
    docs = docs.union(odd_docs.filter("doc_id is null")).union(odd_docs.filter("doc_id is null").withColumn("text", F.lit("q w e r t y")))
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    want = Counter()
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        n = len(r.text)
        edited = r.text[: n - n // 2] + after.text[: n // 2]
        want[r.doc_id, n, hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = queries.fingerprints_beside_next(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(r.near_next is not None and r.near_edited is not None for r in got)
    assert sorted(r.near_next for r in got if r.doc_id == 6)[1:] == [1.0, 1.0]
    assert queries.fingerprints_beside_next(empty_docs).count() == 0


def test_components_of_few_links_are_few_tasks_in_many_partitions(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 80)]
    pairs = [(1000 + 2 * i, 1001 + 2 * i) for i in range(40)] + [(1001, 1040), (100, 100), (90, 60)]
    keys = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    context = spark.sparkContext
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        context.setJobGroup("components-tasks", "links of components")
        got = {r.node: r.root for r in bag_minhash.components(spark.createDataFrame(chain + star + pairs, "a long, b long")).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    parent = {x: x for pair in chain + star + pairs for x in pair}
    for _ in parent:
        for a, b in chain + star + pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("components-tasks") for s in tracker.getJobInfo(job).stageIds}
    tasks = [info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s))]
    assert sum(tasks) < 24 * len(tasks), (len(tasks), sum(tasks))


def family_of_bags(chance, rows, size, low, high):
    base = chance.integers(0, 1 << 63, size).astype(np.uint64)
    found = []
    for i in range(rows):
        own = chance.random(size) < chance.uniform(low, high)
        hashes, counts = np.unique(np.concatenate([base[own], chance.integers(0, 1 << 63, size - own.sum()).astype(np.uint64)]), return_counts=True)
        found.append((hashes, counts + chance.integers(0, 4, len(counts)) if i % 5 == 0 else counts))
    return found


def test_pairs_of_a_family_are_exact_and_few_others_are_counted():
    chance = np.random.default_rng(11)
    left, right = family_of_bags(chance, 60, 400, 0.75, 0.99), family_of_bags(chance, 40, 300, 0.75, 0.99)
    right += left[:25] + [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    wanted = chance.random((len(left), len(right))) < 0.9
    got = list(bag_minhash.alike(list(map(bag_minhash.features, left)), list(map(bag_minhash.features, right)), wanted, 0.8))
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if wanted[i, j] and bag_minhash.overlap_of_bags(a, b) >= 0.8}
    assert len(got) == len(set(got)) and set(got) == want and 25 < len(want) < 1000
    below = [bag_minhash.features(b) for b in family_of_bags(chance, 200, 400, 0.7, 0.87)]
    sizes = np.array(list(map(len, below)), float)
    most = bag_minhash.most_common(below, below)
    exact = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in below[:40]] for a in below[:40]])
    assert (most[:40, :40] >= exact).all()
    assert (most / (sizes[:, None] + sizes - most) >= 0.8).sum() < 200 + 0.02 * 200 * 200


def test_a_family_of_many_blocks_is_compared_without_its_texts(spark, monkeypatch):
    chance = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        text = list(words)
        for at in chance.integers(0, 120, 3 if i % 3 else 1):
            text[at] = f"v{i}x{at}"
        rows.append((i, " ".join(text)))
    seen, durable = [], bag_minhash.durable
    monkeypatch.setattr(bag_minhash, "durable", lambda frame: seen.append(frame.columns) or durable(frame))
    monkeypatch.setattr(bag_minhash, "BLOCK_HEADS", 12)
    got = bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    families = [columns for columns in seen if "family" in columns]
    assert families and not [columns for columns in families if "text" in columns], families


def test_signing_long_texts_holds_few_of_them():
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"w{i}x{j}" for j in range(6_000)) for i in range(64)] + ["", None, "a b c " * 400]
    tracemalloc.start()
    try:
        got = np.concatenate([bag_minhash.signatures(bags) for _, bags in bag_minhash.together(pa.array(texts), 5)])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        bag_minhash.REMEMBERED.clear()
    assert peak < 110e6, peak
    assert (got == np.concatenate([bag_minhash.signatures([bag_minhash.shingles(text)]) for text in texts])).all()
