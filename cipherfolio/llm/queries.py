"""The registered queries of the training-data operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherfolio.llm import (
    bag_minhash, byte_transducer, cotraining, exact_dedup, fingerprints, hilbert_codes, language_id, packing, prefix_bpe, ranked_search, sharding, token_blocks, toxicity,
)
from cipherfolio.operators.durable import durable, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.text_model(table(spark, sf_dir, "documents"))
    return language_id.identify(table(spark, sf_dir, "pages"), model).select("page_id", "host", "declared", "text_lang", "lang", F.round("chance", 6).alias("chance"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), hash_rest=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.text_sha256 FROM n JOIN g ON n.text_sha256 = g.text_sha256
"""

def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = cotraining.slim_texts(docs, "doc_id", "text", "lang", "source")
    views = cotraining.train(docs, table(spark, sf_dir, "labels"), slim=slim)
    return cotraining.score_slim(slim, views).withColumn("kept", F.col("score") >= 0.5)


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decode=True)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("names", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    # Written once: numbering reads the slim pieces several times, and none of that should tokenize again.
    slim = durable(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return packing.number_sequences(slim).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "bucket_slot")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document meets half of the next one's text, so the text is shuffled twice and never gathered."""
    return fingerprints_beside_next(table(spark, sf_dir, "documents"))


def fingerprints_beside_next(docs: DataFrame) -> DataFrame:
    """One row per input row, beside the row that follows in descending order of (id, text hash), nulls last.

    Rows that repeat an id and its text stand side by side: each is followed by the next of them, and the last one by the
    next text. So they meet other rows as one row with a count, and their slim results are repeated at the end.
    """
    key = ["_id", "_null", "_hash"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    base = rows.groupBy(*key).agg(F.first("text").alias("text"))
    slim = durable(rows.select(*key, F.expr("char_length(text) div 2").cast("int").alias("taken")).groupBy(*key).agg(F.max("taken").alias("taken"), F.count(F.lit(1)).alias("times")))
    # As (id or null, hash): nulls sort first, and so come last in descending order.
    ids = slim.select(F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "_null", "_hash")
    follows = fingerprints.next_in_descending_order(ids, ties=("_null", "_hash")).select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"), "_null", "_hash", F.coalesce("next_id", F.lit(0)).alias("next_id"), "next__null", "next__hash")
    asked = follows.join(slim, key).select(
        *(F.col(c).alias(f"asker{c}") for c in key), F.col("next_id").alias("_id"), F.col("next__null").alias("_null"), F.col("next__hash").alias("_hash"), "taken", "times")
    lent = asked.join(base, key).select(
        *(F.col(f"asker{c}").alias(c) for c in key), "taken", "times", F.expr("substring(text, 1, taken)").alias("lent"), fingerprints.sketch(F.col("text")).alias("next_sketch"))
    met = base.join(lent, key)
    # A row followed by its own copy borrows from itself; its sketch is the next one's too.
    beside_next = F.struct("lent", "next_sketch", F.lit(1).cast("long").alias("n"))
    beside_copy = F.struct(F.expr("substring(text, 1, taken)").alias("lent"), F.lit(None).cast("array<bigint>").alias("next_sketch"), (F.col("times") - 1).alias("n"))
    sides = met.select(*key, "text", F.explode(F.when(F.col("times") > 1, F.array(beside_next, beside_copy)).otherwise(F.array(beside_next))).alias("side"))
    n_chars = F.char_length("text").cast("long")
    both = sides.select(F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), "text", "side.lent", "side.next_sketch", "side.n", n_chars.alias("n_chars"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), F.col("lent"))
    final = both.select("doc_id", "n", "n_chars", "next_sketch", edited.alias("edited"), fingerprints.sketch(F.col("text")).alias("sketch")).withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    answer = final.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.coalesce("next_sketch", "sketch")).alias("near_next"), "n")
    return answer.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("_copy", "n")


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-blocks")
    token_blocks.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    documents, starts = token_blocks.read_token_files(spark, path)
    slim = documents.select("part", "chunk", "doc_id", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return token_blocks.with_starts(slim, starts).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY term, docs),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY item_id, term),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM n, c),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op12_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = hilbert_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", hilbert_codes.code_text("code").alias("code"), "error", "label_error",
                        F.lit(hilbert_codes.codebooks_sha256(codebooks)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """Two rounds of assignment and floored means, and the last assignment, as plain joins."""
    def assigned(books: str) -> str:
        return f"""(SELECT x.vec_id, x.p, x.v, min({{'d': list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS a
            FROM parts x JOIN {books} b ON x.p = b.p GROUP BY x.vec_id, x.p, x.v)"""

    def refined(books: str) -> str:
        return f"""(WITH u AS (SELECT p, a.e AS e, unnest(v) AS x, unnest(range(len(v))) AS i FROM {assigned(books)}),
            means AS (SELECT p, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM u GROUP BY p, e, i),
            used AS (SELECT p, e, list(x ORDER BY i) AS v FROM means GROUP BY p, e)
            SELECT b.p, b.e, coalesce(used.v, b.v) AS v FROM {books} b LEFT JOIN used ON used.p = b.p AND used.e = b.e)"""

    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, list_transform(embedding[p * w + 1 : (p + 1) * w], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM kept, range(16) r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT p, e, v FROM first JOIN parts USING (vec_id)),
b1 AS MATERIALIZED {refined('b0')},
b2 AS MATERIALIZED {refined('b1')},
final AS (SELECT vec_id, string_agg(printf('%02x', a.e), '' ORDER BY p) AS code, sum(a.d)::BIGINT AS error FROM {assigned('b2')} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM final JOIN kept USING (vec_id), h
"""


def op13_byte_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = byte_transducer.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return rows.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_cotraining": op2_cotraining,
    "op3_prefix_bpe": op3_prefix_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_fingerprints": op8_fingerprints,
    "op9_token_blocks": op9_token_blocks,
    "op10_bag_minhash": op10_bag_minhash,
    "op11_ranked_search": op11_ranked_search,
    "op12_hilbert_codes": op12_hilbert_codes,
    "op13_byte_transducer": op13_byte_transducer,
}
ORACLES = {
    "op6_exact_dedup": OP6_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_hilbert_codes": _op12_sql(),
}
