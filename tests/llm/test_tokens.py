"""Encoding, packing and token files: against the tokenizers library and exact round trips."""

import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cipherfolio.llm import packing, prefix_bpe, token_blocks, word_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "don't", "É", "Σ", "ß", "12", "%%", "!!", "漢", "🙂", "\x1c", "\x85", " ", "　", "é", "<|endoftext|>", "İ", "x" * 70])


@pytest.fixture(scope="module")
def libraries():
    return {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}


def by_library(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_both_encoders_equal_the_library(text):
    tokenizers = {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)} if not CACHE else CACHE
    CACHE.update(tokenizers)
    ids = by_library(tokenizers[BYTES], text)
    assert list(array("I", prefix_bpe.prefix_bpe(BYTES).ids(text))) == ids
    assert prefix_bpe.prefix_bpe(BYTES).text(array("I", ids).tobytes()) == tokenizers[BYTES].decode(ids, skip_special_tokens=False)
    assert list(array("I", word_tokens.word_ids(WORDS).ids(text))) == by_library(tokenizers[WORDS], text)


CACHE: dict = {}


def test_broken_utf8_decodes_as_the_library_does(libraries):
    for ids in ([149], [149, 220, 162], [50256, 149], []):
        assert prefix_bpe.prefix_bpe(BYTES).text(array("I", ids).tobytes()) == libraries[BYTES].decode(ids, skip_special_tokens=False)


def test_documents_encode_and_decode(libraries, odd_docs, documents, empty_docs):
    for docs in (odd_docs, documents):
        rows = prefix_bpe.encode_documents(docs, BYTES, decode=True).withColumn("back", prefix_bpe.decoded("ids", BYTES)).collect()
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert len(rows) == docs.count()
        for r in rows:
            ids = by_library(libraries[BYTES], texts[r.doc_id])
            assert list(array("I", r.ids)) == ids and r.back == r.decoded == (texts[r.doc_id] or "") and r.names == ",".join(map(str, ids))
    assert prefix_bpe.encode_documents(empty_docs, BYTES).count() == 0


def test_packing_cuts_every_document_into_binary_lengths(libraries, odd_docs, empty_docs):
    pieces = packing.pack_documents(odd_docs, WORDS)
    slim = packing.number_sequences(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("crc"), "doc_tokens"))
    rows = slim.collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for number, text in texts.items():
        ids = array("I", [*by_library(libraries[WORDS], text), word_tokens.END_ID])
        own = sorted((r for r in rows if r.doc_id == number), key=lambda r: r.start)
        assert [r.length for r in own] == packing.binary_lengths(len(ids)) and sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and r.crc == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids) and r.length & (r.length - 1) == 0
            at += r.length
    for bucket in {r.bucket for r in rows}:
        assert sorted(r.bucket_slot for r in rows if r.bucket == bucket) == list(range(sum(r.bucket == bucket for r in rows)))
    assert packing.pack_documents(empty_docs, WORDS).count() == 0
    with pytest.raises(ValueError):
        packing.binary_lengths(5, 1000)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=1600), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_blocks_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    chunk = token_blocks.Chunk(token_blocks.write_chunk([5, 6], [len(ids), 0], ids, percentile))
    assert (chunk.ids() == ids).all() and chunk.doc_ids.tolist() == [5, 6] and chunk.lengths.tolist() == [len(ids), 0]
    for start, stop in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
        assert (chunk.slice(start, stop) == ids[start:stop]).all()


def test_ids_are_narrowed_where_they_fit():
    for ids in ([], [1], [65535, 0], [65536, 1], [2**32 - 1]):
        packed = token_blocks.narrow(np.array(ids, np.uint32).tobytes())
        assert token_blocks.widened(packed).tolist() == ids and len(packed) == 1 + len(ids) * (2 if max(ids, default=0) < 65536 else 4)


def test_blocks_are_smaller_than_plain_ids():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 50_000), 49_000).astype(np.uint32)
    assert len(token_blocks.write_chunk([1], [len(ids)], ids)) < 0.7 * 4 * len(ids)


def test_token_files_read_back(spark, libraries, odd_docs, empty_docs, tmp_path):
    path = str(tmp_path / "tokens")
    # Null ids, one id with several texts, and equal rows.
    docs = odd_docs.unionByName(odd_docs.filter("doc_id IN (1, 9)").withColumn("doc_id", F.lit(2).cast("long"))).unionByName(odd_docs.filter("doc_id IN (2, 6) OR doc_id IS NULL"))
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: r[:2])
    for run in ("1", "2"):
        token_blocks.write_token_files(docs.repartition(int(run) * 3), path + run, WORDS, chunk_ids=1000, part_bytes=50_000)
    runs = [token_blocks.with_starts(*token_blocks.read_token_files(spark, path + run)).collect() for run in ("1", "2")]
    found = [sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in rows), key=lambda r: r[0]) for rows in runs]
    assert spark.read.parquet(path + "1").select("part").distinct().count() > 3
    assert found[0] == found[1], "the order of repeated ids does not depend on the run"
    assert [(i is not None, i or 0) for _, i, _, _ in found[0]] == [r[:2] for r in want]
    ids_of = {text: [*by_library(libraries[WORDS], text), word_tokens.END_ID] for _, _, text in want}
    assert sorted((i is not None, i or 0, ids) for _, i, _, ids in found[0]) == sorted((known, i, array("I", ids_of[text]).tobytes()) for known, i, text in want)
    at = 0
    for start, _, n, _ in found[0]:
        assert start == at
        at += n
    token_blocks.write_token_files(empty_docs, path + "3", WORDS)
    assert token_blocks.with_starts(*token_blocks.read_token_files(spark, path + "3")).count() == 0
