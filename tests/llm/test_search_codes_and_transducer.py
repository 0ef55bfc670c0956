"""Ranked search, vector codes and the byte transducer: against brute force, tiktoken and exact round trips."""

import base64
import math
import re
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cipherfolio.llm import byte_transducer, hilbert_codes, ranked_search

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ranked_by_definition(docs, items, best=10):
    held = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        found = []
        for (doc, counts), size in zip(held, sizes):
            if not size:
                continue
            m = 25 + 75 * size * n // total
            score = 0
            for term in TERM.findall(lowered(text)):
                if counts[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * counts[term] // (1000 * counts[term] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda x: x[:3])
        rows += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(found[:best], 1)]
    return Counter(rows)


def ranked(docs, items, **options):
    return Counter(tuple(r) for r in ranked_search.rank_documents(docs, items, **options).collect())


def test_ranks_equal_the_definition(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = ranked_by_definition([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ranked(documents, items) == want


def test_ranks_of_odd_rows_in_many_passes(spark, odd_docs, empty_docs):
    docs = odd_docs.unionByName(odd_docs.filter("doc_id IN (1, 2, 14)")).unionByName(odd_docs.filter("doc_id IS NULL"))
    asked = [(1, "one two THREE three"), (1, "seven a"), (None, "four"), (3, None), (4, ""), (5, "!!"), (6, "σίσυφος ΣίΣυφος z"), (7, "wort1 " * 500 + "x1 x2")]
    items = spark.createDataFrame([(*row, "?") for row in asked], "item_id int, text string, doc_id string")
    want = ranked_by_definition([(r.doc_id, r.text) for r in docs.collect()], asked)
    assert ranked(docs, items) == want and ranked(docs, items, pass_terms=40) == want
    assert ranked(empty_docs, items) == Counter() and ranked(docs, items.limit(0)) == Counter()


def test_products_stay_exact():
    rng = np.random.default_rng(5)
    counts, ceilings = rng.integers(0, 4, (30, 5)), rng.integers(1, 1 << 40, 30)
    counts[3, 2], ceilings[3] = 1 << 25, 1 << 30
    impacts = rng.integers(0, ceilings, (7, 30))
    slices = ranked_search.exact_slices(counts, ceilings)
    assert (sum(slices) == counts).all() and len(slices) > 1
    assert all((part.T @ ceilings.astype(float)).max() < 1 << 53 for part in slices)
    total = sum((impacts.astype(float) @ part).astype(np.int64) for part in slices)
    assert total.tolist() == [[sum(int(a) * int(b) for a, b in zip(row, column)) for column in counts.T] for row in impacts]
    assert ranked_search.exact_slices(np.zeros((2, 2), np.int64), np.ones(2, np.int64)) == []


def codes_by_definition(rows):
    size = next(len(v) for _, _, v in sorted((r for r in rows if usable(r[2])), key=lambda r: (r[0] is None, r[0] or 0, r[2])))
    kept = sorted(((i, label, v) for i, label, v in rows if usable(v) and len(v) == size), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    points = np.array([[math.floor(256 * float(np.float32(x))) for x in v] for _, _, v in kept], np.int64).reshape(len(kept), 16, size // 16)
    books = points[:64].transpose(1, 0, 2).copy()

    def nearest():
        far = ((points.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1)

    for _ in range(2):
        codes, _ = nearest()
        for p in range(16):
            for e in range(books.shape[1]):
                mine = points[codes[p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    codes, errors = nearest()
    total = Counter()
    for (_, label, _), error in zip(kept, errors.sum(0)):
        total[label] += int(error)
    out = [(i, "".join(f"{c:02x}" for c in codes[:, k]), int(errors[:, k].sum()), total[label]) for k, (i, label, _) in enumerate(kept)]
    return Counter(out), hilbert_codes.codebooks_sha256(books)


def usable(v):
    return v is not None and len(v) > 0 and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)


SHAPE = "vec_id long, embedding array<float>, label int, code string, _salt string"


def coded(spark, rows, pieces=3):
    frame = spark.createDataFrame([(i, v, label, "?", "?") for i, label, v in rows], SHAPE).repartition(pieces)
    out, books = hilbert_codes.compress(frame)
    found = out.select("vec_id", hilbert_codes.code_text("code"), "error", "label_error").collect()
    return Counter(tuple(r) for r in found), hilbert_codes.codebooks_sha256(books)


@pytest.mark.parametrize("n,size,spread", [(700, 48, 0.2), (90, 16, 3.0), (20, 32, 0.1)])
def test_codes_equal_the_definition(spark, n, size, spread, monkeypatch):
    rng = np.random.default_rng(n)
    vectors = np.float32(rng.normal(0, spread, (n, size)))
    vectors[n // 3 : n // 2] = vectors[0]  # ties, and blocks that one entry decides
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0] * 15, [nan] * size, [0.5] * (size - 1) + [inf], [0.5] * (size - 1) + [None], [0.25] * (size + 16)]
    rows = [(i * 7 % n if i % 50 else 3, None if i % 4 == 0 else i % 3, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(-1 - i if v is None or not usable(v) else n + 5, 1, v) for i, v in enumerate(odd)] + [(None, 2, vectors[1].tolist())]
    want = codes_by_definition(rows)
    assert coded(spark, rows) == want and coded(spark, rows, 1) == want


def test_codes_of_no_rows_and_of_huge_values(spark):
    out, books = hilbert_codes.compress(spark.createDataFrame([], SHAPE))
    assert out.count() == 0 and books.shape == (16, 0, 1)
    assert coded(spark, [(1, 1, None)])[0] == Counter()
    with pytest.raises(Exception, match="lies beyond"):
        coded(spark, [(1, 1, [1e9] * 16)])


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for shape in ((8, 8), (4, 4, 4)):
        cells = np.array(list(np.ndindex(shape)))
        path = cells[np.argsort(hilbert_codes.hilbert_key(cells))]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_short_lists_hold_every_nearest_entry():
    rng = np.random.default_rng(2)
    points, entries = rng.integers(-40, 40, (8000, 4)), rng.integers(-40, 40, (64, 4))
    order = np.argsort(hilbert_codes.hilbert_key(points))
    blocks = hilbert_codes.Blocks(order, points[order])
    listed = blocks.short_lists(entries)
    codes, errors = blocks.assign(entries, np.zeros((64, 4), np.int64), np.zeros(64, np.int64))
    far = ((points[order][:, None] - entries[None]) ** 2).sum(-1)
    assert (codes == far.argmin(1)).all() and (errors == far.min(1)).all()
    assert all(listed[k // hilbert_codes.BLOCK, c] for k, c in enumerate(codes)) and listed.sum() < 0.5 * listed.size


PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "don't", "É", "ß", "12", "%%", "__", "==", "漢", "🙂", "\x1c", "\x85", "　", "é", "ing", "tion", "xx", "x" * 70])


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def machine():
    return byte_transducer.transducer(RANKS, PATTERN)


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.lists(PIECES, max_size=30).map("".join), st.text(max_size=60)))
def test_transducer_equals_the_library(text, library, machine):
    assert list(array("I", machine.encode(text))) == library.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(content=st.one_of(st.binary(max_size=40), st.lists(st.sampled_from([b"=", b"-", b"_", b" ", b"ab", b"ing"]), max_size=60).map(b"".join)))
def test_single_pieces_of_any_bytes(content, library, machine):
    ids = list(machine.run(content))
    whole = library._encode_single_piece(content) if content else []
    assert ids == whole or [machine.ranks.get(content)] == whole
    assert b"".join(machine.bytes_of[i] for i in ids) == content


def test_a_full_memory_changes_nothing(library, machine, documents, monkeypatch):
    texts = [r.text for r in documents.limit(40).collect()]
    small = byte_transducer.Transducer(RANKS, PATTERN)
    monkeypatch.setattr(byte_transducer, "MOST_STATES", 50)
    monkeypatch.setattr(byte_transducer, "MOST_PIECES", 20)
    for text in texts:
        assert list(array("I", small.encode(text))) == library.encode_ordinary(text or "")
    assert len(small.states) <= 50


@settings(max_examples=300, deadline=None)
@given(content=st.one_of(st.binary(max_size=30), st.text(max_size=12).map(str.encode)), cuts=st.lists(st.integers(0, 30), max_size=4))
def test_decoding_a_stream_in_any_cuts(content, cuts):
    stream, held, out, at = byte_transducer.Utf8Stream(), b"", "", 0
    for cut in [*sorted(cuts), len(content)]:
        text, held = stream.step(held, content[at:cut])
        out, at = out + text, max(at, cut)
    assert out + ("�" if held else "") == content.decode("utf-8", "replace")


def test_documents_by_transducer(library, odd_docs, documents, empty_docs):
    for docs in (odd_docs.unionByName(odd_docs.filter("doc_id < 3")), documents):
        encoded = byte_transducer.encode_documents(docs, RANKS, PATTERN, decode=True)
        want = Counter()
        for r in docs.collect():
            ids = library.encode_ordinary(r.text or "")
            want[r.doc_id, array("I", ids).tobytes(), library.decode_bytes(ids)] += 1
        rows = encoded.collect()
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == want
        texts = byte_transducer.decode_documents(encoded, RANKS, PATTERN).collect()
        assert Counter(t.text.encode() for t in texts) == Counter(d for _, _, d in want.elements())
    assert byte_transducer.encode_documents(empty_docs, RANKS, PATTERN).count() == 0
    broken = byte_transducer.decoder(RANKS, PATTERN)
    ids = array("I", [library._mergeable_ranks[bytes([b])] for b in (0xF0, 0x9F, 0x41, 0xE6)]).tobytes()
    assert broken.text(ids) == "�A�" and broken.content(ids) == b"\xf0\x9fA\xe6"
