"""Byte-level BPE, importance resampling and whitening against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm.bpe import DECODED, IDS, OFFSETS, Vocabulary, decode, encode, merge_heap, merge_plain
from plumbline.llm.eigen import leading_pairs
from plumbline.llm.pretoken_scan import AFTER, SYMBOLS, boundaries, class_table, functions, states_before
from plumbline.llm.queries import QUERIES, RANKS
from plumbline.llm.resampling import resample
from plumbline.llm.span_crc import span_crcs
from plumbline.llm.whitening import whiten

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(RANKS)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def odd_texts():
    rng = random.Random(11)
    letters = list("abstmdrelv''''  \n\t 12!?.é日ñ") + [" ", "²", "Ᲊ", "\U0001e5f0", "😀", "́"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    spread = ["".join(chr(c) for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in range(0, 0x20000, 512)]
    return [*made, *spread, "", " ", "a" * 3000, " " * 3000, "'" * 999, "x's'll\n've 'd<|endoftext|>"]


def test_encoder_equals_the_library(vocabulary, library):
    texts = odd_texts()
    ids, offsets, counts = vocabulary.encode(texts, class_table(PATTERN))
    at = 0
    for text, n in zip(texts, counts):
        own = ids[at : at + n].tolist()
        assert own == library.encode_ordinary(text)
        size = [len(library.decode_single_token_bytes(i)) for i in own]
        assert offsets[at : at + n].tolist() == [sum(size[:i]) for i in range(n)] if n < 50 else True
        at += n
    data, sizes = vocabulary.decode(ids, offsets, counts)
    assert data.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(t.encode()) for t in texts]


def test_scan_equals_a_walk():
    sym = np.random.default_rng(2).integers(0, SYMBOLS, 5000).astype(np.uint8)
    state, want = 0, []
    for s in sym:
        want.append(state)
        state = AFTER[state, s]
    for block in (1, 7, 128, 9999):
        assert states_before(sym, block).tolist() == want
    apply, _, compose = functions()
    for f in range(len(apply)):
        for g in range(len(apply)):
            assert (apply[compose[f, g]] == apply[g][apply[f]]).all()
    assert boundaries([], class_table(PATTERN)) == []


def test_both_ways_of_merging_agree(vocabulary):
    rng = random.Random(3)
    for _ in range(500):
        piece = bytes(rng.choice(b"abcdethe \xc3\xa9") for _ in range(rng.randint(0, 90)))
        assert merge_plain(vocabulary.ranks, piece) == merge_heap(vocabulary.ranks, piece)


def test_tokens_of_a_table(spark, library):
    texts = [None, "", "the cat's hat", "the cat's hat", "x" * 200_000 + " é", "日本 12"]
    rows = [(i if i != 1 else None, t, "n", [1], "o") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids array<int>, _pl_ids string")
    got = decode(encode(docs, RANKS), RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        text = r.text or ""
        assert r[IDS] == library.encode_ordinary(text) and bytes(r[DECODED]) == text.encode()
        assert (r.n_tokens, r.ids) == ("n", [1])
    # Any run of tokens decodes alone, and without offsets.
    part = encode(docs, RANKS).select(F.slice(IDS, 2, 2).alias("some"), F.col(IDS))
    for r in decode(part, RANKS, ids="some", offsets=None).collect():
        assert bytes(r[DECODED]) == library.decode_bytes(r[IDS][1:3])
    none = decode(spark.createDataFrame([(None, None)], f"{IDS} array<int>, {OFFSETS} array<int>"), RANKS).first()
    assert bytes(none[DECODED]) == b""
    assert decode(encode(docs.limit(0), RANKS), RANKS).count() == 0


def test_byte_bpe_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(",".join(map(str, ids)).encode())
        assert r.decoded_sha256 == digest((docs[r.doc_id] or "").encode())


def test_span_checksums():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 50_000, dtype=np.uint8)
    length = np.r_[np.arange(1, 300), [1023, 1024, 1025, 20_000, 49_999]]
    start = rng.integers(0, 50_000 - length + 1)
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, length)]
    assert span_crcs(data, start, start + length).tolist() == want
    assert span_crcs(data, start[:5], start[:5] + 3).tolist() == [zlib.crc32(data[a : a + 3].tobytes()) for a in start[:5]]


def drawn(docs, target, shortest, longest, buckets, least, percent):
    """(doc_id, n_features, weight, score) per document, and the ids drawn in order."""
    def bag(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        runs = [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    bags = [bag(t) for _, t in docs]
    s, t = Counter(b for _, own in bags for b in own), Counter(b for x in target for b in bag(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for (doc_id, _), (words, own) in zip(docs, bags):
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    able = [r for r in out if r[4] >= least]
    first = sorted(able, key=lambda r: (-r[3], r[0] is not None, r[0]))[: percent * len(able) // 100]
    return [r[:4] for r in out], [r[0] for r in first]


@pytest.mark.parametrize("how", [(1, 1, 10_000, 20, 10), (1, 2, 97, 3, 50), (2, 3, 1000, 0, 100)])
def test_resampling_equals_a_plain_draw(spark, how):
    rng = random.Random(8)
    words = ["Alpha", "beta9", "ünï", "日本", "x" * 150, "é" * 700, "ΑΒΓ", "--", "don't", "A1"]
    docs = [(i, "".join(rng.choice(words) + rng.choice(" \n.\x00_ ") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, docs[0][1]), (900, None), (901, ""), (902, " .. "), (903, "word " * 50_000)]
    target = [(docs[i][1][:200],) for i in range(20)] + [(None,), ("",)]
    shortest, longest, buckets, least, percent = how
    given = spark.createDataFrame([(d, t, "r", 1.5) for d, t in docs], "doc_id long, text string, rank string, _pl_id double")
    got = resample(given, spark.createDataFrame(target, "text string"), shortest=shortest, longest=longest,
                   buckets=buckets, least_words=least, percent=percent).collect()
    want, order = drawn(docs, [t for t, in target], *how)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.doc_id, r._pl_features, r._pl_weight, r._pl_score) for r in got], key=key) == sorted(want, key=key)
    assert [r.doc_id for r in sorted((r for r in got if r._pl_rank), key=lambda r: r._pl_rank)] == order
    assert sorted(r._pl_rank for r in got if r._pl_rank) == list(range(1, len(order) + 1))
    assert {(r.rank, r._pl_id) for r in got} == {("r", 1.5)}


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    rows = [(7, "a b c d " * 9)] * 400 + [(i, f"w{i} " * 30) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    target = spark.createDataFrame([("a b",)], "text string")
    ranks = sorted(r._pl_rank for r in resample(docs, target).collect() if r._pl_rank)
    assert ranks == list(range(1, 101))
    assert resample(docs.limit(0), target).count() == 0
    assert resample(docs, target.limit(0)).where("_pl_rank IS NOT NULL").count() == 100


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_leading_pairs(n):
    rng = np.random.default_rng(n)
    turn, _ = np.linalg.qr(rng.normal(size=(n, n)))
    multiple = np.r_[np.ones(n // 2 + 1), np.zeros(n)][:n]
    for values in (rng.uniform(0, 9, n), multiple, np.full(n, 3.0), 10.0 ** -np.arange(n), 1 + 1e-12 * np.arange(n), np.zeros(n)):
        for matrix in ((turn * values) @ turn.T, np.diag(values)):
            matrix = (matrix + matrix.T) / 2
            k = min(8, n)
            found, vectors = leading_pairs(matrix, k)
            size = max(np.abs(values).max(), 1e-300)
            assert np.abs(found - np.linalg.eigvalsh(matrix)[::-1][:k]).max() < 1e-13 * size
            assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-13
            assert np.abs(matrix @ vectors.T - vectors.T * found).max() < 1e-13 * size


def plainly_whitened(vectors, k):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    away = x - total / n
    cov = away.T @ away / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    return away @ turn / np.sqrt(values), values / np.trace(cov), deviation


def test_whitening_equals_a_plain_version(spark):
    rng = np.random.default_rng(12)
    vectors = (rng.normal(size=(400, 12)) * np.r_[5, 4, 3, np.ones(9)]).astype(np.float32).tolist()
    vectors += [vectors[0]] * 200
    odd = [None, [], [None] * 12, [float("nan")] * 12, [float("inf")] * 12, [1.0, 2.0], [1.0] * 11 + [None]]
    rows = [(i if i else None, v, "n", 3) for i, v in enumerate([*vectors, *odd])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, _pl_whitened int")
    got = sorted(whiten(table).collect(), key=lambda r: r.vec_id or 0)
    want, share, deviation = plainly_whitened(vectors, 8)
    assert [r.vec_id for r in got] == [None, *range(1, len(vectors))] and {r._pl_n for r in got} == {len(vectors)}
    own = np.array([r._pl_whitened for r in got])
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9
    assert np.abs(np.array(got[0]._pl_explained) - share).max() < 1e-12
    assert [r._pl_deviation for r in got] == deviation and {r.component for r in got} == {"n"}
    assert 0 <= got[0]._pl_identity_error < 1e-12


def test_whitening_without_variance_and_with_large_entries(spark):
    schema = "vec_id long, embedding array<double>"
    same = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r._pl_whitened, r._pl_explained, r._pl_identity_error, r._pl_deviation) for r in same] == [([None, None], [None, None], None, 0)] * 2
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted(r._pl_whitened[0] for r in flat) == pytest.approx([-1, 1]) and flat[0]._pl_whitened[1] is None
    assert flat[0]._pl_explained == pytest.approx([1, 0]) and flat[0]._pl_identity_error < 1e-12
    large = {r.vec_id: r for r in whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 5e5]), (3, [0.0, 0.0])], schema)).collect()}
    x = [[1024 * 2**30 + 100_000, 100_000], [100_000, 512_000_000 + 100_000], [100_000, 100_000]]
    total = [sum(c) for c in zip(*x)]
    exact = [sum((3 * v - s) ** 2 for v, s in zip(row, total)) for row in x]
    assert [large[i + 1]._pl_deviation for i in range(3)] == [e if e < 1 << 63 else None for e in exact]
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], schema)).count() == 0


def test_whitening_query(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = QUERIES["op12_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    ids = sorted(vectors)
    want, share, deviation = plainly_whitened([vectors[i] for i in ids], 8)
    own = got.whitened.to_numpy().reshape(len(ids), 8)
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9
    assert got.deviation.tolist() == [d for d in deviation for _ in range(8)]
    assert got.explained.tolist()[:8] == pytest.approx(share.tolist(), rel=1e-9) and got.identity_error.nunique() == 1


def test_rank_file_is_read_as_published(vocabulary):
    with open(RANKS, "rb") as lines:
        pairs = [line.split() for line in lines]
    assert len(vocabulary.ranks) == len(pairs) and all(vocabulary.ranks[base64.b64decode(a)] == int(b) for a, b in pairs)
