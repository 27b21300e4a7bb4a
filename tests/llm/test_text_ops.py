"""Line dedup, token counts, sharding, near duplicates, packing, quality, mixing on small tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm.line_dedup import dedup_lines
from plumbline.llm.minhash import near_duplicates, text_key
from plumbline.llm.mixing import mix, mixed
from plumbline.llm.packing import best_pattern, pack, plan
from plumbline.llm.quality import classify_quality, fit, train
from plumbline.llm.queries import COUNT_VOCABULARY, PACK_VOCABULARY
from plumbline.llm.sharding import bounded_loads, shard_rows
from plumbline.llm.token_counts import count_tokens
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, size string, shard string, label string, id string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [
    "a  b\n\n c\t\td   ", "  lead", "x　y z w", "\x1c\x1d a\x1fb",
    "don't I'LL we've 's '", "ABC123½Ⅷ²٣ ñandú", "foo  <|endoftext|> bar<|endoftext|>",
    "   ", "İstanbul ΣΑΣ́ é", "\U0001d49c\U0001d4d1 \U0001f600\U0001f44d\U0001f3fd",
    "漢字かな​x\x85y\xa0z", "_a__b -- ... !!! $$$ 1,234.56",
]


def rows(*docs):
    return [(d, t, s, "a", "b", "c", "d") for d, t, s in docs]


def table(spark, *docs):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame(rows(*docs), SCHEMA)


MIXED_BAG = [
    (1, "menu\nown line one\nfooter", "s1"), (2, "menu \nown line two\nfooter", "s2"),
    (3, " menu\n\nmenu\nfooter", None), (4, None, "s1"), (5, "", "s2"), (6, LONG, "s1"),
    (7, "\n\n", None), (8, "menu", "s3"), *((10 + i, t, "s4") for i, t in enumerate(ODD)),
]


def test_line_dedup_equals_brute_force(spark):
    for least in (1, 2, 3, 4):
        found = dedup_lines(table(spark, *MIXED_BAG), least)
        assert found.columns[:7] == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        got = {r.doc_id: r.text for r in found.collect()}
        assert got == brute.clean_lines(MIXED_BAG, least)


def test_line_dedup_repeated_rows_nulls_and_empty(spark):
    twice = [(1, "x\ny", "a"), (1, "x\ny", "a"), (2, "x", "b"), (None, "x\nz", "c")]
    got = Counter((r.doc_id, r.text) for r in dedup_lines(table(spark, *twice), 2).collect())
    # A null id sorts first, so it keeps the line; equal rows are treated alike.
    assert got == {(1, "y"): 2, (2, ""): 1, (None, "x\nz"): 1}
    assert dedup_lines(table(spark)).count() == 0


def test_token_counts_equal_the_library(spark):
    texts = [None, "", LONG, "a" * 5000, *ODD]
    docs = table(spark, *((i, t, "s") for i, t in enumerate(texts)), (3, "again", "s"))
    library = Tokenizer.from_file(COUNT_VOCABULARY)
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(texts), (3, "again")])
    got = count_tokens(docs, COUNT_VOCABULARY)
    assert sorted((r.doc_id, r._pl_bytes, r._pl_tokens) for r in got.collect()) == want
    assert got.where("_pl_over_limit != (_pl_tokens > 512)").count() == 0
    assert count_tokens(table(spark), COUNT_VOCABULARY).count() == 0


def test_sharding_is_balanced_gapless_and_stable(spark):
    docs = table(spark, *((i, f"t{i % 7}", "s") for i in range(500)), (None, None, None), (3, "", None), (3, "", None))
    placed = {}
    for shards in (7, 8):
        got = shard_rows(docs, shards).collect()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.size >= 8
        assert len(got) == 503 and set(slots) == set(range(shards))
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        placed[shards] = {r.doc_id: r.shard for r in got if r.doc_id not in (3, None)}
    stayed = sum(placed[7][d] == placed[8][d] for d in placed[7])
    assert stayed > 0.6 * len(placed[7])  # a plain hash by count would keep an eighth
    assert shard_rows(table(spark), 7).count() == 0


def test_bounded_loads_places_every_row_once():
    counts = {5: 1000, 6: 1, 65_535: 30}  # one position holds almost everything
    placed = bounded_loads(counts, 5)
    loads, spans = Counter(), defaultdict(list)
    for cell, first, last, shard, slot in placed:
        assert slot == loads[shard]
        loads[shard] += last - first
        spans[cell].append((first, last))
    assert sum(loads.values()) == 1031 and max(loads.values()) - min(loads.values()) <= 1
    for cell, parts in spans.items():
        ends = [0, *(last for _, last in sorted(parts))]
        assert [first for first, _ in sorted(parts)] == ends[:-1] and ends[-1] == counts[cell]


def near_copies():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, 120)) for _ in range(12)]
    out = []
    for i, words in enumerate(base):
        for changes in (0, 0, 1, 2, 3, 6, 12)[: 3 + i % 5]:
            copy = list(words)
            for at in rng.choice(len(copy), changes, replace=False):
                copy[at] = f"new{rng.integers(1_000_000)}"
            out.append(" ".join(copy))
    return [*out, "three word text", "three  word text", "other", ""]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_copies()
    want = brute.groups((brute.jaccard(texts) >= 0.8) | np.array([[a == b for b in texts] for a in texts]))
    docs = table(spark, *((i, t, "s") for i, t in enumerate(texts)), (900, None, "s"), (901, None, "s"), (None, texts[0], "s"), (0, texts[0], "s"))
    got = near_duplicates(docs).collect()
    by_id = {r.doc_id: (r.group_id, r.kept) for r in got}
    assert len(got) == len(texts) + 4 and [by_id[i][0] for i in range(len(texts))] == list(want)
    assert all(kept == (group == i) for i, (group, kept) in by_id.items() if i is not None)
    assert by_id[900] == (900, True) and by_id[901] == (901, True) and by_id[None] == (None, True)
    assert near_duplicates(table(spark)).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    one, other, far, last = (" ".join(f"{c}{i}" for i in range(90)) for c in "abcd")
    near = one.replace("a3 ", "new ")
    docs = [(1, one), (2, near), (2, far), (3, other), (3, other), (3, last), (3, near), (4, far), (3, None)]
    # Texts of one id are apart unless they are alike; near copies under one id are one group.
    want = {
        (1, one): (one, 1, True), (2, near): (one, 1, False), (3, near): (one, 1, False), (2, far): (far, 2, True),
        (4, far): (far, 2, False), (3, other): (other, 3, True), (3, last): (last, 3, True), (3, None): (None, 3, True),
    }
    given = table(spark, *((d, t, "s") for d, t in docs))
    text_of = {(r.h1, r.h2): r.text for r in given.select("text", *text_key("text")).collect()}
    got = near_duplicates(given).collect()
    named = [((r.doc_id, text_of[r.text_h1, r.text_h2]), (text_of[r.group_h1, r.group_h2], r.group_id, r.kept)) for r in got]
    assert len(named) == len(docs) and dict(named) == want and set(named) == set(want.items())
    out = corpus_pipeline.drop_near_duplicates(spark, given, "")
    assert out.columns == given.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted((n for n, (_, _, kept) in want.items() if kept), key=repr)
    hot = table(spark, *((7, f"only {i} of these words {i * i}", "s") for i in range(300)), (None, one, "s"), (None, one, "s"))
    assert corpus_pipeline.drop_near_duplicates(spark, hot, "").count() == 302


def check_packing(spark, docs, capacity, texts):
    library = Tokenizer.from_file(PACK_VOCABULARY)
    got = pack(docs, PACK_VOCABULARY, capacity, keep_ids=True).toPandas()
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 2]) for t in texts)
    sequences, held = defaultdict(list), defaultdict(list)
    for r in got.itertuples():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        held[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return got, held, want


def test_packing_round_trip(spark):
    texts = [None, "", "a b c", LONG, *ODD, *(f"some words {'x ' * i}" for i in range(60))]
    got, held, want = check_packing(spark, table(spark, *((i, t, "s") for i, t in enumerate(texts))), 256, texts)
    whole = Counter(tuple(np.frombuffer(b"".join(p for _, p, _ in sorted(parts)), "<u4").tolist()) for parts in held.values())
    assert whole == want
    assert got.length.sum() / 256 / (got.sequence_id.max() + 1) > 0.95
    twice, _, _ = check_packing(spark, table(spark, (1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")), 256, [])
    assert len(twice) == 3
    assert pack(table(spark), PACK_VOCABULARY).count() == 0


def test_pattern_pricing_and_plan():
    sizes, values = np.array([2, 3, 5]), np.array([0.3, 0.5, 0.9])
    pattern, value = best_pattern(sizes, values, 11)
    best = max(a * 0.3 + b * 0.5 + c * 0.9 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11)
    assert value == pytest.approx(best) and (pattern * sizes).sum() <= 11
    histogram = {1: 300, 2: 200, 3: 150, 5: 90, 7: 40, 10: 5}
    entries = plan(histogram, 10)
    load, ranks = Counter(), defaultdict(list)
    for size, first, last, sequence, each in entries:
        ranks[size].append((first, last))
        for rank in range(last - first):
            load[sequence + rank // each] += size
    assert max(load.values()) <= 10 and set(load) == set(range(len(load)))
    assert all(sum(b - a for a, b in ranks[s]) == n for s, n in histogram.items())
    assert len(load) <= -(-sum(s * n for s, n in histogram.items()) // 10) + 2


def test_mix_equals_brute_force(spark):
    docs = [(i, "w " * (i % 13), f"s{i % 5}") for i in range(200)] + [
        (300, "one two", "tiny"), (301, "a", None), (302, None, None), (303, "", "none"),
        (None, "x y z", "s1"), (7, "dup dup", "s1"), (7, "dup dup", "s1"),
    ]
    got = mix(table(spark, *docs))
    found = sorted((str(r.doc_id), r._pl_size, r._pl_source_size, round(r._pl_target, 6), r._pl_taken) for r in got.collect())
    assert found == sorted((str(d), n, m, round(g, 6), t) for d, n, m, g, t in brute.taken(docs))
    totals = {r.source: (r.t, r.g) for r in got.groupBy("source").agg({"_pl_taken": "sum", "_pl_target": "max"}).toDF("source", "t", "g").collect()}
    assert all(abs(t - g) <= 0.5 for t, g in totals.values())
    out = mixed(table(spark, *docs))
    assert out.columns == table(spark).columns and out.where("text is null").count() == 0
    assert mix(table(spark)).count() == 0


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    scored = classify_quality(docs, train(docs, labels)).join(labels, "doc_id")
    rows = scored.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("_pl_score", "_pl_predicted", "quality").toPandas()
    right = (rows._pl_predicted == rows.quality).mean()
    good, bad = rows[rows.quality == 1]._pl_score.to_numpy(), rows[rows.quality == 0]._pl_score.to_numpy()
    assert right > 0.95 and (good[:, None] > bad[None, :]).mean() > 0.97


def test_quality_without_labels_and_on_odd_texts(spark):
    docs = table(spark, (1, None, "s"), (2, "", "s"), (3, LONG, "s"), (3, LONG, "s"), (None, "x", "s"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    scores = [r._pl_score for r in classify_quality(docs, train(docs, none)).collect()]
    assert scores == [0.5] * 5
    assert fit(np.zeros((3, 2)), np.ones(3)).score(np.zeros((1, 2)))[0] > 0.99
    some = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r._pl_score for r in classify_quality(docs, train(docs, some)).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    assert classify_quality(table(spark), train(table(spark), some)).count() == 0
