"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is its set of five-word shingles. A shingle weighs its count in the document times
its inverse document frequency, the mean over its words of ``1 + ln((1 + N) / (1 + df)) /
ln(1 + N)`` (from 1 to 2). Frequencies cover all documents and are kept per word-hash bucket, so
the broadcast table has ``DF_BUCKETS`` numbers whatever the corpus. Two documents are linked when
the weighted Jaccard similarity of their shingles is at least the threshold; groups are the
connected components. A document is named by its id and its text's 128-bit hash, as one id may
stand on several texts; a group has the name of its smallest document.

Steps. (1) Equal texts fall into one class by the hash; only one text of a class goes on, and
classes are numbered in the order of their smallest names, so a node is one number. (2) Improved consistent weighted sampling gives ``BANDS * ROWS`` samples, each equal for two
documents with their similarity as probability; bands of ``ROWS`` samples are bucket keys. (3) In
each bucket every member is verified, on full texts, against the bucket's smallest id only; links
give components. (4) Members of a bucket that lie in different components are compared with each
other, where weights and samples leave a similarity at the threshold possible, and verified.
Copies are thus never paired among themselves, and a bucket's members meet only across the
components that verification left apart. At similarity 0.8 a pair shares a bucket with
probability ``1 - (1 - 0.8**4)**14 = 0.9994``; the sample test of (4) misses it with less than 1e-5.

Only ids, hashes and samples are shuffled; texts move only for documents that share a bucket.

Defined results: rows of one id and one text are treated alike, and rows of one id with
different texts are different documents; a null text or null id stands alone and is kept; texts without words are equal only to equal texts; fewer than five words make
one shingle; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, stored
from plumbline.operators.history import number_rows
from plumbline.sources.shared import checked_keys

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
DF_BUCKETS = 1 << 18
# Step (4) looks at agreeing samples before it verifies a pair: LEAST_AGREE of the samples above
# and, of FINE further ones, first the number expected at the threshold, so that most of what
# belongs together is united by few pairs, then that number less 4.6 standard deviations.
LEAST_AGREE = 31
FINE = 256
FINE_AGREE = (205, 176)
# What rounding may take from an exact bound.
ROUNDING = 1e-9
BLOCK = 512
CACHED = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gamma_draws() -> np.ndarray:
    """65,536 equally likely values of a Gamma(2, 1) variable."""
    grid = np.linspace(0, 40, 2_000_001)
    share = (np.arange(65_536) + 0.5) / 65_536
    return np.interp(share, 1 - (1 + grid) * np.exp(-grid), grid)


class Shingler:
    """Weighted shingles and samples of texts."""

    def __init__(self, idf: np.ndarray | None = None, first: int = 1, samples: int = SAMPLES):
        class Words(dict):
            def __missing__(self, word: str) -> int:
                value = xxhash.xxh64_intdigest(word)
                if len(self) < CACHED and len(word) <= 48:
                    self[word] = value
                return value

        self.words, self.idf = Words(), idf
        if idf is not None:
            gamma = _gamma_draws()
            self.rate = gamma.astype(np.float32)
            self.inverse = (1 / gamma).astype(np.float32)
            self.log = np.log(gamma).astype(np.float32)
            start = np.arange(first, first + samples, dtype=np.uint64)
            self.seeds = _mixed(start * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def hashes(self, words: Collection[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))

    def weigh(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles (ascending) and their weights."""
        words = self.hashes(text.split())
        n = len(words)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0)
        span = min(n, SHINGLE)
        rarity = self.idf[(words % np.uint64(DF_BUCKETS)).astype(np.int64)]
        code, weight = np.zeros(n - span + 1, np.uint64), np.zeros(n - span + 1)
        for i in range(span):
            code = (code + words[i : n - span + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            weight += rarity[i : n - span + 1 + i]
        distinct, first, count = np.unique(code, return_index=True, return_counts=True)
        return distinct, weight[first] / span * count

    def sample(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Consistent weighted samples: for each, the shingle and level of the least value."""
        count = len(self.seeds)
        least = np.full(count, np.inf, np.float32)
        out = np.zeros(count, np.uint64)
        columns = np.arange(count)
        for at in range(0, len(shingles), BLOCK):
            some = _mixed(shingles[at : at + BLOCK])
            log_weight = np.log(weights[at : at + BLOCK]).astype(np.float32)[:, None]
            # Odd multipliers tell the samples apart; the low bits of the product are not used.
            draw = some[:, None] * self.seeds[None, :]
            draw ^= draw >> np.uint64(32)
            draw *= np.uint64(0xD6E8FEB86659FD93)
            bits = draw.view(np.uint16).reshape(len(some), count, 4)
            rate, beta = self.rate[bits[:, :, 3]], bits[:, :, 2] * np.float32(2.0**-16)
            level = np.floor(log_weight * self.inverse[bits[:, :, 3]] + beta)
            value = self.log[bits[:, :, 1]] - rate * (level - beta + np.float32(1))
            best = value.argmin(axis=0)
            lower = value[best, columns] < least
            chosen = _mixed(some[best] + level[best, columns].astype(np.int64).astype(np.uint64))
            least = np.where(lower, value[best, columns], least)
            out = np.where(lower, chosen, out)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 where either has no shingle."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """The idf of each word-hash bucket over all texts. At most DF_BUCKETS sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen, total = Shingler(), np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch["text"]:
                words = shingler.hashes(set(value.split()))
                seen[np.unique(words % np.uint64(DF_BUCKETS)).astype(np.int64)] += 1
                total += 1
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(used, -1), "df": np.append(seen[used], total)})

    rows = (
        docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
        .mapInPandas(count, "bucket bigint, df bigint")
        .groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    )
    df = dict(zip(rows["bucket"], rows["df"]))
    total = max(1, int(df.pop(-1, 0)))
    seen = np.zeros(DF_BUCKETS)
    seen[np.fromiter(df, np.int64, len(df))] = np.fromiter(df.values(), float, len(df))
    return 1 + np.log((1 + total) / (1 + seen)) / np.log(1 + total)


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """``id, h1, h2, weight, samples, bands`` per row of ``docs (id, text, h1, h2)``; texts
    without words have no bands."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shared.value)
        known: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            out = []
            for key, text in zip(zip(batch["h1"], batch["h2"]), batch["text"]):
                if key not in known:
                    shingles, weights = shingler.weigh(text)
                    if len(shingles):
                        samples = shingler.sample(shingles, weights)
                        band = np.zeros(BANDS, np.uint64)
                        for row in samples.reshape(BANDS, ROWS).T:
                            band = _mixed(band * np.uint64(31) + row)
                        found = (weights.sum(), samples.astype(np.uint32).view(np.int32), band.view(np.int64))
                    else:
                        found = (0.0, np.zeros(0, np.int32), np.zeros(0, np.int64))
                    if len(known) >= 10_000:
                        known.clear()
                    known[key] = found
                out.append(known[key])
            yield pd.DataFrame(
                {"id": batch["id"], "h1": batch["h1"], "h2": batch["h2"], "weight": [o[0] for o in out],
                 "samples": [o[1] for o in out], "bands": [o[2] for o in out]}
            )

    return docs.mapInPandas(
        sign, "id bigint, h1 bigint, h2 bigint, weight double, samples array<int>, bands array<bigint>"
    )


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The ``pairs (a, b)`` whose texts reach the threshold."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shared.value)
        last_id, last = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"], batch["x"], batch["y"]):
                if (a, x) != last_id:
                    last_id, last = (a, x), shingler.weigh(x)
                keep.append(similarity(last, shingler.weigh(y)) >= threshold)
            yield batch.loc[keep, ["a", "b"]]

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").mapInPandas(check, "a bigint, b bigint")


def unshared(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(id, alone)``: the weight of a document's shingles that no other of ``texts`` has."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shared.value)
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"]):
                shingles, weights = shingler.weigh(text)
                yield pd.DataFrame({"id": doc, "shingle": shingles.view(np.int64), "w": weights})

    return (
        texts.mapInPandas(weigh, "id bigint, shingle bigint, w double")
        .groupBy("shingle")
        .agg(F.min("id").alias("id"), F.max("id").alias("last"), F.max("w").alias("w"))
        .where(F.col("id") == F.col("last"))
        .groupBy("id").agg(F.sum("w").alias("alone"))
    )


def fine_samples(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(id, fine)``: FINE further samples per document, a byte each. Bytes may agree by chance,
    so a pair never seems less alike than its samples are."""
    shared = texts.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shared.value, SAMPLES + 1, FINE)
        for batch in batches:
            fine = [shingler.sample(*shingler.weigh(t)).astype(np.uint8).view(np.int8) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "fine": fine})

    return texts.mapInPandas(sign, "id bigint, fine array<tinyint>")


def agreeing(a: str, b: str) -> F.Column:
    same = F.zip_with(F.col(a), F.col(b), lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, v: s + v)


def linked(signed: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The components ``(node, component)`` of all links that steps (3) and (4) find."""
    bands = signed.select("id", F.posexplode("bands").alias("band", "key"))
    bucket = ["band", "key"]
    leaders = stored(
        bands.groupBy(*bucket)
        .agg(F.min("id").alias("leader"), F.max("id").alias("last"))
        .where(F.col("leader") != F.col("last"))
        .drop("last"),
        "buckets",
    )
    members = stored(bands.join(leaders, bucket), "members")
    stars = stored(
        members.where(F.col("id") != F.col("leader"))
        .select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(),
        "stars",
    )
    wanted = checked_keys(members.select("id").distinct())
    near = stored(texts.join(wanted, "id", "left_semi"), "texts")
    first = stored(verified(stars, near, idf, threshold), "links")

    # A pair's direction is free, so what was tried is kept both ways.
    tried = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known, profiles = components(first), None
    for agree in FINE_AGREE:
        placed = stored(
            members.join(known.withColumnRenamed("node", "id"), "id", "left").select(
                *bucket, "id", F.coalesce("component", "id").alias("component")
            ),
            "placed",
        )
        apart = (
            placed.groupBy(*bucket)
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where(F.col("low") != F.col("high"))
            .select(*bucket)
        )
        still = stored(placed.join(apart, bucket, "left_semi"), "apart")
        if profiles is None:
            open_ids = still.select("id").distinct()
            open_texts = stored(near.join(open_ids, "id", "left_semi"), "open_texts")
            # A shared weight is at most what a document shares with anything; where that is too
            # little for the threshold, the document has no partner and needs no samples.
            alone = F.coalesce("alone", F.lit(0.0))
            able = stored(
                signed.select("id", "weight", "samples", "bands").join(open_ids, "id", "left_semi")
                .join(unshared(open_texts, idf), "id", "left")
                .withColumn("common", F.col("weight") - alone).drop("alone")
                .where(F.col("common") >= (threshold - ROUNDING) * F.col("weight")),
                "able",
            )
            fine = fine_samples(open_texts.join(able.select("id"), "id", "left_semi"), idf)
            profiles = stored(able.join(fine, "id"), "profiles")
        pairs = stored(crossing(still, profiles, agree, threshold).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs).union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = merged(known, stored(verified(pairs, near, idf, threshold), "links"))
    return known


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``known`` after further ``links``. Only the components that links join are
    looked at again, each as one node."""
    of_a = known.select(F.col("node").alias("a"), F.col("component").alias("a_in"))
    of_b = known.select(F.col("node").alias("b"), F.col("component").alias("b_in"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")
    )
    joined = components(ends)
    moved = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    told = moved.select("node", F.coalesce("to", "component").alias("component"))
    fresh = joined.join(known.select("node"), "node", "left_anti")
    return stored(told.union(fresh.select("node", "component")), "components")


def crossing(still: DataFrame, profiles: DataFrame, agree: int, threshold: float) -> DataFrame:
    """Pairs of one bucket and two components that may reach the threshold and agree in at least
    ``agree`` of the fine samples. A pair that shares several buckets is met in the first of them."""
    least = threshold - ROUNDING
    shared = F.zip_with("a.bands", "b.bands", lambda x, y: x == y)
    first = F.array_position(shared, True) == F.col("a.band") + 1
    rows = stored(still.join(profiles, "id"), "open")
    a, b = rows.alias("a"), rows.alias("b")
    most = F.least("a.common", "b.common")
    ratio = most / (F.col("a.weight") + F.col("b.weight") - most)
    return (
        a.join(
            b,
            (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))
            & (F.col("a.component") < F.col("b.component")) & first
            & (ratio >= least) & (agreeing("a.samples", "b.samples") >= LEAST_AGREE)
            & (agreeing("a.fine", "b.fine") >= agree),
        )
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .distinct()
    )


def text_key(text: str) -> list[F.Column]:
    """``h1, h2``: 128 bits that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, group_id, kept``, and the hashes that complete the
    names of its text (``text_h1, text_h2``) and of its group (``group_h1, group_h2``). Of each
    group the smallest document is kept."""
    given = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), *text_key(text)
    )
    rows = given.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    idf = inverse_frequencies(rows, "text")
    signed_rows = stored(signatures(rows, idf), "signatures")
    same = ["h1", "h2"]
    firsts = signed_rows.groupBy(*same).agg(F.min("id").alias("first"))
    classes = stored(number_rows(firsts, ["first", *same], "node"), "classes")
    signed = stored(
        signed_rows.join(classes, same).where(F.col("id") == F.col("first"))
        .select(F.col("node").alias("id"), "weight", "samples", "bands").dropDuplicates(["id"]),
        "signed",
    )
    texts = rows.withColumnRenamed("id", "first").join(classes, ["first", *same]).select(
        F.col("node").alias("id"), "text"
    )
    found = linked(signed, texts, idf, threshold)
    names = classes.select(
        F.col("node").alias("component"), F.col("first").alias("group_id"),
        F.col("h1").alias("group_h1"), F.col("h2").alias("group_h2"),
    )
    lead = (F.col("id") == F.col("first")) & F.coalesce(F.col("node") == F.col("component"), F.lit(True))
    judged = (
        signed_rows.select("id", *same).join(classes, same)
        .join(found.join(names, "component"), "node", "left")
        .select(
            F.col("id").alias("doc_id"), F.coalesce("group_id", "first").alias("group_id"), lead.alias("kept"),
            F.col("h1").alias("text_h1"), F.col("h2").alias("text_h2"),
            F.coalesce("group_h1", "h1").alias("group_h1"), F.coalesce("group_h2", "h2").alias("group_h2"),
        )
    )
    alone = given.where(F.col("id").isNull() | F.col("text").isNull()).select(
        "id", "id", F.lit(True), *same, *same
    )
    return judged.union(alone)
