"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Each text's words and word pairs are hashed into buckets. Two bag-of-n-grams models are counted, one over texts
labelled as target and one over all of them; a text's log weight is the sum of its n-grams' log ratios. Models are
kept for groups of languages, so that a language which few labelled texts happen to have isn't taken for poor text. The sample,
without replacement and in proportion to the weights, is the k largest of log weight plus Gumbel noise.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Codes, cut, free_names, texts, uniform63

BITS = 14
BUCKETS = 1 << BITS
GROUPS = 8  # of languages, by hash
PRIOR = 200.0  # counts at the raw rate that each bucket of the target model begins with
TOKEN = re.compile(r"\w+|[^\w\s]+")
MOST_LABELS = 100_000  # labelled rows that the target model is fitted on, about


class Grams:
    """Buckets of words and of pairs of words; a word followed by itself counts as one kind of pair, whichever it is."""

    def __init__(self):
        self.index, self.array = Codes(), np.empty(0, np.uint64)

    def buckets(self, text: str) -> np.ndarray:
        if len(self.index) > 500_000:
            self.__init__()
        index, known = self.index, len(self.index)
        ids = np.array(list(map(index.__getitem__, TOKEN.findall(text.lower()))), np.int64)
        if not len(ids):
            return ids
        if len(index) > known:
            new = [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in index.newest(len(index) - known)]
            if len(index) > len(self.array):
                self.array = np.resize(self.array, max(1024, 2 * len(index)))
            self.array[known : len(index)] = new
        h = self.array[ids]
        pair = np.where(h[:-1] == h[1:], np.uint64(1), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        pair ^= pair >> np.uint64(29)
        return np.concatenate([h, pair * np.uint64(0x165667B19E3779F9)]).astype(np.uint64) >> np.uint64(64 - BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, counts = Grams(), np.zeros((2, GROUPS * BUCKETS), np.int64)
    for batch in batches:
        for target, group, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch)):
            found = grams.buckets(text).astype(np.int64) + group * BUCKETS
            np.add.at(counts[0], found, 1)
            if target:
                np.add.at(counts[1], found, 1)
    some = np.flatnonzero(counts[0])
    yield pa.record_batch([some.astype(np.int32), counts[0, some], counts[1, some]], names=["bucket", "n_raw", "n_target"])


def target_ids(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """(doc_id) of a sample of the labelled documents of quality and without toxicity: those with the smallest
    hashes, so many that about `most` rows are expected. A document with contradicting labels isn't a target."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0 and doc_id is not null").select("doc_id")
    n = good.count()
    return good.where(uniform63(F.lit("label"), F.col("doc_id").cast("string")) < int((1 << 60) * min(1, most / max(1, n))))


def fit(docs: DataFrame, targets: DataFrame) -> list[float]:
    """The log ratio of each bucket: target model over raw model.

    The target model is smoothed towards the raw one: with E the count that a bucket would have in the target texts of
    its group at the raw rate, its ratio is (count + PRIOR) / (E + PRIOR), so buckets that few target texts could show
    say little.
    targets (doc_id) must be bounded, as target_ids() makes it: it is broadcast. The raw model counts every row.
    The result has GROUPS * BUCKETS numbers, whatever the data; they are all that reaches the driver.
    """
    flag = targets.select(F.col("doc_id").alias("_target")).distinct()
    rows = docs.select("doc_id", group_of(docs).alias("_group"), F.col("text").cast("string").alias("text")).join(F.broadcast(flag), F.col("doc_id") == F.col("_target"), "left")
    counts = rows.select(F.col("_target").isNotNull().alias("target"), "_group", "text").mapInArrow(_count, "bucket int, n_raw long, n_target long")
    counts = counts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target")).collect()
    raw, target = np.zeros(GROUPS * BUCKETS), np.zeros(GROUPS * BUCKETS)
    for r in counts:
        raw[r["bucket"]] = r["n_raw"]
        target[r["bucket"]] = r["n_target"]
    raw, target = raw.reshape(GROUPS, -1), target.reshape(GROUPS, -1)
    expected = raw / np.maximum(1.0, raw.sum(1, keepdims=True)) * target.sum(1, keepdims=True)
    return np.log((target + PRIOR) / (expected + PRIOR)).ravel().tolist()


def group_of(docs: DataFrame) -> Column:
    """A row's group of languages, from its column lang; without one, all rows are one group."""
    return F.pmod(F.xxhash64("lang"), F.lit(GROUPS)).cast("int") if "lang" in docs.columns else F.lit(0)


def _score(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ratios = Grams(), np.array(shared.value)
        for batch in batches:
            groups = batch.column(batch.num_columns - 1).to_pylist()  # the last column, the group, is used up here
            weights = [float(ratios[grams.buckets(t).astype(np.int64) + g * BUCKETS].sum()) for g, t in zip(groups, texts(batch))]
            columns = batch.columns[:-2] + [pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return work


def with_weights(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """docs with a column log_weight (replaced, if there is one): 0 for texts without words."""
    return _scored(docs.drop("log_weight"), ratios, "log_weight")


def _scored(docs: DataFrame, ratios: list[float], name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = docs.withColumn(name, F.lit(None).cast("double"))
    return rows.select("*", group_of(docs).alias(free_names(rows.columns, "_group")[0])).mapInArrow(_score(shared), rows.schema)


def noisy(log_weight: Column, doc_id: Column, seed: int = 0) -> Column:
    """Log weight plus standard Gumbel noise, the same for a doc_id each time, in millionths as an integer."""
    u = (uniform63(F.lit("gumbel"), F.lit(str(seed)), doc_id.cast("string")) + F.lit(0.5)) / F.lit(float(1 << 60))
    return F.floor((log_weight - F.log(-F.log(u))) * 1e6).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the column `key` (long), found digit by digit: each round counts at most 4,096 values."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    width = 0
    while (high - low) >> (12 * (width + 1)):
        width += 1
    above, base = 0, low
    for digit in range(width, -1, -1):
        unit = 1 << (12 * digit)
        part = keys.where((F.col("key") >= base) & (F.col("key") < base + unit * 4096))
        counts = sorted(((r["d"], r["n"]) for r in part.groupBy(F.floor((F.col("key") - base) / unit).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if above + n >= k:
                base += d * unit
                break
            above += n
    return base


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most_labels: int = MOST_LABELS, seed: int = 0) -> tuple[DataFrame, list[float], int | None]:
    """(kept rows (doc_id, log_weight, key), log ratios, threshold) of the Gumbel top-k of docs (doc_id, text).

    k: by default the expected number of target-like rows, the sum of min(1, share of targets among labelled rows
    times the weight). Rows that tie with the k-th are all kept; so are repeated rows of a kept one. Noise depends on
    doc_id alone. Null and empty texts have weight 1. Without target labels, or with k = 0, nothing is kept.
    """
    both = labels.groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).cast("int").alias("good"))
    share = both.agg(F.avg("good")).first()[0]
    ratios = fit(docs, target_ids(labels, most_labels))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(["lang"] if "lang" in docs.columns else []))
    scored = with_weights(narrow, ratios).select("doc_id", "log_weight")
    scored = cut(scored.withColumn("key", noisy(F.col("log_weight"), F.col("doc_id"), seed)))
    if k is None:
        k = round(scored.agg(F.sum(F.least(F.lit(1.0), F.lit(share or 0.0) * F.exp(F.least(F.col("log_weight"), F.lit(50.0)))))).first()[0] or 0)
    if not k or share is None:
        return scored.where("false"), ratios, None
    least = kth_largest(scored, k) if k < scored.count() else scored.agg(F.min("key")).first()[0]
    return scored.where(F.col("key") >= F.lit(least)), ratios, least


def keep_target_like(docs: DataFrame, labels: DataFrame, k: int | None = None, most_labels: int = MOST_LABELS, seed: int = 0) -> DataFrame:
    """The rows of docs that resample() keeps, with all columns: scored again where they are, so no text is shuffled."""
    kept, ratios, least = resample(docs, labels, k, most_labels, seed)
    if least is None:
        return docs.limit(0)
    (name,) = free_names(docs.columns, "_log_weight")
    return _scored(docs, ratios, name).where(noisy(F.col(name), F.col("doc_id"), seed) >= F.lit(least)).select(docs.columns)
