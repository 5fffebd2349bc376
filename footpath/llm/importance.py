"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, of target text (labelled good) and of all text, give a
document's importance weight, the ratio of its probabilities.  A document of weight w is of the target
with odds ``prior * w``; as many documents as don't have ``REJECT_ODDS`` against them are drawn without replacement in proportion to their weights, by Gumbel top-k: the k largest of log w plus Gumbel
noise.  Noise is a hash of the id, so a run can be repeated, and the k-th largest is found by counts in
ever narrower ranges, never by a sort in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import materialize, slices

#: Buckets of the hashed n-grams.
BUCKETS = 10_000

#: Labelled good documents, at most, that the target model is fitted on: those with the least hash of their id.
LABELLED_ROWS = 20_000

SEED = 42

#: Tokens of at most ``MEMO_CHARS`` characters whose hashes a Python worker keeps (about 20 MB); emptied when full.
MEMO_ENTRIES, MEMO_CHARS = 100_000, 32

#: Words, and runs of other characters.  A token that repeats the one before counts as this mark.
TOKEN = re.compile(r"\w+|[^\w\s]+")
SAME = "\0same"

_MEMO: dict[str, int] = {}


def features(text: str) -> np.ndarray:
    """Bucket of every word and word pair of a text."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64)
    if len(_MEMO) > MEMO_ENTRIES:
        _MEMO.clear()
    out = []
    for t in tokens:
        h = _MEMO.get(t)
        if h is None:
            h = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED)
            if len(t) <= MEMO_CHARS:
                _MEMO[t] = h
        out.append(h)
    one = np.array(out, np.uint64)
    same = np.concatenate(([False], one[1:] == one[:-1]))
    one[same] = xxhash.xxh64_intdigest(SAME, SEED)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] + np.uint64(0x7F4A7C15))
    two = (two ^ (two >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = np.concatenate((one, two ^ (two >> np.uint64(32))))
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, target_ids: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of all whole texts and of those whose id is in ``target_ids``, by bucket."""
    ids = docs.sparkSession.sparkContext.broadcast(target_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in slices(batches, 1, 4 << 20):
            for one, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                n = np.bincount(features(text), minlength=BUCKETS)
                every += n
                if one in ids.value:
                    target += n
        yield pa.record_batch([pa.array(np.arange(BUCKETS)), pa.array(every), pa.array(target)], names=["bucket", "n", "target"])

    rows = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, "bucket long, n long, target long")
    every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("target").alias("target")).collect():  # BUCKETS rows
        every[r.bucket], target[r.bucket] = r.n, r.target
    return every, target


#: Odds against a document from which on it isn't counted among those to keep: dropping a good
#: document costs more than keeping a bad one.
REJECT_ODDS = 100.0

#: Counts that both models have beforehand in every bucket.  A text's n-grams depend on each other, so a bucket says less than its count;
#: with fewer, on small corpora the misfits of thousands of n-grams add up against long good documents.
PRIOR_COUNT = 1000.0


class Model:
    """N-gram counts of all and of target text, and the prior of the target."""

    def __init__(self, every: np.ndarray, target: np.ndarray, ids: frozenset[int], prior: float):
        self.every, self.target, self.ids, self.prior = every, target, ids, prior

    def log_weight(self, one: int | None, text: str | None) -> float:
        """Log of a whole text's importance weight: the sum over its n-grams of the log ratio of the two models; 0 for a text
        without words.

        The text's own n-grams are taken out of the counts of all text and, if it is one of the
        target's documents, of these, so that the models don't favour what they were fitted on.  A
        bucket of expected target count e and observed count c has the log ratio of c and e, both with the
        prior count; e / (e + prior) / 2 evens out the bias of a logarithm of counts.
        """
        if not text or not self.target.sum():
            return 0.0
        bucket, n = np.unique(features(text), return_counts=True)
        own, size = (n, n.sum()) if one in self.ids else (0, 0)
        share = (self.every[bucket] - n + 1.0) / (self.every.sum() - n.sum() + BUCKETS)
        e = (self.target.sum() - size) * share
        c = self.target[bucket] - own + PRIOR_COUNT + 0.5 * e / (e + PRIOR_COUNT)
        return float((n * np.log(c / (e + PRIOR_COUNT))).sum())


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Fit both models.  ``labels``: ``doc_id, quality`` (1 good) and ``toxic``; good ones that aren't toxic are the target.

    Counts of all text cover every document.  Without labelled good documents every weight is 1.
    """
    labels = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality", "toxic")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    chosen = labels.where(good).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(labelled_rows)
    ids = frozenset(r.doc_id for r in chosen.collect())  # labelled_rows at most
    share = labels.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
    every, target = bucket_counts(docs, ids)
    return Model(every, target, ids, share if share else 1.0)


def weighed(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) and their ``log_weight``, some megabytes of text at a time."""
    names = docs.columns
    one, text = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, 4 << 20):
            found = pa.array(map(model.log_weight, part.column(one).to_pylist(), part.column(text).to_pylist()), pa.float64())
            yield pa.record_batch([*part.columns, found], names=[*names, "log_weight"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("log_weight", DoubleType())]))


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the id."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of column ``key``: counts by range, then by range within that, down to one value."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low or high - width == high:
            break
        index = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        inside = keys.where((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
        found = inside.groupBy(index).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy(F.desc("bin")).collect()  # bins rows at most
        for r in found:
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n
    return low


def scores(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> tuple[Model, float, DataFrame]:
    """The fitted model, the least key (log weight plus noise) that is drawn, and the written table
    ``doc_id, log_weight, key`` of all rows."""
    model = fit(docs, labels, labelled_rows)
    keys = weighed(docs, model).select("doc_id", "log_weight")
    keys = materialize(keys.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"))), "keys")
    k = keys.where(F.col("log_weight") >= F.lit(float(-np.log(REJECT_ODDS * model.prior)))).count()
    return model, kth_largest(keys, k) if k else float("inf"), keys


def classify(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """``docs`` with ``log_weight``, ``key`` and ``keep``.

    Null and empty texts have weight 1; ids that are null share one noise; equal keys at the border are all
    kept, so repeated rows are judged alike.  Columns named like the new ones are replaced; an empty
    table gives an empty result.  Texts are weighed again rather than joined with their written scores:
    a pass over the texts moves no data.
    """
    own = [c for c in docs.columns if c not in ("log_weight", "key", "keep")]
    docs = docs.select(*own)
    model, least, _ = scores(docs.select("doc_id", "text"), labels, labelled_rows)
    rows = weighed(docs, model).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id")))
    return rows.withColumn("keep", F.col("key") >= F.lit(least))


def op10_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Weight, key and decision of every document; see ``classify`` for special cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    _, least, found = scores(docs, labels)
    return found.withColumn("keep", F.col("key") >= F.lit(least))
