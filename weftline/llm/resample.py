"""Quality by importance resampling: hashed n-gram models and Gumbel top-k.

Texts are bags of hashed words and shapes (case, digits and marks), alone and
in pairs. Two generative models are fitted
as smoothed bucket frequencies: one of target text (documents labelled good, a
bounded sample of their ids chosen by hash), one of the raw text, counted over
all documents. A document's log importance weight is the sum over its n-grams
of the log ratio of the two. Adding Gumbel noise, seeded by the document's id,
and keeping the k largest draws k documents without replacement in proportion
to their weights.

Counts are summed inside each task before they are shuffled (a row per bucket
and task). The k-th key is found by histograms that narrow the range around it,
so neither a global sort nor a collection of keys is needed.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.scratch import stored

from .words import utf8, words_of, worker_cache

BUCKETS, TARGET_IDS, SMOOTH, BINS = 10_000, 20_000, 1.0, 1024


#: A-Z to "A", a-z and all beyond ASCII to "a", digits to "0"; marks as they are.
_SHAPE = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_SAME = np.uint64(0x5851F42D4C957F2D)


class _Codes(dict):
    """A chunk's word code (its lower-cased letters and digits) above its shape code."""

    def __missing__(self, chunk: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        shape = re.sub(rb"(.)\1+", rb"\1", chunk.translate(_SHAPE))
        word = b" ".join(words_of(chunk))
        code = self[chunk] = zlib.crc32(word) << 32 | zlib.crc32(shape)
        return code


def buckets_of(text: bytes | None) -> np.ndarray:
    """Buckets of the single words, word pairs, shapes and shape pairs of a text.

    A word twice in a row is one pair whatever the word.
    """
    chunks = text.split() if text else []
    if not chunks:
        return np.zeros(0, np.int64)
    known = worker_cache().setdefault("chunk_codes", _Codes())
    both = np.array([known[c] for c in chunks], dtype=np.uint64)
    out = []
    for kind, one in enumerate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))):
        two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:]) * np.uint64(0x9E3779B97F4A7C15)
        two = np.where((one[:-1] == one[1:]) & (kind == 0), _SAME, two) >> np.uint64(24)
        out += [(x + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20) for x in (one, two)]
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed models for each bucket."""
    p, q = ((c + SMOOTH) / (c.sum() + SMOOTH * len(c)) for c in (target.astype(float), raw.astype(float)))
    return np.log(p) - np.log(q)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratios of target to raw text.

    The target is the documents of up to ``TARGET_IDS`` ids labelled quality 1;
    the raw counts are over all documents. Without labels all ratios are 0.
    """
    import pyarrow as pa

    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    # bounded by TARGET_IDS ids
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_IDS).withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(good), "doc_id", "left")

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, is_good in zip(utf8(batch.column("text")), batch.column("good").to_pylist(), strict=True):
                c = np.bincount(buckets_of(text), minlength=BUCKETS)
                counts[0] += c
                if is_good:
                    counts[1] += c
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_pydict({"bucket": seen, "raw": counts[0][seen], "target": counts[1][seen]})

    made = rows.select("text", "good").mapInArrow(run, "bucket bigint, raw bigint, target bigint")
    total = made.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in total:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return log_ratios(target, raw) if target.any() else np.zeros(BUCKETS)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight and gumbel_key of each row."""
    import pyarrow as pa

    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            weight = [float(shared.value[buckets_of(t)].sum()) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight, pa.float64())], names=["doc_id", "log_weight"])

    rows = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text").mapInArrow(run, "doc_id bigint, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), "doc_id"), 11) + 0.5) * F.lit(2.0**-53)
    return rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, by narrowing histograms; None if there are fewer."""
    value = F.col(column)
    lo, hi, n = keys.agg(F.min(value), F.max(value), F.count(value)).first()
    if k <= 0 or n < k:
        return None
    above = 0  # rows over hi
    while True:
        width = (hi - lo) / BINS
        inside = keys.where((value >= lo) & (value <= hi))
        if not width or lo + width == lo or hi - width == hi:
            return hi
        at = F.least(F.floor((value - lo) / width), F.lit(BINS - 1))
        for r in inside.groupBy(at.alias("at")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).orderBy(F.desc("at")).collect():
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if lo == hi:
            return lo


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, gumbel_key and selected.

    The k rows of largest keys are selected; k is ``share`` of all rows, by
    default the share of quality 1 among the labels of 0 and 1 (all rows without
    labels). Rows that tie with the k-th key are selected as well: noise is by
    doc_id, so repeated rows share their fate, and null ids share one noise.
    Null and empty texts weigh 0. Other columns are ignored.
    """
    if share is None:
        known = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
        share = 1.0 if known is None else known
    keys = stored(weigh(docs, fit(docs, labels)), "gumbel")
    least = kth_largest(keys, "gumbel_key", round(share * keys.count()))
    return keys.withColumn("selected", F.lit(False) if least is None else F.col("gumbel_key") >= least)
