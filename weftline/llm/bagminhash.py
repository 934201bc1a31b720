"""MinHash near-dedup by BagMinHash over bags of five-word shingles.

A shingle that occurs c times has weight c. Weights are discretised at the
integers, and the levels below c are covered by blocks [0,1), [1,2), [2,4),
[4,8) and so on. Each (shingle, block) is a Poisson process whose rate is the
block's width, seeded by the shingle, so two documents that share a shingle
see the same points. A point has a signature slot and a level, whose binary
digits are its way down the block's hierarchy; it counts where its level lies
below c. The earliest point of each slot is the signature, and two documents
agree in a slot with the probability of their weighted Jaccard similarity. A
process stops once no slot can still improve, so a text costs about its
distinct shingles plus K log K.

120 slots in 24 bands of 5 miss a pair of similarity 0.8 once in 13,000. Texts
are collapsed to distinct ones first; candidates of a band are verified by the
exact overlap of their bags (sum of minima over sum of maxima). Of the pairs
that the first comparisons leave open, those go unverified that cannot reach
the similarity because too many shingles of one are in no other open text, or
are not in the other by a table of bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.scratch import stored, temporary

from .graph import link_buckets, only
from .words import slices, utf8, words_of, worker_cache

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: uniform bits from counters and sums."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _WordHash(dict):
    """64-bit hashes of words, alike on every machine; forgotten in bulk."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of ``size`` words; a shorter text with words is one run."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_cache().setdefault("word_hash", _WordHash())
    h = np.array([known[w] for w in words], dtype=np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * _GOLD + h[i : len(h) - n + 1 + i])
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int, slack: float = 2.0) -> np.ndarray:
    """Ids of the earliest point in each slot, for bags of (shingle hashes, counts) that are not empty."""
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    shingle = np.concatenate([h for h, _ in bags])
    count = np.concatenate([c for _, c in bags]).astype(np.int64)
    total = np.array([c.sum() for _, c in bags], dtype=np.float64)
    until = slots * (np.log(slots) + slack) / total
    # the blocks of each shingle: width and first level
    of, lo, width = [np.arange(len(count))], [np.zeros(len(count))], [np.ones(len(count))]
    edge = 1
    while len(at := np.flatnonzero(count > edge)):
        of.append(at)
        lo.append(np.full(len(at), float(edge)))
        width.append(np.full(len(at), float(edge)))
        edge *= 2
    of, lo, width = np.concatenate(of), np.concatenate(lo), np.concatenate(width)
    seed = mixed(shingle[of] + mixed((lo.astype(np.uint64) + np.uint64(1)) * _GOLD))
    doc, count = doc[of], count[of]
    time = np.zeros(len(of))
    first = np.full((len(bags), slots), np.inf)
    points, n = [], np.uint64(0)
    while len(seed):
        with np.errstate(over="ignore"):
            n += np.uint64(1)
            point = mixed(seed + n * _GOLD)
        time = time - np.log(unit(point)) / width
        alive = time <= until[doc]
        doc, count, lo, width, seed, time = (x[alive] for x in (doc, count, lo, width, seed, time))
        point = mixed(point[alive] ^ _GOLD)
        level = lo + width * unit(mixed(point + np.uint64(1)))
        hit = level < count
        slot = (mixed(point + np.uint64(2)) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, (doc[hit], slot[hit]), time[hit])
        points.append((doc[hit], slot[hit], time[hit], point[hit]))
    out = np.zeros((len(bags), slots), np.uint64)
    for d, s, t, p in points:
        best = first[d, s] == t
        out[d[best], s[best]] = p[best]
    again = np.flatnonzero(np.isinf(first).any(axis=1))
    if len(again):  # an empty slot: look further in time
        out[again] = signatures([bags[i] for i in again], slots, slack * 2 + 4)
    return out


def bands_of(texts: list[bytes | None], bands: int = BANDS, rows: int = ROWS) -> tuple[list[int], list]:
    """The number of shingles of each text, and the hashes of its bands (none without words)."""
    bags = [np.unique(shingles(t), return_counts=True) for t in texts]
    size = [int(c.sum()) for _, c in bags]
    out: list = [[] for _ in texts]
    use = [i for i, n in enumerate(size) if n]
    for k in range(0, len(use), 256):
        part = use[k : k + 256]
        points = signatures([bags[i] for i in part], bands * rows).reshape(len(part), bands, rows)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(part), bands))
        for r in range(rows):
            h = mixed(h * _GOLD + points[:, :, r])
        for i, band in zip(part, h.astype(np.int64).tolist(), strict=True):
            out[i] = band
    return size, out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum() + b[1].sum()) - least)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def _signed(docs: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            texts, keys = utf8(batch.column("text")), batch.column("key").to_pylist()
            first: dict = {}
            at = [first.setdefault(k, i) for i, k in enumerate(keys)]  # copies within a slice are signed once
            own = [i for i, j in enumerate(at) if i == j]
            size, bands = bands_of([texts[i] for i in own])
            place = {i: k for k, i in enumerate(own)}
            columns = [
                batch.column("doc_id"), batch.column("key"),
                pa.array([size[place[j]] for j in at], pa.int64()),
                pa.array([bands[place[j]] for j in at], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "size", "bands"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, key binary, size bigint, bands array<bigint>")


#: Texts that are held against one text in one run of rows.
RUN = 256
#: Shingles that a task remembers of the texts that it has met.
REMEMBERED = 1 << 21


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs of text keys whose bags overlap enough, by the texts themselves.

    The pairs of the text that is in most of them form runs of about ``RUN``
    rows, which hold that text once; its bag is made once for all of them. So a
    text that leads a large group is neither sent along with each pair nor
    does all of its group meet in one task.
    """
    import pyarrow as pa

    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "pair-ends")
    texts = stored(_texts_of(docs, ends), "texts")
    for c in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("key").alias(c), F.col("n").alias(f"{c}_n")), c)
    leads = F.col("a_n") >= F.col("b_n")
    pairs = pairs.select(
        F.when(leads, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(leads, F.col("b")).otherwise(F.col("a")).alias("key"),
        F.greatest("a_n", "b_n").alias("n"),
    )
    pairs = stored(pairs.withColumn("run", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / RUN))).drop("n"), "runs")
    heads = pairs.select("lead", "run", F.col("lead").alias("key"), F.lit(0).alias("place")).distinct()
    rows = heads.unionByName(pairs.withColumn("place", F.lit(1))).join(texts, "key")
    rows = rows.repartition("lead", "run").sortWithinPartitions("lead", "run", "place").select("lead", "key", "place", "text")

    def run(batches):
        head, known, size = None, {}, 0
        for batch in slices(batches):
            keep = []
            for i, (place, key) in enumerate(zip(batch.column("place").to_pylist(), batch.column("key").to_pylist(), strict=True)):
                bag = known.get(key)
                if bag is None:
                    bag = np.unique(shingles(batch.column("text")[i].as_py().encode()), return_counts=True)
                    size += len(bag[0])
                    if size > REMEMBERED:
                        known, size = {}, len(bag[0])
                    known[key] = bag
                if place == 0:
                    head = bag
                keep.append(place == 1 and overlap(head, bag) >= similarity)
            kept = pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("key")], names=["lead", "key"])
            yield kept.filter(pa.array(keep, pa.bool_()))

    linked = rows.mapInArrow(run, "lead binary, key binary")
    return linked.select(F.least("lead", "key").alias("a"), F.greatest("lead", "key").alias("b"))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """key and text of the given text keys, each once."""
    found = only(docs.select(text_key(F.col("text")).alias("key"), "text"), ids, "key")
    return found.groupBy("key").agg(F.first("text").alias("text"))


#: 64-bit words of a text's table of shingles.
TABLE = 16


def table_of(shingle: np.ndarray) -> np.ndarray:
    """The bits of distinct shingles, as ``TABLE`` signed words: a bit that only one of two texts has is a shingle that the other lacks."""
    out = np.zeros(TABLE, np.uint64)
    at = shingle % np.uint64(64 * TABLE)
    np.bitwise_or.at(out, (at // np.uint64(64)).astype(np.int64), np.uint64(1) << at % np.uint64(64))
    return out.view(np.int64)


def _odd_shares(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Per text key (id): common, the number of shingles that some other of these texts has too, and t0 and on, its table.

    No text shares more than its common shingles with another of them, nor
    any whose bit is not in the other's table, which bounds the similarity of two texts from above.
    """
    import pyarrow as pa

    def run(batches):
        for batch in slices(batches):
            bags = [np.unique(shingles(t), return_counts=True) for t in utf8(batch.column("text"))]
            bits = np.array([table_of(h) for h, _ in bags], np.int64).reshape(len(bags), TABLE)
            columns = [
                batch.column("key"), pa.array([int(c.sum()) for _, c in bags], pa.int64()),
                pa.array([h.astype(np.int64) for h, _ in bags], pa.list_(pa.int64())), pa.array([c for _, c in bags], pa.list_(pa.int64())),
                *(pa.array(x) for x in bits.T),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "shingles", "counts", *tables])

    tables = [f"t{i}" for i in range(TABLE)]
    texts = _texts_of(docs, stored(ids.withColumnRenamed("id", "key"), "open"))
    kinds = "id binary, size bigint, shingles array<bigint>, counts array<bigint>, " + ", ".join(f"{c} bigint" for c in tables)
    bags = stored(texts.mapInArrow(run, kinds), "bags")
    rows = bags.select("id", F.inline(F.arrays_zip("shingles", "counts")))
    alone = rows.groupBy("shingles").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.max("counts").alias("c")).where("n = 1")
    odd = alone.groupBy("id").agg(F.sum("c").alias("odd"))
    return bags.join(odd, "id", "left").select("id", (F.col("size") - F.coalesce("odd", F.lit(0))).alias("common"), *tables)


def _sized(similarity: float) -> Column:
    return F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-6


def _bounded(similarity: float) -> Column:
    def present(x: str, y: str) -> Column:
        return F.col(f"{x}_size") - sum(F.bit_count(F.col(f"{x}_t{i}").bitwiseAND(F.bitwise_not(f"{y}_t{i}"))) for i in range(TABLE))

    most = F.least("a_common", "b_common", present("a", "b"), present("b", "a"))
    return most >= (similarity - 1e-9) * (F.col("a_size") + F.col("b_size") - most)


def _grouped(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, key (of the text) and component_id of every row."""
    with temporary(docs.sparkSession) as keep:
        signed = keep(stored(_signed(docs), "signed"))
        worded = signed.where("size > 0")
        classes = stored(
            worded.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.first("size").alias("size"), F.first("bands").alias("bands")),
            "classes",
        )
        buckets = classes.select(F.col("key").alias("id"), "size", F.explode("bands").alias("bucket")).select("bucket", "id", "size")
        found = link_buckets(
            buckets,
            lambda pairs: _verified(pairs, docs, similarity),
            lambda: _sized(similarity),
            lambda ids: _odd_shares(docs, ids),
            lambda: _bounded(similarity),
        )
        named = classes.select("key", "first_doc").join(found.withColumnRenamed("id", "key"), "key", "left")
        named = named.select("key", "first_doc", F.coalesce("component", "key").alias("component"))
        names = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
        names = keep(stored(named.join(names, "component").select("key", "component_id"), "components"))
    linked = worded.select("doc_id", "key").join(names, "key").select("doc_id", "key", "component_id")
    return linked.unionByName(signed.where("size = 0").select("doc_id", "key", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id and kept.

    Documents are linked where the weighted Jaccard similarity of their bags of
    shingles is ``similarity`` or more; component_id is the least doc_id that
    links reach, and kept marks the document of that id. A text without words
    (null and empty ones too) links with nothing and is kept. Equal texts are
    always linked; rows that repeat a kept doc_id are all kept; null ids join
    the group of their text but name it only if no other id does. Other columns
    are ignored, and an empty table has no rows.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return _grouped(docs, similarity).select("doc_id", "component_id", kept)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The kept rows of ``docs``, one document of each group, all columns as they were."""
    gone = _grouped(docs, similarity).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    same = (text_key(docs["text"]) == gone["_gone_key"]) & docs["doc_id"].cast("bigint").eqNullSafe(gone["_gone_id"])
    return docs.join(gone, same, "left_anti")
