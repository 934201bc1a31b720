"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item (a shorter
item is one window). For patterns of one length m, blocks of B words give the
shift table: a block that ends no pattern prefix lets the search jump up to
m - B + 1 words; a block that ends a pattern leads to a bucket keyed by that
suffix and split by the pattern's first words, and a direct comparison of the
words decides. Shorter patterns have tables of their own, by length, so they
do not shrink the jumps of the long ones.

Documents are scanned where they lie: no shuffle. The benchmark is the query
set; it goes to executors in blocks of at most ``block_bytes`` of text, and
more blocks mean more scans, never a larger broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.scratch import stored

from .words import utf8, words_of, worker_cache

WINDOW = 13
BLOCK_BYTES = 32 << 20
FOUND = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:int,last:int>>"


class WuManber:
    """Tables for patterns of words, each with the ids of the items that hold it."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW, block: int = 3):
        patterns: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words_of(text)
            m = min(window, len(w))
            for i in range(len(w) - m + 1) if m else ():
                ids = patterns.setdefault(tuple(w[i : i + m]), set())
                if item is not None:
                    ids.add(item)
        self.tables = []
        for m in sorted({len(p) for p in patterns}, reverse=True):
            b = min(block, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
            for p, ids in patterns.items():
                if len(p) != m:
                    continue
                for end in range(b, m + 1):
                    key = p[end - b : end]
                    shift[key] = min(shift.get(key, m), m - end)
                buckets.setdefault(p[m - b :], {}).setdefault(p[:b], []).append((list(p), ids))
            self.tables.append((m, b, shift, buckets))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """All occurrences as (first word, length, item ids)."""
        n = len(words)
        for m, b, shift, buckets in self.tables:
            jump, end = m - b + 1, m
            while end <= n:
                key = tuple(words[end - b : end])
                step = shift.get(key, jump)
                if step:
                    end += step
                    continue
                first = end - m
                for p, ids in buckets[key].get(tuple(words[first : first + b]), ()):
                    if words[first:end] == p:
                        yield first, m, ids
                end += 1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans without overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _tables(name: str, items) -> WuManber:
    cache = worker_cache().setdefault("wu_manber", {})
    if name not in cache:
        cache.clear()
        cache[name] = WuManber(items.value)
    return cache[name]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[tuple]:
    """Broadcast item texts under names of their own, in blocks of about ``block_bytes`` each."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("text")
    ).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [
        (uuid.uuid4().hex, sc.broadcast([(r.item, bytes(r.text)) for r in items.where(part == k).collect()]))
        for k in range(n)
    ]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Which words of each document lie in occurrences of benchmark windows.

    One row per row of ``docs``: doc_id, n_words, n_hit, items (ids of items
    with occurring windows, sorted as strings) and spans (half-open ranges of
    hit words). Null and empty texts have no words and no hits; an item without
    words has no windows; the windows of an item with a null id hit words but
    the item is not listed. Repeated items count once. Other columns are ignored.
    """
    import pyarrow as pa

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = _blocks(benchmark, block_bytes)
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    out = FOUND if len(blocks) == 1 else FOUND + ", text string"
    names = [c.split()[0] for c in out.replace("struct<first:int,last:int>", "s").split(", ")]
    types = {
        "n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "spans": span,
    }

    def scan(items):
        def run(batches):
            search = _tables(*items).search
            for batch in batches:
                got = {k: [] for k in types}
                before = [batch.column(c).to_pylist() for c in ("items", "spans")] if "items" in batch.schema.names else None
                for i, text in enumerate(utf8(batch.column("text"))):
                    words = words_of(text)
                    spans, ids = [], set()
                    for first, m, found_ids in search(words):
                        spans.append((first, first + m))
                        ids |= found_ids
                    if before:
                        ids |= set(before[0][i])
                        spans += [(s["first"], s["last"]) for s in before[1][i]]
                    spans = merged(spans)
                    got["n_words"].append(len(words))
                    got["n_hit"].append(sum(b - a for a, b in spans))
                    got["items"].append(sorted(ids))
                    got["spans"].append([{"first": a, "last": b} for a, b in spans])
                columns = {k: pa.array(v, types[k]) for k, v in got.items()}
                columns |= {k: batch.column(k) for k in ("doc_id", "text")}
                yield pa.RecordBatch.from_arrays([columns[k] for k in names], names=names)

        return run

    for k, items in enumerate(blocks):
        found = found.mapInArrow(scan(items), out)
        if k + 1 < len(blocks):
            found = stored(found, "decontaminate")
    return found.drop("text")


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, all columns as they were.

    Needs the column text; null and empty texts stay.
    """
    import pyarrow as pa

    kept = docs
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        # hits of several blocks add up: find them all, then drop by the text's hash
        probe = docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text")
        probe = probe.where("text is not null")
        bad = _bad_texts(probe, benchmark, block_bytes)
        key = F.unhex(F.md5(F.encode("text", "UTF-8")))
        return docs.withColumn("_weftline_key", key).join(bad, "_weftline_key", "left_anti").drop("_weftline_key")

    def run(batches):
        search = _tables(*blocks[0]).search
        for batch in batches:
            keep = []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                n = sum(b - a for a, b in merged([(f, f + m) for f, m, _ in search(words)]))
                keep.append(not (n and 20 * n >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return kept.mapInArrow(run, kept.schema)


def _bad_texts(probe: DataFrame, benchmark: DataFrame, block_bytes: int) -> DataFrame:
    keyed = probe.groupBy(F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("_weftline_key")).agg(F.first("text").alias("text"))
    # numbered once and stored, so that a number names one text
    ids = stored(keyed.withColumn("doc_id", F.monotonically_increasing_id()), "decontaminate-texts")
    found = find_benchmark(ids, benchmark, block_bytes).where(is_contaminated(F.col("n_words"), F.col("n_hit")))
    return ids.join(found.select("doc_id"), "doc_id", "left_semi").select("_weftline_key")
