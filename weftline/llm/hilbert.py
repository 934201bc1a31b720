"""Sharding by Hilbert-curve order over several metadata dimensions.

Each dimension is quantised to ``bits`` bits; the cell's index on the Hilbert
curve orders the documents, and runs of that order, cut at equal row counts,
are the shards. Neighbours on the curve share ranges of every dimension, so a
shard's manifest (:func:`manifest`) rules it out for filters on any of them.

Ranks come without a global sort. Cells are counted first (at most
2**(dims * bits) rows); a cell above an even share is split by a hash of the
document, so no group holds more than about ``1 / SPLITS`` of the rows; the
running sum over the groups, at most 2**(dims * bits) + SPLITS of them, gives
each group's first rank, and a window within each group gives the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.scratch import stored

BITS = 4
SPLITS = 1024


def curve_index(point: Sequence[int], bits: int) -> int:
    """Position of a cell on the Hilbert curve, by Skilling's transpose of its axes."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in reversed(range(bits)):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


def hilbert(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The curve index of quantised columns, by a table made from the curve's rule."""
    n, side = len(cells), 1 << bits
    points = ([c >> bits * (n - 1 - i) & side - 1 for i in range(n)] for c in range(side**n))
    table = ",".join(str(curve_index(p, bits)) for p in points)
    packed = sum((F.coalesce(c, F.lit(0)) * side ** (n - 1 - i) for i, c in enumerate(cells)), F.lit(0))
    return F.element_at(F.expr(f"cast(split('{table}', ',') as array<int>)"), (packed + 1).cast("int"))


def by_hash(c: Column, bits: int = BITS) -> Column:
    """Quantise a label; null is cell 0."""
    return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << bits))).cast("int")


def by_log(c: Column, bits: int = BITS) -> Column:
    """Quantise a size by its logarithm, from 16 on; null is cell 0."""
    cell = F.floor(F.log2(F.greatest(c.cast("double"), F.lit(16.0)))) - 4
    return F.coalesce(F.least(F.lit((1 << bits) - 1), cell), F.lit(0)).cast("int")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def crc_of(text: Column) -> Column:
    """CRC-32 of the UTF-8 text; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def document_dims(bits: int = BITS) -> list[Column]:
    """The dimensions of documents: size, source and lang."""
    return [by_log(size_of(F.col("text")), bits), by_hash(F.col("source"), bits), by_hash(F.col("lang"), bits)]


def shard_rows(docs: DataFrame, shards: int, dims: Sequence[Column] | None = None, bits: int = BITS) -> DataFrame:
    """Put rows into ``shards`` runs of the Hilbert order, counts at most one apart.

    One row per row of ``docs``: doc_id, size, text_crc32, cells (the quantised
    dimensions), curve (the cell's index), shard and slot (gapless from 0 in each
    shard). ``dims`` are already quantised columns, by default of the size,
    source and lang (:func:`document_dims`). Nulls
    fall into cell 0 and null ids sort first; repeated rows each get a slot of
    their own; an empty table has no rows. Other columns are ignored.
    """
    if dims is None:
        dims = document_dims(bits)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        size_of(F.col("text")).alias("size"),
        crc_of(F.col("text")).alias("text_crc32"),
        F.array(*[F.coalesce(d, F.lit(0)).cast("int") for d in dims]).alias("cells"),
        hilbert(dims, bits).alias("curve"),
    )
    rows = stored(rows, "hilbert")
    cells = rows.groupBy("curve").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    # at most one row for each cell of the curve: a bounded broadcast
    parts = cells.crossJoin(F.broadcast(total)).select(
        "curve", "total", F.ceil(F.col("n") * SPLITS / F.col("total")).cast("int").alias("parts")
    )
    split = rows.join(F.broadcast(parts), "curve").withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.col("parts")).cast("int")
    )
    order = Window.orderBy("curve", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "curve", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("curve", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = split.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(starts), ["curve", "part"])
    rank, total = F.col("start") + F.col("nth"), F.col("total")
    base, more = F.expr(f"total div {shards}"), total % shards
    # the first `more` shards hold base + 1 rows, the rest hold base
    edge = more * (base + 1)
    shard = F.when(rank < edge, F.floor(rank / (base + 1))).otherwise(
        more + F.floor((rank - edge) / F.greatest(base, F.lit(1)))
    )
    first = F.when(rank < edge, F.col("shard") * (base + 1)).otherwise(edge + (F.col("shard") - more) * base)
    return ranked.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", "cells", "curve", "shard", (rank - first).cast("bigint").alias("slot")
    )


def manifest(sharded: DataFrame) -> DataFrame:
    """What each shard spans: rows, bytes, its run of the curve, and the least and greatest cell of every dimension (low, high)."""
    spans = sharded.select("shard", "size", "curve", F.posexplode("cells").alias("dim", "cell"))
    each = spans.groupBy("shard", "dim").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    bounds = F.array_sort(F.collect_list(F.struct("dim", "low", "high")))
    whole = sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("size").alias("bytes"),
        F.min("curve").alias("first_curve"),
        F.max("curve").alias("last_curve"),
    )
    each = each.groupBy("shard").agg(bounds.alias("bounds"))
    return whole.join(each, "shard").select(*whole.columns, F.col("bounds.low").alias("low"), F.col("bounds.high").alias("high"))


def shards_to_read(spans: DataFrame, wanted: dict[int, tuple[Column | int, Column | int]]) -> DataFrame:
    """The shards of a :func:`manifest` that a filter can find rows in; all others may be skipped.

    ``wanted`` has the least and the greatest cell that the filter lets through
    (numbers, or columns such as ``by_hash(lit("web"))``) by dimension.
    """
    may = F.lit(True)
    for dim, (least, most) in wanted.items():
        least, most = (x if isinstance(x, Column) else F.lit(x) for x in (least, most))
        may = may & (F.col("low")[dim] <= most) & (F.col("high")[dim] >= least)
    return spans.where(may).select("shard")
