"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

On a bounded sample, unit vectors are centred, turned to their principal axes
and rotated so that signs lose as little as possible (iterative quantisation);
rotations from different starts give as many balanced bits as are needed. The
code is cut into parts, a table each. A part is so wide that there are four
times as many buckets as vectors, so that chance meetings of a vector do not
grow with the table, and there are so many tables that a pair at the threshold
is missed in ``MISS`` of the cases (:func:`plan`). Every distinct vector is
stored once in each table and looks up its own part and those that differ in
one bit; a pair is taken from the first table that has it, so none is repeated.
Pairs whose codes are eight standard deviations farther apart than a pair at
the threshold go before their vectors are fetched, and the original vectors
decide, by cosine in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.scratch import stored, temporary

from .graph import components

SAMPLE, ITERATIONS, COSINE, MISS = 4096, 40, 0.93, 0.01


def differing(least: float, centre: np.ndarray) -> float:
    """The share of bits that differ between codes of vectors at this cosine, which lie about as far from the centre as most."""
    apart = (1 - least) / max(1 - float(centre @ centre), 1e-6)
    return float(np.clip(np.arccos(np.clip(1 - apart, -1, 1)) / np.pi, 1e-6, 0.5))


def plan(rows: int, share: float) -> tuple[int, int, int]:
    """Bits of a part, tables, and 64-bit words of the code, for so many vectors and this share of differing bits."""
    part = int(min(32, max(16, np.ceil(np.log2(4 * max(rows, 1))))))
    met = (1 - share) ** part + part * share * (1 - share) ** (part - 1)
    tables = int(np.ceil(np.log(MISS) / np.log1p(-min(met, 0.999))))
    return part, tables, -(-tables // (64 // part))


def rotations(sample: np.ndarray, words: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dimensions x bits) learned from unit vectors."""
    rng = np.random.default_rng(seed)
    centre = sample.mean(axis=0)
    x = sample - centre
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :64]
    v = x @ axes
    c, made = axes.shape[1], []
    while sum(m.shape[1] for m in made) < words * 64:
        r = np.linalg.qr(rng.normal(size=(c, c)))[0]
        for _ in range(ITERATIONS):
            left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        made.append(axes @ r)
    return centre, np.concatenate(made, axis=1)[:, : words * 64]


def encode(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes of vectors, as signed 64-bit words."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    bits = (unit - centre) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def usable(embedding: Column) -> Column:
    """Not null, not empty, not zero, and all components finite."""
    big = float(np.finfo(np.float64).max)
    good = F.forall(embedding, lambda c: c.isNotNull() & (F.abs(c) <= big))
    return F.coalesce(good & F.exists(embedding, lambda c: c != 0), F.lit(False))


def _matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists as rows padded with zeros to one width."""
    flat, size = np.asarray(column.flatten(), dtype=np.float64), np.diff(np.asarray(column.offsets))
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; rows are scaled first, so that no square overflows or vanishes."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _sample(classes: DataFrame, rows: int, width: int) -> np.ndarray:
    """Up to ``SAMPLE`` unit vectors, chosen by hash."""
    few = classes.select("key", "v")
    if rows > 2 * SAMPLE:  # about twice the sample, however many splits there are
        few = few.where(F.pmod(F.xxhash64("key"), F.lit(rows // (2 * SAMPLE))) == 0)
    sample = few.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    x = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        x[i, : len(r.v)] = r.v
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(classes: DataFrame, width: int, centre: np.ndarray, projection: np.ndarray) -> DataFrame:
    import pyarrow as pa

    count = projection.shape[1] // 64

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            code = encode(m / np.abs(m).max(axis=1, keepdims=True), centre, projection)
            columns = [batch.column("key"), batch.column("within"), *(pa.array(c) for c in code.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "within", *(f"c{i}" for i in range(count))])

    words = ", ".join(f"c{i} bigint" for i in range(count))
    return classes.select("key", "within", "v").mapInArrow(run, f"key binary, within bigint, {words}")


def _part(words: list[Column], table: int, part: int) -> Column:
    per = 64 // part
    return F.shiftrightunsigned(words[table // per], part * (table % per)).bitwiseAND(F.lit((1 << part) - 1))


def _candidates(codes: DataFrame, part: int, tables: int, count: int, radius: int) -> DataFrame:
    """Pairs (a, b) of keys that some table brings together, once each, within the radius."""
    words = [F.col(f"c{i}") for i in range(count)]
    near = [0, *(1 << b for b in range(part))]
    bucket = lambda t, at: F.struct(F.lit(t).alias("t"), F.xxhash64("within", F.lit(t), at).alias("bucket"))
    stored_at = F.array(*[bucket(t, _part(words, t, part)) for t in range(tables)])
    index = codes.select(F.col("key").alias("b"), F.inline(stored_at), *[w.alias(f"b{i}") for i, w in enumerate(words)])
    # the differing bit is exploded last, so that the plan stays small with many tables
    looks_at = F.array(*[F.struct(F.lit(t).alias("t"), _part(words, t, part).alias("at")) for t in range(tables)])
    probe = codes.select(F.col("key").alias("a"), "within", F.inline(looks_at), *[w.alias(f"a{i}") for i, w in enumerate(words)])
    probe = probe.withColumn("flip", F.explode(F.array(*[F.lit(x).cast("bigint") for x in near])))
    probe = probe.withColumn("bucket", F.xxhash64("within", "t", F.col("at").bitwiseXOR(F.col("flip")))).drop("within", "at", "flip")
    index = index.withColumnRenamed("t", "t_b").withColumnRenamed("bucket", "bucket_b")
    apart = [F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")) for i in range(count)]
    distance = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0]))
    earlier = [(F.col("t") > t) & (F.bit_count(_part(apart, t, part)) <= 1) for t in range(tables - 1)]
    on = (F.col("bucket") == F.col("bucket_b")) & (F.col("t") == F.col("t_b")) & (F.col("a") < F.col("b")) & (distance <= radius)
    for e in earlier:
        on = on & ~e
    # codes are small in files and become a row for each table and bit: by their size Spark would broadcast these rows from the driver
    return probe.join(index.hint("merge"), on).select("a", "b")


def _linked(pairs: DataFrame, classes: DataFrame, width: int, least: float) -> DataFrame:
    import pyarrow as pa

    # pairs repeat their keys, so that files are a small part of what a broadcast takes
    for c in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("key").alias(c), F.col("v").alias(f"{c}_v"), F.col("within").alias(f"{c}_in")).hint("merge"), c)
    pairs = pairs.where("a_in = b_in").select("a", "b", "a_v", "b_v")

    def run(batches):
        for batch in batches:
            keep = cosine(_matrix(batch.column("a_v"), width), _matrix(batch.column("b_v"), width)) >= least
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"])
            yield out.filter(pa.array(keep))

    return pairs.mapInArrow(run, "a binary, b binary")


def similar_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept.

    Vectors are compared where their labels are equal and not null and they
    have equally many components; a vector that is null, empty, zero or holds
    null or non-finite components links with nothing. n_links counts the other
    rows that a row is linked with, copies too; component_id is the least vec_id
    that links reach; kept marks the rows of that id. Equal vectors are
    compared once for all their rows. Null ids name a group only if no other
    does. Other columns are ignored; an empty table has no rows.
    """
    v = F.transform("embedding", lambda c: c.cast("double") + 0.0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), "label")
    good = usable(F.col("v")) & F.col("label").isNotNull()
    within = F.xxhash64(F.col("label").cast("string"), F.size("v"))
    key = F.unhex(F.md5(F.concat_ws(";", F.col("label").cast("string"), F.array_join("v", ","))))
    with temporary(vectors.sparkSession) as keep:
        rows = keep(stored(rows.select("vec_id", F.when(good, key).alias("key"), F.when(good, within).alias("within"), F.when(good, F.col("v")).alias("v")), "vectors"))
        classes = rows.where("key is not null").groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("within").alias("within"), F.first("v").alias("v")
        )
        classes = stored(classes, "vector-classes")
        width = classes.agg(F.max(F.size("v"))).first()[0]
        alone = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
        if width:
            count = classes.count()
            sample = _sample(classes, count, width)
            share = differing(least, sample.mean(axis=0))
            part, tables, words = plan(count, share)
            bits = words * 64
            radius = int(bits * share + 8 * (bits * share * (1 - share)) ** 0.5) + 1
            codes = stored(_coded(classes, width, *rotations(sample, words)), "codes")
            pairs = stored(_candidates(codes, part, tables, words, radius), "code-pairs")
            links = stored(_linked(pairs, classes, width, least), "vector-links")
            sizes = classes.select("key", "n")
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            others = both.join(sizes.withColumnRenamed("key", "b").hint("merge"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
            named = classes.select("key", "n", "first_id").join(others, "key", "left").join(components(links).withColumnRenamed("id", "key"), "key", "left")
            named = named.withColumn("component", F.coalesce("component", "key"))
            ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
            named = named.join(ids, "component").select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
            told = rows.where("key is not null").select("vec_id", "key").join(keep(stored(named, "vector-groups")), "key")
            alone = told.select("vec_id", "n_links", "component_id").unionByName(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
