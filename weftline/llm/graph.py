"""Connected components, and links among rows that share buckets.

Nothing here goes to the driver but counts. Tables between rounds are written
to the shared scratch folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.scratch import drop_stored, stored


#: Edges from which on Spark may not broadcast them: they repeat their ids, so that files are a small part of what that takes.
EDGES = 1 << 16
#: Steps up the forest that one table takes where edges are few: tables cost more than joins then.
HOPS = 3


def components(edges: DataFrame) -> DataFrame:
    """id and component (its least id) of every id in the edges (a, b).

    Each round hooks a vertex to its least neighbour, shortens the paths of
    that forest by pointer doubling, and contracts every tree to its root, so
    the number of vertices that still have edges halves at least. Stars,
    whatever their size, take one or two rounds. Empty edges give no rows.
    """
    kind = edges.schema["a"].dataType
    rest = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while n := rest.n_rows:
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up")), "tree")
        while True:
            above = tree.select(F.col("id").alias("up"), F.col("up").alias("top"))
            new = tree.select("id", "up")
            for _ in range(HOPS if n <= EDGES else 1):
                new = new.join(above, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            new = stored(new, "tree", moved=F.count_if("moved"))
            drop_stored(tree)
            tree = new
            if not tree.counted["moved"]:
                break
        at = lambda c: tree.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        ends = [at(c).hint("merge") if n > EDGES else at(c) for c in ("a", "b")]
        moved_edges = rest.join(ends[0], "a").join(ends[1], "b").where("a_up != b_up")
        moved_edges = moved_edges.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        if labels is None:
            labels = tree.select("id", F.col("up").alias("component"))
        else:
            roots = tree.select(F.col("id").alias("component"), "up")
            labels = labels.join(roots, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        rest = stored(moved_edges.distinct(), "edges")
    if labels is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.select(F.col("id").cast(kind), F.col("component").cast(kind))


#: Values of the hash that :func:`maybe` sends to every executor, at most.
SLOTS = 1 << 20


def maybe(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the distinct ``ids`` (column ``key``), dropped where they lie.

    Keeps all rows whose key is, and few others. It broadcasts half of ``SLOTS``
    small numbers at most; with more ids it would drop little, so all rows are kept.
    ``ids`` is a stored table, whose rows are counted.
    """
    if ids.n_rows > SLOTS // 2:
        return rows
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    some = ids.select(slot.alias("_slot")).distinct()
    return rows.withColumn("_slot", slot).join(F.broadcast(some), "_slot", "left_semi").drop("_slot")


def only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the distinct ``ids`` of a stored table: a semi-join that shuffles few others."""
    return maybe(rows, ids, key).join(ids.select(key), key, "left_semi")


def _relabelled(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links (a, b) between ids, some of which ``found`` may not hold yet."""
    ends = links
    for c in ("a", "b"):
        names = found.select(F.col("id").alias(c), F.col("component").alias("up"))
        ends = ends.join(names, c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
    joined = components(ends.select("a", "b")).select(F.col("id").alias("component"), F.col("component").alias("up"))
    new = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(found, "id", "left_anti")
    ids = found.select("id", "component").unionByName(new.select("id", F.col("id").alias("component")))
    return stored(ids.join(joined, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "relabelled")


def _named(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the components of ``found``; an id that it does not hold is its own."""
    return rows.drop("component").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The stored ``rows`` of buckets that more than one component shares; of others none ever will be."""
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return stored(rows.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed")


def _across(rows: DataFrame, on: Column, share: int, before: int) -> DataFrame:
    """Pairs (a, b) of ids of different components that share a bucket and meet ``on``, once each: one in ``share`` by hash, but for the one in ``before``.

    ``rows`` has the buckets of the id beside each bucket: a pair comes from the least of the buckets that it shares, and so once.
    """
    columns = [c for c in rows.columns if c not in ("bucket", "id")]
    one, other = (rows.select(F.col("bucket").alias(b), *[F.col(c).alias(f"{x}_{c}") for c in ("id", *columns)]) for b, x in (("bucket", "a"), ("bucket_", "b")))
    met = (F.col("bucket") == F.col("bucket_")) & (F.col("a_component") != F.col("b_component")) & (F.col("a_id") < F.col("b_id"))
    number = F.xxhash64("a_id", "b_id")
    if share > 1:
        met = met & (F.pmod(number, F.lit(share)) == 0)
    if before:
        met = met & (F.pmod(number, F.lit(before)) != 0)
    met = met & on & (F.array_min(F.array_intersect("a_buckets", "b_buckets")) == F.col("bucket"))
    return one.join(other, met).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


#: Rounds in which each id is held against one leader, before all other pairs are looked at.
ROUNDS = 4
#: Of more than ``MANY`` pairs that are left then, one in so many is looked at first, by hash, and what that links is not looked at again.
SHARES, MANY = (64, 8, 1), 1 << 16


def _between(rows: DataFrame) -> int:
    """Pairs of ids of different components in the buckets of ``rows``; pairs that share several buckets count in each."""
    each = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = each.groupBy("bucket").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    return int(pairs.agg(F.sum("pairs")).first()[0] or 0)


def link_buckets(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    possible: Callable[[], Column],
    traits: Callable[[DataFrame], DataFrame] | None = None,
    bounded: Callable[[], Column] | None = None,
) -> DataFrame:
    """Components of the verified links among ids that share a bucket.

    ``buckets`` has bucket and id; ``verify`` turns candidate pairs (a, b)
    into the pairs that are links. In each round every bucket has a leader and
    each id is held against one of them, the foremost leader of its buckets that
    is in another component; a group of near copies, whatever its size and
    however many buckets it shares, so costs a pair per member and round. In the
    first round the ids that share most lead, then ids by chance. Rounds end
    when one links nothing. Pairs inside one component cannot change
    it; every other pair that shares a bucket is looked at afterwards, in the
    buckets that more than one component shares. Where these are many, it is in
    ``SHARES``: groups that many pairs would link are one after a small share of
    them, and only ids that nothing links are held against all the others.

    ``possible`` is a condition on further columns of both ids (a_ and b_
    before the names) that every link meets and few other pairs do, so that few
    pairs leave the joins. The columns are those of ``buckets``; ``traits`` may
    give more of them for the ids that are left for the last step, where pairs
    must meet the condition ``bounded`` on them too.
    """
    sizes = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    carried = [c for c in buckets.columns if c not in ("bucket", "id")]
    # what belongs to an id is gathered and dealt out once, so that no join has a row for each bucket of an id
    own = maybe(buckets, sizes, "bucket").join(sizes, "bucket").groupBy("id", *carried)
    own = own.agg(F.sum("n").alias("degree"), F.collect_list("bucket").alias("buckets"))
    rows = stored(own.select("id", *carried, "degree", F.col("id").alias("component"), F.explode("buckets").alias("bucket")), "buckets")
    spark = buckets.sparkSession
    kind = buckets.schema["id"].dataType.simpleString()
    found = spark.createDataFrame([], f"id {kind}, component {kind}")
    tested = spark.createDataFrame([], f"a {kind}, b {kind}")
    for turn in range(ROUNDS):
        ranked = rows if turn == 0 else rows.withColumn("degree", F.xxhash64(F.lit(turn), "id"))
        columns = [*carried, "component"]
        ahead = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "id", *columns)).alias("top"))
        ahead = ahead.select("bucket", F.col("top.degree").alias("rank"), *[F.col(f"top.{c}").alias(f"a_{c}") for c in ("id", *columns)])
        members = rows.select("bucket", *[F.col(c).alias(f"b_{c}") for c in ("id", *columns)])
        met = ahead.join(members, "bucket").where((F.col("a_component") != F.col("b_component")) & possible())
        # the foremost of its leaders, one pair for each id
        best = met.groupBy("b_id").agg(F.max(F.struct("rank", "a_id")).alias("lead"))
        pairs = best.select(F.least("b_id", "lead.a_id").alias("a"), F.greatest("b_id", "lead.a_id").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "led")
        links = stored(verify(pairs), "links") if pairs.n_rows else pairs
        tested = tested.unionByName(pairs)
        if not links.n_rows:
            break
        found = _relabelled(found, links)
        if turn < ROUNDS - 1:
            rows = stored(_named(rows, found), "named")
        if turn == 0:  # the first round settles most buckets, the others few
            rows = _mixed(rows)
            if not rows.n_rows:
                return found
    still = _named(rows.groupBy("id", *carried).agg(F.collect_set("bucket").alias("buckets")), found)
    rows = _mixed(stored(still.select("*", F.explode("buckets").alias("bucket")), "named"))
    if not rows.n_rows:
        return found
    still = stored(rows.drop("bucket").distinct(), "open")
    if traits is not None:
        still = still.join(stored(traits(still.select("id")), "traits"), "id")
        still = stored(still, "open")
    rows, before = None, 0  # the share that has been looked at
    for share in SHARES:
        if rows is None:
            rows = stored(still.select("*", F.explode("buckets").alias("bucket")), "mixed")
        if share > 1 and _between(rows) <= MANY:
            continue
        pairs = _across(rows, possible() if bounded is None else possible() & bounded(), share, before)
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "cross")
        before = share
        links = stored(verify(pairs), "links") if pairs.n_rows else pairs
        if not links.n_rows:
            continue
        found = _relabelled(found, links)
        if share > 1:
            still, rows = stored(_named(still, found), "open"), None
    return found
