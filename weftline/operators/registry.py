"""Label vocabularies, disjoint global ids, source-to-target maps and hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.scratch import drop_stored, stored, temporary

DEPTH = 100


def vocabulary(rows: DataFrame, source: str, label: str, by_count: bool = False) -> DataFrame:
    """Local ids 1..N of each source's distinct labels, by name or by falling count."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(source, label).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.col(label)] if by_count else [F.col(label)]
    local = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return counts.select(F.col(source).alias("source"), F.col(label).alias("label"), "n", local.alias("local_id"))


def offsets(sizes: DataFrame, order: str, size: str) -> DataFrame:
    """Each row's offset: the sizes of all rows before it. For dimension tables."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def global_ids(vocabularies: DataFrame) -> DataFrame:
    """Disjoint ids: a label's local id after the labels of all sources before its own."""
    sizes = vocabularies.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    return vocabularies.join(offsets(sizes, "source", "size"), "source").select(
        "source", "label", "local_id", (F.col("offset") + F.col("local_id")).alias("global_id")
    )


def overlapping_offsets(sizes: DataFrame) -> DataFrame:
    """Offsets that more than one source has; must be empty."""
    return sizes.groupBy("offset").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def label_map(pairs: DataFrame, overrides: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """(label, target) in lower case without null targets, one target a label; overrides replace a label's target.

    Of several targets that lower-casing gives a label, the last by the column
    ``position`` counts, or the greatest where pairs have no order.
    """

    def low(df: DataFrame) -> DataFrame:
        rows = df.where("target is not null").groupBy(F.lower("label").alias("label"))
        target = F.lower("target")
        return rows.agg((F.max_by(target, F.struct(position, target)) if position else F.max(target)).alias("target"))

    if overrides is None:
        return low(pairs)
    new = low(overrides)
    return new.unionByName(low(pairs).join(new.select("label"), "label", "left_anti"))


def conflicting_targets(pairs: DataFrame) -> DataFrame:
    """Labels that lower-casing gives several targets."""
    return pairs.groupBy(F.lower("label").alias("label")).agg(F.count_distinct(F.lower("target")).alias("n")).where("n > 1")


def target_ids(pairs: DataFrame, subset: Sequence[str] | None = None, position: str | None = None) -> DataFrame:
    """Ids 1..N of the sorted distinct targets, or of a subset of them."""
    names = label_map(pairs, position=position).select("target").distinct()
    if subset is not None:
        names = names.where(F.col("target").isin([s.lower() for s in subset]))
    return names.withColumn("target_id", F.row_number().over(Window.orderBy("target")))


def source_to_target(
    vocab: DataFrame, pairs: DataFrame, targets: DataFrame, closure: DataFrame | None = None, position: str | None = None
) -> DataFrame:
    """The target id of each vocabulary row, 0 where nothing maps; one row out for each row in.

    With ``closure`` (label, ancestor, depth), a target that is not among
    ``targets`` rolls up to its nearest ancestor that is.
    """
    named = vocab.withColumn("_label", F.lower("label")).join(label_map(pairs, position=position).withColumnRenamed("label", "_label"), "_label", "left")
    if closure is not None:
        named = named.join(nearest(closure, targets).select(F.col("label").alias("target"), "ancestor"), "target", "left")
        named = named.withColumn("target", F.coalesce("ancestor", "target"))
    out = named.join(targets, "target", "left").withColumn("target_id", F.coalesce("target_id", F.lit(0)))
    return out.select(*vocab.columns, "target_id")


def ancestors(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """label, ancestor, depth and cycle for every label of (name, parent), itself at depth 0.

    Names are lower case, and edges that repeat count once. A walk stops at a root, at a parent that is no name
    (which still counts), or at a name that it has met, which marks a cycle. Each level is a join whose result goes
    to the scratch folder, so there is no limit on rows; a walk of more than ``depth`` levels raises.
    """
    named = edges.select(F.lower("name").alias("name"), F.lower("parent").alias("parent")).distinct()
    with temporary(edges.sparkSession) as keep:
        named = keep(stored(named, "hierarchy"))
        above = named.where("parent is not null")
        last = named.select(F.col("name").alias("label"), F.col("name").alias("ancestor"), F.lit(0).alias("depth"), F.array("name").alias("seen"), F.lit(False).alias("cycle"))
        closure = last.drop("seen")
        for level in range(depth + 1):
            # the names that walks have reached are few, where many labels are below the same
            reached = last.where("not cycle").select(F.col("ancestor").alias("name")).distinct()
            step = last.where("not cycle").join(above.join(reached, "name", "left_semi"), F.col("ancestor") == F.col("name"))
            step = step.select(
                "label", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"),
                F.array_append("seen", F.col("parent")).alias("seen"), F.array_contains("seen", F.col("parent")).alias("cycle"),
            )
            last = stored(step, "ancestors")
            if not last.limit(1).count():
                return closure
            closure = closure.unionByName(keep(last).drop("seen"))
    raise RuntimeError(f"RECURSION_LEVEL: a walk has more than {depth} levels")


def levels(closure: DataFrame) -> DataFrame:
    """Depth of each label below its root; null on a cycle."""
    top = closure.groupBy("label").agg(F.max("depth").alias("depth"), F.max("cycle").alias("cycle"))
    return top.select("label", F.when(~F.col("cycle"), F.col("depth")).alias("level"))


def nearest(closure: DataFrame, targets: DataFrame) -> DataFrame:
    """The nearest ancestor-or-self of each label that is a target; null without one."""
    names = targets.select(F.col("target").alias("ancestor"), F.lit(True).alias("_target")).distinct()
    # one pass over the walk, which is recursive and dear
    marked = closure.join(names, "ancestor", "left")
    depth = F.when(F.col("_target") & ~F.col("cycle"), F.col("depth"))
    return marked.groupBy("label").agg(F.min_by(F.when(depth.isNotNull(), F.col("ancestor")), depth).alias("ancestor"))


#: A walk of more steps than this raises.
STEPS = 1_000_000


def follow_chain(pairs: DataFrame, goal: str, depth: int = STEPS) -> DataFrame:
    """Follow (label, dataset) -> (target, target_dataset) until the goal dataset.

    One row per starting pair: the label reached in ``goal`` (the greatest of
    several), or null where the chain ends elsewhere or runs in a circle. A walk
    stops at the goal or at a pair that leads nowhere; each round doubles the
    steps of all open walks, so that a chain takes as many rounds as its length
    has digits, and a walk still open after as many steps as there are pairs runs
    in a circle. An end that takes more than ``depth`` steps raises.
    """
    start = pairs.select("label", "dataset", F.col("target").alias("at"), F.col("target_dataset").alias("at_dataset")).distinct()
    goes_on = F.coalesce(F.col("at_dataset") != goal, F.lit(False))
    with temporary(pairs.sparkSession) as keep:
        rows = stored(start.withColumns({"steps": F.lit(1).cast("bigint"), "open": goes_on}), "chain")
        most, reach = rows.count(), 1
        while reach <= most and rows.where("open").limit(1).count():
            onward = rows.select(
                F.col("label").alias("at"), F.col("dataset").alias("at_dataset"), F.col("at").alias("to"), F.col("at_dataset").alias("to_dataset"),
                F.col("steps").alias("more"), F.col("open").alias("to_open"),
            )
            moved = rows.where("open").join(onward, ["at", "at_dataset"], "left")
            went = F.col("more").isNotNull()
            moved = moved.select(
                "label", "dataset", F.when(went, F.col("to")).otherwise(F.col("at")).alias("at"),
                F.when(went, F.col("to_dataset")).otherwise(F.col("at_dataset")).alias("at_dataset"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("to_open", F.lit(False)).alias("open"),
            )
            walks = rows.where("not open").unionByName(moved).groupBy("label", "dataset", "at", "at_dataset", "open")
            new = stored(walks.agg(F.min("steps").alias("steps")).select(rows.columns), "chain")
            drop_stored(rows)
            rows, reach = new, 2 * reach
        keep(rows)
        longest = rows.where("not open").agg(F.max("steps")).first()[0]
    if (longest or 0) > depth:
        raise RuntimeError(f"RECURSION_LEVEL: a walk of {longest} steps; {depth} are allowed")
    return rows.groupBy("label", "dataset").agg(F.max(F.when(F.col("at_dataset") == goal, F.col("at"))).alias("reached"))


def final_map(labels: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The first map's target, else the second's, else null; capitalised."""
    from weftline.functions.text import capitalized

    a = first.select("label", F.col("target").alias("_a"))
    b = second.select("label", F.col("target").alias("_b"))
    return labels.join(a, "label", "left").join(b, "label", "left").select("label", capitalized(F.coalesce("_a", "_b")).alias("target"))


def canonical_spelling(labels: DataFrame, label: str) -> DataFrame:
    """Each spelling with the one that stands for its case-insensitive group: not all capitals first, then the least."""
    spelled = labels.select(label).distinct()
    order = Window.partitionBy(F.lower(label)).orderBy((F.col(label) == F.upper(label)), F.col(label))
    return spelled.withColumn("canonical", F.first(label).over(order))


def dense_ids(ids: DataFrame, table: DataFrame, key: str, value: str, default: int = 0) -> DataFrame:
    """Rows of ``ids`` with the value of their key in a lookup table; the default for keys outside it."""
    return ids.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def wide_annotations(rows: DataFrame, names: DataFrame, required: str, others: Sequence[str]) -> DataFrame:
    """Annotator columns of label ids as columns of label names.

    ``names`` (id, name) is the label map, a dimension table. Rows whose ``required``
    annotator has no known label drop out; the other annotators are null where
    they gave none, gave an unknown one, or have no column.
    """
    out = rows
    for i, c in enumerate((required, *others)):
        if c not in rows.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
            continue
        look = names.select(F.col("id").alias(f"_{c}"), F.col("name").alias(f"_{c}_name"))
        out = out.withColumn(f"_{c}", F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("int"))
        out = out.join(look, f"_{c}", "left" if i else "inner").withColumn(c, F.col(f"_{c}_name")).drop(f"_{c}", f"_{c}_name")
    return out


def in_order(choices: DataFrame, fixed: DataFrame, name: str, position: str) -> DataFrame:
    """The entries of a fixed vocabulary that occur among the choices, in its order."""
    return fixed.join(choices.select(name), name, "left_semi").orderBy(position)


def pick_annotator(primary: Column, fallback: Column | None, primary_name: str, fallback_name: str) -> tuple[Column, Column]:
    """The primary label, else the fallback, and who gave it."""
    if fallback is None:
        return primary, F.when(primary.isNotNull(), primary_name)
    return F.coalesce(primary, fallback), F.when(primary.isNotNull(), primary_name).when(fallback.isNotNull(), fallback_name)
