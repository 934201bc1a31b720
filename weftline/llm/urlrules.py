"""URL filters as a sort-merge range join over reversed-host keys.

A host's labels reversed and each closed by a dot ("net.example.") turn "this
host and all subdomains" into a prefix, and so a rule's host into an interval
of keys. Pages and rules are dealt out by ranges of the key, a rule to every
range that its interval meets; in each range both are sorted by the key and
swept once, with a stack of the rules whose intervals are open. Intervals of
prefixes nest, so the stack is as deep as hosts have labels. A page compares
its path with the open rules only, and the longest rule that fits decides.

The key ends in a hash of the page, so that a host with a third of all pages
spans several ranges. The range bounds are the only thing on the driver: a
sample of 64 keys for each partition.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGED = "page_id bigint, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """"a.example.net" as "net.example.a."."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _after(prefix: Column) -> Column:
    """The least string above all strings with this prefix, which ends in a dot."""
    return F.concat(F.substr(prefix, F.lit(1), F.length(prefix) - 1), F.lit("/"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None
) -> DataFrame:
    """The verdict on each page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all
    subdomains where the page's path starts with the rule's path; the longest
    host and path wins, then the longer host, then a block over an allow.
    No fitting rule: rule is null and the verdict is ``default``. A null url, or
    one without "://", has an empty host and path. Rules with a null are
    ignored, repeated rules count once, other columns are ignored; empty pages
    or rules give the rows that follow from this.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url")
    salt = F.lpad(F.hex(F.xxhash64("page_id", "url")), 16, "0")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        salt.alias("salt"),
    ).withColumn("key", F.concat(host_key(F.col("host")), F.lit("\0"), F.col("salt")))
    # by a threshold of the salt, about twice the rows that are asked for, however many splits there are
    share = min(1.0, 128 * n / max(1, pages.count()))
    few = rows.where(F.substring("salt", 1, 8) < f"{int(share * 0xFFFFFFFF):08X}") if share < 1 else rows
    sample = few.select("salt", "key").orderBy("salt", "key").limit(64 * n).collect()
    keys = sorted((r.key.encode() for r in sample))
    ranges = 4 * n  # more than partitions, so that they even out
    bounds = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, k.encode()) for k in key], dtype="int32")

    left = rows.select(
        part(F.col("key")).alias("part"), "key", F.lit(1).alias("kind"), "page_id", "host", "path",
        F.lit(None).cast("string").alias("verdict"),
    )
    clean = rules.select(
        F.lower("host").alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict")
    ).dropna().distinct()
    right = (
        clean.withColumn("key", host_key(F.col("host")))
        .withColumn("part", F.explode(F.sequence(part(F.col("key")), part(_after(F.col("key"))))))
        .select(
            "part", "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("page_id"), "host", "path", "verdict",
        )
    )

    def sweep(batches):
        stack: list[tuple[str, list]] = []  # (key of the rules' host, [(length, host length, verdict, host, path)])
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "host", "path", "rule", "verdict")}
            columns = [batch.column(c).to_pylist() for c in ("kind", "key", "page_id", "host", "path", "verdict")]
            for kind, key, page, host, path, verdict in zip(*columns, strict=True):
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, by_path, lengths = stack[-1]
                    rule = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
                    by_path[path] = max(rule, by_path.get(path, rule))
                    if len(path) not in lengths:
                        insort(lengths, len(path))
                    continue
                best = None
                for _, by_path, lengths in stack:
                    fits = next((by_path[path[:m]] for m in reversed(lengths) if path[:m] in by_path), None)
                    best = max(filter(None, (best, fits)), default=None)
                out["page_id"].append(page)
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(best and best[3])
                out["verdict"].append(best[4] if best else default)
            schema = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("host", "path", "rule", "verdict"))])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    both = left.unionByName(right)
    # a partition may get several ranges; sorted by range and key it sweeps one after the other
    dealt = both.repartition(n, "part").sortWithinPartitions("part", "key", "kind")
    return dealt.mapInArrow(_by_part(sweep), JUDGED)


def _by_part(sweep):
    """Run ``sweep`` on each run of rows with one part."""
    import pyarrow.compute as pc

    def run(batches):
        def runs():
            for batch in batches:
                part = batch.column("part")
                at = 0
                while at < batch.num_rows:
                    same = pc.equal(part, part[at])
                    end = at + pc.sum(same).as_py()
                    yield part[at].as_py(), batch.slice(at, end - at)
                    at = end

        groups = runs()
        held = next(groups, None)
        while held is not None:
            now = held[0]

            def one():
                nonlocal held
                while held is not None and held[0] == now:
                    yield held[1]
                    held = next(groups, None)

            yield from sweep(one())

    return run
