"""Queries of the whole tables leave out no row that counts."""

import os

import pytest

from weftline.operators import registry
from weftline.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_masks_hold_the_points_of_every_image(spark):
    points = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_partkey % 6 > 1").collect()
    want = {}  # (image, row, col) -> (position, value)
    for p in points:
        r, c = int(p.l_quantity) % 20, p.l_suppkey % 24
        for y in range(max(r - 2, 0), min(r + 2, 20)):
            for x in range(max(c - 2, 0), min(c + 2, 24)):
                k, v = (str(p.l_orderkey), y, x), (p.l_linenumber * 1000000 + p.l_partkey, p.l_partkey % 6)
                want[k] = max(v, want.get(k, v))
    got = {(r.image_id, r.row, r.col): r.value for r in QUERIES["mask_rasterise"](spark, SF).collect()}
    assert got == {k: v + 100 for k, (_, v) in want.items()}
    counts = {r.value: r.n for r in QUERIES["pixel_counts"](spark, SF).collect()}
    assert counts == {v: sum(x == v for _, x in want.values()) for v in range(2, 6)}
    tiles = {tuple(r) for r in QUERIES["tile_classes"](spark, SF).select("image_id", "tile_id", "value").collect()}
    assert tiles == {(i, f"{y // 8 * 8}_{x // 8 * 8}", v) for (i, y, x), (_, v) in want.items()}


def test_hierarchy_holds_every_customer(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    regions = {r.r_regionkey: r.r_name.lower() for r in read("region")}
    nations = {n.n_nationkey: n for n in read("nation")}
    level = {"loop_a": None, "loop_b": None, "orphan": 1} | dict.fromkeys(regions.values(), 0)
    level |= {n.n_name.lower(): 1 for n in nations.values()}
    up = dict.fromkeys(["loop_a", "loop_b", "orphan"]) | {name: name if k != 2 else None for k, name in regions.items()}
    up |= {n.n_name.lower(): n.n_name.lower() if k % 4 == 0 else up[regions[n.n_regionkey]] for k, n in nations.items()}
    for c in read("customer"):
        level[c.c_name.lower()], up[c.c_name.lower()] = 2, up[nations[c.c_nationkey].n_name.lower()]
    assert {r.label: r.level for r in QUERIES["hierarchy_levels"](spark, SF).collect()} == level
    assert {r.label: r.ancestor for r in QUERIES["hierarchy_rollup"](spark, SF).collect()} == up


def test_chains_are_followed_to_their_end(spark):
    pairs = [(f"a{i}", "d", f"a{i + 1}", "goal" if i == 24 else "d") for i in range(25)]
    pairs += [("x", "d", "y", "d"), ("y", "d", "x", "d"), ("o", "d", "nowhere", "d"), ("s", "d", "s", "d"), ("n", "d", None, None)]
    df = spark.createDataFrame(pairs, "label string, dataset string, target string, target_dataset string")
    got = {r.label: r.reached for r in registry.follow_chain(df, "goal").collect()}
    assert got == {f"a{i}": "a25" for i in range(25)} | dict.fromkeys(["x", "y", "o", "s", "n"])
    with pytest.raises(Exception, match="RECURSION_LEVEL"):
        registry.follow_chain(df, "goal", depth=5).collect()


@pytest.fixture
def few_recursive_rows(spark):
    """A recursive query would stop at this limit of rows; walks are joins and have none."""
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    yield
    spark.conf.set("spark.sql.cteRecursionRowLimit", limit)


def test_chains_of_many_rows(spark, few_recursive_rows):
    n = 80
    pairs = [(f"a{i}", "d", f"a{i + 1}", "goal" if i == n - 1 else "d") for i in range(n)] + [(f"b{i}", "d", f"b{(i + 1) % 3}", "d") for i in range(3)]
    pairs += [("b0", "d", "a70", "d"), ("f", "d", "f1", "goal"), ("f", "d", "a3", "d"), ("a5", "d", "a6", "d")]
    df = spark.createDataFrame(pairs, "label string, dataset string, target string, target_dataset string")
    got = {r.label: r.reached for r in registry.follow_chain(df, "goal").collect()}
    assert got == {f"a{i}": f"a{n}" for i in range(n)} | dict.fromkeys(["b0", "b1", "b2"], f"a{n}") | {"f": "f1"}


def test_hierarchies_of_many_rows(spark, few_recursive_rows):
    edges = [(f"C{i}", "N") for i in range(200)] + [("n", "R"), ("r", None), ("x", "y"), ("y", "x"), ("z", "x"), ("c7", "n")]
    up = registry.ancestors(spark.createDataFrame(edges, "name string, parent string"))
    level = {r.label: r.level for r in registry.levels(up).collect()}
    assert level == {f"c{i}": 2 for i in range(200)} | {"n": 1, "r": 0, "x": None, "y": None, "z": None}
    assert up.count() == 3 * 200 + 2 + 1 + 3 + 3 + 4
    with pytest.raises(RuntimeError, match="RECURSION_LEVEL"):
        registry.ancestors(spark.createDataFrame(edges, "name string, parent string"), depth=1)
