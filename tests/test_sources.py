"""Files in and out: source folders, listings, parts, checkpoints, digests and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from weftline import schemas
from weftline.operators.annotations import merge_annotations, source_audit
from weftline.sources import files, sinks
from weftline.streaming import jobs

POINTS = ["Name", "Row", "Column", "Label ID", "Status"]


@pytest.fixture
def root(tmp_path):
    """Folders s1 and s42 as exported, one without an image list, and two that are no sources."""
    for s in (1, 42):
        d = tmp_path / f"s{s}"
        (d / "images").mkdir(parents=True)
        names = [f"img_{s}_{i}.jpg" for i in range(3)]
        lines = [f"{n},{100 + p},{200 + p},{1000 + p % 7},Confirmed" for n in names for p in range(5)]
        (d / "annotations.csv").write_text("Name,Row,Column,Label ID,Status\n" + "\n".join(lines) + '\n"odd, name.jpg",1\n')
        for n in names:
            (d / "images" / n).write_bytes(b"x")
    (tmp_path / "s1" / "image_list.csv").write_text("Name,Image Page\n" + "".join(f"img_1_{i}.jpg,/image/{10000 + i}/view/\n" for i in range(3)))
    for bad in ("sNotANumber", "other"):
        (tmp_path / bad).mkdir()
        (tmp_path / bad / "annotations.csv").write_text("Name\nx\n")
    return str(tmp_path)


def test_folders_to_annotations(spark, root):
    found = files.list_sources(spark, root)
    assert [tuple(r) for r in found.collect()] == [(1, ["annotations.csv", "image_list.csv"]), (42, ["annotations.csv"])]
    assert [r[0] for r in files.sources_with(found).collect()] == [1]
    points = files.read_source_csvs(spark, root, "annotations.csv", POINTS)
    assert points.where("Name = 'odd, name.jpg'").select("Row", "Column").collect()[0] == ("1", None)
    pages = files.read_source_csvs(spark, root, "image_list.csv", ["Name", "Image Page"])
    labels = files.read_source_csvs(spark, root, "labelset.csv", ["Label ID", "Name"])
    assert labels.count() == 0
    audit = source_audit(found, files.image_objects(spark, root), points.where("Status is not null"), pages, labels, labels)
    got = {r.source_id: r for r in audit.collect()}
    assert got[1].is_complete and not got[42].is_complete and got[1].n_images_s3 == 3 and got[42].n_labels is None
    merged = merge_annotations(points, pages, audit)
    assert merged.count() == 15 and {r[0] for r in merged.select("image_id").distinct().collect()} == {"10000", "10001", "10002"}


def test_missing_files(spark, tmp_path):
    assert files.read_text_csv(spark, f"{tmp_path}/none.csv") is None
    assert files.non_blank_rows(spark, f"{tmp_path}/none.csv") is None
    (tmp_path / "a.csv").write_text("h\n1\n\n2\n")
    assert files.non_blank_rows(spark, f"{tmp_path}/a.csv") == 2
    assert files.read_parts(spark, f"{tmp_path}/parts", schemas.IMAGES).columns == schemas.IMAGES.fieldNames()


def test_unreadable_parts_are_skipped(spark, tmp_path):
    p = str(tmp_path / "parts")
    sinks.append_part(spark.createDataFrame([(1, "a")], "source_id int, image_id string"), p, sinks.next_batch(spark, p))
    assert sinks.next_batch(spark, p) == 1
    (tmp_path / "parts" / "bad.parquet").write_bytes(b"garbage")
    kind = spark.createDataFrame([], "source_id int, image_id string").schema
    assert files.read_parts(spark, p, kind).count() == 1


def test_label_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": "x", "b": None}))
    assert sorted(map(tuple, files.read_json_map(spark, f"{tmp_path}/m.json").collect())) == [("a", "x"), ("b", None)]
    (tmp_path / "p.txt").write_text("# note\n1;2;coral\nbad\n3;x;y\n4;5;OFF\n")
    assert [tuple(r) for r in files.read_point_text(spark, f"{tmp_path}/p.txt").collect()] == [(1, 2, "coral")]
    (tmp_path / "d.py").write_text("labels = {1: 'a', 20: 'b'}\n")
    assert sorted(map(tuple, files.read_literal_map(spark, f"{tmp_path}/d.py").collect())) == [(1, "a"), (20, "b")]
    assert [r[0] for r in files.id_list(spark, "3, 1,x,1").collect()] == [1, 3]
    with pytest.raises(ValueError):
        files.id_list(spark)
    one = spark.createDataFrame([(" ", "b.jpg")], "imagefile string, image string")
    assert one.select(files.first_filled("imagefile", "image")).first()[0] == "b.jpg"


def test_listing_to_checkpoint(spark):
    df = spark.createDataFrame([("x/resized/s7/images/a.b.jpg",), ("x/s7/images/c.jpg",)], "path string")
    assert [tuple(r) for r in files.resized_listing(df).collect()] == [(7, "a.b", "completed")]


def test_digest_ignores_order_and_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 1, 1, 5, None), (1, "a", 1, 1, 5, "Confirmed")], schemas.ANNOTATIONS)
    sinks.write_sorted(df, f"{tmp_path}/a", schemas.ANNOTATIONS, schemas.KEYS["annotations"])
    sinks.write_sorted(df.orderBy("source_id"), f"{tmp_path}/b", schemas.ANNOTATIONS, schemas.KEYS["annotations"], files=2)
    a, b = (spark.read.parquet(f"{tmp_path}/{x}") for x in "ab")
    assert sinks.digest(a) == sinks.digest(b) != sinks.digest(a.withColumn("row", F.col("row") + 1))
    assert [r.source_id for r in a.collect()] == [1, 2]


def test_replace_table_and_reports(spark, tmp_path):
    p = f"{tmp_path}/t"
    for n in (1, 2):
        sinks.replace_table(spark.range(n), p)
        assert sinks.read_table(spark, p).count() == n
    assert [x.name for x in tmp_path.iterdir()] == ["t"] and sinks.read_table(spark, f"{tmp_path}/none") is None
    assert len([x for x in (tmp_path / "t").iterdir() if x.is_dir()]) == 1  # the version before is gone
    with pytest.raises(Exception, match="ZERO"):  # a failed write leaves the table as it was
        sinks.replace_table(spark.range(3).selectExpr("1 / (id - id) AS id"), p)
    assert sinks.read_table(spark, p).count() == 2
    sinks.write_summary(spark.createDataFrame([(1, "x")], "a int, b string"), f"{tmp_path}/s.yaml")
    assert (tmp_path / "s.yaml").read_text() == "a: 1\nb: x\n"
    sinks.write_json(spark.range(1), f"{tmp_path}/j")
    sinks.write_csv(spark.range(1), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first().id == "0"


def test_version_tag(monkeypatch):
    monkeypatch.delenv("DATASET_VERSION", raising=False)
    assert sinks.version_tag("x") == "x" and sinks.version_tag(today=dt.date(2026, 1, 2)).startswith("20260102_")
    monkeypatch.setenv("DATASET_VERSION", "v9")
    assert sinks.version_tag() == "v9" and sinks.checkpoint_paths(None, "p") == ("p", "p")


def test_streams_resume_where_they_stopped(spark, tmp_path):
    kind = "source_id int, image_id string, status string, resize_timestamp timestamp_ntz"
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    for n, status in ((1, "failed"), (2, "completed")):
        spark.createDataFrame([(1, "a", status, dt.datetime(2026, 1, n))], kind).write.mode("append").parquet(src)
        jobs.append_results(spark, src, kind, out, ck)
    events = spark.read.parquet(out)
    assert events.count() == 2 and jobs.current_state(events).first().status == "completed"
    jobs.process_new_files(spark, src, kind, f"{tmp_path}/p", f"{tmp_path}/ck2", lambda df: df.where("status = 'failed'"))
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1
