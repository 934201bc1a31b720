"""Reference behaviours on small tables made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import html, images, text
from weftline.operators import annotations, concepts, manifest, masks, metrics, registry, remediate, splits, stats, workqueue

TS = dt.datetime


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


RUN = "source_id int, image_id string, status string, resize_timestamp timestamp_ntz"


def test_later_run_wins_and_untimed_rows_lose(spark):
    first = spark.createDataFrame([(1, "a", "completed", TS(2026, 5, 29)), (1, "b", "skipped", None)], RUN)
    second = spark.createDataFrame([(1, "b", "completed", TS(2026, 6, 3))], RUN)
    assert rows(manifest.latest_rows([first, second]), "image_id", "status") == [("a", "completed"), ("b", "completed")]
    new = spark.createDataFrame([(1, "a", "completed", TS(2026, 6, 3))], RUN)
    old = spark.createDataFrame([(1, "a", "failed", None), (1, "b", "skipped", None)], RUN)
    assert rows(manifest.latest_rows([new, old]), "image_id", "status") == [("a", "completed"), ("b", "skipped")]
    with pytest.raises(ValueError):
        manifest.latest_rows([])


def test_training_manifest_scales_points_and_drops_unusable_images(spark):
    img = spark.createDataFrame(
        [(1, "sub", 1000, 800, False), (1, "big", 4000, 2000, True), (1, "fail", 5000, 3000, True), (1, "missing", 6000, 3000, True), (1, "nodims", None, None, False)],
        "source_id int, image_id string, width int, height int, needs_resize boolean",
    ).withColumn("s3_key", F.concat(F.lit("raw/"), "image_id"))
    ck = spark.createDataFrame([(1, "big", "completed"), (1, "fail", "failed")], "source_id int, image_id string, status string")
    ann = spark.createDataFrame(
        [(1, "sub", 400, 500, 82), (1, "big", 1000, 2000, 91), (1, "big", 1999, 3999, 91), (1, "fail", 10, 10, 7), (1, "missing", 10, 10, 7), (1, "nodims", 10, 10, 7)],
        "source_id int, image_id string, row int, col int, label_id int",
    )
    out = manifest.training_manifest(ann, img, ck)
    assert rows(out, "image_id", "row", "col", "load_width", "load_height", "source_label_name") == [
        ("big", 512, 1024, 2048, 1024, "91"), ("big", 1023, 2047, 2048, 1024, "91"), ("sub", 400, 500, 1000, 800, "82"),
    ]
    assert dict(out.dtypes)["row"] == "smallint"
    assert {r.image_s3_key for r in out.collect()} == {"raw/sub", "data/resized/s1/images/big.jpg"}
    done = manifest.resize_manifest(img, ck.withColumn("resize_timestamp", F.lit(None)).unionByName(spark.createDataFrame([(1, "sub", None, None)], "source_id int, image_id string, status string, resize_timestamp string")))
    assert rows(done, "image_id", "original_width", "resized_width", "resized_height") == [("big", 4000, 2048, 1024), ("fail", 5000, 2048, 1228)]


@pytest.mark.parametrize("w,h", [(4000, 2000), (2000, 4000), (3000, 3000), (2049, 2049), (800, 600), (2048, 1000)])
def test_corner_points_stay_inside(spark, w, h):
    img = spark.createDataFrame([(1, "i", w, h, "k")], "source_id int, image_id string, width int, height int, s3_key string")
    img = img.withColumn("needs_resize", manifest.needs_resize(F.col("width"), F.col("height")))
    ck = spark.createDataFrame([(1, "i", "completed")], "source_id int, image_id string, status string")
    ann = spark.createDataFrame([(1, "i", h - 1, w - 1, 1)], "source_id int, image_id string, row int, col int, label_id int")
    r = manifest.training_manifest(ann, img, ck).first()
    longest = max(w, h)
    want = (w, h) if longest <= 2048 else (int(w * (2048 / longest)), int(h * (2048 / longest)))
    assert (r.load_width, r.load_height) == want and 0 <= r.row < r.load_height and 0 <= r.col < r.load_width


POINTS = "source_id int, Name string, `Row` string, Column string, `Label ID` string"
PAGES = "source_id int, Name string, `Image Page` string"


def test_status_comes_from_the_image_list_or_the_points(spark):
    pages = spark.createDataFrame(
        [(1, "a.jpg - Confirmed", "/image/10/view/"), (1, "b.jpg", "https://x/image/11/"), (1, "c.jpg - Confirmed", None), (1, "d.jpg - Unconfirmed", "/image/12/")], PAGES
    )
    pts = spark.createDataFrame(
        [(1, "a.jpg", "1", "2.0", "5"), (1, "a.jpg", "nan", "2", "5"), (1, "b.jpg", "1", "2", "5"), (1, "c.jpg", "1", "2", "5"), (1, "d.jpg", "1", "2", "5"), (2, "a.jpg", "1", "2", "5")], POINTS
    )
    # points without a status of their own take that of their image; the name of points is left as it is
    assert rows(annotations.merge_annotations(pts, pages)) == [(1, "10", 1, 2, 5, "Confirmed")]
    assert annotations.merge_annotations(pts.withColumn("Name", F.concat("Name", F.lit(" - Confirmed"))), pages).count() == 0
    own = spark.createDataFrame([(1, "b.jpg", "3", "4", "6", "Confirmed"), (1, "a.jpg", "3", "4", "6", "Unconfirmed"), (1, "d.jpg", "7", "8", "6", "confirmed"), (1, "a.jpg", "9", "9", "6", None)], POINTS + ", Status string")
    assert rows(annotations.merge_annotations(own, pages)) == [(1, "10", 9, 9, 6, "Confirmed"), (1, "11", 3, 4, 6, "Confirmed")]
    audit = spark.createDataFrame([(1, False)], "source_id int, is_complete boolean")
    assert annotations.merge_annotations(own, pages, audit).count() == 0


def test_one_confirmed_image_of_an_old_export(spark):
    pages = spark.createDataFrame([(1, "img_1.jpg - Confirmed", "/image/1/view/")], PAGES)
    pts = spark.createDataFrame([(1, "img_1.jpg", "1", "2", "3")], POINTS)
    assert annotations.merge_annotations(pts, pages).count() == 1


def test_audit_counts_rows_and_feeds_the_probes(spark):
    sources = spark.createDataFrame([(1, ["annotations.csv", "image_list.csv"]), (2, ["annotations.csv", "image_list.csv", "labelset.csv"]), (3, [])], "source_id int, files array<string>")
    objects = spark.createDataFrame([(1,), (1,), (2,)], "source_id int")
    points = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "source_id int, Name string")
    listed = spark.createDataFrame([(1, "a"), (1, "a")], "source_id int, Name string")  # one name twice: two rows
    none = spark.createDataFrame([], "source_id int")
    bad = spark.createDataFrame([(2, "annotations.csv", "broken")], "source_id int, file string, error string")
    audit = annotations.source_audit(sources, objects, points, listed, none, none, bad)
    assert audit.columns == schemas.AUDIT.fieldNames()
    got = {r.source_id: r for r in audit.collect()}
    assert got[1].n_images_csv == 2 and got[1].image_count_match and got[1].is_complete and got[1].errors is None
    assert got[2].annotations_csv_read_failed and got[2].n_annotations == 0 and not got[2].annotations_empty and got[2].image_list_empty
    assert got[2].errors == ["annotations.csv read failed: broken"] and got[2].n_labels == 0 and got[2].labelset_empty
    assert not got[3].has_images_folder and got[3].n_labels is None
    probes = spark.createDataFrame([(1, True, 5, 3), (2, True, 5, 3), (9, True, 5, 3)], "source_id int, accessible boolean, n_confirmed_website int, total_images_website int")
    report = remediate.probe_report(probes, audit)
    assert rows(report, "source_id", "images_gap", "action") == [(1, 1, remediate.MANUAL), (2, 2, remediate.CSV), (9, 3, remediate.MANUAL)]


def test_a_label_has_one_target(spark):
    vocab = spark.createDataFrame([("s", "Coral", 1)], "source string, label string, local_id int")
    pairs = spark.createDataFrame([("CORAL", "soft", 1), ("coral", "Hard", 2), ("algae", None, 3)], "label string, target string, position int")
    targets = registry.target_ids(pairs, position="position")
    assert rows(targets) == [("hard", 1)]
    assert rows(registry.source_to_target(vocab, pairs, targets, position="position")) == [("s", "Coral", 1, 1)]
    assert registry.conflicting_targets(pairs).count() == 1


def test_wide_annotators_and_failures(spark):
    names = spark.createDataFrame([(1, "coral"), (2, "algae")], "id int, name string")
    wide = spark.createDataFrame([(1, "1", "2"), (2, "9", "1"), (3, "2", ""), (4, "1", "7")], "k int, archived string, host string")
    out = registry.wide_annotations(wide, names, "archived", ["host", "robot"])
    assert rows(out, "k", "archived") == [(1, "coral"), (3, "algae"), (4, "coral")]
    assert {r.k: (r.host, r.robot) for r in out.collect()} == {1: ("algae", None), 3: (None, None), 4: (None, None)}
    loads = spark.createDataFrame([(0, False), (0, False), (1, True), (1, False)], "epoch int, failed boolean")
    rates = metrics.failure_rates(loads, "epoch", "failed")
    assert rows(rates, "epoch", "too_many") == [(0, False), (1, True)]
    with pytest.raises(metrics.TooManyFailures):
        metrics.guard_failures(rates, "epoch")
    assert metrics.guard_failures(metrics.failure_rates(loads, "epoch", "failed", 0.5), "epoch").count() == 2


def test_training_stops_early(spark):
    values = [0.1, 0.5, 0.55, 0.52, 0.9]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 0.3)], "run string, epoch int, v double")
    stop = lambda patience, delta: rows(metrics.early_stopping(df, "run", "epoch", "v", "max", patience, delta))
    assert [tuple(r)[:2] + tuple(r)[3:] for r in stop(2, 0.1)] == [("a", 1, 3), ("b", 0, None)]
    assert [tuple(r)[:2] + tuple(r)[3:] for r in stop(3, 0.1)] == [("a", 4, None), ("b", 0, None)]
    assert rows(metrics.early_stopping(df, "run", "epoch", "v", "min", 1), "run", "stop_epoch") == [("a", 1), ("b", None)]


def test_queue_resumes_pending_and_notices_stale_checkpoints(spark):
    todo = spark.createDataFrame([(1, "a", 3000, 2000)], "source_id int, image_id string, width int, height int")
    ck = workqueue.new_checkpoint(todo)
    assert rows(workqueue.resume(ck, todo), "image_id") == [("a",)]
    stale = spark.createDataFrame([(1, "zzz", 1, 1)], todo.schema)
    with pytest.raises(workqueue.StaleCheckpoint):
        workqueue.resume(ck, stale)
    done = spark.createDataFrame([(1, "a", "failed", "boom")], "source_id int, image_id string, status string, error_message string")
    again = spark.createDataFrame([(1, "a", "skipped", "corrupted_x", None)], "source_id int, image_id string, status string, skip_reason string, error_message string")
    out = workqueue.apply_results(workqueue.apply_results(ck, done), again)
    assert rows(out, "status", "error_message", "skip_reason") == [("skipped", "boom", "corrupted_x")]
    assert tuple(workqueue.checkpoint_summary(out).first()) == (0, 0, 1, 0)
    assert tuple(workqueue.checkpoint_summary(out.drop("skip_reason")).first()) == (0, 0, 0, 1)


def test_text_functions(spark):
    df = spark.createDataFrame([("12.0", "nan", "x", None)], "a string, b string, c string, d string")
    assert tuple(df.select(*[text.coerced_int(F.col(c)) for c in "abcd"]).first()) == (12, None, None, None)
    one = spark.range(1)
    assert tuple(one.select(text.capitalized(F.lit("hARD Coral")), text.half_even_int(F.lit(2.5)), text.half_even_int(F.lit(3.5))).first()) == ("Hard coral", 2, 4)
    rank, value = text.rank_and_value(F.lit("genus__a__b"))
    assert tuple(one.select(rank, value).first()) == ("genus", "a__b")
    p = F.lit("x/y/.hidden")
    assert tuple(one.select(text.file_stem(p), text.file_suffix(p), text.parent_path(p)).first()) == (".hidden", "", "x/y")


PAGE = """<h4>Image Status</h4> <table class="detail_box_table"><tr><td>Unclassified:</td><td><a href="#">1,204</a></td></tr>
<tr><td>Unconfirmed:</td><td><a>7</a></td></tr><tr><td>Confirmed:</td><td><a>0</a></td></tr><tr><td>Total images:</td><td>none</td></tr></table>
<input type="hidden" name="csrfmiddlewaretoken" value="tok"><script>// Classifier overview
let classifierPlotData = [{'x': 1, 'y': 0.5}, {'x': 2, 'y': 0.75}];</script><a href="/source/7/">a</a><a href="/source/3/">b</a><a href="/source/7/">c</a>"""


def test_html_facts(spark):
    df = spark.createDataFrame([(PAGE,), ("Page could not be found",)], "p string")
    p = F.col("p")
    got = df.select(
        html.access_error(p), html.status_count(p, "unclassified"), html.status_count(p, "unconfirmed"), html.status_count(p, "confirmed"),
        html.total_images(p), html.hidden_token(p), html.script_rows(p, "x: int, y: double"), html.anchor_ids(p),
    ).collect()
    assert tuple(got[0])[:6] == (None, 1204, 7, 0, 0, "tok")
    assert [tuple(r) for r in got[0][6]] == [(1, 0.5), (2, 0.75)] and got[0][7] == [3, 7]
    assert got[1][0] == "Source does not exist" and got[1][1] is None and got[1][5] is None


def jpeg(w, h, padding=0, frame=0xC0):
    pad = b"".join(b"\xff\xe0" + (60002).to_bytes(2, "big") + b"\0" * 60000 for _ in range(padding))
    sof = bytes([0xFF, frame]) + (17).to_bytes(2, "big") + b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\0" * 10
    return b"\xff\xd8" + pad + sof + b"\xff\xd9"


@pytest.mark.parametrize("frame", [0xC0, 0xC1, 0xC2, 0xC9])
def test_jpeg_size(frame):
    assert images.jpeg_size(jpeg(1024, 768, 0, frame)) == (1024, 768)
    assert images.jpeg_size(jpeg(640, 480, 2, frame)) == (640, 480)
    assert images.jpeg_size(b"not a jpeg") is None and images.jpeg_size(jpeg(1, 1, 2)[:1000]) is None


def test_scan_images(spark):
    df = spark.createDataFrame(
        [(1, "a", "k", bytearray(jpeg(4096, 3000)), 9), (1, "b", "k", bytearray(b"xx"), 2)], "source_id int, image_id string, s3_key string, content binary, length long"
    )
    assert rows(images.scan_images(df), "image_id", "width", "needs_resize", "header_status") == [("a", 4096, True, "ok"), ("b", None, False, "corrupt")]
    far = [("near", jpeg(10, 20, 1)), ("far", jpeg(10, 20, 2)), ("beyond", jpeg(10, 20, 18)), ("gone", None)]
    df = spark.createDataFrame([(1, i, "k", c and bytearray(c), 9, None) for i, c in far] + [(1, "denied", "k", None, None, "403")], "source_id int, image_id string, s3_key string, content binary, length long, error string")
    got = {r.image_id: (r.width, r.header_status, r.error_message) for r in images.scan_images(df).collect()}
    assert got == {
        "near": (10, "ok", None), "far": (10, "sof_not_found_extended", None), "beyond": (None, "corrupt", "corrupt"),
        "gone": (None, "not_found", "not_found"), "denied": (None, "s3_error", "403"),
    }


def test_remediation_branches(spark):
    base = dict(
        accessible=True, n_confirmed_website=5, total_images_website=10, has_images_folder=True, has_annotations_csv=True, has_image_list_csv=True,
        n_images_s3=10, n_annotations=4, annotations_csv_read_failed=False, annotations_empty=False, image_count_match=True, image_list_covers_annotations=True,
    )
    cases = [
        ({"accessible": False}, remediate.SKIP_NOT_ACCESSIBLE), ({"n_confirmed_website": 0}, remediate.SKIP_NO_CONFIRMED), ({"total_images_website": 0}, remediate.SKIP_EMPTY),
        ({"n_images_s3": 11}, remediate.MANUAL), ({"has_image_list_csv": False}, remediate.FULL), ({"annotations_empty": True}, remediate.CSV), ({"n_annotations": 0}, remediate.CSV),
        ({"image_list_covers_annotations": None}, remediate.CSV), ({"image_count_match": False, "n_images_s3": 9}, remediate.IMAGES), ({}, remediate.MANUAL), ({"n_confirmed_website": None}, remediate.MANUAL),
    ]
    kinds = {k: "boolean" if isinstance(v, bool) else "int" for k, v in base.items()}
    df = spark.createDataFrame([tuple((base | c)[k] for k in base) for c, _ in cases], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    assert [r[0] for r in df.select(remediate.action()).collect()] == [a for _, a in cases]


def test_hierarchy_climbs_and_survives_cycles(spark):
    edges = spark.createDataFrame([("A", None), ("B", "A"), ("C", "B"), ("x", "y"), ("y", "x"), ("o", "gone")], "name string, parent string")
    up = registry.ancestors(edges)
    assert dict(rows(registry.levels(up))) == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "o": 1}
    targets = spark.createDataFrame([("a",), ("gone",)], "target string")
    assert dict(rows(registry.nearest(up, targets))) == {"a": "a", "b": "a", "c": "a", "x": None, "y": None, "o": "gone"}


def test_vocabulary_targets_and_offsets(spark):
    v = registry.vocabulary(spark.createDataFrame([("s", "Sand"), ("s", "background"), ("t", "Sand"), ("t", None)], "src string, label string"), "src", "label")
    assert rows(registry.global_ids(v)) == [("s", "Sand", 1, 1), ("s", "background", 2, 2), ("t", "Sand", 1, 3)]
    pairs = spark.createDataFrame([("SAND", "Sediment"), ("background", None)], "label string, target string")
    out = registry.source_to_target(v, pairs, registry.target_ids(pairs))
    assert rows(out, "source", "label", "target_id") == [("s", "Sand", 1), ("s", "background", 0), ("t", "Sand", 1)]
    clash = spark.createDataFrame([("A", "x"), ("a", "y")], "label string, target string")
    assert rows(registry.conflicting_targets(clash)) == [("a", 2)]


def test_concept_encoding(spark):
    df = spark.createDataFrame([("a", "g1", "TRUE", "TRUE", 0), ("b", "not_given", "FALSE", "not_given", 1), ("c", None, "not_given", "TRUE", 2)], "label string, genus string, hard string, soft string, position int")
    enc = concepts.encode_channels(df, ["genus"], ["hard", "soft"])
    assert rows(enc, "label", "channels") == [("a", [2, 2]), ("b", [0, 1]), ("c", [0, 0])]
    assert concepts.channel_names(df, ["genus"], ["hard", "soft"]) == ["genus__g1", "hard"]
    labels = spark.createDataFrame([(1, "a"), (2, "zz")], "global_id int, label string")
    assert rows(concepts.concept_matrix(labels, enc, 2)) == [(0, [0, 0]), (1, [2, 2]), (2, [0, 0])]


def test_hierarchical_argmax_prefers_deep_levels(spark):
    df = spark.createDataFrame([([0.9, 0.6, 0.7],), ([0.9, 0.4, 0.5],), ([0.1, 0.2, 0.3],)], "p array<double>")
    assert [r[0] for r in df.select(concepts.hierarchical_argmax(F.col("p"), [0, 1, 1])).collect()] == [2, 0, -1]


def test_masks_pad_clip_and_overwrite(spark):
    pts = spark.createDataFrame([("i", 0, 0, "a", 0), ("i", 1, 1, "b", 1), ("i", 3, 3, "nope", 2), ("i", 3, 3, None, 3)], "image_id string, row int, col int, source_label_name string, position int")
    img = spark.createDataFrame([("i", 4, 4)], "image_id string, height int, width int")
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "source_label_name string, value int")
    assert rows(masks.rasterise(pts, img, ids)) == [("i", 0, 0, 1), ("i", 1, 1, 2)]
    padded = {(r, c): v for _, r, c, v in rows(masks.rasterise(pts, img, ids, padding=1))}
    assert padded == {(0, 0): 2, (0, 1): 2, (1, 0): 2, (1, 1): 2}
    assert masks.rasterise(pts.limit(0), img, ids, 2).count() == 0


def test_statistics_keep_empty_classes_and_images(spark):
    pts = spark.createDataFrame([("train", 1, "i1"), ("train", 2, "i1"), ("train", 1, "i2")], "split string, target_id int, image_id string")
    classes = spark.createDataFrame([(0, "ignore"), (1, "a"), (2, "b")], "target_id int, target_name string")
    out = {r.target_id: r for r in stats.class_counts(pts, classes, ["train", "val"]).collect()}
    assert out[1].train_annotations == 2 and out[1].train_images == 2 and out[0].train_annotations == 0 and out[2].val_fraction == 0.0
    imgs = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "image_id string")
    s = stats.per_image_summary(imgs, pts).first()
    assert (s.n_images, s.n_annotations, s["min"], s["max"], s["median"]) == (3, 3, 0, 2, 1.0)


def test_metrics(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (0, 2)], "t int, p int")
    m = metrics.confusion(pairs, "t", "p")
    assert abs(metrics.accuracy(m).first().accuracy - 2 / 3) < 1e-12
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.per_class(m).collect()}
    assert got == {1: (1, 0, 1), 2: (1, 1, 0)}
    with pytest.raises(ValueError):
        metrics.canonical_metric("bleu")
    assert metrics.canonical_metric(" Loss ") == "loss"


def test_balanced_split_is_disjoint_and_covers(spark):
    cells = [(s, x, 10 + (s * 7 + x) % 5) for s in range(12) for x in range(3)]
    counts = spark.createDataFrame(cells, "s int, l int, n int")
    out = splits.balanced_split(counts, "s", "l", "n", {"train": 0.6, "val": 0.2, "test": 0.2}, trials=40)
    got = dict(rows(out))
    assert set(got) == set(range(12)) and set(got.values()) == {"train", "val", "test"}
    assert dict(rows(splits.balanced_split(counts, "s", "l", "n", {"train": 0.6, "val": 0.2, "test": 0.2}, trials=40))) == got
    with pytest.raises(ValueError):
        splits.balanced_split(spark.createDataFrame([(1, 1, 5), (2, 1, 5)], "s int, l int, n int"), "s", "l", "n", {"a": 1.0})


def test_schemas(spark):
    df = spark.createDataFrame([("1", "i", "2", "3", "4", "Confirmed", "extra")], "source_id string, image_id string, row string, col string, label_id string, status string, more string")
    out = schemas.conform(df, schemas.ANNOTATIONS)
    assert out.columns == schemas.ANNOTATIONS.fieldNames() and tuple(out.first()) == (1, "i", 2, 3, 4, "Confirmed")
    with pytest.raises(schemas.SchemaError):
        schemas.validate(df.drop("row"), schemas.ANNOTATIONS)
    assert len(schemas.AUDIT) == 25
    assert schemas.duplicate_keys(out.union(out), schemas.KEYS["annotations"]).count() == 1
