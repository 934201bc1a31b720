"""Image headers and coordinates; the header parser is the one Python function here."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.manifest import longest_edge, needs_resize

HEADER = T.StructType(
    [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("status", T.StringType())]
)
#: Start-of-frame markers: C0 to CF but for the table and arithmetic segments.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first start-of-frame segment; None if the bytes end before one."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no payload
            at += 2
            continue
        if marker in FRAMES:
            if at + 9 > len(data):
                return None
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        if marker in (0xD9, 0xDA):
            return None
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


#: Bytes of a file in which its header is looked for first, and at most.
FIRST, MOST = 1 << 16, 1 << 20


@F.pandas_udf(HEADER)
def jpeg_header(content: pd.Series) -> pd.DataFrame:
    """Dimensions and status of the first ``MOST`` bytes of a JPEG file.

    ok: the header lies in the first ``FIRST`` bytes; sof_not_found_extended: only
    further on; corrupt: nowhere in these bytes; not_found: null.
    """
    rows = []
    for data in content:
        data = None if data is None else bytes(data)
        size, status = None, "not_found"
        if data is not None:
            size, status = jpeg_size(data[:FIRST]), "ok"
            if size is None and len(data) > FIRST:
                size, status = jpeg_size(data), "sof_not_found_extended"
            status = status if size else "corrupt"
        rows.append((*(size or (None, None)), status))
    out = pd.DataFrame(rows, columns=["width", "height", "status"])
    return out.astype({"width": "Int32", "height": "Int32"})


def scan_images(files: DataFrame, most: int = 2048) -> DataFrame:
    """Image rows from (source_id, image_id, s3_key, content, length) and maybe error.

    Python gets the first ``MOST`` bytes of a file at most, and parses those after
    the first ``FIRST`` only where they are needed. A file with an error could
    not be read and has the status s3_error.
    """
    failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
    rows = files.withColumn("_h", jpeg_header(F.substring("content", 1, MOST)))
    status = F.when(failed, "s3_error").otherwise(F.col("_h.status"))
    why = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    found = status.isin("ok", "sof_not_found_extended")
    w, h = F.when(found, F.col("_h.width")), F.when(found, F.col("_h.height"))
    return rows.select(
        "source_id", "image_id", "s3_key", w.alias("width"), h.alias("height"), longest_edge(w, h).alias("longest_edge"),
        F.col("length").alias("file_size"), needs_resize(w, h, most).alias("needs_resize"), status.alias("header_status"),
        F.when(~found, F.coalesce(why, status)).alias("error_message"),
    )


def content_range_total(header: Column) -> Column:
    """The total size in a Content-Range header; null without one."""
    return F.regexp_extract(header, r"/(\d+)$", 1).try_cast("bigint")


def source_coordinate(at: Column, shown: Column, size: Column) -> Column:
    """A display coordinate on the source image, clamped to it."""
    return F.least(F.greatest(F.floor(at * size / shown), F.lit(0)), size - 1).cast("int")
