"""Facts from provider pages by regular expressions; matching is case-sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null

STATUS_ROWS = {
    "unclassified": "Unclassified:", "unconfirmed": "Unconfirmed:", "confirmed": "Confirmed:", "total_images": "Total images:",
}


def access_error(page: Column) -> Column:
    """Why a source page is closed, or null if it is open."""
    return F.when(F.contains(page, F.lit("Page could not be found")), "Source does not exist").when(
        F.contains(page, F.lit("don't have permission")), "Permission denied"
    )


def title(page: Column) -> Column:
    return blank_to_null(F.regexp_extract(page, r"(?s)<title>(.*?)</title>", 1))


def status_table(page: Column) -> Column:
    """What the table under the Image Status heading holds; null without one."""
    after = page
    for mark in ("<h4>Image Status</h4>", '<table class="detail_box_table">'):
        at = F.instr(after, mark)
        after = F.when(at > 0, F.substr(after, at + len(mark)))
    return F.when(F.instr(after, "</table>") > 0, F.substring_index(after, "</table>", 1))


def status_count(page: Column, field: str) -> Column:
    """The number in a status row's link, thousands commas dropped; null if missing."""
    row = F.regexp_extract(status_table(page), rf"(?s)(?<![A-Za-z]){STATUS_ROWS[field]}(.*?)(?:</tr>|$)", 1)
    number = F.regexp_extract(row, r"<a[^>]*>\s*([\d,]+)\s*</a>", 1)
    return F.replace(number, F.lit(","), F.lit("")).try_cast("int")


def total_images(page: Column) -> Column:
    return F.coalesce(status_count(page, "total_images"), F.lit(0))


def hidden_token(page: Column) -> Column:
    return blank_to_null(F.regexp_extract(page, r'<input[^>]*name="csrfmiddlewaretoken"[^>]*value="([^"]*)"', 1))


def form_token(page: Column, form_id: str = "export-annotations-prep-form") -> Column:
    """The hidden token inside the form of that id."""
    form = F.regexp_extract(page, rf'(?s)(<form[^>]*id="{form_id}".*?</form>)', 1)
    return hidden_token(form)


def script_rows(page: Column, schema: str, marker: str = "let classifierPlotData = ") -> Column:
    """An array of objects assigned in a script, single quotes allowed."""
    blob = blank_to_null(F.regexp_extract(page, rf"(?s)Classifier overview.*?{marker}(\[.*?\]);", 1))
    return F.from_json(F.translate(blob, "'", '"'), f"array<struct<{schema}>>")


def anchor_ids(page: Column, pattern: str = r"/source/(\d+)/") -> Column:
    """Distinct ids in links of a listing page, ascending."""
    found = F.regexp_extract_all(page, F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def image_sources(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'<img[^>]*src="([^"]+)"'), F.lit(1))
