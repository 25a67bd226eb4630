"""Documentation page extraction.

Pages arrive as a table ``(page_id, url, html)``; fetching is not part of the
library.  Every extractor is a regex / higher-order-function expression over
the whole page, so a page corpus is processed in one projection (H-2 and H-3
then explode to one row per table row or query block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions._col import col
from telemark.functions.text import strip_ws, unescape_entities

#: Fixed values (H-1..H-4): the patterns that define what is read from a page.
HEAD_PARAGRAPH = r"(?is)<h1[^>]*>.*?</h1>\s*<p>(.*?)</p>"
TABLE = r"(?is)<table.*?>.*?</table>"
NAME_HEADER = r"(?is)<th[^>]*>\s*Name\s*</th>"
TYPE_HEADER = r"(?is)<th[^>]*>\s*Type\s*</th>"
TABLE_ROW = r"(?is)<tr>(.*?)</tr>"
TABLE_CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
HEADING = r"(?i)<h[23][^>]*>"
CODE_BLOCK = r"(?i)<pre[^>]*>\s*<code[^>]*>([\s\S]*?)</code>\s*</pre>"
ANY_CODE = r"(?i)<code[^>]*>([\s\S]*?)</code>"
RESOURCE_BOLD = r"(?i)Resource\s*type:?\s*</?strong>[^A-Za-z0-9/]*([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
RESOURCE_NEAR = r"(?i)Resource\s*type:?[^\n]{0,120}?([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)"
_TAG = "<[^>]+>"


def _untag(c: Column) -> Column:
    return strip_ws(F.regexp_replace(c, _TAG, ""))


def page_description(html) -> Column:
    """H-1 the first paragraph right after the ``<h1>``, tags removed ('' if none)."""
    p = F.regexp_extract(col(html), HEAD_PARAGRAPH, 1)
    return _untag(p)


def column_table_rows(df: DataFrame, html: str = "html", keep=("page_id",)) -> DataFrame:
    """H-2 rows of the first ``<table>`` whose header has Name and Type cells:
    one output row per data row (name, type, description)."""
    tables = F.regexp_extract_all(col(html), F.lit(TABLE), 0)
    good = F.filter(tables, lambda t: t.rlike(NAME_HEADER) & t.rlike(TYPE_HEADER))

    def table_rows(t):
        rows = F.regexp_extract_all(t, F.lit(TABLE_ROW), 1)
        data = F.filter(rows, lambda r, i: i > 0)
        cells = F.transform(data, lambda r: F.regexp_extract_all(r, F.lit(TABLE_CELL), 1))
        parsed = F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: F.struct(
            _untag(c[0]).alias("name"), _untag(c[1]).alias("type"),
            F.when(F.size(c) >= 3, _untag(c[2])).otherwise(F.lit("")).alias("description")))
        return F.filter(parsed, lambda x: x["name"] != "")

    # The first qualifying table that yields at least one column wins.
    per_table = F.filter(F.transform(good, table_rows), lambda r: F.size(r) > 0)
    named = F.coalesce(F.try_element_at(per_table, F.lit(1)),
                       F.array().cast("array<struct<name:string,type:string,description:string>>"))
    z = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.greatest(F.size(named), F.lit(1))).alias("row_no"),
                               named.alias("c")))
    return (df.select(*keep, z.alias("z")).filter(F.col("z.c").isNotNull())
              .select(*keep, "z.row_no", "z.c.name", "z.c.type", "z.c.description"))


def query_blocks(df: DataFrame, html: str = "html", keep=("page_id",)) -> DataFrame:
    """H-3 query examples: each ``<h2>``/``<h3>`` heading opens a segment up
    to the next one; the segment's first paragraph is the description and its
    ``<pre><code>`` (else first ``<code>``) block is the code, tags removed and
    entities decoded.  Only segments with a title and code are kept."""
    segs = F.split(col(html), HEADING)
    segs = F.filter(segs, lambda s, i: (i > 0) & s.rlike(r"(?is)^.*?</h[23]>"))

    def block(s):
        title = _untag(F.regexp_extract(s, r"(?is)^(.*?)</h[23]>", 1))
        body = F.regexp_replace(s, r"(?is)^.*?</h[23]>", "")
        desc = _untag(F.regexp_extract(body, r"(?is)<p>(.*?)</p>", 1))
        pre = F.regexp_extract(body, CODE_BLOCK, 1)
        anyc = F.regexp_extract(body, ANY_CODE, 1)
        has_pre = body.rlike(CODE_BLOCK)
        code = F.when(has_pre, pre).otherwise(anyc)
        code = strip_ws(unescape_entities(F.regexp_replace(code, _TAG, "")))
        return F.struct(title.alias("name"), desc.alias("description"), code.alias("code"))

    blocks = F.filter(F.transform(segs, block), lambda b: (b["name"] != "") & (b["code"] != ""))
    z = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.greatest(F.size(blocks), F.lit(1))).alias("block_no"),
                               blocks.alias("b")))
    return (df.select(*keep, z.alias("z")).filter(F.col("z.b").isNotNull())
              .select(*keep, "z.block_no", "z.b.name", "z.b.description", "z.b.code",
                      F.lit("docs").alias("source")))


def resource_type_label(html) -> Column:
    """H-4 resource type named on the page, provider spelled ``Microsoft.``."""
    a = F.regexp_extract(col(html), RESOURCE_BOLD, 1)
    b = F.regexp_extract(col(html), RESOURCE_NEAR, 1)
    rt = F.when(a != "", a).when(b != "", b)
    fix = F.startswith(F.lower(rt), F.lit("microsoft.")) & ~F.startswith(rt, F.lit("Microsoft."))
    return F.when(fix, F.concat(F.lit("Microsoft."), F.regexp_replace(rt, r"^[^.]*\.", ""))).otherwise(rt)
