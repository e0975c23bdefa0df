"""Where elements stand in the source of a page: many locators share one index of its line starts."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements that evidence points at.
LOCATORS = {
    "title": r"<title[^>]*>[\s\S]*?</title>", "h1": r"<h1[^>]*>[\s\S]*?</h1>", "desc": r"""<meta[^>]*name=["']description["'][^>]*>""", "canonical": r"""<link[^>]*rel=["']canonical["'][^>]*>""",
    "robots": r"""<meta[^>]*name=["']robots["'][^>]*>""", "schema": r"<script[^>]*application/ld\+json[^>]*>[\s\S]*?</script>", "lang": r"<html[^>]*>",
}
SNIPPET = 400
_PLACES = "array<struct<focus:string,count:bigint,line:int,column:int,end_line:int,snippet:string>>"


def element_places(pages: DataFrame, locators: dict[str, str] | None = None, html: str = "html") -> DataFrame:
    """pages without html, a row for each locator: how many elements match it, where the first begins and ends, and its text.

    Lines and columns count from 1; they and the snippet (spaces squeezed, SNIPPET characters) are null where
    nothing matches.  Patterns do not mind case.
    """
    found = {k: re.compile(p, re.I) for k, p in (locators or LOCATORS).items()}

    @F.arrow_udf(_PLACES)
    def places(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            text = t.as_py() or ""
            starts = [0, *(m.end() for m in re.finditer("\n", text))]
            row = []
            for focus, pattern in found.items():
                hits = pattern.finditer(text)
                first = next(hits, None)
                if first is None:
                    row.append({"focus": focus, "count": 0})
                    continue
                line, last = (bisect.bisect_right(starts, at) for at in (first.start(), max(first.start(), first.end() - 1)))
                row.append({"focus": focus, "count": 1 + sum(1 for _ in hits), "line": line, "column": first.start() - starts[line - 1] + 1, "end_line": last, "snippet": re.sub(r"\s+", " ", first[0]).strip()[:SNIPPET]})
            rows.append(row)
        kind = pa.struct([("focus", pa.string()), ("count", pa.int64()), ("line", pa.int32()), ("column", pa.int32()), ("end_line", pa.int32()), ("snippet", pa.string())])
        return pa.array(rows, pa.list_(kind))

    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(places(html)).alias("_p")).select(*rest, "_p.*")
