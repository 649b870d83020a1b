"""HTML pages to text: one substitution takes out comments, scripts, styles and tags, of which block tags end a line."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from lexmill.functions.ship import ship

#: The tags that end a line.
BLOCKS = frozenset(("address", "article", "br", "div", "li", "p", "section", "tr"))
_REST = r"""(?:"[^"]*"|'[^']*'|[^'">])*>"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b{_REST}.*?(?:</\1\s*>|\Z)|</?(?P<tag>[a-z][^\s/>]*){_REST}|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)


def text_of(html: str) -> str:
    """The text outside markup with its references resolved; lines are trimmed and blank ones dropped."""
    bare = _MARKUP.sub(lambda m: "\n" if (m["tag"] or "").lower() in BLOCKS else "", html)
    return "\n".join(line for line in map(str.strip, unescape(bare).splitlines()) if line)


def html_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text), by Arrow batches; a null page has an empty text."""
    ship(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(x or "") for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string")
