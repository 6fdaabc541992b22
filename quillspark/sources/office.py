"""Word documents as rows of paragraphs, read with the standard library: a docx file is a zip archive of XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import layout
from quillspark.sources.nodes import table_html

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
#: Space after a paragraph, in twentieths of a point, that parts it from the next.
WIDE_SPACE = 240
#: Bytes that a document's XML may unpack to.
LARGEST = 256 << 20


def _text(paragraph: ElementTree.Element) -> str:
    """A paragraph's text; breaks inside it are line ends."""
    parts = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda _: "\t", f"{_W}br": lambda _: "\n", f"{_W}cr": lambda _: "\n"}
    return "".join(parts[x.tag](x) for x in paragraph.iter() if x.tag in parts).strip()


def paragraphs_of(raw: bytes) -> list[tuple[str, str, int | None, bool]]:
    """(kind, text, level, wide) of a document's paragraphs, tables and images in order; none for bytes that are no document."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            if archive.getinfo("word/document.xml").file_size > LARGEST:
                raise ValueError("a document's XML is too large")
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out: list[tuple[str, str, int | None, bool]] = []
    for element in body if body is not None else ():
        if element.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(_text, cell.iter(f"{_W}p")))) for cell in row.iter(f"{_W}tc")] for row in element.iter(f"{_W}tr")]
            out.append(("table", table_html(["|" + "|".join(cells) + "|" for cells in rows]), None, False))
        elif element.tag == f"{_W}p":
            out += [("image", "", None, False) for _ in element.iter(_BLIP)]
            style = next((x.get(f"{_W}val") or "" for x in element.iter(f"{_W}pStyle")), "")
            heading = re.fullmatch(r"(?:heading|标题)\s*([1-9])", style.strip(), re.I)
            spacing = next((x.get(f"{_W}after") or "" for x in element.iter(f"{_W}spacing")), "")
            listed = next(element.iter(f"{_W}numPr"), None) is not None or style.lower().startswith("list")
            kind = "heading" if heading else "list" if listed else "code" if "code" in style.lower() else "body"
            out.append((kind, _text(element), int(heading[1]) if heading else None, spacing.isdigit() and int(spacing) >= WIDE_SPACE))
    return out


def docx_nodes(files: DataFrame, key: str = "doc", content: str = "content") -> DataFrame:
    """(doc, pos, kind, text, level, title_path) of docx files (key, binary content): body paragraphs run together, the others stand alone, under the headings above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *p) for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if raw for i, p in enumerate(paragraphs_of(raw))]
            cols = zip(*rows, strict=True) if rows else [()] * 6
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc", "pos", "kind", "text", "level", "wide"])

    rows = files.select(F.col(key).cast("long").alias("doc"), F.col(content)).mapInArrow(run, "doc long, pos int, kind string, text string, level int, wide boolean")
    # An empty paragraph of any style is a blank one.
    bare = F.when((F.col("text") == "") & ~F.col("kind").isin("image", "table"), "body").otherwise(F.col("kind"))
    blocks = layout.clusters(rows.withColumn("kind", bare))
    levels = rows.select("doc", "pos", "level")
    return layout.title_paths(blocks.join(levels, ["doc", "pos"], "left"), depth=9).select("doc", "pos", "kind", "text", "level", "title_path")
