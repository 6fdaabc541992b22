"""Files as documents: binary reading with fallback encodings, dispatch to a parser by detected type, and BPE token counts."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspark.functions import text as T
from quillspark.sources import html, nodes, office

#: Encodings tried in turn; the last one reads any bytes.
ENCODINGS = ("utf-8", "gbk", "latin-1")


def decoded(raw: bytes | None) -> str | None:
    """The text of some bytes in the first encoding that reads them all; null for null."""
    for encoding in ENCODINGS if raw is not None else ():
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return None


@F.pandas_udf(StringType())
def _fallback(raw: pd.Series) -> pd.Series:
    return raw.map(decoded)


def text_of(content: Column) -> Column:
    """Binary content as text. UTF-8 is read by the JVM; only other bytes go to Python."""
    plain = content.cast("string")
    fine = F.is_valid_utf8(plain)
    return F.when(fine, plain).otherwise(_fallback(F.when(~fine, content)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file below a folder, but for empty ones, which the reader skips."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", text_of(F.col("content")).alias("text"))


def _parsed(kind: str, text: str, language: str | None) -> list[nodes.Node]:
    if kind == "markdown":
        return nodes.markdown_nodes(text)
    if kind == "html":
        return html.page_nodes(text)
    if kind == "code":
        return nodes.code_nodes(text, language)
    return nodes.line_nodes(text) if kind == "linebased" else []


def parsed(docs: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", content: str | None = None) -> DataFrame:
    """(key, document_type, pos, type, text, level, title_path, language, group_id): each document by the parser of its type.

    The type is told by extension, else by content. Word documents are read from their bytes, in the column ``content`` if it is named.
    Spreadsheets and pdf have no parser here and give no nodes, nor do null and blank texts.
    """
    shown = _parsed_texts(docs, key, path, text)
    if content is None:
        return shown
    word = docs.where((T.document_type(F.col(path), F.col(text)) == "docx") & F.col(content).isNotNull())
    return shown.unionByName(_word_nodes(word, key, content))


def _word_nodes(docs: DataFrame, key: str, content: str) -> DataFrame:
    """Paragraphs of Word documents as nodes: runs of body text over the target in pieces of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, pos, kind, text, level, title in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                pieces = nodes.cluster_pieces(text) if kind == "body" else [text]
                rows += [(doc, pos, i, "text" if kind == "body" else kind, p, level, title, f"c-{pos}" if len(pieces) > 1 else None) for i, p in enumerate(pieces)]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, types, strict=True)], names=["doc", "at", "piece", "type", "text", "level", "title_path", "group_id"])

    split = office.docx_nodes(docs, key, content).mapInArrow(run, "doc long, at int, piece int, type string, text string, level int, title_path string, group_id string")
    pos = (F.row_number().over(Window.partitionBy("doc").orderBy("at", "piece")) - 1).cast("int")
    return split.select(F.col("doc").alias(key), F.lit("docx").alias("document_type"), pos.alias("pos"), "type", "text", "level", "title_path", F.lit(None).cast("string").alias("language"), "group_id")


def _parsed_texts(docs: DataFrame, key: str, path: str, text: str) -> DataFrame:
    typed = docs.select(F.col(key).cast("long").alias(key), T.document_type(F.col(path), F.col(text)).alias("document_type"), T.file_language(F.col(path), F.col(text)).alias("_l"), F.col(text).alias("_t"))
    names = [key, "document_type", *nodes.Node._fields]
    names.insert(2, "pos")
    types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, kind, i, *n) for k, kind, lang, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) if t and t.strip() for i, n in enumerate(_parsed(kind, t, lang))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 9, types, strict=True)], names=names)

    return typed.mapInArrow(run, f"{key} long, document_type string, pos int, type string, text string, level int, title_path string, language string, group_id string")


def bpe_tokens(text: Column, ranks: str, pattern: str) -> Column:
    """Number of tokens of a text by a byte-level BPE: ranks is the path of its rank file on every worker, pattern splits words. Null counts as none."""
    held: dict = {}

    def encoding():
        if not held:
            import tiktoken

            with open(ranks, "rb") as lines:
                held["e"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
        return held["e"]

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encoding().encode_ordinary(t)) if t else 0)

    return count(text)
