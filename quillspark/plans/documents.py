"""Queries over documents: text functions, parsers, chunks and what surrounds a chunk."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunks
from quillspark.plans import parser_twins
from quillspark.plans.registry import query
from quillspark.sources import files
from quillspark.sources import nodes as N
from quillspark.sources.tables import table

# The texts hold no line ends, so these queries put them behind sentences: two behind a full stop, one behind a comma.
_LINED = r"""lined AS (SELECT doc_id, lang, source, replace(replace(text, '. ', '.' || chr(10) || chr(10)), ', ', ',' || chr(10)) AS text FROM documents)"""
_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n")), F.lit(", "), F.lit(",\n"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.alias("text"))


@query(rf"WITH {_LINED} SELECT doc_id, len(p) AS paragraphs, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, list_filter([{_TRIM.format('x')} FOR x IN regexp_split_to_array(text, '\n\s*\n')], lambda x: x <> '') AS p FROM lined WHERE text IS NOT NULL)")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _lined(spark, sf_dir).where("text is not null").select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    return split.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(rf"""WITH {_LINED}, l AS (SELECT doc_id, string_split(text, chr(10)) AS lines, list_filter([length({_TRIM.format('x')})::DOUBLE FOR x IN string_split(text, chr(10))], lambda n: n > 0) AS n FROM lined)
SELECT doc_id, coalesce(len(lines) >= 5 AND len(n) >= 3 AND list_sum([x * x FOR x IN n]) / len(n) - list_avg(n) ** 2 < list_avg(n) ** 2 * 0.5, false) AS line_based FROM l""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lined(spark, sf_dir).select("doc_id", T.uniform_lines(F.col("text")).alias("line_based"))


@query(parser_twins.line_sql(_LINED))
def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.nodes(_lined(spark, sf_dir), N.line_nodes)


# Marks that could begin other blocks are blanked, and a table, an image and code are put behind the text.
_MARKED = _LINED.replace(" AS text FROM", ", '|!`#', '    ') AS text FROM").replace("source, replace(", "source, translate(replace(") + ", none_ AS (SELECT 1)"


@query(parser_twins.markdown_sql(_MARKED))
def markdown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = "\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n![x](p.png)\n![far](http://h/i.png)\n\n```py\nx = 1\n```\n"
    docs = _lined(spark, sf_dir).select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n"), F.translate("text", "|!`#", "    "), F.lit(tail)).alias("text"))
    return N.nodes(docs, N.markdown_nodes)


@query(r"""WITH s AS (SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), chr(10)) AS t FROM pages WHERE html IS NOT NULL), n AS (SELECT page_id, 0 AS k, t AS text, NULL AS title FROM s WHERE trim(t) <> ''
  UNION ALL SELECT page_id, 1, '# head' || chr(10) || 'class A' || page_id || ':', 'A' || page_id FROM s UNION ALL SELECT page_id, 2, '    def f(self):' || chr(10) || '        pass', 'A' || page_id || ' > f' FROM s UNION ALL SELECT page_id, 3, 'def g' || page_id || '(x):' || chr(10) || '    return x', 'A' || page_id || ' > g' || page_id FROM s)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY k) - 1)::INT AS pos, 'code' AS type, text, NULL::INT AS level, title AS title_path, NULL::VARCHAR AS language, NULL::VARCHAR AS group_id FROM n""")
def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of a page are its code, followed by a class with a method and a function."""
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1), "\n")
    more = F.expr(r"concat('\n\n# head\nclass A', page_id, ':\n    def f(self):\n        pass\n\ndef g', page_id, '(x):\n    return x\n')")
    return N.nodes(table(spark, sf_dir, "pages").select("page_id", F.concat(scripts, more).alias("text")), N.code_nodes, key="page_id")


@query(f"""SELECT page_id AS doc_id, 'html' AS document_type, * EXCLUDE (page_id) FROM ({parser_twins.HTML_SQL}) UNION ALL SELECT -doc_id - 1, 'linebased', * EXCLUDE (doc_id) FROM ({parser_twins.line_sql(_LINED)})""")
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents, known by their extensions, each by its parser."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("a/b.HTML").alias("path"), F.col("html").alias("text"))
    docs = _lined(spark, sf_dir).select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("a.TXT").alias("path"), "text")
    return files.parsed(pages.unionByName(docs))


def _word_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in Word's format: a heading, a paragraph, one of a list, two blank ones and a paragraph."""
    style = lambda name: f'<w:pPr><w:pStyle w:val="{name}"/></w:pPr>' if name else ""
    for batch in batches:
        made = []
        for doc, text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            parts = [("Heading1", f"T{doc}"), ("", (text or "")[:200]), ("ListParagraph", lang or ""), ("", ""), ("", ""), ("", source or "")]
            body = "".join(f"<w:p>{style(name)}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for name, t in parts)
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as archive:
                archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            made.append(raw.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])


@query(r"""WITH d AS (SELECT doc_id, trim(left(coalesce(text, ''), 200), chr(9) || chr(10) || chr(13) || ' ') AS t, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM documents),
n AS (SELECT doc_id, 0 AS k, 'heading' AS type, 'T' || doc_id AS text, 1 AS level FROM d UNION ALL SELECT doc_id, 1, 'text', t, NULL FROM d WHERE t <> '' UNION ALL SELECT doc_id, 2, 'list', l, NULL FROM d WHERE l <> '' UNION ALL SELECT doc_id, 5, 'text', s, NULL FROM d WHERE s <> '')
SELECT doc_id, 'docx' AS document_type, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, type, text, level::INT AS level, 'T' || doc_id AS title_path, NULL::VARCHAR AS language, NULL::VARCHAR AS group_id FROM n""")
def word_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as bytes of Word files, dispatched by their extension."""
    made = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").mapInArrow(_word_files, "doc_id long, content binary")
    return files.parsed(made.select("doc_id", F.lit("a/b.docx").alias("path"), F.lit(None).cast("string").alias("text"), "content"), content="content")


_OF_LINES = parser_twins.chunked(f"r AS ({parser_twins.line_sql(_LINED)})")


@query(f"WITH RECURSIVE {_OF_LINES} SELECT doc_id, sort_order, chunk_level, parent_order, chunk_level = 2 AS searchable, title_path, nodes, text FROM made")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunks(line_nodes(spark, sf_dir))


@query(f"WITH RECURSIVE {_OF_LINES}, {parser_twins.CONTEXT} SELECT doc_id, sort_order, chunk_level, parent_order, chunk_level = 2 AS searchable, title_path, nodes, text, context FROM made JOIN context USING (doc_id, sort_order)")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.with_context(document_chunks(spark, sf_dir))


@query(r"""SELECT page_id, CASE WHEN contains(h, '# ') OR contains(h, '```') OR regexp_matches(h, '^\s*#') THEN 'markdown' WHEN regexp_matches(lower(h), '<html|<body|<div|<head|<!doctype html') THEN 'html'
  WHEN regexp_matches(h, '\b(package|import|class|def|function|fn|func)\b') THEN 'code' ELSE 'linebased' END AS sniffed, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'code' ELSE 'linebased' END AS named FROM (SELECT page_id, coalesce(html[:500], '') AS h FROM pages)""")
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("dir.x/f."), F.element_at(F.array(*map(F.lit, ("PDF", "rs", "log"))), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", T.document_type(F.lit("f"), F.col("html")).alias("sniffed"), T.document_type(path, F.col("html")).alias("named"))


@query(r"""WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[<>:"|?*]', '_', 'g'), '[\x00-\x1f\x7f]', '', 'g'), '^ +|[ .]+$', '', 'g') AS c FROM pages)
SELECT page_id, CASE WHEN trim(s) <> '' THEN s[:100] || e END AS file_name, coalesce(nullif(regexp_replace(regexp_replace(url, '[^\p{L}\p{Nd}]+', '_', 'g'), '^_|_$', '', 'g'), ''), 'unnamed') AS archive_name
FROM (SELECT page_id, url, regexp_extract(c, '^(.+?)(\.[^.]*)?$', 1) AS s, regexp_extract(c, '^.+?(\.[^.]*)?$', 1) AS e FROM b)""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("file_name"), T.archive_name(F.col("url")).alias("archive_name"))


@query(r"""SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]+>', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '') AS title FROM pages""")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.title_of(F.col("html")).alias("title"))


@query(rf"""SELECT doc_id, md5({_TRIM.format("coalesce(nullif(source, '') || ' ', '') || coalesce(nullif(lang, '') || ' ', '') || coalesce(text, '')")}) AS digest,
  '{{"user_id":"' || source || '","document_id":"' || doc_id || '","chunk_id":"' || doc_id || '","chunk_type":"general","title_path":"' || lang || '","chunk_level":2}}' AS metadata FROM documents""")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    meta = F.struct(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("general").alias("chunk_type"), F.lit(None).cast("string").alias("parent_chunk_id"), F.col("lang").alias("title_path"), F.lit(2).alias("chunk_level"))
    return docs.select("doc_id", F.md5(T.embedding_text(F.col("source"), F.col("lang"), F.lit(" "), F.col("text"))).alias("digest"), F.to_json(meta).alias("metadata"))


@query(r"""WITH h AS (SELECT doc_id, text, instr(lower(text), 'the') - 1 AS hit FROM documents), w AS (SELECT doc_id, text, greatest(0, hit - 248) AS s, least(length(text), hit + 3 + 248) AS e FROM h WHERE hit >= 0)
SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || regexp_replace(replace(substr(text, s + 1, e - s), chr(10), ' '), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet FROM w""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), "the").alias("snippet")).where("snippet is not null")


@query(r"SELECT page_id, '/api' || p || '&sig=' || sha256(o || unhex(sha256(i || encode(p)))) AS signed FROM (SELECT page_id, '/assets/images/' || page_id || '.png?expires=' || page_id * 1000 AS p, unhex(repeat('5d', 3) || repeat('36', 61)) AS i, unhex(repeat('37', 3) || repeat('5c', 61)) AS o FROM pages)")
def image_signing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.signed_image(F.concat(F.col("page_id").cast("string"), F.lit(".png")), "kkk", F.col("page_id") * 1000).alias("signed"))


@query("SELECT DISTINCT array_to_string(s[:d], '/') AS path, d AS depth, d < len(s) AS folder FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS d)")
def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").select(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/").alias("s"))
    steps = parts.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("d"))
    return steps.select(F.array_join(F.slice("s", F.lit(1), F.col("d")), "/").alias("path"), F.col("d").cast("long").alias("depth"), (F.col("d") < F.size("s")).alias("folder")).distinct()
