"""Nodes of a parsed document: their kinds, the texts they show, index and give as background, and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Kinds of nodes, those whose content is kept beside the text, and what stands in for missing content.
KINDS = ("TEXT", "HEADING", "IMAGE", "CODE", "TABLE", "FORMULA")
RICH = ("IMAGE", "CODE", "TABLE", "FORMULA")
LABELS = {"IMAGE": "图片", "CODE": "代码块", "TABLE": "表格", "FORMULA": "公式"}
NO_LANGUAGE, NO_CODE, NO_TABLE, NO_FORMULA, ANY_IMAGE = "未知语言", "无代码内容", "无表格内容", "无公式内容", "[图片]"
#: Node kinds of a layout service's blocks.
BLOCK_KINDS = {"title": "heading", "text": "text", "list": "text", "image": "image", "table": "table", "code": "code", "equation": "formula"}

_text = lambda c: F.nullif(T.trimmed(c), F.lit(""))


def kind_of(c: Column) -> Column:
    """The kind in upper case; blank, null and unknown ones are TEXT."""
    return F.when(F.upper(c).isin(*KINDS), F.upper(c)).otherwise("TEXT")


def shown(kind: Column, node: Column, content: Column, mark: str = "NODE") -> Column:
    """What a chunk shows: a place mark for kinds that are kept beside the text, else the text."""
    return F.when(kind.isin(*RICH), F.concat(F.lit(f"[[{mark}:"), kind, F.lit(":"), node, F.lit("]]"))).otherwise(F.coalesce(content, F.lit("")))


def indexed(kind: Column, node: Column, content: Column, language: Column, caption: Column, semantic: Column) -> Column:
    """What is indexed: the description if there is one, else a stand-in by kind, else the text."""
    label = F.coalesce(*(F.when(kind == k, v) for k, v in LABELS.items()))
    body = F.when(kind == "IMAGE", F.coalesce(_text(caption), node)).when(kind == "FORMULA", F.coalesce(_text(content), node)).otherwise(node)
    name = F.when(kind == "CODE", F.concat(label, F.lit("("), F.coalesce(language, F.lit(NO_LANGUAGE)), F.lit(")"))).otherwise(label)
    return F.when(kind.isin(*RICH), F.coalesce(_text(semantic), F.concat(F.lit("["), name, F.lit(": "), body, F.lit("]")))).otherwise(F.coalesce(content, F.lit("")))


def background(kind: Column, content: Column, language: Column, caption: Column) -> Column:
    """What a node gives as background of others: its content, with the language before code and the caption for an image."""
    code = F.concat(F.lit("[代码语言: "), F.coalesce(language, F.lit(NO_LANGUAGE)), F.lit("]\n"), F.coalesce(content, F.lit(NO_CODE)))
    return (
        F.when(kind == "CODE", code).when(kind == "TABLE", F.coalesce(content, F.lit(NO_TABLE))).when(kind == "FORMULA", F.coalesce(content, F.lit(NO_FORMULA)))
        .when(kind == "IMAGE", F.coalesce(_text(caption), F.lit(ANY_IMAGE))).otherwise(F.coalesce(content, F.lit("")))
    )


def full_background(nodes: DataFrame, doc: str = "doc", pos: str = "pos") -> DataFrame:
    """(doc, background): all nodes' backgrounds in order; a document's text once more, never more."""
    part = F.struct(pos, background(F.col("kind"), F.col("content"), F.col("language"), F.col("caption")).alias("b"))
    return nodes.groupBy(doc).agg(F.array_join(F.array_sort(F.collect_list(part))["b"], "\n\n").alias("background"))


def metadata_of(nodes: Column) -> Column:
    """The kept fields of an array of nodes (id, kind, content, language, caption, image): one map for each rich node, null fields left out."""

    def entry(n: Column) -> Column:
        fields = {"id": n["id"], "type": F.lower(n["kind"]), "language": F.when(n["kind"] == "CODE", n["language"]), "code": F.when(n["kind"] == "CODE", n["content"])}
        fields |= {"html": F.when(n["kind"] == "TABLE", n["content"]), "formula": F.when(n["kind"] == "FORMULA", n["content"])}
        fields |= {"imagePath": F.when(n["kind"] == "IMAGE", n["image"]), "caption": F.when(n["kind"] == "IMAGE", n["caption"])}
        return F.map_filter(F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())

    return F.transform(F.filter(nodes, lambda n: n["kind"].isin(*RICH)), entry)


def context_of(file_type: Column, whole: Column, near: Column) -> Column:
    """The background a node gets: the whole text for file types that want it, else its neighbours."""
    return F.when(T.wants_whole_context(file_type), whole).otherwise(near)


def from_blocks(blocks: DataFrame) -> DataFrame:
    """(doc, pos, type, text, level, language) of a layout service's blocks (doc, pos, type, text, level, code, items array<string>).

    Lists are joined by lines, blank items left out. Blocks of unknown type or, but for images and tables, without text have no node.
    """
    kind = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in BLOCK_KINDS.items()))
    items = F.array_join(F.filter(F.transform("items", T.trimmed), lambda x: x != ""), "\n")
    text = F.when(F.col("type") == "list", items).when(F.col("type") == "code", F.coalesce(_text(F.col("code")), T.trimmed(F.col("text")))).otherwise(T.trimmed(F.col("text")))
    made = blocks.select("doc", "pos", kind.alias("type"), text.alias("text"), F.when(F.col("type") == "title", F.greatest(F.least(F.coalesce("level", F.lit(1)), F.lit(6)), F.lit(1))).alias("level"))
    kept = made.where("type is not null").where(F.col("type").isin("image", "table") | (F.coalesce("text", F.lit("")) != ""))
    return kept.withColumn("language", F.when(F.col("type") == "code", T.language_of(F.col("text"))))


def page_order(elements: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``rank``: elements of a document by page, then by the top of their box, those without a box last, then as they came."""
    from pyspark.sql import Window

    return elements.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("page", F.asc_nulls_last("top"), "pos")))
