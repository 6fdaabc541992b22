"""Layout heuristics on rows of spans, blocks and paragraphs, as page and office formats give them.

Windows are per document and share its partitioning, so a chain of them costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size ratios to the body of headings of levels 1 to 3, and of a bold one of level 3.
RATIOS, BOLD_RATIO = (1.8, 1.5, 1.3), 1.15


def body_sizes(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, body): the upper-middle font size of each document, from counts by size."""
    counts = spans.groupBy(doc, "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy(doc)
    ranked = counts.select(doc, "size", F.sum("n").over(w.orderBy("size")).alias("upto"), F.sum("n").over(w).alias("of"))
    return ranked.where("upto > of div 2").groupBy(doc).agg(F.min("size").alias("body"))


def block_features(spans: DataFrame, doc: str = "doc", block: str = "block") -> DataFrame:
    """(doc, block, size, bold, mono): the size most characters have, to a tenth, of equals the first met, then the smaller; flags that half the characters have.

    spans: (doc, block, pos, size, bold, mono, text).
    """
    chars = F.length(F.coalesce("text", F.lit("")))
    some = lambda flag: F.sum(F.when(F.col(flag), F.col("_c")).otherwise(0))
    by_size = spans.withColumns({"_s": F.round("size", 1), "_c": chars}).groupBy(doc, block, "_s").agg(F.sum("_c").alias("c"), F.min("pos").alias("at"), some("bold").alias("b"), some("mono").alias("m"))
    total = F.greatest(F.sum("c"), F.lit(1))
    return by_size.groupBy(doc, block).agg(F.max_by("_s", F.struct("c", -F.col("at"), -F.col("_s"))).alias("size"), (F.sum("b") * 2 >= total).alias("bold"), (F.sum("m") * 2 >= total).alias("mono"))


def heading_level(size: Column, bold: Column, body: Column) -> Column:
    """Level 1 to 3 by the ratio to the body; null for what is no heading."""
    ratio = F.when(body > 0, size / body)
    levels = [F.when(ratio >= r, i) for i, r in enumerate(RATIOS, 1)]
    return F.coalesce(*levels, F.when(bold & (ratio >= BOLD_RATIO), 3))


def title_paths(nodes: DataFrame, doc: str = "doc", pos: str = "pos", depth: int = 3) -> DataFrame:
    """Adds title_path by a stack that a heading pops down to levels above its own; nodes: (doc, pos, level, text), level null for no heading."""
    order = Window.partitionBy(doc).orderBy(pos)
    out = nodes.withColumns({f"_c{k}": F.sum(F.when(F.col("level") < k, 1).otherwise(0)).over(order) for k in range(1, depth + 1)})
    slots = {f"_h{k}": F.last(F.when(F.col("level") == k, F.col("text")), True).over(Window.partitionBy(doc, f"_c{k}").orderBy(pos)) for k in range(1, depth + 1)}
    for name, slot in slots.items():
        out = out.withColumn(name, slot)
    return out.withColumn("title_path", F.concat_ws(" > ", *slots)).drop(*slots, *(f"_c{k}" for k in range(1, depth + 1)))


def stitched(nodes: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, page, pos, type, text): the first node of a page joined to the last text before it where both are texts of equal font.

    nodes: (doc, page, pos, type, text, size, bold); a null size, as parts of split texts have, never joins.
    """
    order = Window.partitionBy(doc).orderBy("page", F.asc_nulls_last("pos"))
    font = F.when((F.col("type") == "text"), F.struct("size", "bold"))
    marked = nodes.withColumns({"_font": font, "_first": ~F.coalesce(F.lag("page").over(order).eqNullSafe(F.col("page")), F.lit(False))})
    marked = marked.withColumn("_last", F.last("_font", True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    equal = (F.col("_font.size") == F.col("_last.size")) & F.col("_font.bold").eqNullSafe(F.col("_last.bold"))
    joins = F.coalesce(F.col("_first") & equal, F.lit(False))
    # A joined text belongs to the last text that stands for itself; all other nodes are their own.
    placed = marked.withColumns({"_joins": joins, "_i": F.row_number().over(order)})
    own = F.when((F.col("type") == "text") & ~F.col("_joins"), F.col("_i"))
    anchored = placed.withColumn("_anchor", F.when(F.col("_joins"), F.last(own, True).over(order)).otherwise(F.col("_i")))
    part = F.struct("_i", "page", "pos", "type", "text")
    grouped = anchored.groupBy(doc, "_anchor").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return grouped.select(doc, F.col("p")[0]["page"].alias("page"), F.col("p")[0]["pos"].alias("pos"), F.col("p")[0]["type"].alias("type"), F.array_join("p.text", "\n").alias("text"))


def clusters(paragraphs: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, pos, kind, text): body paragraphs run together; other kinds, two blank paragraphs and wide space after break a run, one blank leaves an empty line.

    paragraphs: (doc, pos, kind, text, wide), kind ``body`` for plain ones, pos without gaps.
    """
    order = Window.partitionBy(doc).orderBy("pos")
    numbered = paragraphs.withColumn("_i", F.row_number().over(order)).where(~((F.col("kind") == "body") & (F.trim(F.coalesce("text", F.lit(""))) == "")))
    gap = F.col("_i") - F.lag("_i").over(order) - 1
    after = (F.lag("kind").over(order) == "body") & ~F.coalesce(F.lag("wide").over(order), F.lit(False))
    together = F.coalesce((F.col("kind") == "body") & after & (gap < 2), F.lit(False))
    marked = numbered.select("*", together.alias("_with"), gap.alias("_gap")).withColumn("_run", F.sum(F.when(F.col("_with"), 0).otherwise(1)).over(order))
    text = F.concat(F.when(F.col("_with") & (F.col("_gap") == 1), "\n").otherwise(""), F.coalesce("text", F.lit("")))
    grouped = marked.groupBy(doc, "_run").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", text.alias("text")))).alias("p"))
    return grouped.select(doc, F.col("p")[0]["pos"].alias("pos"), F.col("p")[0]["kind"].alias("kind"), F.array_join("p.text", "\n").alias("text"))


def rendered(kind: Column, text: Column, level: Column, language: Column, limit: int = 200) -> Column:
    """A node as its neighbours are shown it, cut at the limit."""
    fence = F.concat(F.lit("[代码块"), F.coalesce(F.concat(F.lit("("), F.nullif(language, F.lit("")), F.lit(")")), F.lit("")), F.lit("]"))
    shown = (
        F.when(kind == "heading", F.coalesce(F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), text), F.lit("[空标题]")))
        .when(kind == "image", F.coalesce(F.concat(F.lit("[图片: "), text, F.lit("]")), F.lit("[图片]")))
        .when(kind == "code", F.when(F.trim(text) != "", F.concat(fence, F.lit("\n"), text)).otherwise(fence))
        .when(kind == "table", "[表格]")
        .when(kind == "formula", F.coalesce(F.concat(F.lit("[公式: "), F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text), F.lit("]")), F.lit("[公式]")))
        .otherwise(F.coalesce(text, F.lit("[空文本]")))
    )
    return F.when(F.length(shown) > limit, F.concat(F.substring(shown, 1, limit), F.lit("..."))).otherwise(shown)


def neighbours(nodes: DataFrame, doc: str = "doc", reach: int = 2) -> DataFrame:
    """(doc, pos, before, after): the rendered nodes within reach on each side, a line each; ``无`` for none."""
    base = nodes.select(doc, "pos", rendered(F.col("type"), F.col("text"), F.col("level"), F.col("language")).alias("_t"))
    order = Window.partitionBy(doc).orderBy("pos")
    near = lambda a, b: F.coalesce(F.nullif(F.array_join(F.collect_list("_t").over(order.rowsBetween(a, b)), "\n"), F.lit("")), F.lit("无"))
    return base.select(doc, "pos", near(-reach, -1).alias("before"), near(1, reach).alias("after"))
