"""Chunks of nodes: greedy packing on the token estimate, kept apart by group, a parent chunk for each group.

Nodes of a document are one task's array: they hold its text once more, never more than that. The
packing carries only lengths and positions, and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

BUDGET, SEPARATOR = 450, 2


def tokens(c: Column) -> Column:
    return F.floor(F.length(c) * 1.5).cast("int")


def _bins(sizes: str, budget: int = BUDGET) -> Column:
    """Bin number of each element of an array of sizes. A bin ends before the element that would, with a separator, pass the budget; an element over the budget stands alone."""
    step = f"""(a, x) -> named_struct(
        'bins', a.bins || array(case when a.last < 0 then 0 when a.used + x + {SEPARATOR} > {budget} then a.last + 1 else a.last end),
        'used', case when a.last < 0 or a.used + x + {SEPARATOR} > {budget} then x else a.used + x + {SEPARATOR} end,
        'last', case when a.last < 0 then 0 when a.used + x + {SEPARATOR} > {budget} then a.last + 1 else a.last end)"""
    return F.expr(f"aggregate({sizes}, named_struct('bins', cast(array() as array<int>), 'used', 0, 'last', -1), {step}, a -> a.bins)")


def chunks(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sort_order, chunk_level, parent_order, searchable, title_path, nodes, text): chunks in reading order, sort_order from 0.

    Neighbouring nodes of one group make a parent (level 1, not searchable) of all of them, followed
    by its packed children (level 2) that name it in parent_order. Other nodes are packed alone, at
    level 2, and never with those of a group. The title is that of the chunk's first node, of children their group's.
    """
    order = Window.partitionBy(key).orderBy("pos")
    fresh = ~F.coalesce(F.col("group_id").eqNullSafe(F.lag("group_id").over(order)), F.lit(False)) | (F.lag("pos").over(order).isNull())
    runs = nodes.select(key, "pos", "text", "title_path", "group_id", fresh.cast("int").alias("_new")).withColumn("_run", F.sum("_new").over(order))
    each = F.struct("pos", "text", "title_path", tokens(F.coalesce("text", F.lit(""))).alias("size"))
    grouped = runs.groupBy(key, "_run").agg(F.first("group_id").alias("g"), F.sort_array(F.collect_list(each)).alias("n"))
    binned = grouped.withColumn("b", F.expr("transform(n, x -> x.size)")).withColumn("b", _bins("b"))
    made = """transform(sequence(0, b[size(b) - 1]), i -> named_struct('rank', i + 1, 'level', 2, 'part', filter(n, (x, j) -> b[j] = i)))"""
    parent = "array(named_struct('rank', 0, 'level', 1, 'part', n))"
    parts = binned.select(key, "_run", "g", F.col("n")[0]["title_path"].alias("_title"), F.explode(F.expr(f"case when g is null then {made} else {parent} || {made} end")).alias("c"))
    flat = parts.select(key, "_run", "g", "_title", "c.*").withColumn("sort_order", F.row_number().over(Window.partitionBy(key).orderBy("_run", "rank")) - 1)
    above = F.when(F.col("g").isNotNull() & (F.col("level") == 2), F.min("sort_order").over(Window.partitionBy(key, "_run")))
    title = F.when(F.col("g").isNotNull(), F.col("_title")).otherwise(F.col("part")[0]["title_path"])
    return flat.select(key, "sort_order", F.col("level").alias("chunk_level"), above.alias("parent_order"), (F.col("level") == 2).alias("searchable"), title.alias("title_path"), F.size("part").alias("nodes"), F.array_join("part.text", "\n\n").alias("text"))


def with_context(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``context``: for a child its parent's text, for a parent its children's texts in order; null for others."""
    family = F.coalesce("parent_order", F.when(F.col("chunk_level") == 1, F.col("sort_order")))
    together = Window.partitionBy(key, "_f")  # a parent and its children
    parent = F.max(F.when(F.col("chunk_level") == 1, F.col("text"))).over(together)
    kids = F.array_sort(F.collect_list(F.when(F.col("parent_order").isNotNull(), F.struct("sort_order", "text"))).over(together))
    context = F.when(F.col("parent_order").isNotNull(), parent).when((F.col("chunk_level") == 1) & (F.size(kids) > 0), F.array_join(kids["text"], "\n\n"))
    return made.withColumn("_f", family).withColumn("context", context).select(*made.columns, "context")


def merged_small(made: DataFrame, least: int, most: int = 800, key: str = "doc_id") -> DataFrame:
    """(key, sort_order, chunk_level, parent_order, text): neighbouring small chunks of one parent joined, up to ``most`` characters.

    Small is a child or lone chunk of 1 to least - 1 characters. made: (key, sort_order, chunk_level, parent_order, text). A joined chunk
    is its first one's heir; orders are counted anew and parents named by them.
    """
    order = Window.partitionBy(key).orderBy("sort_order")
    small = F.coalesce((F.coalesce("chunk_level", F.lit(2)) != 1) & F.length("text").between(1, least - 1), F.lit(False))
    marked = made.select(key, "sort_order", "chunk_level", "parent_order", "text", small.alias("_s"))
    goes_on = F.col("_s") & F.coalesce(F.lag("_s").over(order), F.lit(False)) & F.lag("parent_order").over(order).eqNullSafe(F.col("parent_order"))
    runs = marked.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    each = F.struct("sort_order", "chunk_level", "parent_order", "text", F.length("text").alias("size"))
    grouped = runs.groupBy(key, "_run").agg(F.sort_array(F.collect_list(each)).alias("n")).withColumn("s", F.expr("transform(n, x -> coalesce(x.size, 0))"))
    binned = grouped.withColumn("b", _bins("s", most))
    parts = binned.select(key, F.explode(F.expr("transform(sequence(0, b[size(b) - 1]), i -> filter(n, (x, j) -> b[j] = i))")).alias("p"))
    flat = parts.select(key, F.expr("p[0].sort_order").alias("_old"), F.expr("p[0].chunk_level").alias("chunk_level"), F.expr("p[0].parent_order").alias("_parent"), F.array_join("p.text", "\n\n").alias("text"))
    numbered = flat.withColumn("sort_order", F.row_number().over(Window.partitionBy(key).orderBy("_old")) - 1)
    heirs = numbered.select(key, F.col("_old").alias("_parent"), F.col("sort_order").alias("parent_order"))
    return numbered.join(heirs, [key, "_parent"], "left").select(key, "sort_order", "chunk_level", "parent_order", "text")


#: Kinds that a chunk brings along and keeps.
STRUCTURED = ("code", "table", "image", "formula")


def classified(made: DataFrame) -> DataFrame:
    return made.withColumn("chunk_type", F.when(F.col("chunk_type").isin(*STRUCTURED), F.col("chunk_type")).otherwise(T.chunk_type(F.coalesce("text", F.lit("")))))


def titled(made: DataFrame) -> DataFrame:
    """A title from the text's first heading where there is none."""
    return made.withColumn("title_path", F.coalesce(F.nullif("title_path", F.lit("")), T.title_of(F.col("text"))))


def prefixed(prefixes: DataFrame, key: str = "id"):
    """Context prefixes (key, prefix) for weak chunks that have none."""

    def step(made: DataFrame) -> DataFrame:
        weak = (F.col("chunk_type") == "weak") & (F.coalesce(F.trim("context_prefix"), F.lit("")) == "")
        joined = made.join(prefixes.withColumnRenamed("prefix", "_p"), key, "left")
        return joined.withColumn("context_prefix", F.when(weak, F.col("_p")).otherwise(F.col("context_prefix"))).drop("_p")

    return step


def indexed(made: DataFrame) -> DataFrame:
    """The search text: the words of prefix, title and text."""
    return made.withColumn("ts_content", F.array_join(T.segments(F.concat_ws(" ", "context_prefix", "title_path", "text")), " "))


def flagged(made: DataFrame) -> DataFrame:
    """A flag that isn't set is true for children alone."""
    return made.withColumn("searchable", F.coalesce("searchable", F.coalesce(F.col("chunk_level") == 2, F.lit(False))))


def embedded(made: DataFrame) -> DataFrame:
    """What is embedded, for searchable chunks."""
    return made.withColumn("embedding_text", F.when(F.col("searchable"), T.embedding_text(F.col("context_prefix"), F.col("title_path"), F.lit(""), F.col("text"))))


def stopping(where: Column):
    """A step that ends the chain for chunks that meet a condition."""

    def step(made: DataFrame) -> DataFrame:
        return made.withColumn("stop", F.coalesce(where, F.lit(False)))

    return step


def handled(made: DataFrame, steps: list) -> DataFrame:
    """made after each (order, step), lowest order first. An error in a step ends the job.

    A step gives the chunks back with all their columns. Where it sets a column ``stop`` the chain ends for those chunks alone: what the
    step itself did to them stays, later steps leave them as they are. A step that gives None ends the chain for all.
    """
    now = made.withColumn("_live", F.lit(True))
    for _, step in sorted(steps, key=lambda s: s[0]):
        before = now.columns
        after = step(now.withColumn("_was", F.struct(*before)))
        if after is None:
            break
        names = [c for c in after.columns if c not in ("_was", "_live", "stop")]
        kept = {c: F.when(F.col("_live"), F.col(c)).otherwise(F.col("_was")[c] if c in before else F.lit(None)).alias(c) for c in names}
        live = F.col("_live") & ~F.coalesce("stop", F.lit(False)) if "stop" in after.columns else F.col("_live")
        now = after.select(*kept.values(), live.alias("_live"))
    return now.drop("_live")
