"""Progress, grading, paging and activity counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def progress(phases: DataFrame, plan: str, status: str) -> DataFrame:
    """Counts by status, percentage completed and the plan's own status."""
    count = lambda s: F.count_if(F.col(status) == s)
    done, idle, total = count("completed"), count("not_started"), F.count("*")
    whole = F.when(done == total, "completed").when(idle == total, "not_started").otherwise("in_progress")
    return phases.groupBy(plan).agg(done.alias("completed"), count("in_progress").alias("in_progress"), idle.alias("not_started"), F.floor(100.0 * done / total + 0.5).cast("int").alias("percent"), whole.alias("plan_status"))


def answer_set(c: Column) -> Column:
    """The answers in a text, lower-cased, trimmed, distinct and sorted: the items of a JSON array, or else of a list with commas, blank ones left out."""
    item = lambda x: F.lower(T.trimmed(x))
    listed = F.from_json(F.when(T.trimmed(c).rlike(r"^\[.*\]$"), c), "array<string>")
    plain = F.filter(F.transform(F.split(c, "[,，]"), item), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.when(listed.isNotNull(), F.transform(listed, item)).otherwise(plain)))


def answer_matches(kind: Column, given: Column, expected: Column) -> Column:
    """Trimmed, case-blind equality; sets for multiple choice. Blank answers, short answers and unknown kinds never match."""
    plain = F.lower(T.trimmed(given)) == F.lower(T.trimmed(expected))
    by_kind = F.when(kind == "multi_choice", answer_set(given) == answer_set(expected)).when(kind.isin("single_choice", "true_false", "fill_blank"), plain)
    return F.coalesce((T.trimmed(given) != "") & by_kind, F.lit(False))


def graded(questions: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """questions (on, type, answer) with ``given`` of answers (on, given), empty where there is none, and ``correct``."""
    joined = questions.join(answers, on, "left").withColumn("given", F.coalesce("given", F.lit("")))
    return joined.withColumn("correct", answer_matches(F.col("type"), F.col("given"), F.col("answer")))


def phase_status(phases: DataFrame, progress_rows: DataFrame, phase: str) -> DataFrame:
    """Phases with the status of their progress row, ``not_started`` where there is none."""
    return phases.join(progress_rows.select(phase, "status"), phase, "left").withColumn("status", F.coalesce("status", F.lit("not_started")))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of ordered rows; numbers below 1 count as 1, sizes below 1 as 10."""
    number, size = max(number, 1), size if size >= 1 else 10
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def activity(events: DataFrame, kind: str, since: str, until: str) -> DataFrame:
    """Events of a kind by user and day, since <= ts < until."""
    rows = events.where((F.col("event_type") == kind) & (F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def validate_exam(questions: DataFrame) -> DataFrame:
    """(exam, index, field, message) of every broken rule of questions (exam, index, title, type, stem, answer, options array<string>).

    An answer is a list where it is a JSON array: of multiple choice it has to be one, of others but filled blanks it must not.
    A row of a null index stands for an exam without questions. Index -1 is the exam itself.
    """
    kinds = ("single_choice", "multi_choice", "true_false", "fill_blank", "short_answer")
    blank = lambda c: F.coalesce(T.trimmed(c) == "", F.lit(True))
    choice, listed = F.col("type").isin("single_choice", "multi_choice"), T.trimmed(F.col("answer")).rlike(r"^\[.*\]$")
    rule = lambda broken, field, message: F.when(F.coalesce(broken, F.lit(False)), F.struct(F.col("index"), F.lit(field).alias("field"), F.lit(message).alias("message")))
    whole = lambda broken, field: F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(-1).alias("index"), F.lit(field).alias("field"), F.lit("missing").alias("message")))
    of = lambda broken, field, message: rule(F.col("index").isNotNull() & broken, field, message)
    has = F.size("options") > 0
    answers = F.coalesce(F.from_json(F.when(listed, F.col("answer")), "array<string>"), F.array(F.col("answer")))
    found = F.array(
        of(~F.coalesce(F.col("type").isin(*kinds), F.lit(False)), "type", "unknown type"),
        of(blank(F.col("stem")), "stem", "missing"),
        of(blank(F.col("answer")) | (F.col("answer") == "[]"), "answer", "missing"),
        of((F.col("type") == "multi_choice") & ~listed, "answer", "not a list"),
        of(~F.col("type").isin("multi_choice", "fill_blank") & listed, "answer", "a list"),
        of(choice & (F.coalesce(F.size("options"), F.lit(0)) < 1), "options", "missing"),
        of(choice & has & (F.size(F.array_except(answers, F.col("options"))) > 0), "answer", "not an option"),
        of((F.col("type") == "true_false") & ~F.col("answer").isin("正确", "错误"), "answer", "not a truth value"),
        whole((F.coalesce(F.col("index"), F.lit(0)) == 0) & blank(F.col("title")), "title"),
        whole(F.col("index").isNull(), "questions"),
    )
    return questions.select("exam", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("exam", "e.*")


def first_fault(faults: DataFrame, of: str) -> DataFrame:
    """The fault that a check would stop at: of each group the one of the lowest index, then field and message."""
    return faults.groupBy(of).agg(F.min(F.struct("index", "field", "message")).alias("e")).select(of, "e.*")


def validate_plan(plans: DataFrame) -> DataFrame:
    """(plan, index, field, message) of every broken rule of plans (plan, title, goal, source_type, phases array<struct<title>>); index -1 is the plan itself."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fault = lambda at, field, message: F.struct(at.cast("int").alias("index"), F.lit(field).alias("field"), F.lit(message).alias("message"))
    whole = [F.when(blank(F.col(c)), fault(F.lit(-1), c, "missing")) for c in ("title", "goal", "source_type")]
    whole.append(F.when(F.coalesce(F.size("phases"), F.lit(0)) < 1, fault(F.lit(-1), "phases", "missing")))
    phases = F.coalesce(F.transform("phases", lambda p, i: F.when(blank(p["title"]), fault(i, "title", "missing"))), F.array())
    found = F.filter(F.concat(F.array(*whole), phases), lambda x: x.isNotNull())
    return plans.select("plan", F.explode(found).alias("e")).select("plan", "e.*")


#: Marks of a phase's status in an exported plan.
MARKS = {"completed": "[x]", "in_progress": "[~]"}


#: Words of an exported plan.
LABELS = {"completed": "已完成", "in_progress": "进行中"}
SECTIONS = {"key_topics": "关键知识点", "resources": "学习资源", "practice_tasks": "实践任务", "milestones": "里程碑"}


def _exported(phases: DataFrame, plan: str, part: Column, head, tail: str) -> DataFrame:
    """Each plan's head, its parts in the order of phases, and a tail; head is called with counts and percentage as texts."""
    done, total = F.count_if(F.col("status") == "completed"), F.count("*")
    grouped = phases.groupBy(plan).agg(done.alias("_d"), total.alias("_n"), F.array_sort(F.collect_list(F.struct("phase_order", part.alias("part")))).alias("_p"), F.first(F.struct("plan_title", "goal", "description", "plan_duration")).alias("_h"))
    percent = F.floor(100.0 * F.col("_d") / F.col("_n") + 0.5).cast("int").cast("string")
    return grouped.select(plan, F.concat(head(F.col("_d").cast("string"), F.col("_n").cast("string"), percent), F.array_join("_p.part", ""), F.lit(tail)).alias("text"))


def _if_any(c: Column, *parts: Column) -> Column:
    """The parts joined where c isn't blank, else nothing."""
    return F.when(T.trimmed(c) != "", F.concat(*parts)).otherwise(F.lit(""))


def plan_markdown(phases: DataFrame, plan: str) -> DataFrame:
    """(plan, text): each plan as Markdown. phases: (plan, phase_order, title, status, duration, objective, notes, the arrays of SECTIONS, and of the plan plan_title, goal, description, plan_duration)."""
    lit = F.lit
    mark = F.coalesce(*(F.when(F.col("status") == s, m) for s, m in MARKS.items()), lit("[ ]"))
    lists = [F.when(F.size(c) > 0, F.concat(lit(f"- **{name}**：\n"), F.array_join(F.transform(c, lambda x: F.concat(lit("  - "), x, lit("\n"))), ""))).otherwise("") for c, name in SECTIONS.items()]
    part = F.concat(
        lit("## "), mark, lit(" 阶段 "), F.col("phase_order").cast("string"), lit("："), F.coalesce("title", lit("")), lit("\n\n"),
        _if_any(F.col("duration"), lit("- **时长**："), F.col("duration"), lit("\n")), _if_any(F.col("objective"), lit("- **目标**："), F.col("objective"), lit("\n")),
        *lists, _if_any(F.col("notes"), lit("\n**学习笔记**：\n\n> "), F.col("notes"), lit("\n")), lit("\n"),
    )

    def head(done: Column, total: Column, percent: Column) -> Column:
        h = F.col("_h")
        return F.concat(
            lit("# "), h["plan_title"], lit("\n\n> **学习目标**："), h["goal"], lit("\n\n"), _if_any(h["description"], lit("**描述**："), h["description"], lit("\n\n")), _if_any(h["plan_duration"], lit("**总时长**："), h["plan_duration"], lit("\n\n")),
            lit("**进度**："), done, lit("/"), total, lit(" 阶段已完成（"), percent, lit("%）\n\n---\n\n"),
        )

    return _exported(phases, plan, part, head, "").withColumnRenamed("text", "markdown")


def plan_html(phases: DataFrame, plan: str) -> DataFrame:
    """(plan, html): the same plan as an HTML page without style rules; texts are escaped."""
    lit = F.lit

    def safe(c: Column) -> Column:
        for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, lit(raw), lit(name))
        return c

    row = lambda c, name: _if_any(c, lit(f"<p><strong>{name}</strong>："), safe(c), lit("</p>\n"))
    label = F.coalesce(*(F.when(F.col("status") == s, m) for s, m in LABELS.items()), lit("未开始"))
    lists = [F.when(F.size(c) > 0, F.concat(lit(f"<p><strong>{name}</strong></p>\n<ul>"), F.array_join(F.transform(c, lambda x: F.concat(lit("<li>"), safe(x), lit("</li>"))), ""), lit("</ul>\n"))).otherwise("") for c, name in SECTIONS.items()]
    part = F.concat(
        lit('<div class="phase">\n<h2>阶段 '), F.col("phase_order").cast("string"), lit("："), safe(F.coalesce("title", lit(""))), lit('<span class="status-'), F.col("status"), lit('">'), label, lit("</span></h2>\n"),
        row(F.col("duration"), "时长"), row(F.col("objective"), "目标"), *lists, row(F.col("notes"), "学习笔记"), lit("</div>\n"),
    )

    def head(done: Column, total: Column, percent: Column) -> Column:
        h = F.col("_h")
        return F.concat(
            lit("<!DOCTYPE html>\n<html>\n<body>\n<h1>"), safe(h["plan_title"]), lit("</h1>\n"), row(h["goal"], "学习目标"), row(h["description"], "描述"), row(h["plan_duration"], "总时长"),
            lit("<p><strong>进度</strong>："), done, lit("/"), total, lit(" 阶段已完成（"), percent, lit("%）</p>\n"),
        )

    return _exported(phases, plan, part, head, "</body>\n</html>\n").withColumnRenamed("text", "html")


def search_stats(found: DataFrame, group: str, item: str, score: str, threshold: float, top: int = 10) -> DataFrame:
    """Candidates, those at the threshold or above, the best score and the ids of the ten best, without collecting a group."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(item)))
    best = found.select(group, item, rank.alias("_r")).where(F.col("_r") <= top)
    ids = best.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_r", item)))[item].cast("array<string>"), ",").alias("top"))
    counts = found.groupBy(group).agg(F.count("*").alias("searches"), F.count_if(F.col(score) >= threshold).alias("hits"), F.round(F.max(score), 6).alias("best"))
    return counts.join(ids, group)
