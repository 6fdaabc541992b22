"""Text documents into ordered nodes: line-based, Markdown and code parsers, each a plain function over one text.

A parser returns Node tuples; ``nodes`` maps one over a table in Arrow batches, so rows never leave
their partition and a text is held once. Null and blank texts have no nodes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, LIMIT, ELASTIC, OVERSIZE = 250, 300, 1.2, 1.5


class Node(NamedTuple):
    type: str
    text: str
    level: int | None = None
    title_path: str | None = None
    language: str | None = None
    group_id: str | None = None


def accumulated(parts: list[str], joint: str, target: int = TARGET) -> list[str]:
    """Greedy runs of parts: a run ends before the part that would take it over the elastic bound."""
    out: list[str] = []
    now = ""
    for part in parts:
        if now and len(now) + len(joint) + len(part) > int(target * ELASTIC):
            out.append(now)
            now = part
        else:
            now = now + joint + part if now else part
    return [*out, now] if now else out


def sentences(text: str) -> list[str]:
    """Sentences with their delimiter; the white space after it stays on the next one."""
    return [s for s in re.findall(r"[^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$", text) if s.strip()]


def weak_paragraphs(text: str) -> list[str]:
    """Runs of plain lines and whole lists; blank lines part them."""

    def kind(line: str) -> str:
        bare = line.strip()
        return "blank" if not bare else "list" if re.match(r"[-*+] |\d+\.\s+.", bare) else "plain"

    return ["\n".join(run).strip() for k, run in groupby(text.split("\n"), kind) if k != "blank"]


def long_pieces(text: str, limit: int = LIMIT) -> list[str]:
    """Pieces of at most limit characters, each cut behind the last boundary in reach, or hard."""
    out = []
    while len(text) > limit:
        ends = [m.end() for m in re.finditer(r"[，。、；！？,.;:!?（）()\s]", text[:limit])]
        cut = ends[-1] if ends else limit
        out.append(text[:cut].strip())
        text = text[cut:].lstrip()
    return [p for p in (*out, text.strip()) if p]


def _oversize(text: str) -> list[str]:
    weak = weak_paragraphs(text)
    if "\n" in text and all(len(w) <= TARGET for w in weak):
        return accumulated(weak, "\n")
    return [s.strip() for s in accumulated(sentences(text), "")]


def capped(nodes: list[Node]) -> list[Node]:
    """Text nodes over the limit as pieces of one group; a node's own group stays."""
    out = []
    for i, node in enumerate(nodes):
        if node.type != "text" or len(node.text.strip()) <= LIMIT:
            out.append(node)
        else:
            out += [node._replace(text=p, group_id=node.group_id or f"g-{i}") for p in long_pieces(node.text.strip())]
    return out


def cluster_pieces(text: str) -> list[str]:
    """A run of paragraphs as it is, or over the target in pieces."""
    return [text] if len(text) <= TARGET else [p for p in _oversize(text) if p]


def line_nodes(text: str) -> list[Node]:
    """Blank-line paragraphs run together up to the target; one over 1.5 times the target is split and its parts share a group."""
    out: list[Node] = []
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    for big, run in groupby(paragraphs, lambda p: len(p) > TARGET * OVERSIZE):
        if not big:
            out += [Node("text", t) for t in accumulated(list(run), "\n\n")]
            continue
        for p in run:
            group = f"n-{len(out)}"
            out += [Node("text", s, group_id=group) for s in _oversize(p)]
    return capped(out)


def table_html(lines: list[str]) -> str:
    """A pipe table as HTML: the first row as heads, the ruler dropped."""
    cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in lines]
    cells = [r for r in cells if not all(re.fullmatch(r":?-+:?", c) for c in r)]
    tag = lambda i: "th" if i == 0 else "td"
    return "<table>" + "".join("<tr>" + "".join(f"<{tag(i)}>{c}</{tag(i)}>" for c in r) + "</tr>" for i, r in enumerate(cells)) + "</table>"


def _blocks(text: str, title: str | None) -> list[Node]:
    """The code, table, image and text blocks of a section."""
    out = []
    for part in re.split(r"(?ms)(^```[^\n]*\n.*?(?:^```[^\n]*$|\Z))", text):
        fence = re.match(r"(?s)```([^\n]*)\n(.*)", part)
        if fence:
            body = re.sub(r"(?m)^```[^\n]*\Z", "", fence[2]).rstrip("\n")
            out.append(Node("code", body, title_path=title, language=fence[1].strip() or None))
            continue
        for paragraph in re.split(r"\n\s*\n", part):
            for table, run in groupby(paragraph.split("\n"), lambda line: line.lstrip().startswith("|")):
                lines = list(run)
                if table:
                    out.append(Node("table", table_html(lines), title_path=title))
                    continue
                for i, piece in enumerate(re.split(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)", "\n".join(lines))):
                    if i % 2:
                        out += [] if re.match(r"https?://", piece) else [Node("image", piece, title_path=title)]
                    elif piece.strip():
                        bare = piece.strip()
                        group = f"b-{len(out)}" if len(bare) > TARGET else None
                        out += [Node("text", s, title_path=title, group_id=group) for s in (_oversize(bare) if group else [bare])]
    return out


def markdown_nodes(text: str) -> list[Node]:
    """Sections of headings of levels 1 to 3, with their title path of three slots; remote images are skipped.

    Sections without a body have no node, but their heading stays in the path of those below.
    """
    slots: list[str | None] = [None] * 3
    out: list[Node] = []
    preamble, *rest = re.split(r"(?m)^(#{1,3})[^\S\n]+(\S.*)$", text)
    out += _blocks(preamble, None)
    for marks, title, body in zip(rest[::3], rest[1::3], rest[2::3], strict=True):
        level = len(marks)
        slots[level - 1 :] = [title.strip(), *[None] * (3 - level)]
        if body.strip():
            path = " > ".join(s for s in slots if s)
            out += [Node("heading", title.strip(), level, path), *_blocks(body, path)]
    return capped(out)


_MODIFIER = r"(?:(?:public|private|protected|static|final|abstract|sealed|open|override|async|export|default|native|inline|pub|data|synchronized)[ \t]+)"
_TYPE = re.compile(rf"^[ \t]*{_MODIFIER}*(?:class|interface|enum|object|trait|struct|impl|module)(?:[ \t]+(?:class|struct))?[ \t]+(?P<name>\w+)", re.M)
_FUNCTION = re.compile(
    rf"^[ \t]*(?:{_MODIFIER}*(?:def|fn|func|fun|function|sub|proc)[ \t]+(?:\([^)\n]*\)[ \t]*)?|{_MODIFIER}+(?:[\w<>\[\],.]+[ \t]+)*|(?!(?:return|else|new|throw)\b)(?:[\w:<>\[\]]+[ \t]+)+(?=\w+[ \t]*\([^)\n]*\)[ \t]*\{{))(?P<name>\w+)[ \t]*\([^)]*\)", re.M
)
_COMMENT = re.compile(r"//|#(?!include)|--|/\*|\*")


def code_nodes(text: str, language: str | None = None) -> list[Node]:
    """One node a class head or function, with the comments just above; what comes before the first is a node too.

    The title is ``Class > function``; a class stays until the next one begins.
    """
    starts = sorted([(m.start(), "class", m["name"]) for m in _TYPE.finditer(text)] + [(m.start(), "function", m["name"]) for m in _FUNCTION.finditer(text)])
    cuts = []
    for at, kind, name in starts:
        lines = text[:at].split("\n")[:-1]
        while lines and (not lines[-1].strip() or _COMMENT.match(lines[-1].strip())):
            at -= len(lines.pop()) + 1
        cuts.append((at, kind, name))
    out, owner = [], None
    if text[: cuts[0][0] if cuts else len(text)].strip():
        out.append(Node("code", text[: cuts[0][0] if cuts else len(text)].strip("\n"), language=language))
    for (at, kind, name), end in zip(cuts, [*(c[0] for c in cuts[1:]), len(text)], strict=False):
        owner = name if kind == "class" else owner
        title = name if kind == "class" or not owner else f"{owner} > {name}"
        if text[at:end].strip():
            out.append(Node("code", text[at:end].strip("\n"), title_path=title, language=language))
    return out


_SCHEMA = "pos int, type string, text string, level int, title_path string, language string, group_id string"


def nodes(docs: DataFrame, parse: Callable[[str], list[Node]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, type, text, level, title_path, language, group_id) of every row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *n) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and t.strip() for i, n in enumerate(parse(t))]
            cols = zip(*rows, strict=True) if rows else [()] * 8
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, *(s.split()[0] for s in _SCHEMA.split(", "))])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("_t")).mapInArrow(run, f"{key} long, {_SCHEMA}")
