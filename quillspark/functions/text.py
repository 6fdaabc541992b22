"""Column functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters or digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}0-9]+)"), 1)


#: Words that carry no search meaning.
STOP_WORDS = ("a", "an", "and", "are", "for", "how", "in", "is", "of", "on", "or", "the", "to", "was", "what", "with")


def keywords(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct tokens of two or more characters that aren't stop words, first occurrence first."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(*stop)))


def strip_reasoning(c: Column) -> Column:
    """Without chain-of-thought blocks: angle, bracket and dash pairs, then blocks left open; trimmed."""
    names = "(?:think|thinking|reasoning|thought)"
    for pattern in (rf"(?is)<{names}>.*?</{names}>", rf"(?is)\[{names}\].*?\[/{names}\]", rf"(?is)---{names}---.*?---/{names}---", rf"(?is)<{names}>.*$", rf"(?is)\[{names}\].*$"):
        c = F.regexp_replace(c, pattern, "")
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def estimated_tokens(c: Column) -> Column:
    """One and a half tokens a character, rounded down."""
    return F.floor(F.length(c) * 1.5).cast("int")


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def chunk_type(c: Column) -> Column:
    """code, table, qa, heading, weak or general, in that order."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    weak = (F.length(c) < 50) | ((words < 15) & ~F.contains(c, F.lit(".")))
    return F.when(F.contains(c, F.lit("```")), "code").when(c.rlike(r"(?m)^\|.*\|"), "table").when(c.rlike(r"(?m)^(Q|A)[:：]"), "qa").when(c.rlike(r"(?m)^#{1,6}\s"), "heading").when(weak, "weak").otherwise("general")


def sentences(c: Column) -> Column:
    """Sentences with their delimiter; what follows the last one is a sentence too; blank ones are dropped."""
    parts = F.regexp_extract_all(c, F.lit("([^。！？.!?；;]*[。！？.!?；;]|[^。！？.!?；;]+$)"), 1)
    return F.filter(parts, lambda s: F.length(F.regexp_replace(s, r"\s+", "")) > 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def packed(parts: Column, budget: int, joint: int) -> Column:
    """Greedy packing of texts in order: bins of texts whose lengths, with joint between, stay within budget; a longer text stands alone.

    Bins are cut on lengths first, as places where one begins, and each bin's texts are joined once.
    """
    start = F.struct(F.array().cast("array<int>").alias("begin"), F.lit(-1).alias("used"), F.lit(0).alias("at"))

    def step(acc: Column, part: Column) -> Column:
        n = F.length(part)
        fresh = (acc["used"] < 0) | (acc["used"] + n + joint > budget)
        return F.struct(F.when(fresh, F.concat(acc["begin"], F.array(acc["at"]))).otherwise(acc["begin"]).alias("begin"), F.when(fresh, n).otherwise(acc["used"] + n + joint).alias("used"), (acc["at"] + 1).alias("at"))

    def joined(p: Column, b: Column) -> Column:
        return F.transform(F.slice(b, 1, F.size(b) - 1), lambda x, i: F.array_join(F.slice(p, x + 1, F.get(b, i + 1) - x), "\n" * joint))

    # Arrays of one element bind the parts and the places, so that both are computed once.
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(parts, lambda p: bind(F.aggregate(p, start, step, lambda acc: F.concat(acc["begin"], F.array(acc["at"]))), lambda b: joined(p, b)))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def paragraphs(c: Column) -> Column:
    """Blocks parted by blank lines, trimmed; blank ones are dropped."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), trimmed), lambda p: p != "")


def uniform_lines(c: Column) -> Column:
    """Whether a text looks line-based: five lines or more, three with text, and a variance of their lengths below half the squared mean."""
    lines = F.split(c, "\n")
    sizes = F.filter(F.transform(lines, lambda x: F.length(trimmed(x)).cast("double")), lambda n: n > 0)
    total = F.aggregate(sizes, F.lit(0.0), lambda s, n: s + n)
    squares = F.aggregate(sizes, F.lit(0.0), lambda s, n: s + n * n)
    n = F.size(sizes)
    mean = total / n
    return F.coalesce((F.size(lines) >= 5) & (n >= 3) & (squares / n - mean * mean < mean * mean * 0.5), F.lit(False))


def frequent_gaps(c: Column) -> Column:
    """Whether three or more runs of two or more blank lines stand before some later line."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?:^|\n)(?:[^\S\n]*\n){2,}(?=[^\S\n]*\S)")) >= 3, F.lit(False))


#: File types by extension.
EXTENSIONS = {"pdf": ("pdf",), "docx": ("docx", "doc"), "xlsx": ("xlsx",), "markdown": ("md",), "html": ("html",), "code": ("java", "py", "js", "ts", "go", "rs", "c", "cpp", "cs", "kt", "rb", "php", "swift", "scala", "hs", "lua", "r", "sh", "bash", "sql"), "linebased": ("log", "csv", "tsv", "txt")}
CODE_WORDS = r"\b(package|import|class|def|function|fn|func)\b"


def document_type(path: Column, text: Column) -> Column:
    """By the extension, else by the first 500 characters: markdown, html, code, then line-based."""
    ext, head = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1)), F.substring(F.coalesce(text, F.lit("")), 1, 500)
    named = F.coalesce(*(F.when(ext.isin(*known), kind) for kind, known in EXTENSIONS.items()))
    marked = F.contains(head, F.lit("# ")) | F.contains(head, F.lit("```")) | head.rlike(r"^\s*#")
    return F.coalesce(named, F.when(marked, "markdown").when(F.lower(head).rlike("<html|<body|<div|<head|<!doctype html"), "html").when(head.rlike(CODE_WORDS), "code").otherwise("linebased"))


def safe_file_name(c: Column) -> Column:
    """The last path segment without characters that file systems refuse, its stem cut to 100; null where no stem is left."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r'[<>:"|?*]', "_"), r"[\x00-\x1f\x7f]", "")
    clean = F.regexp_replace(base, r"^ +|[ .]+$", "")
    stem, ext = F.regexp_extract(clean, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(clean, r"^.+?(\.[^.]*)?$", 1)
    return F.when(F.trim(stem) != "", F.concat(F.substring(stem, 1, 100), ext))


def archive_name(c: Column) -> Column:
    """Letters and digits, all else one underscore a run, none at the ends; ``unnamed`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", "_"), "^_|_$", ""), F.lit("")), F.lit("unnamed"))


def title_of(c: Column) -> Column:
    """The first Markdown heading if under 120 characters, else the first HTML heading without its tags; null if none."""
    mark = F.nullif(trimmed(F.regexp_extract(c, r"(?m)^#{1,6}[^\S\n]+(\S.*)$", 1)), F.lit(""))
    tag = F.nullif(trimmed(F.regexp_replace(F.regexp_extract(c, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), "<[^>]+>", "")), F.lit(""))
    return F.coalesce(F.when(F.length(mark) < 120, mark), tag)


def snippet(c: Column, word: str, width: int = 500) -> Column:
    """The text around the first hit, blind to case, line ends as spaces, ``…`` where it is cut; null without a hit."""
    at, half = F.locate(word.lower(), F.lower(c)) - 1, max(width - len(word), 0) // 2
    start, end = F.greatest(F.lit(0), at - half), F.least(F.length(c), at + len(word) + half)
    body = trimmed(F.translate(F.substring(c, start + 1, end - start), "\n", " "))
    return F.when(at >= 0, F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(c), "…").otherwise("")))


def section(c: Column, title: str) -> Column:
    """The body below a second-level heading, up to the next one; empty if there is none."""
    return trimmed(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?s)## {title}(.*?)(?:\n## .*)?\z", 1))


def head_summary(c: Column, limit: int = 600) -> Column:
    """The first second-level section with its heading, else the whole; cut at the limit; ``(空)`` for a blank text."""
    whole = trimmed(c)
    part = F.when(F.contains(whole, F.lit("\n## ")), trimmed(F.regexp_extract(whole, r"(?s)\n## (.*?)(?:\n## .*)?\z", 1))).otherwise(whole)
    cut = F.when(F.length(part) > limit, F.concat(F.substring(part, 1, limit), F.lit("…(已截断)"))).otherwise(part)
    return F.when(F.coalesce(whole, F.lit("")) == "", "(空)").otherwise(cut)


def embedding_text(prefix: Column, title: Column, index_text: Column, text: Column) -> Column:
    """What is embedded: prefix, title path and the index text, or the text where that is blank; reasoning stripped."""
    body = F.when(F.trim(index_text) != "", index_text).otherwise(F.coalesce(text, F.lit("")))
    return strip_reasoning(F.concat_ws(" ", F.nullif(prefix, F.lit("")), F.nullif(title, F.lit("")), body))


def source_label(file: Column, title: Column) -> Column:
    return F.concat_ws(" > ", file, F.nullif(title, F.lit("")))


def rounded4(c: Column) -> Column:
    """Half up, to four places."""
    return F.floor(c * 10000 + 0.5) / 10000


#: Marks of programming languages, in the order they are tried, and languages of file extensions.
LANGUAGE_MARKS = (("public class", "java"), ("System.out", "java"), ("private class", "java"), ("def ", "python"), ("import ", "python"), ("func ", "go"), ("fn ", "rust"), ("function ", "javascript"), ("var ", "javascript"), ("const ", "javascript"), ("fun ", "kotlin"), ("package main", "go"), ("#include", "c"))
FILE_MARKS = (("public class", "java"), ("System.out", "java"), ("def ", "python"), ("import ", "python"), ("function ", "javascript"), ("var ", "javascript"), ("const ", "javascript"))
EXTENSION_LANGUAGES = {"java": "java", "py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "cs": "csharp", "kt": "kotlin", "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala", "sh": "bash", "sql": "sql"}


def _marked(head: Column, marks) -> Column:
    return F.coalesce(*(F.when(F.contains(head, F.lit(mark)), name) for mark, name in marks))


def language_of(c: Column) -> Column:
    """A programming language by marks in the first 200 characters, SQL first where both SELECT and FROM are met; null if none is."""
    head = F.substring(c, 1, 200)
    sql = F.contains(F.upper(head), F.lit("SELECT ")) & F.contains(F.upper(head), F.lit(" FROM "))
    return F.coalesce(F.when(sql, "sql"), _marked(head, LANGUAGE_MARKS))


def file_language(path: Column, c: Column) -> Column:
    """The language of a code file: by its extension, else by marks, of which SELECT or FROM alone means SQL; null if none is met."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSION_LANGUAGES.items() for x in pair))
    ext, head = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./\\]+)$", 1)), F.substring(c, 1, 200)
    sql = F.contains(F.upper(head), F.lit("SELECT ")) | F.contains(F.upper(head), F.lit("FROM "))
    by_mark = F.coalesce(_marked(head, FILE_MARKS), F.when(sql, "sql"), _marked(head, (("fn ", "rust"), ("func ", "go"))))
    return F.coalesce(F.try_element_at(known, ext), F.when(F.substring(c, 1, 500).rlike(CODE_WORDS), by_mark))


#: Labels of errors by the class name met first along the chain of causes.
ERRORS = {"RateLimitException": "RATE_LIMIT", "InternalServerException": "SERVER_ERROR", "TimeoutException": "TIMEOUT", "UnresolvedModelServerException": "DNS", "UnresolvedAddressException": "DNS", "HttpTimeoutException": "NETWORK_TIMEOUT", "IOException": "NETWORK"}


def error_label(chain: Column) -> Column:
    """The label of the first known class in an array of class names, outermost first; OTHER if none is known."""
    known = F.create_map(*(F.lit(x) for pair in ERRORS.items() for x in pair))
    return F.coalesce(F.get(F.filter(F.transform(chain, lambda n: F.try_element_at(known, n)), lambda x: x.isNotNull()), F.lit(0)), F.lit("OTHER"))


def segments(c: Column) -> Column:
    """Search words of a text: lower-cased runs of letters and digits, and of runs of Chinese characters every two neighbours (a lone one as it is)."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\u4e00-\u9fff]+|[\p{L}0-9&&[^\u4e00-\u9fff]]+)"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^[\u4e00-\u9fff]{2,}$"), pairs(r)).otherwise(F.array(r))))


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 of the UTF-8 message, in lower-case hex, from two built-in digests."""
    import hashlib

    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def signed_image(key: Column, secret: str, expires: Column) -> Column:
    """The signed path of an image; null for a blank key."""
    path = F.concat(F.lit("/assets/images/"), key, F.lit("?expires="), expires.cast("string"))
    return F.when(F.trim(key) != "", F.concat(F.lit("/api"), path, F.lit("&sig="), hmac_sha256(secret, path)))


def verified_image(key: Column, expires: Column, signature: Column, secret: str, now: Column, grace: int = 0) -> Column:
    """Whether a signed path holds: the signature is that of key and time, and the time is not over by more than the grace."""
    at = expires.try_cast("long")
    message = F.concat(F.lit("/assets/images/"), key, F.lit("?expires="), at.cast("string"))
    return F.coalesce((at + grace >= now) & (hmac_sha256(secret, message) == signature), F.lit(False))


#: File types of which a whole text is the context; of others it is the neighbours.
WHOLE_CONTEXT = ("java", "c", "cpp", "cc", "cxx", "h", "hpp", "hxx", "cs", "py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "go", "rs", "rb", "php", "kt", "kts", "swift", "scala", "sh", "bash", "zsh", "bat", "cmd", "ps1", "sql", "html", "htm")


def wants_whole_context(file_type: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(trimmed(file_type)), r"^\.", "").isin(*WHOLE_CONTEXT), F.lit(False))


def topic_of(c: Column) -> Column:
    """The first line of the Topic section that is neither blank nor a comment; null if there is none."""
    lines = F.transform(F.split(section(c, "Topic"), "\n"), trimmed)
    return F.get(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("<!--"))), F.lit(0))


def front_matter(c: Column) -> Column:
    """The ``key: value`` lines of a leading ``---`` block as a map, of repeated keys the last; empty if there is none."""
    lines = F.split(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1), "\n")
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(r"^[^:]+:")), lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def json_object(c: Column) -> Column:
    """A model's answer without its code fence, cut behind the brace that balances the first one; prose before it stays, null gives empty.

    Braces within strings don't count; without a balanced object the trimmed text is returned.
    Strings and escapes are blanked to equal lengths first, then depths are summed by a scan.
    """
    whole = trimmed(F.coalesce(c, F.lit("")))
    bare = F.when(F.startswith(whole, F.lit("```")), F.regexp_replace(F.regexp_replace(whole, r"\A```[^\n]*\n", ""), r"(?s)```(?!.*```).*\z", "")).otherwise(whole)
    text = trimmed(bare)
    # Before the first brace a quote is prose, so only what follows is read as JSON.
    lead = F.regexp_extract(text, r"(?s)\A([^{]*)", 1)
    body = F.substr(text, F.length(lead) + 1)
    # Runs that hold no brace outside a string are one token; the depth after each token tells where the object ends.
    tokens = F.regexp_extract_all(body, F.lit(r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)|[{}]|[^{}"]++)'), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = acc["at"] + F.length(token)
        end = F.when((acc["end"] == 0) & (token == "}") & (depth == 0), at).otherwise(acc["end"])
        return F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))

    end = F.aggregate(tokens, start, step, lambda acc: acc["end"])
    return F.when(end > 0, F.concat(lead, F.substr(body, F.lit(1), end))).otherwise(text)
