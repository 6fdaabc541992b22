"""DuckDB twins of the parsers: the same rules as set operations and recursive runs over rows."""

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


def runs(name: str, source: str, joint: int, limit: int = 300, fresh: str = "false") -> str:
    """Greedy runs of rows (d, i, k, s): adds ``bin`` within (d, i), where a run ends before the row that would take it over the limit."""
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY d, i ORDER BY k) AS r FROM {source}),
{name}_w AS (SELECT d, i, r, 0 AS bin, length(s) AS used FROM {name}_o WHERE r = 1 UNION ALL
  SELECT o.d, o.i, o.r, CASE WHEN {fresh} OR w.used + {joint} + length(o.s) > {limit} THEN w.bin + 1 ELSE w.bin END, CASE WHEN {fresh} OR w.used + {joint} + length(o.s) > {limit} THEN length(o.s) ELSE w.used + {joint} + length(o.s) END FROM {name}_w w JOIN {name}_o o ON o.d = w.d AND o.i = w.i AND o.r = w.r + 1),
{name} AS (SELECT o.*, w.bin FROM {name}_o o JOIN {name}_w w USING (d, i, r))"""


def oversize(name: str, source: str) -> str:
    """The parts (d, i, bin, s) of large paragraphs (d, i, p): weak paragraphs run together by lines if all are short, else sentences."""
    sentences = "[。！？.!?；;]"
    return rf"""{name}_l AS (SELECT d, i, unnest(string_split(p, chr(10))) AS line, generate_subscripts(string_split(p, chr(10)), 1) AS n FROM {source}),
{name}_k AS (SELECT *, CASE WHEN {_strip('line')} = '' THEN 'blank' WHEN regexp_matches({_strip('line')}, '^([-*+] |\d+\.\s+.)') THEN 'list' ELSE 'plain' END AS kind FROM {name}_l),
{name}_c AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY d, i ORDER BY n) = kind THEN 0 ELSE 1 END AS f FROM {name}_k),
{name}_r AS (SELECT *, sum(f) OVER (PARTITION BY d, i ORDER BY n) AS run FROM {name}_c),
{name}_p AS (SELECT d, i, run AS k, {_strip("string_agg(line, chr(10) ORDER BY n)")} AS s FROM {name}_r WHERE kind <> 'blank' GROUP BY d, i, run),
{name}_t AS (SELECT d, i, contains(any_value(p), chr(10)) AND max(length(s)) <= 250 AS weak FROM {name}_p JOIN {source} USING (d, i) GROUP BY d, i),
{name}_ws AS (SELECT q.* FROM {name}_p q JOIN {name}_t USING (d, i) WHERE weak),
{name}_e AS (SELECT d, i, unnest(regexp_extract_all(p, '[^。！？.!?；;]*{sentences}|[^。！？.!?；;]+$')) AS s, generate_subscripts(regexp_extract_all(p, '[^。！？.!?；;]*{sentences}|[^。！？.!?；;]+$'), 1) AS k FROM {source} JOIN {name}_t USING (d, i) WHERE NOT weak),
{name}_es AS (SELECT d, i, k, s FROM {name}_e WHERE {_strip('s')} <> ''),
{runs(name + '_wr', name + '_ws', 1)},
{runs(name + '_er', name + '_es', 0)},
{name} AS (SELECT d, i, bin, string_agg(s, chr(10) ORDER BY k) AS s FROM {name}_wr GROUP BY d, i, bin UNION ALL SELECT d, i, bin, {_strip("string_agg(s, '' ORDER BY k)")} FROM {name}_er GROUP BY d, i, bin)"""


def capped(name: str, source: str) -> str:
    """Nodes (d, x, type, text, g, ...) with long texts cut into pieces: adds j, and the group of cut ones. x counts nodes from 0."""
    end = r"coalesce(nullif(length(regexp_extract({0}[:300], '(?s)^.*[，。、；！？,.;:!?（）()\s]')), 0), 300)"
    head = lambda t: f"CASE WHEN length({t}) <= 300 THEN {_strip(t)} ELSE {_strip(f'{t}[:{end.format(t)}]')} END"
    tail = lambda t: rf"CASE WHEN length({t}) <= 300 THEN '' ELSE regexp_replace({t}[{end.format(t)} + 1:], '^\s+', '') END"
    return f"""{name}_s AS (SELECT *, {_strip('text')} AS bare FROM {source}),
{name}_w AS (SELECT d, x, 0 AS j, {head('bare')} AS piece, {tail('bare')} AS rest FROM {name}_s WHERE type = 'text' AND length(bare) > 300 UNION ALL SELECT d, x, j + 1, {head('rest')}, {tail('rest')} FROM {name}_w WHERE rest <> ''),
{name} AS (SELECT s.* EXCLUDE (text, bare, g), coalesce(w.piece, s.text) AS text, coalesce(w.j, 0) AS j, CASE WHEN w.piece IS NULL THEN g ELSE coalesce(g, 'g-' || s.x) END AS group_id FROM {name}_s s LEFT JOIN {name}_w w ON w.d = s.d AND w.x = s.x WHERE w.piece IS NULL OR w.piece <> '')"""


def _rows(source: str, key: str) -> str:
    return f"SELECT d AS {key}, (row_number() OVER (PARTITION BY d ORDER BY x, j) - 1)::INT AS pos, type, text, level::INT AS level, title_path, language, group_id FROM {source}"


_PARAGRAPHS = r"regexp_split_to_array({0}, '\n\s*\n')"


def line_sql(lined: str) -> str:
    """lined: a common table ``lined`` (doc_id, text)."""
    return f"""WITH RECURSIVE {lined},
p0 AS (SELECT doc_id AS d, unnest({_PARAGRAPHS.format('text')}) AS q, generate_subscripts({_PARAGRAPHS.format('text')}, 1) AS i FROM lined WHERE text IS NOT NULL),
p AS (SELECT d, i, {_strip('q')} AS p, length({_strip('q')}) > 375 AS big FROM p0 WHERE {_strip('q')} <> ''),
bigs AS (SELECT d, i, p FROM p WHERE big),
{oversize('ov', 'bigs')},
order_ AS (SELECT *, sum(CASE WHEN big THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i) AS after FROM p),
small AS (SELECT d, after AS i, i AS k, p AS s FROM order_ WHERE NOT big),
{runs('sr', 'small', 2)},
nodes0 AS (SELECT d, min(k) AS i, 0 AS bin, string_agg(s, chr(10) || chr(10) ORDER BY k) AS text, false AS big FROM sr GROUP BY d, i, bin UNION ALL SELECT d, i, bin, s, true FROM ov),
nodes1 AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY i, bin) - 1 AS x FROM nodes0),
nodes2 AS (SELECT d, x, 'text' AS type, text, NULL AS level, NULL::VARCHAR AS title_path, NULL::VARCHAR AS language, CASE WHEN big THEN 'n-' || min(x) OVER (PARTITION BY d, i) END AS g FROM nodes1),
{capped('out_', 'nodes2')}
{_rows('out_', 'doc_id')}"""


def markdown_sql(lined: str) -> str:
    """lined: a common table ``lined`` (doc_id, text, source, lang) of plain texts; each stands under two headings and before a table, an image and code."""
    return f"""WITH RECURSIVE {lined},
p0 AS (SELECT doc_id AS d, source || ' > ' || lang AS title_path, lang, unnest({_PARAGRAPHS.format('text')}) AS q, generate_subscripts({_PARAGRAPHS.format('text')}, 1) AS i FROM lined WHERE text IS NOT NULL),
p AS (SELECT d, i, {_strip('q')} AS p FROM p0 WHERE {_strip('q')} <> ''),
bigs AS (SELECT * FROM p WHERE length(p) > 250),
{oversize('ov', 'bigs')},
blocks AS (SELECT d, i, 0 AS bin, p AS text, false AS big, 'text' AS type, NULL::VARCHAR AS language FROM p WHERE length(p) <= 250 UNION ALL SELECT d, i, bin, s, true, 'text', NULL FROM ov
  UNION ALL SELECT doc_id, 1000000000 + t, 0, b, false, k, l FROM lined, (VALUES (1, '<table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>', 'table', NULL), (2, 'p.png', 'image', NULL), (3, 'x = 1', 'code', 'py')) v(t, b, k, l) WHERE text IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY i, bin) AS x FROM blocks),
nodes2 AS (SELECT n.d, x, type, text, NULL::INT AS level, title_path, language, CASE WHEN big THEN 'b-' || (min(x) OVER (PARTITION BY n.d, i) - 1) END AS g FROM numbered n JOIN (SELECT DISTINCT d, title_path FROM p0) USING (d)
  UNION ALL SELECT DISTINCT d, 0, 'heading', lang, 2, title_path, NULL, NULL FROM p0),
{capped('out_', 'nodes2')}
{_rows('out_', 'doc_id')}"""


#: Pages of one nav, an advert, an article under one heading and a footer: each is a text, and no title outlives its scope.
HTML_SQL = rf"""WITH RECURSIVE b AS (SELECT page_id AS d, regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<!--.*?-->', '', 'g') AS body FROM pages WHERE html IS NOT NULL),
s AS (SELECT d, unnest(regexp_split_to_array(body, '</?(?:nav|article|footer)[^>]*>')) AS s, generate_subscripts(regexp_split_to_array(body, '</?(?:nav|article|footer)[^>]*>'), 1) AS i FROM b),
h AS (SELECT d, i, regexp_extract(s, '(?s)<h1>(.*?)</h1>', 1) AS h, regexp_replace(s, '(?s)<h1>.*?</h1>', chr(1)) AS s FROM s),
t AS (SELECT d, i, regexp_replace(s, '<[^>]+>', '', 'g') AS s, regexp_replace(regexp_replace(regexp_replace(h, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') || ' ' AS h FROM h),
u AS (SELECT d, i, replace(replace(replace(replace(replace(replace(replace(replace(s, chr(1), h), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS s FROM t),
nodes2 AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY i) - 1 AS x, 'text' AS type, {_strip('s')} AS text, NULL AS level, NULL::VARCHAR AS title_path, NULL::VARCHAR AS language, NULL::VARCHAR AS g FROM u WHERE {_strip('s')} <> ''),
{capped('out_', 'nodes2')}
{_rows('out_', 'page_id')}"""


def chunked(nodes: str) -> str:
    """Chunks, as a common table ``made``, of a common table ``r`` of nodes (doc_id, pos, text, title_path, group_id)."""
    return f"""{nodes},
m AS (SELECT *, floor(length(text) * 1.5)::INT AS size, row_number() OVER o AS i, CASE WHEN row_number() OVER o > 1 AND lag(group_id) OVER o IS NOT DISTINCT FROM group_id THEN 0 ELSE 1 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
b AS (SELECT doc_id, i, 0 AS bin, size AS used FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN n.fresh = 1 THEN 0 WHEN b.used + n.size + 2 > 450 THEN b.bin + 1 ELSE b.bin END, CASE WHEN n.fresh = 1 OR b.used + n.size + 2 > 450 THEN n.size ELSE b.used + n.size + 2 END FROM b JOIN n ON n.doc_id = b.doc_id AND n.i = b.i + 1),
p AS (SELECT doc_id, run, group_id, bin + 1 AS rank, 2 AS chunk_level, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, count(*)::INT AS nodes, arg_min(title_path, pos) AS first FROM n JOIN b USING (doc_id, i) GROUP BY ALL
  UNION ALL SELECT doc_id, run, group_id, 0, 1, string_agg(text, chr(10) || chr(10) ORDER BY pos), count(*)::INT, arg_min(title_path, pos) FROM n WHERE group_id IS NOT NULL GROUP BY ALL),
s AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY run, rank) - 1)::INT AS sort_order, CASE WHEN group_id IS NULL THEN first ELSE first_value(first) OVER (PARTITION BY doc_id, run ORDER BY rank) END AS title_path FROM p),
made AS (SELECT *, CASE WHEN group_id IS NOT NULL AND chunk_level = 2 THEN min(sort_order) OVER (PARTITION BY doc_id, run) END AS parent_order FROM s)"""


#: Chunks of ``made`` with their context: a child's is its parent's text, a parent's its children's.
CONTEXT = """context AS (SELECT c.doc_id, c.sort_order, CASE WHEN c.parent_order IS NOT NULL THEN any_value(p.text) ELSE string_agg(k.text, chr(10) || chr(10) ORDER BY k.sort_order) END AS context FROM made c LEFT JOIN made p ON p.doc_id = c.doc_id AND p.sort_order = c.parent_order
  LEFT JOIN made k ON k.doc_id = c.doc_id AND k.parent_order = c.sort_order GROUP BY c.doc_id, c.sort_order, c.parent_order)"""
