"""DuckDB twins of the corpus queries that SQL can express."""

from .filter_audit import ORDERS
from .url_filter import SUFFIXES

OP1 = """WITH RECURSIVE poly AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
rows AS (SELECT doc_id, source, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS s FROM documents),
crc0 AS (SELECT doc_id, source, size, s, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM (SELECT *, hex(encode(text)) AS x FROM rows), poly),
crc AS (SELECT *, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32) AS h FROM crc0),
spread AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, size, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS f FROM crc),
placed AS (SELECT *, row_number() OVER (ORDER BY f, s, h, size, text_crc32) - 1 AS g, count(*) OVER () AS n FROM spread),
cut AS (SELECT *, g * 8 // n AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (g - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM cut"""

OP2 = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""

OP10 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id"""

OP3 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT r, x, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
dup AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
gaps AS (SELECT r, i, i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 AS joined FROM dup),
runs AS (SELECT r, i, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM gaps),
spans AS (SELECT r, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY ALL),
cut AS (SELECT s.r, a, b, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY s.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.r ORDER BY a), 0))) AS piece FROM spans s JOIN d USING (r)),
kept AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS front, max(b) AS tail FROM cut GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s]')"
OP6 = rf"""WITH rows AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT / 4294967296 AS draw FROM documents),
tok0 AS (SELECT r, good, draw, unnest(list_concat([chr(1), chr(1)], {_TOKENS}, [chr(2)])) AS z, generate_subscripts(list_concat([chr(1), chr(1)], {_TOKENS}, [chr(2)]), 1) AS i FROM rows WHERE text IS NOT NULL),
rate AS (SELECT coalesce(count(*) FILTER (good) / nullif(count(*) FILTER (NOT good), 0), 0) AS b_rate, coalesce(count(*) FILTER (NOT good) / nullif(count(*) FILTER (good), 0), 0) AS t_rate FROM tok0 WHERE i > 2),
tok AS (SELECT r, i, z, CASE WHEN good AND draw < t_rate THEN 't' WHEN NOT good AND draw < b_rate THEN 'b' ELSE '' END AS role FROM tok0, rate),
g AS (SELECT r, role, i, z, lag(z) OVER w AS y, lag(z, 2) OVER w AS x FROM tok WINDOW w AS (PARTITION BY r ORDER BY i)),
c0 AS (SELECT count(*) AS a, count(*) FILTER (role = 't') AS t, count(*) FILTER (role = 'b') AS b FROM g WHERE i > 2),
c1 AS (SELECT z, count(*) AS a, count(*) FILTER (role = 't') AS t, count(*) FILTER (role = 'b') AS b FROM g WHERE i > 1 GROUP BY z),
c2 AS (SELECT y, z, count(*) FILTER (role = 't') AS t, count(*) FILTER (role = 'b') AS b FROM g WHERE i > 1 GROUP BY ALL),
c3 AS (SELECT x, y, z, count(*) FILTER (role = 't') AS t, count(*) FILTER (role = 'b') AS b FROM g WHERE i > 2 GROUP BY ALL),
o0 AS (SELECT r, count(*) AS o FROM g WHERE i > 2 GROUP BY r), o1 AS (SELECT r, z, count(*) AS o FROM g WHERE i > 1 GROUP BY ALL), o2 AS (SELECT r, y, z, count(*) AS o FROM g WHERE i > 1 GROUP BY ALL), o3 AS (SELECT r, x, y, z, count(*) AS o FROM g WHERE i > 2 GROUP BY ALL),
q AS (SELECT g.r, c1.a / c0.a AS base, n0, n1, n2, n3, m1, m2, {', '.join(f"c0.{m} AS {m}0, c1.{m} AS {m}1, c2.{m} AS {m}2, c3.{m} AS {m}3, cy.{m} AS {m}4, cx.{m} AS {m}5, (g.role = '{m}')::INT AS {m}m" for m in 'tb')} FROM (SELECT g.*, o0.o AS n0, o1.o AS n1, o2.o AS n2, o3.o AS n3, p1.o AS m1, p2.o AS m2 FROM g JOIN o0 USING (r) JOIN o1 USING (r, z) JOIN o2 USING (r, y, z) JOIN o3 USING (r, x, y, z) JOIN o1 p1 ON p1.r = g.r AND p1.z = g.y JOIN o2 p2 ON p2.r = g.r AND p2.y = g.x AND p2.z = g.y WHERE i > 2) g
  JOIN c1 USING (z) JOIN c2 USING (y, z) JOIN c3 USING (x, y, z) JOIN c1 cy ON cy.z = g.y JOIN c2 cx ON cx.y = g.x AND cx.z = g.y, c0),
l AS (SELECT r, {', '.join(f"-ln(({m}3 - {m}m * n3 + 4 * (({m}2 - {m}m * n2 + 4 * (({m}1 - {m}m * n1 + 4 * base) / ({m}0 - {m}m * n0 + 4))) / ({m}4 - {m}m * m1 + 4))) / ({m}5 - {m}m * m2 + 4)) AS {m}" for m in 'tb')} FROM q),
s AS (SELECT r, count(*) AS n, avg(t) AS t, avg(b) AS b FROM l GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_tokens, round(t, 9) AS loss_target, round(b, 9) AS loss_background, round(t - b, 9) AS score FROM rows LEFT JOIN s USING (r)"""


def _xxh64(hex_of: str, seed: int) -> dict[str, str]:
    """SQL of XXH64 over a column of hexadecimal bytes, as named steps that build on one another: the last is ``h``."""
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261  # fixed values of the public hash
    mod = "18446744073709551616::UHUGEINT"
    wide = lambda x: f"({x})::UHUGEINT"
    mul = lambda x, y: f"({wide(x)} * {y}::UHUGEINT % {mod})::UBIGINT"
    add = lambda x, y: f"(({wide(x)} + {wide(y)}) % {mod})::UBIGINT"
    rotl = lambda x, r: f"({wide(x)} * {1 << r}::UHUGEINT % {mod} + {wide(x)} // {1 << (64 - r)}::UHUGEINT)::UBIGINT"
    little = lambda at, n: "('0x' || " + " || ".join(f"substr({hex_of}, {at} + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT"
    u = lambda v: f"{v % (1 << 64)}::UBIGINT"
    round_ = lambda v, lane: mul(rotl(add(v, mul(lane, p2)), 31), p1)
    out = {"n": f"strlen({hex_of}) // 2"}
    out["lanes"] = f"list_transform(range(0, n // 8), lambda j: {little('16 * j', 8)})"
    for i, start in enumerate((seed + p1 + p2, seed + p2, seed, seed - p1)):
        out[f"v{i}"] = f"list_reduce(list_prepend({u(start)}, list_transform(range(0, n // 32), lambda j: lanes[4 * j + {i + 1}])), lambda v, lane: {round_('v', 'lane')})"
    out["m"] = add(add(rotl("v0", 1), rotl("v1", 7)), add(rotl("v2", 12), rotl("v3", 18)))
    for i in range(4):
        out[f"m{i}"] = add(mul(f"xor({'m' if i == 0 else f'm{i - 1}'}, {round_(u(0), f'v{i}')})", p1), u(p4))
    out["h0"] = f"CASE WHEN n >= 32 THEN {add('m3', 'n')} ELSE {add(u(seed + p5), 'n')} END"
    out["rest"] = f"list_transform(lanes[4 * (n // 32) + 1:], lambda lane: {round_(u(0), 'lane')})"
    out["h1"] = f"list_reduce(list_prepend(h0, rest), lambda h, k: {add(mul(rotl('xor(h, k)', 27), p1), u(p4))})"
    out["h2"] = f"CASE WHEN n % 8 >= 4 THEN {add(mul(rotl('xor(h1, ' + mul(little('16 * (n // 8)', 4), p1) + ')', 23), p2), u(p3))} ELSE h1 END"
    out["tail"] = f"list_transform(range(n - n % 4, n), lambda j: {mul(little('2 * j', 1), p5)})"
    out["h3"] = f"list_reduce(list_prepend(h2, tail), lambda h, k: {mul(rotl('xor(h, k)', 11), p1)})"
    out["h4"] = mul("xor(h3, h3 >> 33)", p2)
    out["h5"] = mul("xor(h4, h4 >> 29)", p3)
    out["h"] = "xor(h5, h5 >> 32)"
    return out


def _steps(source: str, steps: dict[str, str], prefix: str) -> str:
    """Common table expressions that add one step after the other to a table; the last is named prefix."""
    parts, last = [], source
    for i, (name, sql) in enumerate(steps.items()):
        here = prefix if i == len(steps) - 1 else f"{prefix}_{i}"
        parts.append(f"{here} AS MATERIALIZED (SELECT *, {sql} AS {name} FROM {last})")
        last = here
    return ",\n".join(parts)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BITS = " + ".join(f"(CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END)" for b in range(64))
OP7 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) > 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] ELSE [array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
x AS (SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM s)),
{_steps('x', _xxh64('x', 42), 'hashed')},
f AS (SELECT r, ({_BITS})::UBIGINT AS fp FROM s JOIN hashed USING (s) GROUP BY r),
p AS (SELECT d.r, doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM d LEFT JOIN f USING (r)),
k AS (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM k a, k b WHERE bit_count(xor(a.fp, b.fp)::BIT) <= 3),
reach AS (SELECT fp AS a, fp AS b FROM k UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT reach.a AS fp, min(least) AS component_id FROM reach JOIN k ON k.fp = reach.b GROUP BY 1)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM p JOIN c USING (fp)"""


def _level(name: str, above: str, of: str, rows: str) -> str:
    """One level of the reputation: the strength of its prior from the spread of its shares, and its means."""
    return f"""{name}_in AS (SELECT l.*, {above} AS prior FROM {rows}),
{name}_fit AS (SELECT coalesce(sum(round(n * (bad / n - prior) ** 2, 9)::DECIMAL(38, 9)), 0)::DOUBLE AS seen, coalesce(sum(round(prior * (1 - prior), 9)::DECIMAL(38, 9)), 0)::DOUBLE AS sampling, coalesce(sum(round(n * prior * (1 - prior), 9)::DECIMAL(38, 9)), 0)::DOUBLE AS whole FROM {name}_in WHERE n > 0),
{name}_k AS (SELECT CASE WHEN rho <= 0 THEN 1000.0 ELSE least(greatest(1 / rho - 1, 1.0), 1000.0) END::DOUBLE AS k FROM (SELECT CASE WHEN whole > sampling THEN (seen - sampling) / (whole - sampling) ELSE 0 END AS rho FROM {name}_fit)),
{name}_mean AS (SELECT {of}, n, k, (bad + k * prior) / (n + k) AS mean FROM {name}_in, {name}_k)"""


def op8(suffixes) -> str:
    listed = ", ".join(f"'{x}'" for x in suffixes)
    fits = lambda at, slash: f"(host = '{at}' OR suffix(host, '.{at}')) AND prefix(path, '{slash}')"
    rules = sorted((("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")), key=lambda r: -len(r[1]))
    cases = [(fits(t[: t.index("/")], t[t.index("/") :]), what, t) for what, t in rules]
    return rf"""WITH m AS (SELECT doc_id AS page_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, toxic FROM pages LEFT JOIN m USING (page_id)),
hosts0 AS (SELECT host, count(toxic) AS n, count(*) FILTER (toxic > 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u GROUP BY host),
hosts1 AS (SELECT *, string_split(name, '.') AS p, regexp_matches(name, '^[0-9]+(\.[0-9]+){{3}}$') OR prefix(name, '[') AS ip FROM hosts0),
hosts2 AS (SELECT *, CASE WHEN array_to_string(p[greatest(len(p) - 1, 1):], '.') IN ({listed}) THEN 3 ELSE 2 END AS k FROM hosts1),
h AS (SELECT host, n, bad, CASE WHEN ip THEN name ELSE array_to_string(p[greatest(len(p) - k + 1, 1):], '.') END AS domain, CASE WHEN ip THEN '' ELSE array_to_string(p[greatest(len(p) - k + 2, 1):], '.') END AS suffix FROM hosts2),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
{_level('s', '(SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END FROM s)', 'suffix', 's l')},
{_level('d', 'a.mean', 'domain', 'd l JOIN s_mean a USING (suffix)')},
{_level('h', 'a.mean', 'host', 'h l JOIN d_mean a USING (domain)')},
base AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS base FROM s),
b AS (SELECT host, mean - sqrt(mean * (1 - mean) / (n + k + 1)) AS bound FROM h_mean)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {f} THEN '{t}'" for f, _, t in cases)} END AS rule, CASE {' '.join(f"WHEN {f} THEN '{w}'" for f, w, _ in cases)} WHEN bound > 2 * base / (1 - base + 2 * base) THEN 'block' ELSE 'allow' END AS verdict FROM u JOIN b USING (host), base"""


_SHINGLED = r"CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
_SPLIT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
OP9 = rf"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
ds AS (SELECT r, doc_id, {_SHINGLED} AS s FROM (SELECT r, doc_id, {_SPLIT} AS w FROM docs)), its AS (SELECT item_id, {_SHINGLED} AS s FROM (SELECT item_id, {_SPLIT} AS w FROM benchmark WHERE text IS NOT NULL)),
items AS (SELECT item_id, len(s) AS m, unnest(s) AS h FROM its), weights AS (SELECT item_id, m, h, count(*) AS weight FROM items GROUP BY ALL),
places AS (SELECT r, len(s) AS size, unnest(s) AS h, generate_subscripts(s, 1) - 1 AS at_ FROM ds),
hits AS MATERIALIZED (SELECT r, item_id, m, size, h, at_, weight, greatest(size - m, 0) AS final FROM places JOIN weights USING (h)),
starts AS (SELECT DISTINCT r, item_id, at_ AS start FROM hits WHERE at_ <= final UNION SELECT DISTINCT r, item_id, final FROM hits),
shared AS (SELECT r, item_id, start, m, least(m, size) AS n, h, least(count(*), weight) AS c FROM starts JOIN hits USING (r, item_id) WHERE at_ >= start AND at_ < start + m GROUP BY r, item_id, start, m, size, h, weight),
likeness AS (SELECT r, item_id, start, sum(c)::DOUBLE / (m + n - sum(c)) AS similarity FROM shared GROUP BY r, item_id, start, m, n)
SELECT doc_id, item_id, max(similarity) AS similarity, min(start) FILTER (similarity = best)::INT AS start, count(*) AS windows FROM (SELECT *, max(similarity) OVER (PARTITION BY r, item_id) AS best FROM likeness WHERE similarity >= 0.8) JOIN docs USING (r) GROUP BY r, doc_id, item_id"""



def _lloyd(rounds: int = 4) -> str:
    """Rounds of assigning and averaging, one common table expression each: a{i} the assignment by codebook c{i}."""
    nearest = "SELECT r, k, any_value(x) AS x, min(list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)) AS d, min((list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)) * 256 + e)::HUGEINT % 256 AS e FROM p JOIN c{i} USING (k) GROUP BY r, k"
    steps = ["c0 AS (SELECT k, rank AS e, x AS c FROM p WHERE rank < 256)"]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i=i)})")
        steps.append(f"s{i} AS (SELECT k, e, j, floor(sum(x[j]) / count(*)) AS m FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS j) GROUP BY k, e, j)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, e, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT k, e, list(m ORDER BY j) AS c FROM s{i} GROUP BY k, e) n USING (k, e))")
    return ", ".join([*steps, f"last AS MATERIALIZED ({nearest.format(i=rounds)})"])


OP11 = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS x, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, rank, x[k * (len(x) // 4) + 1:(k + 1) * (len(x) // 4)] AS x FROM v, (SELECT unnest(range(4)) AS k)), {_lloyd()},
done AS (SELECT r, string_agg(lpad(lower(to_hex(e::UBIGINT)), 2, '0'), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM last GROUP BY r),
books AS (SELECT sha256(string_agg(u::BIGINT::VARCHAR, ',' ORDER BY k, e, j)) AS h FROM (SELECT k, e, unnest(c) AS u, generate_subscripts(c, 1) AS j FROM c4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM done JOIN v USING (r), books"""

_STEPS = ", ".join(f"('{o}', {k + 1}, {sum(1 << ord(f) - 65 for f in o[:k])}, {1 << ord(o[k]) - 65})" for o in ORDERS for k in range(5))
OP13 = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT part, good, toxic, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS m FROM w),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
steps(filter_order, step, b, f) AS (VALUES {_STEPS})
SELECT part, filter_order, step, coalesce(sum(n) FILTER (m & (b | f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & f <> 0 AND m & b = 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (m & f <> 0 AND m & b <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (m = f), 0)::BIGINT AS unique_fails, coalesce(sum(g) FILTER (m & f <> 0 AND m & b = 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (m & f <> 0 AND m & b = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(CASE WHEN m & f <> 0 THEN n * (120 // greatest(bit_count(m), 1)) END), 0)::BIGINT AS shapley FROM c, steps GROUP BY ALL"""

SQL = {"op1_sharding": OP1, "op2_warc": OP2, "op3_suffix_dedup": OP3, "op6_lm_score": OP6, "op7_simhash": OP7, "op8_url_filter": op8(SUFFIXES), "op9_decontaminate": OP9, "op10_embed_dedup": OP10, "op11_vector_codes": OP11, "op13_filter_audit": OP13}
