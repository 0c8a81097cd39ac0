"""DuckDB SQL for the queries of the training-data operators that SQL can express.

Not here: learned scores (3, 7), the language model's score (8), surrogates (2) and the mix (5, its shuffle is a hash
that SQL lacks); tests hold those against brute force or held-out labels.
"""

from __future__ import annotations

from isochron.llm import jaccard, licenses, merkle, neighbours, urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_templates = ", ".join(f"({t}, '{label}', {str(base).lower()}, {words}, {grams}, {whole}, '{gram}', {pos}, {marks})" for t, label, base, words, grams, whole, gram, pos, marks in licenses.template_grams(licenses.BASE, licenses.NOTICES))

LICENSES = f"""WITH t(template, label, is_base, t_words, t_grams, t_marks, gram, t_at, marks) AS (VALUES {_templates}),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d),
g AS (SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {licenses.SHORT}], ' ') AS gram FROM p WHERE pos + {licenses.SHORT} <= len(w)
 UNION ALL SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {licenses.MID}], ' ') FROM p WHERE pos + {licenses.MID} <= len(w)
 UNION ALL SELECT doc_id, pos, array_to_string(w[pos + 1 : pos + {licenses.LONG}], ' ') FROM p WHERE pos + {licenses.LONG} <= len(w)),
v AS (SELECT DISTINCT doc_id, template, label, is_base, t_grams, t_marks, t_at, marks, pos - t_at AS diagonal FROM g JOIN t USING (gram)),
x AS (SELECT doc_id, template, label, is_base, t_grams, t_marks, diagonal FROM v GROUP BY ALL),
y AS (SELECT *, CASE WHEN is_base OR diagonal - lag(diagonal) OVER o > {licenses.SHIFT} OR lag(diagonal) OVER o IS NULL THEN 1 ELSE 0 END AS apart FROM x WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
z AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM y),
s AS (SELECT z.doc_id, z.template, z.label, z.is_base, z.span, z.t_marks, bit_or(v.marks) AS marks, min(z.diagonal) AS start, count(DISTINCT v.t_at) / max(z.t_grams) AS covered
 FROM z JOIN v ON z.doc_id = v.doc_id AND z.template = v.template AND z.diagonal = v.diagonal GROUP BY ALL),
k AS (SELECT *, covered >= CASE WHEN is_base THEN 1.0 ELSE {licenses.COVERAGE} END AND marks = t_marks AS kept FROM s)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (kept AND is_base) AS n_base,
 CAST(min(start) FILTER (kept AND is_base) AS BIGINT) AS first_word, CAST(max(start) FILTER (kept AND is_base) AS BIGINT) AS last_word,
 coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (kept AND is_base)), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (kept)), ','), '') AS labels, coalesce(max(covered), 0.0) AS score, count(*) FILTER (kept) AS n_spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""

NEIGHBOURS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, embedding, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {neighbours.THRESHOLD}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY 1), c AS (SELECT a, count(*) AS n FROM l GROUP BY 1), k AS (SELECT embedding, min(vec_id) AS class_id FROM v GROUP BY 1)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id, v.vec_id <= coalesce(m.m, v.vec_id) AS kept, k.class_id
FROM v JOIN k ON v.embedding = k.embedding LEFT JOIN c ON v.vec_id = c.a LEFT JOIN m ON v.vec_id = m.a"""

SUFFIXES = """WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS s FROM h WHERE len(h) >= 200)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
i AS (SELECT *, CASE WHEN s > lag(s) OVER o + 100 OR lag(s) OVER o IS NULL THEN 1 ELSE 0 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
j AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM i),
k AS (SELECT doc_id, run, min(s) AS low, max(s) + 100 AS high FROM j GROUP BY 1, 2),
e AS (SELECT k.doc_id, low, high, substr(h, 2 * coalesce(lag(high) OVER o, 0) + 1, 2 * (low - coalesce(lag(high) OVER o, 0))) AS piece, lead(low) OVER o IS NULL AS ends, h FROM k JOIN h USING (doc_id) WINDOW o AS (PARTITION BY k.doc_id ORDER BY low)),
f AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(piece || CASE WHEN ends THEN substr(h, 2 * high + 1) ELSE '' END, '' ORDER BY low) AS kept FROM e GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN f USING (doc_id)"""

DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[pos + 1 : pos + least(10, len(w))], ' ') AS g FROM (SELECT item, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS pos FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
m AS (SELECT doc_id, pos, p.k, item FROM (SELECT doc_id, pos, k, array_to_string(w[pos + 1 : pos + k], ' ') AS g FROM p) p JOIN i ON p.g = i.g AND p.k = i.k),
c AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS word FROM m) GROUP BY 1),
x AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos + 1 : pos + {jaccard.N}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - least({jaccard.N}, len(w)) + 1)) AS pos FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, shared = x.n AND shared = y.n AS same FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE shared / (x.n + y.n - shared) >= {jaccard.THRESHOLD}),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY 1), c AS (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS copies, min(b) FILTER (same) AS first FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.first, d.doc_id)) AS class_id, coalesce(c.copies, 0) + 1 AS n_copies, coalesce(c.n_links, 0) AS n_links,
 least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.m, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a LEFT JOIN m ON d.doc_id = m.a"""

#: CTEs: t.c is the table of CRC-32 by byte; the checksum of a text is CRC(text) in a statement that reads t.
CRC_TABLE = """t AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)))"""


def crc(text: str, table: str = "t.c") -> str:
    """DuckDB SQL of the unsigned CRC-32 of an ASCII text."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1])), 4294967295)"


_lead = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_leaf = "sha256(concat({}))"
_values = [_lead.format(c) for c in merkle.FIELDS]

MERKLE = f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, coalesce('v' || lang, 'n') AS key, {_leaf.format(", ".join(_values))} AS leaf,
 {_leaf.format(", ".join(_lead.format("changed") if c == "n_chars" else v for c, v in zip(merkle.FIELDS, _values, strict=True)))} AS start
 FROM (SELECT *, CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed FROM documents, t)),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n AS (SELECT key, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY key) AS n FROM p
 UNION ALL SELECT key, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM n WHERE n > 1 GROUP BY key, level, pos // 2),
s AS (SELECT key, node AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos FROM n WHERE n = 1),
m AS (SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM s
 UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM m WHERE n > 1 GROUP BY level, pos // 2),
a AS (SELECT key, CAST(NULL AS BIGINT) AS own, level, pos, node, n FROM n WHERE n > 1 UNION ALL SELECT s.key, s.pos, 1000 + level, m.pos, node, m.n FROM s, m WHERE m.n > 1),
x AS (SELECT p.key, p.doc_id, p.leaf, p.start, p.pos, a.level, coalesce(a.own, p.pos) AS place FROM p LEFT JOIN (SELECT DISTINCT key, own, level FROM a) a USING (key)),
y AS (SELECT x.*, x.place // CAST(pow(2, x.level % 1000) AS BIGINT) % 2 AS side, coalesce(a.node, '') AS beside FROM x LEFT JOIN a ON a.key = x.key AND a.level = x.level AND a.pos = xor(x.place // CAST(pow(2, x.level % 1000) AS BIGINT), 1)),
f AS (SELECT key, pos, doc_id, any_value(leaf) AS leaf, any_value(start) AS start, list(CASE WHEN side = 1 THEN {{'l': beside, 'r': ''}} ELSE {{'l': '', 'r': beside}} END ORDER BY level) FILTER (level IS NOT NULL) AS path FROM y GROUP BY key, pos, doc_id),
g AS (SELECT f.*, s.subroot, (SELECT node FROM m WHERE n = 1) AS root FROM f JOIN s USING (key)),
z AS (SELECT *, list_reduce(list_concat([{{'l': start, 'r': ''}}], coalesce(path, [])), lambda v, w: {{'l': sha256(w.l || v.l || w.r), 'r': ''}}).l AS folded_root FROM g)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda w: w.l || w.r), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z"""

#: Label strings by the grammar state before (row) and after (column); a state's weight is its cost, twelve digits, then its labels.
_space = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _weigh(weight: str, cost: str, labels: str) -> str:
    return f"lpad(CAST(CAST(left({weight}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({weight}, 13) || {labels}"


def _least(*found: str) -> str:
    return f"least({', '.join(found)})"


def _inserted(v: str) -> list[str]:
    """Weights of the grammar states 0, s, u, a after up to two inserts."""
    o, s, u, a = (f"{v}.{k}" for k in "osua")
    one, two = (lambda w: _weigh(w, "5", "'I'")), (lambda w: _weigh(w, "10", "'II'"))
    return [o, s, _least(u, one(o), one(s), one(a)), _least(a, one(u), two(o), two(s))]


def _read(v: str, r: str) -> str:
    """The states' weights after row r: its initial i, whether it must go (f), what it adds when kept (m)."""
    o, s, u, a = (f"{v}.{k}" for k in "osua")
    more, may = f"{r}.m", lambda test, w: f"CASE WHEN {test} AND NOT {r}.f THEN {w} END"
    to = lambda w, x: _least(may(f"{r}.i = '{x}'", _weigh(w, more, "'K'")), may("true", _weigh(w, f"1 + {more}", "'R'")))
    gone = lambda w: _weigh(w, "2", "'D'")
    keep_system = may(f"{r}.i = 's'", _weigh(o, more, "'K'"))
    parts = {"o": gone(o), "s": _least(gone(s), keep_system), "u": _least(gone(u), to(o, "u"), to(s, "u"), to(a, "u")), "a": _least(gone(a), to(u, "a"))}
    return "{" + ", ".join(f"'{k}': {w}" for k, w in parts.items()) + "}"


def _struct(values: list[str]) -> str:
    return "{" + ", ".join(f"'{k}': {w}" for k, w in zip("osua", values, strict=True)) + "}"


CONVERSATIONS = rf"""WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code FROM conversations, t),
e AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nr, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, {_space}) AS bare FROM e),
g AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nr) AS before FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, list({{'i': i, 'f': fault IN (1, 2), 'm': CASE WHEN fault = 3 THEN 5 ELSE 0 END}} ORDER BY nr) AS rows, list(role ORDER BY nr) AS roles, list(text ORDER BY nr) AS texts, count(*) AS n FROM g GROUP BY 1),
w AS (SELECT conv_id, 0 AS nr, rows, n, {{'o': '000000000000', 's': CAST(NULL AS VARCHAR), 'u': CAST(NULL AS VARCHAR), 'a': CAST(NULL AS VARCHAR)}} AS v FROM s
 UNION ALL SELECT conv_id, nr, rows, n, {_read("q.x", "q.r")} FROM (SELECT conv_id, nr + 1 AS nr, rows, n, rows[nr + 1] AS r, {_struct(_inserted("w.v"))} AS x FROM w WHERE nr < n) q),
l AS (SELECT conv_id, {_least("x.o", "x.a")} AS best FROM (SELECT conv_id, {_struct(_inserted("w.v"))} AS x FROM w WHERE nr = n)),
b AS (SELECT conv_id, CAST(left(best, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM l),
p AS (SELECT conv_id, audit, k, substr(audit, k, 1) AS edit, k - length(replace(left(audit, k), 'I', '')) AS inserted, len(replace(left(audit, k), 'D', '')) AS out FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM b)),
h AS (SELECT p.conv_id, p.k, p.edit, p.out, s.roles[p.k - p.inserted] AS role, CASE WHEN edit = 'I' THEN '' ELSE s.texts[p.k - p.inserted] END AS text, bool_or(p.out = 1 AND p.edit = 'K' AND left(s.roles[p.k - p.inserted], 1) = 's') OVER (PARTITION BY p.conv_id) AS led FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id WHERE edit <> 'D'),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (out % 2 = 1) <> led THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS repaired FROM h GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id"""


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"


_rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
_place = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_bare = f"regexp_replace(regexp_replace({_host('url')}, '^.*@', ''), '(:(80|443))?$', '')"
_name = rf"regexp_replace(regexp_replace({_bare}, '\.$', ''), '^www\.', '')"
_kept = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{urls.TRACKING}'))), '&')"

URLS = f"""WITH rules(h, p, v) AS (VALUES {_rules}),
u AS (SELECT page_id, url, {_host("url")} AS host, {_place} AS path, CASE WHEN contains(url, '://') THEN {_name} || CASE WHEN regexp_replace({_place}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_place}, '/+$', '') END || CASE WHEN {_kept} = '' THEN '' ELSE '?' || {_kept} END END AS whole FROM pages),
l AS (SELECT DISTINCT whole FROM u WHERE regexp_matches(host, '{urls.LISTED_WORDS}')),
r AS (SELECT DISTINCT url, first_value(h || p) OVER w AS rule, first_value(v) OVER w AS verdict FROM (SELECT DISTINCT url, host, path FROM u WHERE contains(url, '://')), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) WINDOW w AS (PARTITION BY url ORDER BY length(h || p) DESC, length(h) DESC))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN l.whole IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.whole IS NOT NULL AS listed
FROM u LEFT JOIN r USING (url) LEFT JOIN l ON u.whole = l.whole"""

ORACLES: dict[str, str] = {
    "op1_licenses": LICENSES,
    "op4_nn_descent": NEIGHBOURS,
    "op6_suffix_dedup": SUFFIXES,
    "op9_decontamination": DECONTAMINATION,
    "op10_jaccard_join": JACCARD,
    "op11_merkle": MERKLE,
    "op12_conversations": CONVERSATIONS,
    "op13_urls": URLS,
}
