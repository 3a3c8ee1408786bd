"""DuckDB SQL for the queries of this subpackage that SQL can express.

Each text states the contract by itself: links by counting common shingles of
all pairs, overlaps by comparing words along every alignment, measures word by
word, Markov models by joins of n-gram counts. The other queries hold library
tokenizers, learned weights, DOM trees or hashes DuckDB does not have.
"""

from __future__ import annotations

from shotgrid.llm import decontaminate as D
from shotgrid.llm import host_rules as H
from shotgrid.llm import merkle as M
from shotgrid.llm import topk_search as K
from shotgrid.llm import url_filter as U

UPPER, LOWER = U.UPPER, U.LOWER
# words [^\x20\x09-\x0D]+ of a text
WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SQL: dict[str, str] = {}

SQL["op3_minhash_dedup"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
           THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT d.doc_id, count(sh.s) AS n FROM d LEFT JOIN sh ON sh.doc_id = d.doc_id GROUP BY d.doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM n
  UNION
  SELECT reach.id, sym.y FROM reach JOIN sym ON sym.x = reach.r)
SELECT n.doc_id, n.n AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept
FROM n JOIN reach ON reach.id = n.doc_id GROUP BY n.doc_id, n.n"""

_WORD = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
SQL["op4_decontamination"] = f"""
WITH dw AS (SELECT doc_id, {_WORD} AS w FROM documents),
iw AS (SELECT item_id, {_WORD} AS w FROM benchmark),
dp AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
ip AS (SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM iw WHERE len(w) >= {D.MIN_ITEM}),
eq AS (
  SELECT doc_id, item_id, p - q AS shift, q, n, m, least(m, {D.MIN_OVERLAP}) AS need
  FROM dp JOIN ip ON dp.word = ip.word),
enough AS (
  SELECT doc_id, item_id, shift, any_value(n) AS n, any_value(m) AS m, any_value(need) AS need,
         -CAST(floor(-{D.MIN_EQUAL} * any_value(need)) AS BIGINT) AS wanted
  FROM eq GROUP BY doc_id, item_id, shift HAVING count(*) >= wanted),
-- a window that holds the most equal words starts at one of them, or ends where item or document does
win AS (
  SELECT a.doc_id, a.item_id, a.shift, b.need, b.wanted, a.q,
         least(a.q, least(b.m, b.n - a.shift) - b.need + 1) AS s, greatest(1, 1 - a.shift) AS lo
  FROM eq a JOIN enough b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.shift = b.shift),
counted AS (
  SELECT w.doc_id, w.item_id, w.shift, w.q, any_value(w.wanted) AS wanted, count(*) AS c
  FROM win w JOIN eq e ON e.doc_id = w.doc_id AND e.item_id = w.item_id AND e.shift = w.shift
       AND e.q BETWEEN w.s AND w.s + w.need - 1
  WHERE w.s >= w.lo GROUP BY w.doc_id, w.item_id, w.shift, w.q),
hits AS (
  SELECT doc_id, item_id, max(c) AS c FROM counted WHERE c >= wanted GROUP BY doc_id, item_id),
found AS (SELECT doc_id, list(item_id ORDER BY item_id) AS items, max(c) AS n_equal FROM hits GROUP BY doc_id)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, f.doc_id IS NULL AS kept,
       coalesce(f.items, CAST([] AS BIGINT[])) AS items, coalesce(f.n_equal, 0) AS n_equal
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN found f ON f.doc_id = d.doc_id"""

_RULES = " OR ".join(f"({r})" for r in H.RULES.values())
SQL["op7_host_rules"] = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) q),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) q WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (
  SELECT *, n_words < {H.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_RULES} AS rule FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR rule) AS failures FROM f GROUP BY source),
p AS (
  SELECT least(greatest(avg(failures / n), 1e-3), 1 - 1e-3) AS mean, var_pop(failures / n) AS v, avg(1 / n) AS inv FROM h),
prior AS (
  SELECT mean, CASE WHEN v - mean * (1 - mean) * inv > 0
    THEN least(greatest(mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1, 1.0), {H.MAX_PRIOR}) ELSE {H.MAX_PRIOR} END AS weight
  FROM p)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       base_failed OR rule AS rules_failed,
       NOT base_failed AND (failures + mean * weight) / (n + weight)
         <= least(mean + {H.SPREADS} * sqrt(mean * (1 - mean) / (weight + 1)), {H.MAJORITY}) AS kept
FROM f JOIN h ON h.source IS NOT DISTINCT FROM f.source, prior"""


def _rules() -> str:
    """The longest fitting rule first."""
    out = "CASE"
    for verdict, h, p in sorted(U.RULES, key=lambda r: -len(r[1] + r[2])):
        out += f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        out += f" THEN {{'rule': '{h + p}', 'verdict': '{verdict}'}}"
    return out + " END"


_K = len(U.ALPHABET)
_STEP = 2 * U.REACH / U.BINS


def _model(label: str, name: str) -> str:
    """Interpolated trigram model of the urls with one verdict: lp of every gram that a url holds."""
    return f"""
{name}3 AS (SELECT g, count(*) AS n FROM grams WHERE verdict = '{label}' GROUP BY g),
{name}2 AS (SELECT substr(g, 2, 2) AS g, sum(n) AS n FROM {name}3 GROUP BY 1),
{name}1 AS (SELECT substr(g, 3, 1) AS g, sum(n) AS n FROM {name}3 GROUP BY 1),
{name}c AS (SELECT substr(g, 1, 2) AS c, sum(n) AS n, count(*) AS t FROM {name}3 GROUP BY 1),
{name}d AS (SELECT substr(g, 1, 1) AS c, sum(n) AS n, count(*) AS t FROM {name}2 GROUP BY 1),
{name}e AS (SELECT sum(n) AS n, count(*) AS t FROM {name}1),
{name}p AS (
  SELECT every.g, (coalesce({name}1.n, 0) + {name}e.t / {_K}) / ({name}e.n + {name}e.t) AS p0,
         (coalesce({name}2.n, 0) + coalesce({name}d.t, 1) * p0) / (coalesce({name}d.n, 0) + coalesce({name}d.t, 1)) AS p1,
         (coalesce({name}3.n, 0) + coalesce({name}c.t, 1) * p1) / (coalesce({name}c.n, 0) + coalesce({name}c.t, 1)) AS p2
  FROM (SELECT DISTINCT g FROM grams) every
  CROSS JOIN {name}e LEFT JOIN {name}3 ON {name}3.g = every.g LEFT JOIN {name}2 ON {name}2.g = substr(every.g, 2, 2)
  LEFT JOIN {name}1 ON {name}1.g = substr(every.g, 3, 1) LEFT JOIN {name}c ON {name}c.c = substr(every.g, 1, 2)
  LEFT JOIN {name}d ON {name}d.c = substr(every.g, 2, 1))"""


SQL["op10_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fit AS (SELECT *, {_rules()} AS fit FROM hosts),
urls AS (
  SELECT page_id, host, path, fit.rule AS rule, fit.verdict AS verdict,
         regexp_replace(translate(host || path, '{UPPER}123456789', '{LOWER}000000000'), '[^a-z0./_-]', '~', 'g') AS text
  FROM fit),
grams AS (
  SELECT page_id, verdict, substr('^^' || text || '^', unnest(range(1, length(text) + 2)), 3) AS g FROM urls),
{_model('allow', 'a')},
{_model('block', 'b')},
score AS (
  SELECT page_id, avg(ln(ap.p2) - ln(bp.p2)) AS s FROM grams JOIN ap ON ap.g = grams.g JOIN bp ON bp.g = grams.g GROUP BY page_id),
bins AS (
  SELECT floor((least(greatest(s, {-U.REACH}), {U.REACH}) + {U.REACH}) / {_STEP}) AS bin,
         count(*) FILTER (WHERE verdict = 'allow') AS good, count(*) FILTER (WHERE verdict = 'block') AS bad
  FROM urls JOIN score USING (page_id) WHERE rule IS NOT NULL GROUP BY 1),
run AS (
  SELECT bin, (sum(good) OVER () - coalesce(sum(good) OVER before, 0)) / sum(good) OVER ()
              + coalesce(sum(bad) OVER before, 0) / sum(bad) OVER () AS value
  FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT bin * {_STEP} - {U.REACH} AS lim FROM run ORDER BY value DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN s >= lim THEN 'allow' ELSE 'block' END) AS verdict
FROM urls JOIN score USING (page_id), cut"""


SQL["op11_topk_search"] = f"""
WITH whole AS (
  SELECT row_number() OVER () AS row_id, vec_id,
         list_transform(embedding, lambda x: floor({K.FACTOR} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.row_id AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.row_id <> q.row_id WHERE q.vec_id % {K.EVERY} = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K.K}"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
# the checksum of decimal text, bit by bit: 8 steps (-1) after each character
_CRC = ("xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length({0}) + 1), "
        "lambda i: list_concat([CAST(ascii(substr({0}, i, 1)) AS BIGINT)], list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)")
SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, lang, leaf, tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         row_number() OVER () AS row_id, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {_LEAF.replace("{n}", "n_chars")} AS leaf,
               CASE WHEN {_CRC.format("CAST(doc_id AS VARCHAR)")} % {M.TAMPERED} = 0
                    THEN {_LEAF.replace("{n}", "(n_chars + 1)")} END AS tampered FROM documents)),
nodes AS (
  SELECT lang, 0 AS level, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(next, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY lang ORDER BY idx) AS next FROM nodes WHERE n > 1) WHERE idx % 2 = 0),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, idx, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(digest || coalesce(next, ''))
  FROM (SELECT *, lead(digest) OVER (ORDER BY idx) AS next FROM upper WHERE n > 1) WHERE idx % 2 = 0),
climb AS (
  SELECT row_id, lang, 0 AS level, idx, n, coalesce(tampered, leaf) AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT c.row_id, c.lang, c.level + 1, c.idx // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END),
         c.proof || coalesce(s.digest, '')
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.idx = xor(c.idx, 1)
  WHERE c.n > 1),
further AS (
  SELECT c.row_id, 0 AS level, s.idx, s.n, c.digest, c.proof FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
  WHERE c.n = 1
  UNION ALL
  SELECT c.row_id, c.level + 1, c.idx // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.idx % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END),
         c.proof || coalesce(s.digest, '')
  FROM further c LEFT JOIN upper s ON s.level = c.level AND s.idx = xor(c.idx, 1) WHERE c.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
       f.digest = r.digest AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN further f ON f.row_id = l.row_id AND f.n = 1
JOIN upper r ON r.n = 1"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
