"""DuckDB SQL that the queries are held against, where SQL can express them."""

from __future__ import annotations

from peaklane.llm.quality import CLASSES, COMMON, WORD_BASE, WORD_SLOPE

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP3 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
lo AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN lo USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
        SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
        UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
low AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON low.u = w.doc_id
"""

_ESCAPED = r"replace(replace({0}, '\', '\e'), '<', '\l')"
_OP8 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("text")}) + length(replace({_ESCAPED.format("role")}, '>', '\\g')) + 15)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP9 = f"""
WITH w AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
item AS (SELECT item_id, iw, least(10, len(iw)) AS k FROM (SELECT item_id, {_PLAIN} AS iw FROM benchmark) WHERE len(iw) > 0),
iwin AS (SELECT DISTINCT item_id, k, array_to_string(iw[i:i+k-1], ' ') AS t FROM (SELECT *, unnest(range(1, len(iw) - k + 2)) AS i FROM item)),
dwin AS (SELECT doc_id, i, k, array_to_string(ws[i:i+k-1], ' ') AS t
         FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM iwin))),
hit AS (SELECT doc_id, i, k, item_id FROM dwin JOIN iwin USING (k, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

_CLASS_ROWS = ", ".join(f"('{lang}', {k}, {q})" for lang, shares in CLASSES.items() for k, q in enumerate(shares))
_WORD_ROWS = ", ".join(f"('{lang}', '{w}', {q})" for lang, words in COMMON.items() for w, q in words.items())
_REST_ROWS = ", ".join(f"('{lang}', {1 - sum(words.values())})" for lang, words in COMMON.items())
_PART = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
_STRIP = "length(regexp_replace(j, '{0}', '', 'g'))"
_OP7 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
b AS (SELECT doc_id, t, ws, len(ws) AS n, array_to_string(ws, '') AS j FROM w),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, length(j) AS chars, length(j) - {_STRIP.format('[A-Za-z]')} AS le, length(j) - {_STRIP.format('[0-9]')} AS di, length(j) - {_STRIP.format(r'[^\x00-\x7F]')} AS ot FROM b),
s AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS k, unnest([le, di, ot, chars - le - di - ot]) / greatest(chars, 1) AS p FROM c),
cd AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, lang, sqrt(greatest(sum({_PART}) / 2, 0)) AS d FROM s JOIN (VALUES {_CLASS_ROWS}) r(lang, k, q) USING (k) GROUP BY doc_id, lang) GROUP BY doc_id),
u AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, lower(unnest(ws)) AS word FROM w) GROUP BY ALL),
h AS (SELECT b.doc_id, r.lang, coalesce(u.c, 0) / greatest(b.n, 1) AS p, r.q FROM b CROSS JOIN (VALUES {_WORD_ROWS}) r(lang, word, q) LEFT JOIN u ON u.doc_id = b.doc_id AND u.word = r.word),
f AS (SELECT doc_id, lang, p, q FROM h UNION ALL SELECT doc_id, lang, 1 - sum(p), any_value(x.q) FROM h JOIN (VALUES {_REST_ROWS}) x(l, q) ON x.l = lang GROUP BY doc_id, lang),
wd AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, lang, sqrt(greatest(sum({_PART}) / 2, 0)) AS d FROM f GROUP BY doc_id, lang) GROUP BY doc_id),
a AS (SELECT b.doc_id, n, length(j) AS chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS sym, coalesce(n_dup, 0) AS n_dup, coalesce(n_rep, 0) AS n_rep, cd.d AS cd, wd.d AS wd
      FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) JOIN cd USING (doc_id) JOIN wd USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, sym::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words,
       n < 50 OR 100 * n_rep > 50 * n AS base_failed,
       NOT (n < 50 OR 100 * n_rep > 50 * n) AND NOT ((chars >= 500 AND cd > 0.25) OR (n >= 100 AND wd > {WORD_BASE} + {WORD_SLOPE} / sqrt(n))) AS kept
FROM a
"""

_OP11 = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_PLAIN}) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT item_id, term, times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM w JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

#: Levels of the trees that the SQL of op12 can build: 8 ** 7 leaves a language.
_HEIGHT = 7
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
_CRC = "(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT))"


def _tree(name: str, leaves: str, height: int) -> str:
    """CTEs name0 to nameH (tree, idx, n, h) over ``leaves(tree, idx, n, h)``, runs of their children, and roots."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(height + 1):
        out.append(f"{name}r{k} AS (SELECT tree, idx // 8 AS run, any_value(n) AS n, list(h ORDER BY idx) AS hs FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 8)")
        out.append(f"{name}{k + 1} AS (SELECT tree, run AS idx, (n + 7) // 8 AS n, sha256(array_to_string(hs, '')) AS h FROM {name}r{k})")
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(height + 2))
    out.append(f"{name}top AS ({tops})")
    return ",\n".join(out)


def _climb(name: str, frm: str, height: int) -> str:
    """CTEs that carry (row, tree, idx, proof, fold) from the leaves to the roots of a forest."""
    out = [f"{name}c0 AS ({frm})"]
    for k in range(height + 1):
        hs = f"r.hs[:c.idx % 8] || [c.fold] || r.hs[c.idx % 8 + 2:]"
        out.append(
            f"{name}c{k + 1} AS (SELECT c.row, c.tree, c.idx // 8 AS idx, CASE WHEN r.run IS NULL THEN c.proof ELSE c.proof || array_to_string(r.hs[:c.idx % 8] || r.hs[c.idx % 8 + 2:], '') END AS proof,"
            f" CASE WHEN r.run IS NULL THEN c.fold ELSE sha256(array_to_string({hs}, '')) END AS fold"
            f" FROM {name}c{k} c LEFT JOIN {name}r{k} r ON r.tree IS NOT DISTINCT FROM c.tree AND r.run = c.idx // 8)"
        )
    return ",\n".join(out)


_TAB = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i))"
_OP12 = f"""
WITH d AS (SELECT *, row_number() OVER () AS row, sha256({_LEAF.format(text='text')}) AS leaf,
                  CASE WHEN {_CRC} % 3 = 0 THEN {_LOWER.replace("coalesce(text, '')", 'text')} ELSE text END AS told FROM documents, {_TAB}),
e AS (SELECT *, sha256({_LEAF.format(text='told')}) AS changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_tree('a', 'SELECT lang AS tree, idx, n, leaf AS h FROM e', _HEIGHT)},
{_tree('b', 'SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, h FROM atop', 2)},
g AS (SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx FROM atop),
{_climb('a', "SELECT row, lang AS tree, idx, '' AS proof, changed AS fold FROM e", _HEIGHT)},
{_climb('b', f'SELECT c.row, 0 AS tree, g.idx, c.proof, c.fold FROM ac{_HEIGHT + 1} c JOIN g ON g.tree IS NOT DISTINCT FROM c.tree', 2)}
SELECT doc_id, leaf, g.h AS subroot, btop.h AS root, sha256(c.proof) AS proof_sha256, c.fold AS folded_root, c.fold = btop.h AS verified
FROM e JOIN bc3 c USING (row) JOIN g ON g.tree IS NOT DISTINCT FROM e.lang, btop
"""

_HOST, _PATH_OF = r"regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')", r"regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_OP13 = f"""
WITH u AS (SELECT page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_PATH_OF} AS path FROM pages),
r(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT u.*, r.host || r.path AS rule, action FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(action, length(rule)), 'allow') AS verdict FROM f GROUP BY page_id, host, path
"""

SQL = {"op3_substring_dedup": _OP3, "op6_near_dedup": _OP6, "op7_quality_rules": _OP7, "op8_chat_format": _OP8, "op9_decontamination": _OP9, "op11_lexical_search": _OP11, "op12_merkle_manifest": _OP12, "op13_url_filter": _OP13}
