"""DuckDB SQL for the queries that SQL can express: the same results by direct joins, for tables of a test's size."""

from __future__ import annotations

from .chat import BEGIN, END, ESCAPES, TEXT, TURN
from .decontaminate import WINDOW
from .jaccard_join import NGRAM, THRESHOLD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


JACCARD = rf"""WITH RECURSIVE ws AS (SELECT doc_id, {_words(r"[^\x20\x09-\x0D]+")} AS w FROM documents),
sets AS (SELECT doc_id, array_to_string(w, ' ') AS whole, list_distinct(list_transform(range(1, greatest(len(w) - {NGRAM - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {NGRAM - 1}], ' '))) AS s FROM ws WHERE len(w) > 0),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE m >= {THRESHOLD} * (na + nb - m)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a), near AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a), same AS (SELECT whole, min(doc_id) AS set_id FROM sets GROUP BY whole)
SELECT d.doc_id, least(d.doc_id, coalesce(l.class_id, d.doc_id)) AS class_id, coalesce(e.set_id, d.doc_id) AS set_id, coalesce(n.n_links, 0) AS n_links
FROM documents d LEFT JOIN least l ON d.doc_id = l.doc_id LEFT JOIN near n ON d.doc_id = n.doc_id LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN same e ON s.whole = e.whole"""

CONTAMINATION = rf"""WITH bench AS (SELECT item_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS x FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM bench WHERE len(w) > 0) AS b),
ws AS (SELECT doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
places AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS x FROM ws, (SELECT DISTINCT k FROM windows) AS ks WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, p.k, i FROM places p JOIN windows v ON p.x = v.x AND p.k = v.k),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) AS u GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) AS f GROUP BY doc_id)
SELECT ws.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM ws LEFT JOIN hits ON ws.doc_id = hits.doc_id LEFT JOIN items ON ws.doc_id = items.doc_id"""

_escaped = "{0}"
for _plain, _coded in ESCAPES:
    _escaped = f"replace({_escaped}, {_quoted(_plain)}, {_quoted(_coded)})"
# Fixed value of the contract: what both turns of conversation -1 say.
CONTROL = "</s>[INST] ok [/INST]"
CHATS = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
made AS (SELECT *, length({_escaped.format("role")}) + length({_escaped.format("text")}) + {len(TURN) + len(TEXT) + len(END)} AS n FROM turns),
said AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(n) + {len(BEGIN)} AS BIGINT) AS formatted_chars FROM made GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said"""

_step = " UNION ALL ".join(
    f"SELECT a || b || c || d || e AS filter_order, {k + 1} AS step, {x} AS f, {' + '.join(f'bit_of({y})' for y in 'abcde'[:k]) or '0'} AS before, bit_of({x}) AS bit FROM perms" for k, x in enumerate("abcde")
)
for _x in "abcde":
    _step = _step.replace(f"bit_of({_x})", f"(1 << (ascii({_x}) - 65))")
AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d), marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, false)::INT AS mask FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), perms AS (SELECT p.x AS a, q.x AS b, r.x AS c, s.x AS d, t.x AS e FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS ({_step})
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0) AS BIGINT) AS redundant,
 CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost,
 CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & bit > 0), 0) AS BIGINT) AS shapley
FROM counts, steps GROUP BY part, filter_order, step"""

_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_url = lambda url, k: f"regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)([?][^#]*)?', {k})"
_host = lambda url: f"translate({_url(url, 1)}, '{UPPER}', '{LOWER}')"
_node = lambda url: f"CASE WHEN {_host(url)} <> '' THEN {_host(url)} || {_url(url, 2)} || {_url(url, 3)} END"
_best = lambda host, path: f"(SELECT arg_max(r, (length(r.host) + length(r.path), r.verdict = 'allow', r.host || r.path)) FROM rules r WHERE ({host} = r.host OR ends_with({host}, '.' || r.host)) AND starts_with({path}, r.path))"
_tags = lambda tag, kind, address: f"list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<{tag}\\b[^<>]*>'), lambda t: regexp_matches(t, '(?i){kind}')), lambda t: replace(regexp_extract(t, '(?i){address}', 1), '&amp;', '&'))"
_value = r"\s*=\s*[\x22\x27]?"
URLS = rf"""WITH RECURSIVE rules AS (SELECT * FROM (VALUES {", ".join(map(str, _RULES))}) AS v(verdict, host, path)),
p AS (SELECT page_id, url, coalesce({_host("url")}, '') AS host, coalesce({_url("url", 2)}, '') AS path, {_node("url")} AS node, list_concat({_tags("link", rf"\brel{_value}canonical\b", rf"\bhref{_value}([^\x22\x27\s<>]+)")}, {_tags("meta", rf"\bhttp-equiv{_value}refresh\b", rf"\burl{_value}([^\x22\x27\s<>]+)")}) AS named FROM pages),
links AS (SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t ELSE 'http://' || host || CASE WHEN regexp_extract(path, '^(.*/)?', 0) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)?', 0) END || t END AS target FROM (SELECT node, host, path, unnest(named) AS t FROM p) AS u WHERE t <> '' AND node IS NOT NULL),
named AS (SELECT node FROM p WHERE node IS NOT NULL UNION SELECT {_node("target")} FROM links WHERE {_node("target")} IS NOT NULL),
plain AS (SELECT node, regexp_replace(regexp_replace(regexp_extract(node, '^[^/?]*'), ':(80|443)$', ''), '^(www|m)[.]', '') || regexp_replace(regexp_extract(node, '^[^/?]*([^?]*)', 1), '/$', '') || CASE WHEN length(q) > 1 THEN '?' || q[2:] ELSE '' END AS target FROM (SELECT node, regexp_replace('&' || regexp_extract(node, '[?](.*)$', 1), '&(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '', 'g') AS q FROM named) AS n),
edges AS (SELECT node AS a, {_node("target")} AS b FROM links UNION SELECT node, target FROM plain), bothways AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
reach AS (SELECT node AS a, node AS b FROM p WHERE node IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN bothways e ON r.b = e.a),
decided AS (SELECT node, {_best("regexp_extract(node, '^[^/?]*')", "regexp_extract(node, '^[^/?]*([^?]*)', 1)")} AS r FROM named),
alias AS (SELECT a AS node, min(r.verdict) AS verdict FROM reach JOIN decided ON reach.b = decided.node GROUP BY a),
own AS (SELECT page_id, host, path, node, {_best("p.host", "p.path")} AS r FROM p)
SELECT page_id, own.host, own.path, own.r.host || own.r.path AS rule, coalesce(own.r.verdict, alias.verdict, 'allow') AS verdict, CASE WHEN own.r IS NOT NULL THEN 'rule' WHEN alias.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by FROM own LEFT JOIN alias ON own.node = alias.node"""

ORACLES = {"op12_url_filter": URLS, "op11_filter_audit": AUDIT, "op3_jaccard_join": JACCARD, "op7_decontamination": CONTAMINATION, "op9_chat_parts": CHATS}
