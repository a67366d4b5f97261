"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from harborline.llm import decontamination as d
from harborline.llm import divergence as v
from harborline.llm import fill_middle as f
from harborline.llm import substring_dedup as r
from harborline.llm import url_filter as u


def op6_sql() -> str:
    def weight(bad: str, n: str, mean: str) -> str:
        over = f"sum(power({bad} - {n} * {mean}, 2) - {n} * {mean} * (1 - {mean}))"
        room = f"sum({n}::DOUBLE * ({n} - 1) * {mean} * (1 - {mean}))"
        found = f"CASE WHEN {over} > 0 AND {room} > 0 THEN {room} / {over} - 1 ELSE {u.MOST_PRIOR} END"
        return f"round(least(greatest({found}, {u.LEAST_PRIOR}), {u.MOST_PRIOR}), 6)::DOUBLE AS k"

    shared = rf"regexp_matches(host, '[^.]\.({'|'.join(u.SHARED_LABELS)})\.[a-z]{{2}}$')"
    fits = {
        rule: "('.' || host) LIKE '%.{}' AND starts_with(path, '/{}')".format(*rule.split("/", 1)) for rule, _ in u.RULES
    }
    order = sorted(u.RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in order)
    verdict = " ".join(f"WHEN {fits[r]} THEN '{v}'" for r, v in order)
    return rf"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT host, coalesce(sum(bad), 0) AS bad, count(bad) AS n, CASE WHEN {shared} THEN 2 ELSE 1 END AS wide
  FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host),
hosts AS (
  SELECT host, bad, n, array_to_string(list_slice(string_split(host, '.'), -wide - 1, -1), '.') AS domain,
         array_to_string(list_slice(string_split(host, '.'), -wide, -1), '.') AS suffix
  FROM counted),
base AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0)::DOUBLE AS base FROM hosts),
s_sums AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, any_value(base) AS m FROM hosts, base GROUP BY suffix),
s_weight AS (SELECT {weight("bad", "n", "m")} FROM s_sums),
suffixes AS (SELECT suffix, (bad + k * m) / (n + k) AS s_mean FROM s_sums, s_weight),
d_sums AS (
  SELECT domain, sum(bad) AS bad, sum(n) AS n, any_value(s_mean) AS m FROM hosts JOIN suffixes USING (suffix) GROUP BY domain),
d_weight AS (SELECT {weight("bad", "n", "m")} FROM d_sums),
domains AS (SELECT domain, (bad + k * m) / (n + k) AS d_mean FROM d_sums, d_weight),
h_sums AS (SELECT host, bad, n, d_mean AS m FROM hosts JOIN domains USING (domain)),
h_weight AS (SELECT {weight("bad", "n", "m")} FROM h_sums),
posterior AS (SELECT host, n, k, (bad + k * m) / (n + k) AS mean FROM h_sums, h_weight),
bounds AS (
  SELECT host, mean - {u.BOUND_DEVIATIONS} * sqrt(mean * (1 - mean) / (n + k + 1)) AS low FROM posterior)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN low > {u.BAD_SHARE} THEN 'block' ELSE 'allow' END AS verdict
FROM urls JOIN bounds USING (host)"""


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op10_sql() -> str:
    words = f"SELECT {{}}, text, {_WORDS.format(_LOWERED)} AS w FROM {{}} WHERE text IS NOT NULL"
    gram = "unnest(list_transform(range(1, len(w) - g + 2), lambda i: array_to_string(w[i:i + g - 1], ' '))) AS gram"
    return f"""
WITH item_words AS (
  SELECT *, least(len(w), {d.SHINGLE_WORDS}) AS g FROM ({words.format("item_id", "(SELECT DISTINCT * FROM benchmark)")}) WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, text, g, {gram} FROM item_words),
docs AS (
  SELECT DISTINCT doc_id, text, g, {gram}
  FROM ({words.format("doc_id", "documents")}) JOIN (SELECT DISTINCT g FROM items) ON len(w) >= g),
sizes AS (SELECT item_id, text, count(*) AS n FROM items GROUP BY ALL),
shared AS (
  SELECT d.doc_id, i.item_id, i.text, count(*) AS n FROM docs d JOIN items i USING (g, gram) GROUP BY d.doc_id, d.text, i.item_id, i.text)
SELECT doc_id, item_id, shared.n::INTEGER AS shared, sizes.n::INTEGER AS of, shared.n / sizes.n AS containment
FROM shared JOIN sizes USING (item_id, text)
WHERE shared.n >= greatest(1, ceil({d.CONTAINMENT}::DOUBLE * sizes.n - 1e-9))"""


def op8_sql() -> str:
    n = r.WINDOW_WORDS
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT rid, doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS pos FROM docs),
named AS (SELECT rid, doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + {n - 1}), ' ')) AS name FROM windows),
firsts AS (SELECT name, min(doc_id) AS least FROM named GROUP BY name),
hits AS (SELECT rid, pos FROM named JOIN firsts USING (name) WHERE doc_id > least),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + {n})) AS place FROM hits),
places AS (SELECT rid, list(place) AS places FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN places USING (rid)"""


def op12_sql() -> str:
    draws = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(text, '{m}')" for m in (f.PREFIX, f.SUFFIX, f.MIDDLE))
    part = "array_to_string(list_slice(u, {} + 1, {}), '')"
    return rf"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{f.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
numbered AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, {draws} FROM drawn),
cut AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR {marked} OR h3 % 100 >= {f.CUT_PERCENT} THEN 'plain'
              WHEN h4 % 100 < {f.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
parts AS (
  SELECT doc_id, text, n, form, {part.format(0, "a")} AS p, {part.format("a", "b")} AS m, {part.format("b", "n")} AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{f.PREFIX}' || p || '{f.SUFFIX}' || s || '{f.MIDDLE}' || m
              ELSE '{f.SUFFIX}' || s || '{f.PREFIX}' || p || '{f.MIDDLE}' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


def op13_sql() -> str:
    def share(count: str, total: str) -> str:
        return f"(1 + ({v.SCALE}::HUGEINT * ({count} + {v.SMOOTHING})) // ({total} + {v.SMOOTHING} * terms))::BIGINT"

    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWERED.replace("text", "coalesce(text, '')", 1)}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT rid, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {v.MIN_DOCS}),
langs AS (SELECT lang, count(*) AS terms, sum(n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (
  SELECT lang, source, coalesce(terms, 0) AS terms, coalesce(lang_total, 0) AS lang_total, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN langs USING (lang) LEFT JOIN totals USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "g.total")} AS p,
         {share("k.n", "g.lang_total")} AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM items)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {v.TOP_TERMS}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_filter": op6_sql(), "op8_substring_dedup": op8_sql(), "op10_decontamination": op10_sql(),
        "op12_fill_middle": op12_sql(), "op13_source_divergence": op13_sql(),
    }
