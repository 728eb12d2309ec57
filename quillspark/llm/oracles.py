"""SQL for the queries that it can express on whole tables."""

from __future__ import annotations

import re

from quillspark.llm import pii, secrets
from quillspark.llm.quality import BASE_POLICY, POLICIES, RULES

_WORD = r"[^\x20\x09-\x0D]"

_BITS = " + ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, rule in enumerate(RULES.values()))

_LEDGER = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w)-6)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(8) r(k) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS nl, count(*) - count(DISTINCT l) AS nd FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(nd, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(nl, 0)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1))::BIGINT AS n_upper_words, len(list_filter(w, lambda x: x = '|'))::BIGINT AS n_bars
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)"""

OP6 = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {BASE_POLICY.mask}) <> 0 AS base_failed,
  (fail_bits & {BASE_POLICY.mask | POLICIES["v1"].mask}) = 0 AS kept, fail_bits, 'v1' AS policy FROM b"""

ABLATION = f"""{_LEDGER},
r AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {1 << i})" for i, r in enumerate(RULES))}) t(rule, bit))
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only, count(*) FILTER (fail_bits & ~bit = 0) AS n_kept_without FROM r, b GROUP BY rule"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w)-48)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM win) WHERE o < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, range(50) r(k)),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w)+1)) AS i FROM d),
mark AS (SELECT p.doc_id, p.i, p.x, g.i IS NOT NULL AS r FROM pos p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
edge AS (SELECT *, lag(r, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM mark),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (r) AS n_removed, count(*) FILTER (r AND NOT before) AS n_spans, string_agg(x, ' ' ORDER BY i) FILTER (NOT r) AS kept FROM edge GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""

OP1 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(x, (2*i + 1)::INT, 100)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x)//2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM win) WHERE o < doc_id),
run AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000000) AS gap FROM hit),
part AS (SELECT doc_id, i, sum((gap > 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM run),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM part GROUP BY 1, 2),
gap AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM span UNION ALL SELECT doc_id, max(b), 1000000000 FROM span GROUP BY 1),
kept AS (SELECT d.doc_id, string_agg(substr(x, (2*a + 1)::INT, (2*(b - a))::BIGINT), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT d.doc_id, (length(x)//2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_NORM = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

#: every item-sized window that starts at a shared shingle, by exact multiset similarity, without fingerprints
OP2 = rf"""
WITH d AS (SELECT doc_id, {_NORM} AS w FROM documents),
items AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, {_NORM} AS w FROM benchmark) WHERE len(w) >= 5),
held AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, n, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, n-3)) AS i FROM items)) GROUP BY ALL),
sh AS (SELECT doc_id, i - 1 AS p, dn, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, len(w) AS dn, unnest(range(1, len(w)-3)) AS i FROM d)),
st AS (SELECT DISTINCT doc_id, item_id, n, least(dn, n) - 4 AS wide, least(p, greatest(dn - n, 0)) AS start FROM sh JOIN held USING (s)),
win AS (SELECT st.doc_id, item_id, n, wide, start, x.s, count(*) AS c FROM st JOIN sh x ON x.doc_id = st.doc_id AND x.p >= start AND x.p < start + wide GROUP BY ALL),
sim AS (SELECT doc_id, win.item_id, start, sum(least(win.c, held.c)) AS b, any_value(wide) AS wide, any_value(win.n) AS n FROM win JOIN held ON held.item_id = win.item_id AND held.s = win.s GROUP BY 1, 2, 3),
r AS (SELECT doc_id, item_id, start, b / (wide + n - 4 - b) AS v FROM sim)
SELECT doc_id, item_id, arg_max(start, (v, -start))::BIGINT AS start_word, round(max(v), 6) AS similarity FROM r WHERE v >= 0.8 GROUP BY 1, 2"""

#: fewest consecutive lines with 20 words or more, from each line and up to each line; a line goes if an earlier document holds such a run around it
OP3 = r"""
WITH l AS (SELECT doc_id, ln, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (
  SELECT doc_id, unnest(range(len(p))) AS ln, unnest(list_transform(p, lambda y: regexp_replace(y, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'))) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))),
f AS (SELECT doc_id, ln, x, n, row_number() OVER w AS i, sum(n) OVER w AS t FROM l WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
run AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM f a JOIN f b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + 19 AND b.t - a.t + a.n >= 20 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM f a JOIN f b ON b.doc_id = a.doc_id AND a.i BETWEEN b.i - 19 AND b.i AND b.t - a.t + a.n >= 20 GROUP BY 1, 3),
k AS (SELECT r.doc_id, r.i, r.j, string_agg(f.x, chr(10) ORDER BY f.i) AS s FROM run r JOIN f ON f.doc_id = r.doc_id AND f.i BETWEEN r.i AND r.j GROUP BY 1, 2, 3),
hit AS (SELECT doc_id, i, j FROM (SELECT doc_id, i, j, min(doc_id) OVER (PARTITION BY s) AS o FROM k) WHERE o < doc_id),
gone AS (SELECT DISTINCT f.doc_id, f.ln, f.i FROM f JOIN hit h ON h.doc_id = f.doc_id AND f.i BETWEEN h.i AND h.j),
cut AS (SELECT doc_id, ln, CASE WHEN lag(i) OVER w = i - 1 THEN lag(ln) OVER w + 1 ELSE ln END AS a FROM gone WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
mark AS (SELECT l.doc_id, l.ln, c.doc_id IS NOT NULL AS r FROM l LEFT JOIN cut c ON c.doc_id = l.doc_id AND l.ln BETWEEN c.a AND c.ln),
raw AS (SELECT doc_id, unnest(range(len(p))) AS ln, unnest(p) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
s AS (SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (r) AS n_removed, string_agg(raw.x, chr(10) ORDER BY m.ln) FILTER (NOT r) AS kept FROM mark m JOIN raw ON raw.doc_id = m.doc_id AND raw.ln = m.ln GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)"""


def _found(kind: str, rank: int, pattern: str, group: int = 0) -> str:
    """Matches of a pattern: code points before each are those of the pieces and matches before it."""
    p = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m[i] AS m, v[i] AS v, (list_sum(g[1:i]) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s FROM ("
        f"SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS g FROM d) WHERE len(m) > 0)"
    )


def _any_case(pattern: str) -> str:
    """The ASCII letters of a pattern in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


_SECRET = {k: (i, p, g, least, value) for i, (k, p, g, least, value) in enumerate(secrets.PATTERNS)}
_SECRET["assign"] = (0, _any_case("(password|passwd|secret|token|api_?key)") + _SECRET["assign"][1].split("key))", 1)[1], *_SECRET["assign"][2:])

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_found(k, i, p, g) for k, (i, p, g, _, _) in _SECRET.items())}),
c AS (SELECT raw.*, s + length(m) AS e, CASE WHEN kind = 'private_key' THEN regexp_replace(v, '[\\x20\\x09-\\x0D]', '', 'g') ELSE v END AS x FROM raw JOIN (VALUES {", ".join(f"('{k}', {least}, {value})" for k, (_, _, _, least, value) in _SECRET.items())}) r(kind, least, value) USING (kind)
  WHERE length(m) >= least AND length(v) >= value),
o AS (SELECT x, count(DISTINCT coalesce('=' || source, '')) AS n_owners, count(DISTINCT coalesce(source, '') || '/' || coalesce(lang, '')) AS n_repositories FROM c JOIN documents USING (doc_id) WHERE x <> '' GROUP BY 1),
j AS (SELECT c.*, n_owners, n_repositories, n_owners >= 3 OR (n_owners > 1 AND n_repositories >= 6) AS shared, regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS mixed FROM c LEFT JOIN o USING (x)),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
  count(*) FILTER (NOT shared AND mixed) AS n_live, count(*) FILTER (shared) AS n_shared, coalesce(max(n_owners), 0) AS max_owners, coalesce(max(n_repositories), 0) AS max_repositories FROM j GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(max_owners, 0) AS max_owners, coalesce(max_repositories, 0) AS max_repositories FROM d LEFT JOIN s USING (doc_id)"""

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": pii.IBAN,
    "ssn": "[0-9-]+",
    "local_phone": pii.LOCAL_PHONE,
}
_BY_KIND = lambda values: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_found(k, i, p) for i, (k, p) in enumerate(_PII.items()))}),
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM raw),
size AS (SELECT *, CASE kind
  WHEN 'email' THEN length(m)
  WHEN 'ip' THEN CASE WHEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(right(x, 3) AS INT), 0) > 255)) = 0 THEN length(m) END
  WHEN 'card' THEN CASE WHEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(g)), lambda i: CASE WHEN i % 2 = 0 THEN g[length(g)-i]::INT WHEN g[length(g)-i]::INT > 4 THEN 2 * g[length(g)-i]::INT - 9 ELSE 2 * g[length(g)-i]::INT END)) % 10 = 0 THEN length(m) END
  WHEN 'phone' THEN CASE WHEN length(g) BETWEEN 9 AND 15 THEN length(m) END
  WHEN 'ssn' THEN CASE WHEN regexp_full_match(m, '{pii.SSN}') THEN length(m) END
  WHEN 'iban' THEN list_max(list_filter(range(15, length(m) + 1), lambda c: (c = length(m) OR m[c+1] = ' ') AND length(replace(m[1:c], ' ', '')) BETWEEN 15 AND 34
    AND list_reduce(list_concat([0::BIGINT], list_transform(string_split(replace(m[1:c], ' ', '')[5:] || m[1:4], ''), lambda x: (strpos('{_ALPHABET}', x) - 1)::BIGINT)), lambda r, x: (CASE WHEN x < 10 THEN r * 10 ELSE r * 100 END + x) % 97) = 1))
  ELSE length(m) END AS w FROM digits),
span AS (SELECT d.doc_id, rank, kind, s, s + w AS e, t[greatest(1, s - {pii.CONTEXT - 1}):s] AS near, t[s:s] AS prior, t[s+w+1:s+w+1] AS next FROM size JOIN d USING (doc_id) WHERE w IS NOT NULL),
scored AS (SELECT *, greatest(0, least(100, {_BY_KIND(pii.PRIOR)} + CASE WHEN {_BY_KIND({k: f"regexp_matches(near, '{p}')" for k, p in pii.NEAR.items()})} THEN {pii.RAISE} ELSE 0 END - CASE WHEN regexp_matches(near, '{pii.FAKE}') THEN {pii.LOWER} ELSE 0 END)) AS score
  FROM span WHERE kind <> 'local_phone' OR (NOT regexp_matches(prior, '[0-9+(-]') AND next <> '-')),
taken AS (SELECT doc_id, list(struct_pack(a := s, b := e)) AS spans FROM scored WHERE rank < 4 GROUP BY 1),
whole AS (SELECT x.* FROM scored x LEFT JOIN taken USING (doc_id) WHERE rank < 4 OR (score >= {pii.MIN_SCORE} AND len(list_filter(coalesce(spans, []), lambda y: x.s < y.b AND y.a < x.e)) = 0)),
s AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) FILTER (rank < 4), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY rank, s) AS spans, count(*) AS n_spans, string_agg(score, ',' ORDER BY rank, s) AS scores, count(*) FILTER (kind IN {pii.CHECKSUM}) AS n_confirmed FROM whole GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores, coalesce(n_confirmed, 0) AS n_confirmed FROM d LEFT JOIN s USING (doc_id)"""

SQL = {"op1_suffix_dedup": OP1, "op2_decontaminate": OP2, "op3_line_dedup": OP3, "op4_substring_dedup": OP4, "op5_secrets": OP5, "op6_quality": OP6, "quality_ablation": ABLATION, "op10_pii": OP10}
