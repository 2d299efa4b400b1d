"""DuckDB SQL for the corpus queries that SQL can express.

The others have none: op2 and op10 hang on XXH64, op3 on JSON schemas, op6 on a tokenizer, op8 on
passages of floating-point vectors; they are tested against plain versions.
"""

from __future__ import annotations

from tapelark.llm import lines, priors, quality, spans, urls

_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"'[\x20\x09-\x0D]'"


def _strength(chi: str, groups: str, trials: str) -> str:
    rho = f"least({priors.RHO_HIGH}, greatest({priors.RHO_LOW}, CASE WHEN {trials} > {groups} THEN ({chi} - {groups}) / ({trials} - {groups}) ELSE 0.5 END))"
    return f"(1.0 / CAST({rho} AS DOUBLE) - 1.0)"


def _fit(bad: str, n: str, mean: str) -> str:
    """Aggregate: strength of a prior around ``mean``."""
    chi = f"sum(({bad} - {n} * {mean}) * ({bad} - {n} * {mean}) / ({n} * {mean} * (1.0 - {mean})))"
    return _strength(chi, "count(*)", f"sum({n})")


def _low(bad: str, n: str, mean: str, m: str, z: float) -> str:
    a, t = f"({bad} + {m} * {mean})", f"({n} + {m})"
    return f"({a} / {t} - {z} * sqrt({a} * ({t} - {a}) / ({t} * {t} * ({t} + 1.0))))"


def _op1() -> str:
    two = "array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 1), len(string_split(host, '.'))), '.')"
    three = "array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.')"
    second = ", ".join(f"'{x}'" for x in urls.SECOND_LEVEL)
    long = f"len(string_split(host, '.')) > 1 AND string_split(host, '.')[-2] IN ({second}) AND regexp_full_match(string_split(host, '.')[-1], '[a-z]{{2}}')"
    fits = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.pattern}:{r.verdict}'"
        for r in sorted(urls.RULES, key=lambda r: -len(r.pattern))
    )
    return rf"""WITH p AS (SELECT page_id, url,
  CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
 q AS (SELECT *, CASE WHEN {long} THEN {three} ELSE {two} END AS domain, CASE WHEN {long} THEN {two} ELSE string_split(host, '.')[-1] END AS suffix,
  try_cast(regexp_extract(url, '^[^#?]*?://[^/?#]*/(?:[^/?#]*/)?([0-9]+)', 1) AS BIGINT) AS doc_id FROM p),
 o AS (SELECT host, domain, suffix, CAST(quality IS NOT DISTINCT FROM 0 OR toxic IS NOT DISTINCT FROM 1 AS INTEGER) AS bad FROM q JOIN labels USING (doc_id) WHERE coalesce(quality, toxic) IS NOT NULL),
 h AS (SELECT host, domain, suffix, sum(bad) AS bad, count(*) AS n FROM o GROUP BY 1, 2, 3),
 g AS (SELECT CAST((coalesce(sum(bad), 0) + 0.5) AS DOUBLE) / (coalesce(sum(n), 0) + 1.0) AS m FROM h),
 s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n, m FROM h CROSS JOIN g GROUP BY suffix, m), fs AS (SELECT {_fit("bad", "n", "m")} AS f FROM s),
 ms AS (SELECT suffix, (bad + f * m) / (n + f) AS m FROM s CROSS JOIN fs),
 d AS (SELECT domain, sum(bad) AS bad, sum(n) AS n, ms.m FROM h JOIN ms USING (suffix) GROUP BY domain, ms.m), fd AS (SELECT {_fit("bad", "n", "m")} AS f FROM d),
 md AS (SELECT domain, (bad + f * m) / (n + f) AS m FROM d CROSS JOIN fd),
 fh AS (SELECT {_fit("bad", "n", "m")} AS f FROM h JOIN md USING (domain)),
 r AS (SELECT u.host, coalesce(h.bad, 0) AS bad, coalesce(h.n, 0) AS n, coalesce(md.m, ms.m, g.m) AS m, coalesce(fh.f, 1.0 / {priors.RHO_HIGH} - 1.0) AS f
  FROM (SELECT DISTINCT host, domain, suffix FROM q) u LEFT JOIN h USING (host) LEFT JOIN md ON md.domain = u.domain LEFT JOIN ms ON ms.suffix = u.suffix CROSS JOIN g CROSS JOIN fh),
 x AS (SELECT page_id, host, path, CASE{fits} END AS fit, (bad + f * m) / (n + f) AS share, {_low("bad", "n", "m", "f", urls.BOUND)} AS low FROM q JOIN r USING (host))
SELECT page_id, host, path, split_part(fit, ':', 1) AS rule, coalesce(split_part(fit, ':', 2), CASE WHEN low > {urls.MAX_BAD} THEN 'block' ELSE 'allow' END) AS verdict, round(share, 6) AS share, round(low, 6) AS low FROM x"""


_LINES = rf"""b AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {{'i': i - 1, 'x': x, 'm': len(regexp_extract_all(x, {_WORD}))}}), lambda p: p.m > 0) AS l FROM documents),
 w AS (SELECT doc_id, s, s + o - 1 AS e, list_slice(list_transform(l, lambda p: p.x), s, s + o - 1) AS k FROM (SELECT doc_id, l, o, unnest(range(1, len(l) - o + 2)) AS s FROM b JOIN (SELECT unnest(range(1, {lines.RUN + 1})) AS o) ON len(l) >= o)
  WHERE o = {lines.RUN} OR list_sum(list_transform(list_slice(l, s, s + o - 1), lambda p: p.m)) >= {lines.LONG_WORDS}),
 r AS (SELECT doc_id, s, e FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS c FROM w) WHERE c > 1),
 v AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS j FROM r),
 n AS (SELECT doc_id, count(*) AS n, string_agg(CAST(l[j].i AS VARCHAR), ',' ORDER BY j) AS t FROM v JOIN b USING (doc_id) GROUP BY 1)"""

_SENTENCES = rf"""b AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10), chr(1)),
  '([.!?]+)([ \t\r\x0b\x0c])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: regexp_extract_all(p, {_WORD})), lambda w: len(w) > 0) AS l FROM documents),
 u AS (SELECT doc_id, unnest(range(1, len(l) + 2)) AS j, unnest(list_append(list_transform(l, lambda w: len(w)), 0)) AS m, len(l) AS z FROM b),
 q AS (SELECT doc_id, j, m, z, coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM u),
 f AS (SELECT *, min(j) OVER (PARTITION BY doc_id ORDER BY c RANGE BETWEEN {spans.MIN_WORDS} FOLLOWING AND UNBOUNDED FOLLOWING) AS on_, max(j) OVER (PARTITION BY doc_id ORDER BY c RANGE BETWEEN UNBOUNDED PRECEDING AND {spans.MIN_WORDS} PRECEDING) AS back FROM q),
 g AS (SELECT DISTINCT doc_id, s, e FROM (SELECT doc_id, z, j AS s, greatest(j + {spans.SPAN}, on_) AS e FROM f WHERE on_ IS NOT NULL UNION ALL SELECT doc_id, z, least(j - {spans.SPAN}, back), j FROM f WHERE back IS NOT NULL UNION ALL SELECT doc_id, z, j, j + 1 FROM f WHERE m >= {spans.LONG_WORDS})
  WHERE s >= 1 AND e <= z + 1),
 w AS (SELECT doc_id, s, e, list_slice(l, s, e - 1) AS k FROM g JOIN b USING (doc_id)),
 r AS (SELECT doc_id, s, e FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS c FROM w) WHERE c > 1),
 v AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS j FROM r),
 n AS (SELECT doc_id, count(*) AS n, string_agg(CAST(j - 1 AS VARCHAR), ',' ORDER BY j) AS t FROM v GROUP BY 1)"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_OP7 = rf"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM benchmark),
 p AS (SELECT DISTINCT item, list_slice(w, s, s + least(13, len(w)) - 1) AS k FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM i WHERE len(w) > 0)),
 m AS (SELECT DISTINCT len(k) AS m FROM p),
 d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, {_ALNUM}) AS w FROM documents),
 x AS (SELECT rid, s, m, list_slice(w, s, s + m - 1) AS k FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d JOIN m ON len(w) >= m)),
 h AS (SELECT rid, s, m, item FROM x JOIN p USING (k)),
 c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(s, s + m)) AS j FROM (SELECT DISTINCT rid, s, m FROM h)) GROUP BY 1),
 t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.t, '')) AS items_sha256,
 coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""


def _op9() -> str:
    fails = {
        "few_words": f"n_words < {quality.MIN_WORDS}",
        "repeats": f"100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words",
        "symbols": f"100 * n_symbols > {quality.SYMBOL_PERCENT} * word_chars",
        "dup_lines": f"100 * n_dup_lines > {quality.DUP_LINE_PERCENT} * n_lines",
    }
    names = list(fails)
    lows = [_low(f"h.x_{x}", "h.n", f"m_{x}", f"f_{x}", quality.BOUND) for x in names]
    return rf"""WITH b AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS l FROM documents),
 g AS (SELECT rid, i, list_slice(w, i, i + 4) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
 d AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS z FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
 r AS (SELECT rid, CAST(sum(least(5, coalesce(z - i, 5))) AS BIGINT) AS n FROM d GROUP BY 1),
 f AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, {_SPACE}, '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines FROM b LEFT JOIN r USING (rid)),
 j AS (SELECT *, {", ".join(f"CAST({fails[x]} AS INTEGER) AS y_{x}" for x in names)} FROM f),
 h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(sum(y_{x}) AS DOUBLE) AS x_{x}" for x in names)} FROM j GROUP BY 1),
 m AS (SELECT {", ".join(f"(sum(x_{x}) + 0.5) / (sum(n) + 1.0) AS m_{x}" for x in names)} FROM h),
 s AS (SELECT {", ".join(f"{_fit(f'x_{x}', 'n', f'm_{x}')} AS f_{x}" for x in names)} FROM h CROSS JOIN m),
 k AS (SELECT host, greatest({", ".join(lows)}) AS low FROM h CROSS JOIN m CROSS JOIN s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, y_few_words + y_repeats > 0 AS base_failed, j.host AS host, round(k.low, 6) AS host_low, y_few_words + y_repeats = 0 AND k.low <= {quality.HOST_RATE} AS kept
FROM j JOIN k ON j.host IS NOT DISTINCT FROM k.host"""


SQL: dict[str, str] = {
    "op1_url_filters": _op1(),
    "op4_line_dedup": f"WITH {_LINES} SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, coalesce(n.n, 0) AS n_removed, coalesce(n.t, '') AS removed_lines FROM b LEFT JOIN n USING (doc_id)",
    "op5_substring_dedup": f"WITH {_SENTENCES} SELECT doc_id, CAST(len(l) AS BIGINT) AS n_sentences, coalesce(n.n, 0) AS n_removed, coalesce(n.t, '') AS removed_sentences FROM b LEFT JOIN n USING (doc_id)",
    "op7_decontamination": _OP7,
    "op9_quality_rules": _op9(),
}
