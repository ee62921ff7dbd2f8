"""SQL twins of queries of this subpackage, for DuckDB."""

from __future__ import annotations

from ..plans.base import _WS, VISIBLE

#: Decodes the part of a label after ``xn--``: digits are folded into insertions of code points (the bootstring of RFC 3492).
_ADAPT = "CASE WHEN {d} > 15925 THEN 72 + 36 * ({d} // 1225) // (({d} // 1225) + 38) WHEN {d} > 455 THEN 36 + 36 * ({d} // 35) // (({d} // 35) + 38) ELSE 36 * {d} // ({d} + 38) END"


def _step() -> str:
    """One digit x of the fold; the accumulator has i, n, bias, w, k, old and the code points so far."""
    t = "least(greatest(a.k - a.bias, 1), 26)"
    i = "(a.i + x * a.w)"
    size = "(len(a.out) + 1)"
    first = f"(({i} - a.old) // CASE WHEN a.old = 0 THEN 700 ELSE 2 END)"
    delta = f"({first} + {first} // {size})"
    n, at = f"(a.n + {i} // {size})", f"({i} % {size})"
    done = f"{{'i': {at} + 1, 'n': {n}, 'bias': {_ADAPT.format(d=delta)}, 'w': 1::BIGINT, 'k': 36::BIGINT, 'old': {at} + 1, 'out': list_concat(list_concat(a.out[:{at}], [{n}]), a.out[{at} + 1:])}}"
    more = f"{{'i': {i}, 'n': a.n, 'bias': a.bias, 'w': a.w * (36 - {t}), 'k': a.k + 36, 'old': a.old, 'out': a.out}}"
    return f"CASE WHEN x < {t} THEN {done} ELSE {more} END"


def _label(c: str) -> str:
    """A label in Unicode form."""
    tail = f"substr({c}, 5)"
    basic = f"CASE WHEN contains({tail}, '-') THEN regexp_extract({tail}, '^(.*)-', 1) ELSE '' END"
    digits = f"list_transform(regexp_extract_all(regexp_extract({tail}, '([^-]*)$', 1), '.'), lambda ch: CASE WHEN ch BETWEEN '0' AND '9' THEN (unicode(ch) - 22)::BIGINT ELSE (unicode(ch) - 97)::BIGINT END)"
    start = f"{{'i': 0::BIGINT, 'n': 128::BIGINT, 'bias': 72::BIGINT, 'w': 1::BIGINT, 'k': 36::BIGINT, 'old': 0::BIGINT, 'out': list_transform(regexp_extract_all({basic}, '.'), lambda ch: unicode(ch)::BIGINT)}}"
    points = f"list_reduce({digits}, lambda a, x: {_step()}, {start}).out"
    return f"CASE WHEN starts_with({c}, 'xn--') THEN nfc_normalize(array_to_string(list_transform({points}, lambda p: chr(p::INT)), '')) ELSE {c} END"


def sites_sql(table: str) -> str:
    """CTE ``sites`` (url, site) of the distinct urls of a table."""
    return f"""u0 AS (SELECT DISTINCT url, regexp_replace(regexp_replace(url, '^[\\s\\x{{a0}}\\x{{3000}}]+', ''), '[\\s\\x{{a0}}\\x{{3000}}]+$', '') AS s FROM {table} WHERE url IS NOT NULL),
u1 AS (SELECT url, CASE WHEN regexp_matches(s, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://') THEN regexp_replace(s, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://', '') WHEN starts_with(s, '//') THEN substr(s, 3)
 WHEN regexp_matches(lower(s), '^(about|blob|cid|data|file|javascript|mailto|mid|news|sms|tel|urn|view-source):') THEN NULL ELSE s END AS s FROM u0),
u2 AS (SELECT url, nfc_normalize(lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_extract(s, '^[^/?#\\\\]*'), '^.*@', ''), ':\\d*$', '')), '\\.+$', ''))) AS h FROM u1 WHERE s IS NOT NULL),
u3 AS (SELECT url, list_transform(string_split(replace(h, '。', '.'), '.'), lambda c: {_label('c')}) AS labels FROM u2 WHERE h <> ''),
u4 AS (SELECT url, labels, unnest(range(1, len(labels))) AS i FROM u3 WHERE list_bool_and(list_transform(labels, lambda c: regexp_full_match(c, '[\\p{{L}}\\p{{N}}]([\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}])?')))),
suf AS (SELECT DISTINCT nfc_normalize(trim(lower(trim(suffix)), '.')) AS suffix FROM public_suffixes WHERE suffix IS NOT NULL),
sites AS (SELECT url, arg_min(array_to_string(labels[i:], '.'), i) AS site FROM u4 JOIN suf ON array_to_string(labels[i + 1:], '.') = suf.suffix GROUP BY 1)"""


P1_FOUND = f"""WITH {sites_sql('clean_records')}, own AS (SELECT lower(trim(site)) AS site, any_value(owner_key) AS owner_key FROM site_owners WHERE site IS NOT NULL AND owner_key IS NOT NULL GROUP BY 1),
g AS (SELECT record_no, split, CASE WHEN owner_key IS NULL THEN 's:' || sites.site ELSE 'o:' || owner_key END AS grp FROM clean_records JOIN sites USING (url) LEFT JOIN own ON own.site = sites.site)
SELECT record_no FROM g WHERE grp IN (SELECT grp FROM g GROUP BY 1 HAVING count(DISTINCT split) > 1)"""

_LINES = f"""{sites_sql('source_records')}, r AS (SELECT source_ord, site, crawled_at, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM source_records JOIN sites USING (url) WHERE {VISIBLE}),
l AS (SELECT source_ord, site, crawled_at, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS x FROM r),
k AS (SELECT source_ord, site, crawled_at, line_no, trim(regexp_replace(lower(regexp_replace(nfc_normalize(x), '[0-9]+', '0', 'g')), '[{_WS}]+', ' ', 'g')) AS key FROM l),
n AS (SELECT site, count(*) AS site_records FROM r GROUP BY 1)"""

P5_FOUND = f"""WITH {_LINES}, e AS (SELECT site, key FROM (SELECT site, key, count(DISTINCT source_ord) AS c FROM k WHERE key <> '' GROUP BY 1, 2) JOIN n USING (site) WHERE c >= 8 AND c * 5 >= site_records)
SELECT source_ord, line_no FROM k JOIN e USING (site, key)"""

P5_BOILERPLATE = f"""WITH {_LINES}, whole AS (SELECT site, source_ord, string_agg(key, chr(10) ORDER BY line_no) FILTER (WHERE key <> '') AS page FROM k GROUP BY 1, 2), page AS (SELECT *, min(source_ord) OVER (PARTITION BY site, page) AS cluster FROM whole),
c AS (SELECT k.site, key, count(DISTINCT k.source_ord) AS records, count(DISTINCT cluster) AS clusters FROM k JOIN page USING (site, source_ord) WHERE key <> '' GROUP BY 1, 2),
days AS (SELECT k.site, key, count(DISTINCT k.crawled_at::DATE) AS days FROM k JOIN page USING (site, source_ord) WHERE key <> '' AND k.source_ord = cluster GROUP BY 1, 2),
e AS (SELECT site, key, records, clusters, days, site_records FROM c JOIN days USING (site, key) JOIN n USING (site) WHERE records >= 8 AND records * 5 >= site_records AND clusters >= 8 AND days >= 2)
SELECT source_ord, line_no, records, clusters, days, site_records FROM k JOIN e USING (site, key)"""

SQL = {"p1_found": P1_FOUND, "p5_found": P5_FOUND, "p5_boilerplate": P5_BOILERPLATE}
