"""Plain SQL for the queries that SQL can express.

The others hash with functions DuckDB lacks, train models, or walk graphs; the
tests hold them against brute force."""

# The contract's patterns, with either case spelled out.
_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)


def _one(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""select doc_id, {k} as k, '{kind}' as kind, unnest(range(1, len(f) + 1)) as i, f, g, p, {least} as least from
 (select doc_id, regexp_extract_all(t, '{pattern}', 0) as f, regexp_extract_all(t, '{pattern}', {group}) as g, regexp_split_to_array(t, '{pattern}') as p from d where regexp_matches(t, '{pattern}'))"""


SECRETS = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), m as ("
    + " union all ".join(_one(k, *r) for k, r in enumerate(_KINDS))
    + """), s as (select doc_id, k, kind, length(array_to_string(p[1:i], '')) + length(array_to_string(f[1:i-1], '')) as a, length(f[i]) as n from m where length(g[i]) >= least),
b as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
 string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, k) filter (k < 3) as base, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, k) as spans from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join b using (doc_id)"""
)
