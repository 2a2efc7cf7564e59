"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

_WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _p1_rows() -> str:
    parts = []
    for f in ("original_sha256", "original_filename"):
        k = f"nfc_normalize(lower({_trim(f)}))"
        parts.append(f"select archive_id as id, 0 as is_new, '{f}' as key_field, {k} as k from archived_keys")
        parts.append(f"select audit_id, 1, '{f}', {k} from audit_log")
    return "with r as (select * from (" + " union all ".join(parts) + ") where k <> ''), f as (select key_field, k, min(is_new) as old, min(case when is_new = 1 then id end) as first_id from r group by all), "


_P1_FOUND = _p1_rows() + "found as (select r.id as audit_id, r.key_field from r join f using (key_field, k) where r.is_new = 1 and (f.old = 0 or r.id > f.first_id)) "
_P3 = (
    f"with e as (select event_id, min(doc_id) as doc_id, min(nfc_normalize({_trim('word')})) as word, min(direction) as direction from candidate_events "
    f"where {_trim('word')} <> '' and direction is not null group by event_id), "
    "n as (select count(distinct doc_id) as n from candidate_events), "
    "c as (select word, direction, count(*) as n_events, count(distinct doc_id) as n_docs from e group by all), "
    "m as (select word, direction, n_events, n_docs, case when n_docs < 3 then 'rare' when n_docs > 0.05 * n then 'common' end as mark from c, n) "
)

ORACLE = {
    "p1_found": _P1_FOUND + "select audit_id, key_field from found",
    "p1_seen": _P1_FOUND
    + "select a.audit_id, s.audit_id is not null as original_sha256_seen, n.audit_id is not null as original_filename_seen from audit_log a "
    "left join (select audit_id from found where key_field = 'original_sha256') s on s.audit_id = a.audit_id "
    "left join (select audit_id from found where key_field = 'original_filename') n on n.audit_id = a.audit_id",
    "p3_found": _P3 + "select word, direction, mark from m where mark is not null",
    "p3_counts": _P3 + "select * from m",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
