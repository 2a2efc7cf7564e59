"""SQL of the queries that SQL can express, for DuckDB over the same tables. Written on its own: relational
where the engine works within the row."""

from __future__ import annotations

import re

from garimi import dictionaries as D

WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LINE_WS = r"\x{09}\x{0B}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ND = r"\p{Nd}"
ALNUM = r"[\p{L}\p{N}]"
PHONE = rf"01[016789]-?{ND}{{3,4}}-?{ND}{{4}}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
RRN = rf"{ND}{{6}}-{ND}{{7}}"
PASSPORT = rf"[A-Z]{ND}{{8}}"
ACCOUNT = rf"{ND}{{2,6}}-{ND}{{1,6}}-{ND}{{2,8}}"
CARD = rf"{ND}{{4}}[- ]?{ND}{{4}}[- ]?{ND}{{4}}[- ]?{ND}{{4}}"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _words(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _label(words: list[str]) -> str:
    return rf"{_words(words)}[{WS}]*[:：][{WS}]*"


REGION = _words(D.REGIONS)
LAYOUT = sorted({*D.NAME_LABELS, *D.BUSINESS_LABELS, *D.ADDRESS_LABELS, *D.LAYOUT_LABELS}, key=lambda w: (-len(w), w))
LAYOUT_LABEL = f"({'|'.join(LAYOUT)})[{WS}]*[:：]"


def occ(pattern: str, source: str = "documents", text: str = "text", keep: str = "doc_id") -> str:
    """Matches with positions: ``keep``, ord, value, start_pos, end_pos and the text as ``t``."""
    return (
        f"(select {keep}, t, i as ord, ms[i] as value, s as start_pos, s + length(ms[i])::int as end_pos from (select *, (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0))::int as s "
        f"from (select *, unnest(range(1, len(ms) + 1))::int as i from (select {keep}, {text} as t, regexp_extract_all({text}, '{pattern}') as ms, string_split_regex({text}, '{pattern}') as gs from {source} where {text} is not null))))"
    )


def _rrn_ok(v: str) -> str:
    d = f"replace(translate({v}, '０１２３４５６７８９', '0123456789'), '-', '')"
    total = " + ".join(f"coalesce(try_cast(substr({d}, {i + 1}, 1) as int), 0) * {w}" for i, w in enumerate([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]))
    return f"coalesce(regexp_full_match({d}, '[0-9]{{13}}') and (11 - ({total}) % 11) % 10 = try_cast(substr({d}, 13, 1) as int), false)"


def _line_start(t: str, pos: str) -> str:
    return f"({pos} - coalesce(nullif(instr(reverse(substr({t}, 1, {pos})), chr(10)), 0) - 1, {pos}))::int"


def _line_end(t: str, pos: str) -> str:
    return f"(case when instr(substr({t}, {pos} + 1), chr(10)) > 0 then {pos} + instr(substr({t}, {pos} + 1), chr(10)) - 1 else length({t}) end)::int"


_FREE = r"not regexp_matches(case when start_pos > 0 then substr(t, start_pos, 1) else '' end, '[\p{L}\p{N}_]') and not regexp_matches(substr(t, end_pos + 1, 1), '[\p{L}\p{N}_]')"


def _context(words: list[str]) -> str:
    low = f"greatest({_line_start('t', 'start_pos')}, start_pos - 15)"
    return f"regexp_matches(substr(t, {low} + 1, start_pos - {low}), '{'|'.join(words)}')"


def _after(words: list[str], source: str = "documents", text: str = "text", keep: str = "doc_id") -> str:
    return f"(select * from (select {keep}, t, ord, regexp_extract(substr(t, end_pos + 1, 10), '^[가-힣]{{2,4}}') as value, end_pos as start_pos from {occ(_label(words), source, text, keep)}) where value <> '')"


_ONE, _TWO = [s for s in D.SURNAMES if len(s) == 1], [s for s in D.SURNAMES if len(s) == 2]
_IS_NAME = f"(value not in {_list(D.EXCLUDE_WORDS)} and (substr(value, 1, 1) in {_list(_ONE)} or substr(value, 1, 2) in {_list(_TWO)}))"


def _rules(source: str = "documents", text: str = "text", key: str = "doc_id") -> list[tuple[str, int, str, str, str]]:
    """type, confidence, group, and the rows of each rule, in rule order."""
    o = lambda p: occ(p, source, text, key)
    pick = f"select {key}, t, ord, value, start_pos from "
    title = f"(select {key}, t, ord, regexp_extract(value, '[가-힣]{{2,4}}$') as value, end_pos - length(regexp_extract(value, '[가-힣]{{2,4}}$'))::int as start_pos from {o(rf'{_words(D.BUSINESS_TITLES)}[{_LINE_WS}]+[가-힣]{{2,4}}')})"
    raw = f"substr(t, end_pos + 1, {_line_end('t', 'end_pos')} - end_pos)"
    address = (
        f"(select {key}, t, ord, {trim('raw')} as value, (end_pos + length(raw) - length(regexp_replace(raw, '^[{WS}]+', '')))::int as start_pos from (select *, {raw} as raw from {o(_label(D.ADDRESS_LABELS))}))"
    )
    region = f"regexp_extract(value, '^{REGION}')"
    return [
        (D.PHONE, 2, D.GROUP_BASIC, pick + o(PHONE)),
        (D.EMAIL, 2, D.GROUP_BASIC, pick + o(EMAIL)),
        (D.RRN, 2, D.GROUP_BASIC, pick + o(RRN) + f" where {_rrn_ok('value')}"),
        (D.PASSPORT, 2, D.GROUP_BASIC, pick + o(PASSPORT) + f" where {_FREE}"),
        (D.ACCOUNT, 2, D.GROUP_BASIC, pick + o(ACCOUNT) + f" where {_context(D.ACCOUNT_CONTEXT)}"),
        (D.CARD, 1, D.GROUP_BASIC, pick + o(CARD) + f" where {_FREE} and {_context(D.CARD_CONTEXT)}"),
        (D.NAME, 1, D.GROUP_BASIC, pick + _after(D.NAME_LABELS, source, text, key) + f" where {_IS_NAME}"),
        (D.NAME, 0, D.GROUP_BUSINESS, pick + _after(D.BUSINESS_LABELS, source, text, key) + f" where {_IS_NAME}"),
        (D.NAME, 0, D.GROUP_BUSINESS, pick + title + f" where {_IS_NAME}"),
        (D.ADDRESS, 0, D.GROUP_BASIC, pick + address + f" where {region} <> '' and length(value) > length({region})"),
    ]


def detect_ctes(source: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    """CTEs ending in ``det``: the full detection, with t, value, start_pos, end_pos, grp, conf, crossed, emit."""
    parts = [f"select {key}, t, {i} as rule, ord, '{kind}' as type, value, start_pos, (start_pos + length(value))::int as end_pos, '{grp}' as grp, {conf} as conf from ({rows})" for i, (kind, conf, grp, rows) in enumerate(_rules(source, text, key))]
    first = f"row_number() over (partition by {key}, start_pos, end_pos order by rule, ord) = 1"
    prefix = f"regexp_matches(substr(t, {_line_start('t', 'start_pos')} + 1, start_pos - {_line_start('t', 'start_pos')}), '{_words(D.PHONE_CONTEXT_LABELS)}[{WS}]*[:：]')"
    return (
        f"raw0 as ({' union all '.join(parts)}), "
        f"once as (select * from raw0 qualify {first}), "
        f"lined as (select *, {_line_start('t', 'start_pos')} as ls from once), "
        f"hot as (select distinct {key}, ls from lined where type = '{D.PHONE}' and {prefix}), "
        f"bumped as (select l.{key}, t, rule, ord, type, value, start_pos, end_pos, grp, case when type = '{D.NAME}' and h.ls is not null then least(conf + 1, 2) else conf end as conf, type = '{D.NAME}' and h.ls is not null as crossed from lined l left join hot h on h.{key} = l.{key} and h.ls = l.ls), "
        f"ends as (select {key}, t, ord, end_pos from {occ(_label([D.REPEATED_NAME_LABEL]), source, text, key)}), "
        f"starts as (select distinct {key}, start_pos from bumped where type = '{D.NAME}'), "
        f"repeats as (select distinct e.{key} from ends e join starts s on s.{key} = e.{key} and s.start_pos = e.end_pos), "
        f"extra as (select e.{key}, t, 90 as rule, ord, '{D.NAME}' as type, regexp_extract(substr(t, end_pos + 1, 10), '^[가-힣]{{2,4}}') as value, end_pos as start_pos from ends e join repeats using ({key}) where not exists (select 1 from starts s where s.{key} = e.{key} and s.start_pos = e.end_pos)), "
        f"everything as (select * from bumped union all select {key}, t, rule, ord, type, value, start_pos, (start_pos + length(value))::int, '{D.GROUP_CROSS}', 0, true from extra where value <> ''), "
        f"det0 as (select * from everything qualify {first}), "
        f"det as (select *, (row_number() over (partition by {key} order by start_pos, rule, ord) - 1)::int as emit from det0)"
    )


DETECT = "with " + detect_ctes()
LEVEL = "case conf when 0 then '낮음' when 1 then '중간' else '높음' end"
_F = "with f as (select distinct * from findings), s as (select distinct * from spans), p as (select distinct doc_id, page_index from s)"


def _star(n: str) -> str:
    return f"repeat('*', greatest({n}, 0)::int)"


def _chars(v: str, keep: str) -> str:
    """The value with its letters and digits starred but where ``keep`` (on rank r of n) holds."""
    r = f"length(regexp_replace(substr({v}, 1, i - 1), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    n = f"length(regexp_replace({v}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
    cond = keep.replace("#r", r).replace("#n", n)
    return f"case when {v} is not null then coalesce(list_aggregate(list_transform(range(1, length({v}) + 1), lambda i: case when regexp_matches(substr({v}, i, 1), '{ALNUM}') and not ({cond}) then '*' else substr({v}, i, 1) end), 'string_agg', ''), '') end"


def masks(v: str) -> dict[str, str]:
    phone = rf"^(01[016789])(-?)({ND}{{3,4}})(-?)({ND}{{4}})$"
    rrn = rf"^({ND}{{6}})(-?)({ND}{{7}})$"
    local, at = f"split_part({v}, '@', 1)", f"instr({v}, '@')"
    keep = f"(case when length({local}) <= 1 then 0 else least(2, length({local}) - 1) end)"
    space = f"instr({v}, ' ')"
    full = f"regexp_replace({v}, '{ALNUM}', '*', 'g')"
    return {
        "name": f"case when {v} = '' then '' when length({v}) <= 2 then substr({v}, 1, 1) || '*' else substr({v}, 1, 1) || {_star(f'length({v}) - 2')} || substr({v}, -1) end",
        "phone": f"case when regexp_matches({v}, '{phone}') then regexp_extract({v}, '{phone}', 1) || regexp_extract({v}, '{phone}', 2) || {_star(f'''length(regexp_extract({v}, '{phone}', 3))''')} || regexp_extract({v}, '{phone}', 4) || regexp_extract({v}, '{phone}', 5) else {_star(f'length({v})')} end",
        "email": f"case when {v} = '' then '' else substr({local}, 1, {keep}) || {_star(f'length({local}) - {keep}')} || '@' || case when {at} > 0 then substr({v}, {at} + 1) else '' end end",
        "address": f"case when {space} = 0 then {_star(f'length({v})')} else substr({v}, 1, {space}) || regexp_replace(substr({v}, {space} + 1), '[^ ]', '*', 'g') end",
        "full": full,
        "account": _chars(v, "#r >= #n - 4"),
        "card": _chars(v, "#r < 4 or #r >= #n - 4"),
        "rrn": f"case when regexp_matches({v}, '{rrn}') then regexp_extract({v}, '{rrn}', 1) || regexp_extract({v}, '{rrn}', 2) || '*******' else {full} end",
    }


def mask_by_type(t: str, v: str, full: bool = False) -> str:
    m = masks(v)
    by = {D.NAME: m["name"], D.PHONE: m["phone"], D.EMAIL: m["email"], D.ADDRESS: m["address"], D.ACCOUNT: m["full" if full else "account"], D.CARD: m["full" if full else "card"], D.RRN: m["full" if full else "rrn"], D.PASSPORT: m["full"]}
    return "case " + " ".join(f"when {t} = '{k}' then {x}" for k, x in by.items()) + f" else {_star(f'length({v})')} end"


def classify(v: str) -> str:
    m = lambda p: f"regexp_full_match({v}, '{p}')"
    return (
        f"case when {m(PHONE)} then '{D.PHONE}' when {m(EMAIL)} then '{D.EMAIL}' when {m(RRN)} and {_rrn_ok(v)} then '{D.RRN}' when {m(PASSPORT)} then '{D.PASSPORT}' when {m(ACCOUNT)} then '{D.ACCOUNT}' "
        f"when {m(CARD)} then '{D.CARD}' when {m('[가-힣]{2,4}')} and {_IS_NAME.replace('value', v)} then '{D.NAME}' when regexp_matches({v}, '{REGION}') then '{D.ADDRESS}' else '{D.OTHER}' end"
    )


def masked_ctes(source: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    """The detection CTEs and ``masked``: each text with its findings masked, last start first."""
    return (
        detect_ctes(source, text, key)
        + f", mk as (select {key}, start_pos, emit, type, value, {mask_by_type('type', 'value')} as mask from det), "
        + f"fold as (select {key}, list({{'s': start_pos, 'n': length(value), 'm': mask}} order by start_pos desc, emit) as fs from mk group by {key}), "
        + f"masked as (select d.{key}, d.{text} as text, case when fs is null then d.{text} else list_reduce(list_prepend(d.{text}, list_transform(fs, lambda f: lpad(f.s::varchar, 9, '0') || lpad(f.n::varchar, 9, '0') || f.m)), "
        + f"lambda acc, f: substr(acc, 1, substr(f, 1, 9)::int) || substr(f, 19) || substr(acc, substr(f, 1, 9)::int + substr(f, 10, 9)::int + 1)) end as masked from {source} d left join fold using ({key}) where d.{text} is not null)"
    )


_MASKED = "with " + masked_ctes()


def _places(values: str) -> str:
    """Literal occurrences (doc_id, value, start_pos, end_pos) of the rows ``doc_id, value`` of ``values``: by splitting on the value."""
    return (
        f"(select doc_id, value, s as start_pos, s + length(value)::int as end_pos from (select *, (list_sum(list_transform(gs[1:i], lambda g: length(g))) + (i - 1) * length(value))::int as s from (select *, unnest(range(1, len(gs)))::int as i from "
        f"(select v.doc_id, v.value, string_split(d.text, v.value) as gs from (select distinct doc_id, value from {values}) v join documents d using (doc_id) where d.text is not null and v.value <> ''))))"
    )


def _bucket(v: str, size: str) -> str:
    return f"round_even({v} / {size} / 0.03, 0)::int"


_COVER = "(select f.*, s.span_id as s_span_id, s.span_ord as s_span_ord, s.page_index as s_page, s.bbox as s_bbox, s.start_pos as s_start, s.end_pos as s_end, s.text as s_text, s.origin as s_origin, s.fontsize as s_font, s.dir as s_dir from f join s on s.doc_id = f.doc_id and s.start_pos < f.end_pos and s.end_pos > f.start_pos where f.start_pos < f.end_pos and s.start_pos < s.end_pos)"
_PAGE_OF = "(select f.finding_id, any_value(f.doc_id) as doc_id, coalesce(arg_min(s.page_index, (s.span_ord, s.span_id)), 0)::int as page from f left join s on s.doc_id = f.doc_id and s.start_pos <= f.start_pos and s.end_pos > f.start_pos group by f.finding_id)"
_ROT = "(case when abs(dir.dx) >= abs(dir.dy) then case when dir.dx >= 0 then 0 else 180 end when dir.dy > 0 then 270 else 90 end)"
_WORDS = (
    "(select span_id, doc_id, page_index, value as word, (base + start_pos)::int as start_pos, (base + end_pos)::int as end_pos, "
    "case when abs(dir.dx) >= abs(dir.dy) then least(bx, ex) else bbox.x0 end as x0, case when abs(dir.dx) >= abs(dir.dy) then greatest(bx, ex) else bbox.x1 end as x1, "
    "case when abs(dir.dx) >= abs(dir.dy) then bbox.y0 else least(bby, ey) end as y0, case when abs(dir.dx) >= abs(dir.dy) then bbox.y1 else greatest(bby, ey) end as y1 from "
    "(select *, bx + length(value) * fontsize * 0.9 * dir.dx as ex, bby + length(value) * fontsize * 0.9 * dir.dy as ey from (select *, origin.x + start_pos * fontsize * 0.9 * dir.dx as bx, origin.y + start_pos * fontsize * 0.9 * dir.dy as bby from "
    + occ(r"[^ \t\n]+", "(select *, start_pos as base from s where bbox is not null)", "text", "span_id, doc_id, page_index, base, fontsize, origin, bbox, dir")
    + ")))"
)
_PAGES = "pg as (select doc_id, page_index, (doc_id + page_index) % 7 = 0 as has_annot, doc_id % 11 = 0 and page_index = 1 as has_widget, (doc_id % 13 = 0 and page_index = 0)::int as embfile_count, doc_id % 17 = 0 and page_index = 0 as has_ocg from p), hid as (select doc_id, page_index from pg where has_annot or has_widget or doc_id in (select doc_id from pg where embfile_count > 0 or has_ocg)), rot as (select doc_id, page_index from s group by all having bool_or(abs(dir.dy) > 0.01))"
_WIDTH, _HEIGHT = "(case when doc_id % 5 = 0 then 842.0::double else 595.0::double end)", "(case when doc_id % 5 = 0 then 595.0::double else 842.0::double end)"
_CENTRE = f"{_bucket('(s_bbox.x0 + s_bbox.x1) / 2', _WIDTH)} as xb, {_bucket('(s_bbox.y0 + s_bbox.y1) / 2', _HEIGHT)} as yb"
_ANCHORS = (
    f"with s as (select distinct * from spans where bbox is not null), f as (select doc_id, regexp_extract(value, '{LAYOUT_LABEL}', 1) as label, start_pos, end_pos from {occ(LAYOUT_LABEL)}), "
    f"c as (select doc_id, label, start_pos, arg_min({{'p': s_page, 'b': s_bbox}}, (s_span_ord, s_span_id)) as x from {_COVER} group by all), "
    f"an as (select distinct doc_id, x.p as page_index, label, {_CENTRE.replace('s_bbox', 'x.b')} from c)"
)
def _similar(docs: str) -> str:
    """CTEs ending in ``sim``: the anchor sets of ``docs`` against those of every document."""
    return (
        f"sh as (select d.doc_id, t.doc_id as template_id, count(*) as shared from {docs} d join an t using (page_index, label, xb, yb) group by all having count(*) >= 2), "
        f"sim as (select doc_id, template_id, shared, shared / (na + nt - shared) as score from sh join (select doc_id, count(*) as na from {docs} group by 1) using (doc_id) join (select doc_id as template_id, count(*) as nt from an group by 1) using (template_id))"
    )


_GOLD = (
    "with g0 as (select distinct case_id, marked_text from gold_cases where marked_text is not null), "
    f"g1 as (select case_id, case when value[1:2] = '{{{{' then '{D.NAME}' else '{D.ADDRESS}' end as type, substr(value, 3, length(value) - 4) as value, (start_pos - 4 * (ord - 1))::int as start_pos, (end_pos - 4 * ord)::int as end_pos from {occ(r'\{\{.*?\}\}|\[\[.*?\]\]', 'g0', 'marked_text', 'case_id')}), "
    r"pl as (select case_id, regexp_replace(marked_text, '\{\{(.*?)\}\}|\[\[(.*?)\]\]', '\1\2', 'g') as text from g0)"
)
_PRED = _GOLD + ", pr as (select distinct case_id, type, start_pos, (start_pos + length(value))::int as end_pos from (" + " union all ".join(f"select case_id, '{k}' as type, value, start_pos from ({rows})" for k, _, _, rows in _rules("pl", "text", "case_id") if k in (D.NAME, D.ADDRESS)) + "))"
_LAST_TS = (
    f"t as (select change_id, {trim('word')} as word, {trim('direction')} as direction, {trim('event')} as event, hit_count, {trim('ts')} as ts from promotion_log), "
    "z as (select distinct word, direction, event, change_id, hit_count, case when regexp_matches(ts, ':[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)$') then try_cast(ts as timestamptz) else try_cast(ts || '+09:00' as timestamptz) end as tsz from t where word <> '' and direction <> '' and event in ('반영', '정정', '취소') and change_id is not null)"
)
_EVENTS = f"e as (select distinct event_id, {trim('word')} as word, direction, case when regexp_matches({trim('ts')}, ':[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}(:?[0-9]{{2}})?)$') then try_cast({trim('ts')} as timestamptz) else try_cast({trim('ts')} || '+09:00' as timestamptz) end as tsz from candidate_events where {trim('word')} <> '' and direction in ('{D.EXCLUDE_DIRECTION}', '{D.NAME_DIRECTION}') and event_id is not null)"
_HELD = f"(direction = '{D.EXCLUDE_DIRECTION}' and word in {_list(D.EXCLUDE_WORDS)} or direction = '{D.NAME_DIRECTION}' and word in {_list(D.SURNAMES)})"
_LEARNED = f"(value not in {_list(D.EXCLUDE_WORDS)} and value not in (select word from w where direction = '{D.EXCLUDE_DIRECTION}') and (substr(value, 1, 1) in {_list(_ONE)} or substr(value, 1, 2) in {_list(_TWO)} or exists (select 1 from w where direction = '{D.NAME_DIRECTION}' and starts_with(value, word))))"
_P4 = (
    f"with {_LAST_TS}, o as (select *, (tsz, change_id) as seq from z where tsz is not null), "
    "s as (select word, direction, arg_max(event, seq) filter (event <> '정정') as last_set, max(seq) filter (event <> '정정') as set_at, arg_max(change_id, seq) as change_id from o group by all), "
    "h as (select o.word, o.direction, arg_max(o.hit_count, o.seq) filter (o.hit_count is not null or o.event = '반영') as hit_count from o join s using (word, direction) where o.seq >= s.set_at group by all) "
)


def _renamed(ctes: str) -> str:
    """The detection and masking CTEs under other names."""
    return re.sub(r"\b(raw0|once|lined|hot|bumped|ends|starts|repeats|extra|everything|det0|det|mk|fold)\b|\bmasked\b(?= as \(|$)", lambda m: f"{m[0]}_m", ctes)


def _again(source: str, text: str) -> str:
    return _renamed(detect_ctes(source, text))


def _rule(i: int) -> str:
    return f"select doc_id, value, start_pos, (start_pos + length(value))::int as end_pos from ({_rules()[i][3]})"


_M = masks("value")
_CODE = "(case when audit_id % 5 = 0 then audit_id % 9 else 0 end)::int"
_REASON = "case code when 0 then '완료' when 1 then '탐지 없음' when 2 then '취소' when 3 then '자체 검증 실패' when 4 then '이미 처리됨' when 5 then '오류' when 6 then '작업 폴더 오류' else '알 수 없음' end"
_ADDED = f"{_F}, a as (select doc_id, value, (start_pos + finding_id % 2)::int as start_pos, (end_pos + finding_id % 2)::int as end_pos from f where value <> '')"
_ORDER = "start_pos, emit_ord, finding_id"

ORACLE = {
    "flagship": _MASKED + ", e as (select d.doc_type, det.type, substr(m.masked, det.start_pos + 1, length(det.value)) = det.value as kept from det join masked m using (doc_id) join documents d using (doc_id)) select doc_type, type, count(*) as n_findings, count(*) filter (kept) as n_left from e group by all",
    "d1_phone": _rule(0), "d2_email": _rule(1), "d3_rrn": _rule(2), "d5_passport": _rule(3), "d6_account": _rule(4), "d7_card": _rule(5), "n7_address": _rule(9),
    "d4_rrn_checksum": f"select distinct value, {_rrn_ok('value')} as valid from {occ(RRN)}",
    "d8_line_span": f"select doc_id, start_pos, {_line_start('t', 'start_pos')} as line_start, {_line_end('t', 'start_pos')} as line_end from {occ(PHONE)}",
    "d9_classify": f"select distinct value, {classify('value')} as kind from findings where value is not null",
    "d10_occurrences": "select * from " + _places("(select * from findings where value <> '')"),
    "n1_after_labels": f"select doc_id, value, start_pos from {_after(D.NAME_LABELS)}",
    "n2_surname_word": f"select distinct value, {_IS_NAME} as is_name from {_after(D.NAME_LABELS)}",
    "n6_names": f"with r as ({' union all '.join(f'select doc_id, {i} as rule, ord, value, start_pos, {conf} as conf, {chr(39)}{g}{chr(39)} as grp from ({rows})' for i, (k, conf, g, rows) in enumerate(_rules()) if k == D.NAME)}) select doc_id, value, start_pos, grp, {LEVEL} as confidence from r qualify row_number() over (partition by doc_id, start_pos, length(value) order by rule, ord) = 1",
    "n8_hints": DETECT + f", h as (select doc_id, '{D.RRN}(추정)' as type, value, start_pos, end_pos from {occ(RRN)} where not {_rrn_ok('value')} union all select doc_id, '{D.ACCOUNT}(추정)', value, start_pos, end_pos from {occ(ACCOUNT)} union all select doc_id, '{D.CARD}(추정)', value, start_pos, end_pos from {occ(CARD)} where {_FREE}) select doc_id, type, value, start_pos, '{D.GROUP_HINT}' as grp from h where not exists (select 1 from det d where d.doc_id = h.doc_id and d.start_pos = h.start_pos and d.end_pos = h.end_pos)",
    "g1_union": f"with {detect_ctes().split(', once as')[0]}, nm as (select * from raw0 where type <> '{D.NAME}' union all select * from raw0 where type = '{D.NAME}' qualify row_number() over (partition by doc_id, start_pos, end_pos order by rule, ord) = 1) select doc_id, (row_number() over (partition by doc_id order by rule, ord) - 1)::int as emit_ord, type, value, start_pos, grp from nm",
    "g2_first_of_span": _F + " select finding_id, doc_id, start_pos, end_pos from f qualify row_number() over (partition by doc_id, start_pos, end_pos order by emit_ord, finding_id) = 1",
    "g3_document_order": _F + f" select finding_id, (row_number() over (partition by doc_id order by {_ORDER}))::int as position from f",
    "g4_review_order": _F + f" select finding_id, (row_number() over (partition by doc_id order by coalesce(confidence_ord, -1), {_ORDER}))::int as review_position from f",
    "g5_next_unconfirmed": _F + f", o as (select *, row_number() over (partition by doc_id order by {_ORDER}) as rn from f), u as (select * from o where confidence is distinct from '높음') select o.doc_id, o.finding_id, coalesce(arg_min(u.finding_id, u.rn) filter (u.rn > o.rn), arg_min(u.finding_id, u.rn)) as next_id from o left join u on u.doc_id = o.doc_id group by all",
    "g6_counts_by_type": _F + " select doc_id, type, count(*) as n from f where approved group by all",
    "g7_findings_per_page": _F + f" select doc_id, page, count(*) as n from {_PAGE_OF} group by all",
    "g8_history": "select audit_id, logged_at, processor, original_filename, output_filename, masked_counts, review_seconds, case when rotated_text_warning then '⚠ 있음' else '' end as rotated_text, case when hidden_content_warning then '⚠ 있음' else '' end as hidden_content from audit_log",
    "g9_originals": r"with k as (select distinct original_filename as name from archived_keys where original_filename is not null), a as (select distinct original_filename as f, regexp_extract(original_filename, '^(.+?)(\.[^.]*)?$', 1) as stem, regexp_extract(original_filename, '^(.+?)(\.[^.]*)?$', 2) as suffix from audit_log where original_filename is not null), m as (select f, coalesce(min(case when name = f then name end), min(case when starts_with(name, stem) and ends_with(name, suffix) and length(name) >= length(stem) + length(suffix) then name end)) as kept_as from a join k on starts_with(k.name, a.stem) group by f) select audit_id, original_filename, kept_as from audit_log left join m on f = original_filename",
    "g10_recent_promotions": f"with {_LAST_TS}, v as (select distinct word, direction, event, change_id, tsz from z where tsz is not null and event <> '정정'), l as (select word, direction, tsz, event from v qualify row_number() over (partition by word, direction order by tsz desc, change_id) = 1) select word, direction, epoch_us(tsz) as promoted_us from l where event = '반영' and tsz >= (select max(tsz) from v) - interval 7 days order by tsz desc, word, direction limit 5",
    "g11_batch_summary": f"select code, count(*) as files, {_REASON} as reason from (select {_CODE} as code from audit_log) group by code",
    "g12_accuracy": _PRED + ", j as (select coalesce(g.type, p.type) as type, g.case_id is not null as g, p.case_id is not null as p from (select distinct case_id, type, start_pos, end_pos from g1) g full join pr p on p.case_id = g.case_id and p.type = g.type and p.start_pos = g.start_pos and p.end_pos = g.end_pos), n as (select type, count(*) filter (g and p) as hits, count(*) filter (p) as predicted, count(*) filter (g) as gold from j group by 1) select *, case when predicted > 0 then hits / predicted else 'nan'::double end as precision, case when gold > 0 then hits / gold else 'nan'::double end as recall from n",
    "g12_misses": _PRED + " select case_id, type, start_pos, end_pos, value from g1 g where not exists (select 1 from pr p where p.case_id = g.case_id and p.type = g.type and p.start_pos = g.start_pos and p.end_pos = g.end_pos)",
    "g13_trust_report": _F + f", x as (select strftime(d.received_at, '%Y-%m-%d') as day, strftime(date_trunc('week', d.received_at), '%Y-%m-%d') as week, strftime(d.received_at, '%Y-%m') as month, d.doc_type, f.doc_id, count(*) as n, count(*) filter (approved) as kept, count(*) filter (not approved and coalesce(f.source, '') <> '{D.SOURCE_MANUAL}') as unchecked, count(*) filter (f.source = '{D.SOURCE_MANUAL}') as manual from f join documents d using (doc_id) group by all), "
    "y as (" + " union all ".join(f"select '{t}' as span, {t} as start, {b} as by_type, doc_type, n, kept, unchecked, manual from x" for t in ("day", "week", "month") for b in ("true",)) + " union all " + " union all ".join(f"select '{t}' as span, {t} as start, false as by_type, null as doc_type, n, kept, unchecked, manual from x" for t in ("day", "week", "month")) + " union all select 'all', null, false, null, n, kept, unchecked, manual from x) "
    "select span, start, by_type, doc_type, count(*) as documents, sum(n)::bigint as findings, sum(kept) / sum(n) as kept_share, sum(unchecked) / sum(n) as unchecked_share, sum(manual) / count(*) as manual_per_document from y group by all",
    "x_detect_all": DETECT + f" select doc_id, type, value, start_pos, end_pos, grp, {LEVEL} as confidence, conf as confidence_ord, crossed as cross_validated, '{D.SOURCE_AUTO}' as source, emit as emit_ord from det",
    "x1_bumped_names": DETECT + f" select doc_id, value, start_pos, grp, {LEVEL} as confidence from det where crossed and grp <> '{D.GROUP_CROSS}'",
    "x2_candidates": "with tw as (select doc_id, text || chr(10) || '성명: 김가람' || chr(10) || '성명: 쀼룽이' || chr(10) as text from documents where text is not null), " + detect_ctes("tw") + f" select doc_id, value, start_pos from det where grp = '{D.GROUP_CROSS}'",
    "m1_m8_masks": "select value, " + ", ".join(f"{x} as as_{k}" for k, x in _M.items()) + " from (select distinct value from findings where value <> '')",
    "m9_mask_by_type": _F + f" select finding_id, type, {mask_by_type('type', 'value')} as mask from f",
    "m10_full_policy": _F + f" select finding_id, {mask_by_type('type', 'value', True)} as mask from f where type in {_list([D.ACCOUNT, D.CARD, D.RRN])}",
    "m11_masked_text": _MASKED + " select doc_id, masked from masked",
    "l1_spans_covering": _F + f" select finding_id, s_span_id as span_id from {_COVER}",
    "l2_page_of": _F + f" select finding_id, page from {_PAGE_OF}",
    "l3_rect_plans": _F + f", c as (select *, greatest(start_pos, s_start) as lo, least(end_pos, s_end) as hi, {_ROT.replace('dir.', 's_dir.')} as rotate from {_COVER}), w as (select *, s_origin.x + (lo - s_start) * s_font * 0.9 * s_dir.dx as bx, s_origin.y + (lo - s_start) * s_font * 0.9 * s_dir.dy as bby, (hi - lo) * s_font * 0.9 as sw from c) select finding_id, s_span_id as span_id, s_page as page_index, lo - start_pos as seg_lo, hi - start_pos as seg_hi, rotate, round(bx, 3) as baseline_x, round(bby, 3) as baseline_y, round(case when rotate in (0, 180) then least(bx, bx + sw * s_dir.dx) else s_bbox.x0 end, 3) as x0, round(case when rotate in (0, 180) then s_bbox.y0 else least(bby, bby + sw * s_dir.dy) end, 3) as y0, round(case when rotate in (0, 180) then greatest(bx, bx + sw * s_dir.dx) else s_bbox.x1 end, 3) as x1, round(case when rotate in (0, 180) then s_bbox.y1 else greatest(bby, bby + sw * s_dir.dy) end, 3) as y1 from w",
    "l4_rotation": _F + f" select span_id, {_ROT}::int as rotate from s",
    "l5_click_word": _F + f", w as (select * from {_WORDS}), c as (select span_id as click_id, doc_id, page_index, bbox.x0 + span_id % 90 as px, (bbox.y0 + bbox.y1) / 2 as py from s where bbox is not null) select click_id, word, start_pos from (select c.click_id, w.*, c.px from c join w using (doc_id, page_index) where px between x0 and x1 and py between y0 and y1) qualify row_number() over (partition by click_id order by abs(x0 - px), start_pos, span_id) = 1",
    "l6_drag_region": _F + f", w as (select * from {_WORDS}), g as (select span_id as drag_id, doc_id, page_index, bbox.x0 as rx0, bbox.y0 as ry0, bbox.x0 + 60 + span_id % 100 as rx1, bbox.y1 as ry1 from s where bbox is not null), i as (select drag_id, start_pos, end_pos, least(x1, rx1) - greatest(x0, rx0) as iw, least(y1, ry1) - greatest(y0, ry0) as ih, greatest((x1 - x0) * (y1 - y0), 1e-6) as area from g join w using (doc_id, page_index)) select drag_id, min(start_pos) as start_pos, max(end_pos) as end_pos from i where iw > 0 and ih > 0 and iw * ih / area >= 0.5 group by 1",
    "l7_rotated_pages": _F + f", {_PAGES} select * from rot",
    "l8_hidden_content_pages": _F + f", {_PAGES} select * from hid",
    "l9_approval_gate": _F + f", {_PAGES}, wn as (select * from hid union select * from rot), x as (select p.doc_id, (p.doc_id + p.page_index) % 3 = 0 as unseen, w.doc_id is not null as warned, (p.doc_id + p.page_index) % 3 <> 0 and p.doc_id % 2 = 0 as opened from p left join wn w on w.doc_id = p.doc_id and w.page_index = p.page_index) select doc_id, count(*) filter (unseen) as unseen_pages, count(*) filter (warned and not opened) as unopened_warnings, count(*) filter (unseen) = 0 and count(*) filter (warned and not opened) = 0 as may_approve from x group by 1",
    "l10_redaction_plan": _F + f", x as (select f.*, d.text, {mask_by_type('f.type', 'f.value')} as mask from f left join documents d using (doc_id) where approved) select finding_id, mask, coalesce(substr(text, start_pos + 1, end_pos - start_pos) = value and length(mask) = length(value), false) as mapped from x",
    "t3_label_before": f"with f as (select distinct * from findings) select finding_id, coalesce(regexp_extract_all(substr(d.text, {_line_start('d.text', 'start_pos')} + 1, start_pos - {_line_start('d.text', 'start_pos')}), '{LAYOUT_LABEL}', 1)[-1], '') as label from f join documents d using (doc_id) where d.text is not null",
    "t4_item_positions": f"with f as (select distinct * from findings), s as (select distinct * from spans where bbox is not null), c as (select finding_id, any_value(doc_id) as doc_id, arg_min({{'p': s_page, 'b': s_bbox}}, (s_span_ord, s_span_id)) as x from {_COVER} group by 1) select finding_id, x.p as page_index, {_CENTRE.replace('s_bbox', 'x.b')} from c",
    "t5_signatures": _ANCHORS + " select * from an",
    "t6_similarities": _ANCHORS + ", " + _similar("an") + " select * from sim",
    "t7_best_match": _ANCHORS + ", cut as (select * from an where label <> '성명'), " + _similar("cut") + " select doc_id, template_id, score from sim where score >= 0.6 qualify row_number() over (partition by doc_id order by score desc, template_id) = 1",
    "u1_promotions": f"with {_EVENTS} select word, direction, event_id from e where tsz is not null and not {_HELD} qualify row_number() over (partition by word, direction order by tsz, event_id) = 3",
    "u2_epochs": f"with {_LAST_TS}, {_EVENTS}, c as (select word, direction, max(tsz) as cut from z where event = '취소' group by all) select e.word, e.direction, count(*) as n_since, count(*) >= 3 and not bool_or({_HELD.replace('word', 'e.word').replace('direction', 'e.direction')}) as promote from e left join c using (word, direction) where e.tsz is not null and (cut is null or e.tsz > cut) group by all",
    "u5_learned_names": _P4 + f", w as (select word, direction from s where last_set = '반영'), r as ({' union all '.join(f'select doc_id, {i} as rule, ord, value, start_pos, {chr(39)}{g}{chr(39)} as grp from ({rows.replace(_IS_NAME, _LEARNED)})' for i, (k, _, g, rows) in enumerate(_rules()) if k == D.NAME)}) select doc_id, value, start_pos, grp from r qualify row_number() over (partition by doc_id, start_pos, length(value) order by rule, ord) = 1",
    "u3_learning_signals": _F + f" select doc_id, finding_id, case when source = '{D.SOURCE_MANUAL}' then substr(value, 1, 1) else value end as word, case when source = '{D.SOURCE_MANUAL}' then '{D.NAME_DIRECTION}' else '{D.EXCLUDE_DIRECTION}' end as direction from f where type = '{D.NAME}' and value <> '' and ((source = '{D.SOURCE_AUTO}' and not approved) or source = '{D.SOURCE_MANUAL}')",
    "r1_apply_decisions": _F + " select f.finding_id, case when exists (select 1 from f g where g.source = '자동' and g.doc_id = f.doc_id and g.start_pos = f.start_pos and g.end_pos = f.end_pos) then f.start_pos % 2 = 0 else true end as approved from f",
    "r2_set_all": _F + " select finding_id, case when exists (select 1 from documents d where d.doc_id = f.doc_id and d.doc_type = '민원') then f.doc_id % 2 = 0 else approved end as approved from f",
    "r3_same_value": _F + f", k as (select doc_id, value from f where value <> '' and type is not null) select doc_id, value, start_pos, grp, source from f where exists (select 1 from k where k.doc_id = f.doc_id and k.value = f.value) union all select doc_id, value, start_pos, '{D.GROUP_SAME_VALUE}', '{D.SOURCE_MANUAL}' from {_places('k')} o where not exists (select 1 from f where f.doc_id = o.doc_id and f.start_pos = o.start_pos and f.end_pos = o.end_pos)",
    "r4_manual_additions": _ADDED + f" select doc_id, value, start_pos, {classify('value')} as type, exists (select 1 from f where f.doc_id = a.doc_id and f.start_pos = a.start_pos and f.end_pos = a.end_pos) as refused from a",
    "r4_retyped": _ADDED + f", n as (select doc_id, start_pos, end_pos, min({classify('value')}) as nt from a group by all), o as (select doc_id, start_pos, end_pos, min(type) as ot from f group by all) select doc_id, start_pos, end_pos, coalesce(nt, ot) as type from n full join o using (doc_id, start_pos, end_pos)",
    "r5_search": _F + f", q as (select doc_id, ['담당', '010-', '원'][doc_id % 3 + 1] as value from documents) select doc_id, value, start_pos, end_pos, not exists (select 1 from f where f.doc_id = o.doc_id and f.start_pos = o.start_pos and f.end_pos = o.end_pos) as checked from {_places('q')} o",
    "r6_undo_redo": "with recursive " + _F[5:] + ", a as (select doc_id, row_number() over (partition by doc_id order by finding_id) as i, case when finding_id % 5 = 3 then 'undo' when finding_id % 7 = 5 then 'redo' else 'set' end as kind, {'n': finding_id, 't': finding_id % 4, 'a': finding_id % 3 = 0} as x from f where doc_id is not null), "
    "st as (select distinct doc_id, 0::bigint as i, [x][1:0] as done, [x][1:0] as undone from a union all select a.doc_id, a.i, case kind when 'undo' then done[1:greatest(len(done) - 1, 0)] when 'redo' then done || undone[len(undone):len(undone)] else list_append(done, x) end, "
    "case kind when 'undo' then undone || done[len(done):len(done)] when 'redo' then undone[1:greatest(len(undone) - 1, 0)] else undone[1:0] end from st join a on a.doc_id = st.doc_id and a.i = st.i + 1), "
    "l as (select doc_id, unnest(arg_max(done, i)) as e from st group by 1) select doc_id, e.t as target, arg_max(e.a, e.n) as approve from l group by all",
    "r7_deleted": _F + " select finding_id from f where source is distinct from '수동'",
    "r8_retry": _F + " select finding_id from f where exists (select 1 from f g where not g.approved and g.doc_id = f.doc_id and g.value = f.value)",
    "v1_leftovers": _MASKED + " select d.doc_id, d.type, d.value, d.start_pos from det d join masked m using (doc_id) where substr(case when d.doc_id % 10 = 0 then m.text else m.masked end, d.start_pos + 1, length(d.value)) = d.value",
    "v4_byte_residue": _MASKED + " select distinct d.doc_id, d.type, d.value from det d join masked m using (doc_id) where contains(m.masked, d.value)",
    "v3_hidden": f"with h as (select finding_id as hid, '메모: 연락처 010-9999-8888, ' || coalesce(type, '기타') || ': ' || coalesce(value, '') as content from (select distinct * from findings)), {masked_ctes('h', 'content', 'hid')} select hid as ord, (select count(*) from det d where d.hid = m.hid)::int as n_found, masked, not exists (select 1 from det d where d.hid = m.hid and contains(m.masked, d.value)) as clean from masked m",
    "v3_redetected": _MASKED + ", " + _again("masked", "masked") + " select type, count(*) as n from det_m group by 1",
    "v5_gate": _MASKED + f", f as (select distinct * from findings), x as (select f.*, d.text, {mask_by_type('f.type', 'f.value')} as mask from f left join documents d using (doc_id) where approved), u as (select doc_id, count(*) as unmapped from x where not coalesce(substr(text, start_pos + 1, end_pos - start_pos) = value and length(mask) = length(value), false) group by 1), l as (select d.doc_id, count(*) as left_over from det d join masked m using (doc_id) where substr(m.masked, d.start_pos + 1, length(d.value)) = d.value group by 1), "
    f"r as (select d.doc_id, count(distinct (d.type, d.value)) as residue from det d join masked m using (doc_id) where contains(m.masked, d.value) group by 1), h as (select finding_id as hid, doc_id as of, '메모: 연락처 010-9999-8888, ' || coalesce(type, '기타') || ': ' || coalesce(value, '') as content from f), {_renamed(masked_ctes('h', 'content', 'hid'))}, hu as (select h.of as doc_id, count(*) as unclean_hidden from h join masked_m m using (hid) where exists (select 1 from det_m d where d.hid = m.hid and contains(m.masked, d.value)) group by 1) "
    "select doc_id, coalesce(unmapped, 0) as unmapped, coalesce(left_over, 0) as left_over, coalesce(residue, 0) as residue, coalesce(unclean_hidden, 0) as unclean_hidden, unmapped is null and left_over is null and residue is null and unclean_hidden is null as publish from documents left join u using (doc_id) left join l using (doc_id) left join r using (doc_id) left join hu using (doc_id)",
    "s1_rebuild_text": _F + " select doc_id, page_index, string_agg(text, chr(10) order by span_ord, span_id) || chr(10) as text from s where text <> '' group by all",
    "s2_page_sizes": _F + f" select doc_id, page_index, {_WIDTH} as width, {_HEIGHT} as height from p",
    "s3_dictionary": f"select distinct {trim('word')} as word from candidate_events where {trim('word')} <> ''",
    "s4_audit_log": "select logged_at as timestamp, processor, original_filename, original_sha256, output_filename, masked_counts, coalesce(rotated_text_warning, false) as rotated_text_warning, coalesce(hidden_content_warning, false) as hidden_content_warning, review_seconds from audit_log",
    "s5_learning_logs": "select word, direction, '후보' as event, count(*) as n from candidate_events group by all union all select word, direction, event, count(*) from promotion_log group by all",
    "s8_failure_reason": "select audit_id, case audit_id % 6 when 0 then '매크로 보안 경고로 자동화가 차단됨' when 1 then '비밀번호로 잠긴 파일' when 2 then '한/글이 이미 다른 작업으로 사용 중' when 3 then '손상되었거나 지원하지 않는 파일 형식' when 4 then '손상되었거나 지원하지 않는 파일 형식' else '변환 실패 (원인 미분류, 로그 확인 필요): timeout' end as reason from audit_log",
    "s10_gold_spans": _GOLD + " select * from g1",
    "k1_audit_rows": _F + " select a.audit_id, string_agg(type || ':' || n, ';' order by type) as masked_counts from audit_log a join (select doc_id, type, count(*) as n from f where approved and type is not null group by all) c on c.doc_id = a.audit_id group by 1",
    "k2_parse_counts": "select audit_id, split_part(p, ':', 1) as type, split_part(p, ':', 2)::bigint as n from (select audit_id, unnest(string_split(masked_counts, ';')) as p from audit_log) where regexp_full_match(p, '[^:]+:[0-9]+')",
    "k3_content_hash": "select doc_id, sha256(text) as sha256 from documents",
    "k4_summary": "with p as (select audit_id, string_agg('  - ' || split_part(p, ':', 1) || ': ' || split_part(p, ':', 2) || '건', chr(10) order by i) as l from (select audit_id, unnest(string_split(masked_counts, ';')) as p, unnest(range(len(string_split(masked_counts, ';')))) as i from audit_log) where p <> '' group by 1), w as (select *, concat_ws(chr(10), case when rotated_text_warning then '  - ⚠ 회전된 텍스트가 있습니다. 자동 탐지가 놓쳤을 수 있으니 육안으로 재확인하세요.' end, case when hidden_content_warning then '  - ⚠ 주석/폼필드/첨부파일 등 숨겨진 콘텐츠가 있습니다. 별도 확인이 필요합니다.' end) as warn from audit_log) select audit_id, '처리 결과 요약' || chr(10) || '================' || chr(10) || '원본 파일명 : ' || coalesce(original_filename, '') || chr(10) || '처리일시    : ' || coalesce(logged_at, '') || chr(10) || '처리자      : ' || coalesce(processor, '') || chr(10) || '결과물 파일명: ' || coalesce(output_filename, '') || chr(10) || '마스킹 유형별 건수:' || chr(10) || coalesce(l, '  (없음)') || chr(10) || case when warn = '' then '' else chr(10) || '경고 사항:' || chr(10) || warn || chr(10) end as report from w left join p using (audit_id)",
    "k5_output_names": r"""with u as (select regexp_extract(output_filename, '^.+_(\d{8})_(\d{3,})\.pdf$', 1) as day, try_cast(regexp_extract(output_filename, '^.+_(\d{8})_(\d{3,})\.pdf$', 2) as int) as n from audit_log), t as (select day, max(n) as top from u where day <> '' group by 1), b as (select doc_id, doc_type, strftime(received_at, '%Y%m%d') as day from documents where received_at is not null), x as (select b.*, (coalesce(top, 0) + row_number() over (partition by day order by doc_id))::int as serial from b left join t using (day)) select doc_id, day, serial, coalesce(doc_type, '기타') || '_' || day || '_' || case when serial < 1000 then lpad(serial::varchar, 3, '0') else serial::varchar end || '.pdf' as output_filename from x""",
    "k6_unique_names": r"""with x as (select audit_id as id, trim(original_filename) as name, regexp_extract(trim(original_filename), '^(.+?)(\.[^.]*)?$', 1) as stem, regexp_extract(trim(original_filename), '^(.+?)(\.[^.]*)?$', 2) as suffix from audit_log where original_filename is not null), e as (select distinct trim(original_filename) as name from archived_keys where original_filename is not null), """
    r"""n as (select x.*, row_number() over (partition by name order by id) - (case when name in (select name from e) then 0 else 1 end) as k from x), g as (select name, any_value(stem) as stem, any_value(suffix) as suffix, max(k) as most from n group by 1), free as (select name, i, row_number() over (partition by name order by i) as k from (select g.name, stem, suffix, unnest(range(1, most + 1000))::bigint as i from g where most > 0) q where stem || '(' || i || ')' || suffix not in (select name from e)) """
    "select id, case when k = 0 then n.name else stem || '(' || i || ')' || suffix end as dest from n left join free using (name, k)",
    "k7_already_processed": "select audit_id, audit_id % 3 = 0 or audit_id % 4 = 0 as processed from audit_log",
    "k8_processor": "select audit_id, coalesce(nullif(trim(processor), ''), 'user') as processor from audit_log",
    "p4_found": _P4 + "select word, direction, change_id from s where last_set = '반영'",
    "p4_state": _P4 + "select word, direction, change_id, hit_count from s join h using (word, direction) where last_set = '반영'",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
