"""The registered queries as SQL for an independent engine.

The report texts (F2) are built from templates, so their protected tokens are known
from the way the texts are put together; the SQL lists them instead of searching. Tokens
of free text need look-arounds and priorities, which this SQL does not have: those two
queries are compared with a plain scan in the tests.
"""

from __future__ import annotations

import re

from segqa import fixtures as fx
from segqa.functions.rules import PHRASE_RULES
from segqa.functions.usage import INPUT_NAMES, OUTPUT_NAMES, TOTAL_NAMES, USAGE_PATHS
from segqa.operators import memory
from segqa.operators.reports import METRICS
from segqa.sources.languages import LANGUAGES


def lit(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ",".join(lit(v) for v in values) + "]::varchar[]"


def norm(column: str) -> str:
    return rf"trim(regexp_replace(coalesce({column},''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def strip(column: str) -> str:
    return rf"regexp_replace({column}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def short(column: str, n: int) -> str:
    t = norm(column)
    return f"case when length({t}) <= {n} then {t} else left({t}, {n}) || '…' end"


def words(column: str) -> str:
    return rf"string_split_regex({column}, '[^\p{{L}}\p{{N}}_]+')"


# Token templates: literal text, or (kind, text, normalized) with SQL expressions.

_DATE = "regexp_extract(source_text, 'issued ([0-9-]+)', 1)"
_CAS = "cast(100 + c % 900 as varchar) || '-' || lpad(cast(o % 100 as varchar), 2, '0') || '-' || cast(o % 7 as varchar)"
_LIMIT = ("cast(1 + c % 9 as varchar)", "lpad(cast(o % 1000 as varchar), 3, '0')")


def _cents(extra: str = "0") -> str:
    return f"lpad(cast((c + {extra}) % 100 as varchar), 2, '0')"


_OFF = "case when c % 11 = 0 then 1 else 0 end"
_ISSUED = f"cast({_DATE} as varchar)"
_A, _B = "cast(o % 60 as varchar)", "cast(1 + c % 10 as varchar)"
_STD = "'EN 1186-' || cast(1 + o % 15 as varchar)"
_STD_N = "'EN1186-' || cast(1 + o % 15 as varchar)"
_SECTION = "'1.' || cast(c % 9 as varchar)"
_REG = "'Regulation (EU) No 10/2011'"

SOURCE = {
    1: ["'Overall migration was '", ("comparator", "'<'", "'<'"), "' '", ("number", _A, _A), "' '",
        ("unit", "'mg/dm²'", "'mg/dm2'"), "' at '", ("number", "'40'", "'40'"), ("unit", "'°C'", "'°c'"), "' for '",
        ("number", _B, _B), "' '", ("unit", "'days'", "'days'"), "'.'"],
    2: ["'Specific migration was below '", ("number", f"'0.' || {_cents()}", f"'0.' || {_cents()}"), "' '",
        ("unit", "'mg/kg'", "'mg/kg'"), "' per '", ("standard", _STD, _STD_N), "'.'"],
    3: ["'CAS '", ("cas", _CAS, _CAS), "' was not detected, '", ("abbreviation", "'LOQ'", "'LOQ'"), "' '",
        ("number", "'0.01'", "'0.01'"), "' '", ("unit", "'mg/kg'", "'mg/kg'"), "'.'"],
    4: ["'Limit '", ("number", f"{_LIMIT[0]} || ',' || {_LIMIT[1]} || '.50'", f"{_LIMIT[0]} || '.' || {_LIMIT[1]} || '.50'"),
        "' '", ("unit", "'ppm'", "'ppm'")],
    6: ["'Result '", ("number", "cast(c % 20 as varchar)", "cast(c % 20 as varchar)"), "' '", ("unit", "'mg/kg'", "'mg/kg'")],
    7: [("regulation", _REG, "'REGULATION(EU)NO10/2011'"), "', issued '", ("date", _ISSUED, _ISSUED), "', see section '",
        ("number", _SECTION, _SECTION), "' below.'"],
}
_SIGN = "case when c % 6 = 0 then '' else '<' end"
TARGET = {
    1: ["'Migracja globalna była '", ("comparator", _SIGN, _SIGN), "case when c % 6 = 0 then '' else ' ' end",
        ("number", _A, _A), "' '", ("unit", "'mg/dm²'", "'mg/dm2'"), "' w temperaturze '", ("number", "'40'", "'40'"),
        ("unit", "'°C'", "'°c'"), "' przez '", ("number", _B, _B), "' '", ("unit", "'days'", "'days'"), "'.'"],
    2: ["case when c % 7 = 0 then 'Ogólna migracja' else 'Migracja specyficzna' end", "' była poniżej '",
        ("number", f"'0,' || {_cents(_OFF)}", f"'0.' || {_cents(_OFF)}"), "' '", ("unit", "'mg/kg'", "'mg/kg'"), "' per '",
        ("standard", _STD, _STD_N), "'.'"],
    3: ["'CAS '", ("cas", _CAS, _CAS), "case when c % 4 = 0 then ' wykryto' else ' nie wykryto' end", "', '",
        ("abbreviation", "'LOQ'", "'LOQ'"), "' '", ("number", "'0,01'", "'0.01'"), "' '", ("unit", "'mg/kg'", "'mg/kg'"), "'.'"],
    4: ["'Limit '", ("number", f"{_LIMIT[0]} || ' ' || {_LIMIT[1]} || ',50'", f"{_LIMIT[0]} || {_LIMIT[1]} || '.50'"),
        "' '", ("unit", "'ppm'", "'ppm'")],
    6: ["'Wynik '", ("number", "cast(c % 20 as varchar)", "cast(c % 20 as varchar)"), "' '", ("unit", "'mg/kg'", "'mg/kg'")],
    7: ["'Rozporządzenie (EU) No 10/2011, wydane '", ("date", _ISSUED, _ISSUED), "', patrz sekcja '",
        ("number", _SECTION, _SECTION), "'.'"],
}
_TOKEN = "struct(kind varchar, t varchar, n varchar, s bigint)[]"


def _token_list(templates: dict) -> str:
    cases = []
    for k, pieces in templates.items():
        before: list[str] = []
        items = []
        for piece in pieces:
            text = piece if isinstance(piece, str) else piece[1]
            if not isinstance(piece, str):
                start = f"length({' || '.join('(' + b + ')' for b in before)})" if before else "0"
                items.append(f"{{'kind': '{piece[0]}', 't': {piece[1]}, 'n': {piece[2]}, 's': {start}}}")
            before.append(text)
        cases.append(f"when {k} then [{', '.join(items)}]::{_TOKEN}")
    return f"list_filter(case k {' '.join(cases)} else []::{_TOKEN} end, lambda x: x.t <> '')"


def template_text(templates: dict) -> dict[int, str]:
    """SQL for the whole text of each template, to check the templates against the texts."""
    return {k: " || ".join(f"({p if isinstance(p, str) else p[1]})" for p in pieces) for k, pieces in templates.items()}


def _terms() -> str:
    rows = ",".join(
        f"({i},{lit(t.key)},{lit(t.source)},{lit(t.preferred)},{strings(t.alternatives)},{strings(t.forbidden)},"
        f"{str(t.retain_english or t.retain_english_on_first_use).lower()},{lit(t.preserve_abbreviation)},{lit(t.short_form)},"
        f"{strings([a.lower() for a in t.accepted])})"
        for i, t in enumerate(fx.terms())
    )
    return (
        "select * from (values " + rows + ") v(i, key, source, preferred, alternatives, forbidden, retain, "
        "preserve_abbreviation, short_form, accepted)"
    )


def _phrases() -> str:
    rows = ",".join(
        f"({lit(p[0])},{lit(p[1])},{lit(p[2])},{lit(p[3])},{lit(p[4])},{lit(p[5])},{i})" for i, p in enumerate(fx.PHRASES)
    )
    return f"select * from (values {rows}) v(sl, tl, source_text, replace_text, preferred_text, approved_text, stored_no)"


def _localized(x: str) -> str:
    """Decimal commas in the number forms that the report texts use."""
    one = rf"regexp_replace({x}, '(\d)\.(\d\d) mg/kg', '\1,\2 mg/kg')"
    return rf"regexp_replace({one}, 'Limit (\d),(\d\d\d)\.(\d\d) ppm', 'Limit \1 \2,\3 ppm')"


def _replaced(x: str) -> str:
    for t in sorted(fx.terms(), key=lambda t: -len(t.source)):
        x = f"regexp_replace({x}, {lit(t.source)}, {lit(t.preferred)}, 'gi')"
    return x


def _ruled(x: str) -> str:
    for phrase, new in PHRASE_RULES:
        x = rf"regexp_replace({x}, '\b{phrase}\b', {lit(new)}, 'gi')"
    return x


def _english(x: str) -> str:
    return rf"regexp_matches({x}, '(?i)\b(the|and|of|was|were|for|with|migration|detected|compliance)\b')"


def _same(a: str, b: str) -> str:
    return f"lower({strip(a)}) = lower({strip(b)})"


_SOURCE_NEG = f"len(list_filter({words('lower(source_text)')}, lambda x: x in ('no','not','none','without'))) > 0"
_TARGET_NEG = (
    f"len(list_filter({words('lower(translated_text)')}, "
    "lambda x: x in ('nie','brak','bez','żaden','zadna','żadna','niewykryto'))) > 0"
)
_CRIT = "kind not in ('abbreviation','formula')"
_MISSING_TYPE = (
    "case kind when 'number' then 'missing_number' when 'unit' then 'missing_unit' "
    "when 'comparator' then 'changed_comparator' else 'missing_reference' end"
)


def _token_issues(count: str) -> str:
    """Lost and added tokens from a table of counts per (segment, side, kind, normalized)."""
    return f"""
    select s.job_id, s.segment_id, case when s.{_CRIT} then 'critical' else 'warning' end as severity,
      {_MISSING_TYPE.replace('case kind', 'case s.kind')} as issue_type, s.txt as source_value, cast(null as varchar) as translated_value,
      'Chroniony element ''' || s.txt || ''' (' || s.kind || ') nie występuje w tłumaczeniu.' as message
    from {count} s left join {count} t on t.job_id = s.job_id and t.segment_id = s.segment_id and t.kind = s.kind
      and t.normalized = s.normalized and t.side = 'target'
    where s.side = 'source' and s.n > coalesce(t.n, 0)
    union all
    select t.job_id, t.segment_id, 'critical', 'unexpected_addition', null, t.txt,
      'Tłumaczenie dodało chroniony element ''' || t.txt || ''' (' || t.kind || '), którego nie było w źródle.'
    from {count} t left join {count} s on t.job_id = s.job_id and t.segment_id = s.segment_id and t.kind = s.kind
      and t.normalized = s.normalized and s.side = 'source'
    where t.side = 'target' and t.kind in ('number','unit','comparator') and t.n > coalesce(s.n, 0)"""


_COUNTS = "select job_id, segment_id, side, kind, normalized, count(*) as n, arg_min(text, ord) as txt from {tok} group by all"
_SCOPE_TESTS = memory.scope_hash({
    **memory.cache_scope(fx.CONFIG), "domain": "tests",
})

CTES: dict[str, str] = {
    "lines": f"""select doc_id // 20 as job_id, doc_id % 20 + 1 as page_number, doc_id, i - 1 as pos, {norm('line')} as source_text
      from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i
            from (select doc_id, string_split(text, chr(10)) as ls from documents))""",
    "f1": """select job_id, page_number, doc_id, pos, printf('p%03d-b%04d', page_number, pos) as segment_id,
      row_number() over (partition by job_id order by page_number, pos) - 1 as order_index, source_text
      from lines where source_text <> ''""",
    "f2": fx.F2_SQL.format(div="//", orders="orders"),
    "tok": f"""select job_id, segment_id, side, ord, x.kind as kind, x.t as text, x.n as normalized, x.s as start
      from (select job_id, segment_id, side, unnest(l) as x, generate_subscripts(l, 1) as ord from (
        select job_id, segment_id, 'source' as side, {_token_list(SOURCE)} as l from f2
        union all select job_id, segment_id, 'target', {_token_list(TARGET)} from f2))""",
    "cnt": _COUNTS.format(tok="tok"),
    "terms": _terms(),
    "used": """select job_id, segment_id, translated_text, lower(translated_text) as low, t.* from f2, terms t
      where contains(lower(f2.source_text), lower(t.source)) or contains(lower(f2.source_text), replace(t.key, '_', ' '))""",
    "v12": _token_issues("cnt"),
    "v3": f"""select job_id, segment_id, 'critical' as severity, 'missing_negation' as issue_type, source_text as source_value,
      translated_text as translated_value, 'Źródło zawiera negację, której nie widać w tłumaczeniu.' as message
      from f2 where {_SOURCE_NEG} and not ({_TARGET_NEG})""",
    "v5": """select job_id, segment_id, 'warning' as severity, 'untranslated_fragment' as issue_type, source as source_value,
      translated_text as translated_value,
      'Termin ''' || source || ''' nie używa zatwierdzonego odpowiednika ''' || preferred || '''.' as message
      from used where len(list_filter(accepted, lambda a: contains(low, a))) = 0""",
    "v6": """select job_id, segment_id, 'warning' as severity, 'forbidden_term' as issue_type, source as source_value, f as translated_value,
      'Termin ''' || f || ''' jest zabroniony dla ''' || source || '''.' as message
      from (select *, unnest(forbidden) as f from used) where contains(low, lower(f))""",
    "v7": "select * from v12 union all select * from v3 union all select * from v5 union all select * from v6",
    "f5": fx.F5_FINDINGS_SQL.format(pairs="f2"),
    "att": "select job_id, segment_id, 1 as n from f2 where o % 15 = 0",
    "trans": """select job_id, segment_id, translated_text, case when c % 9 = 0 then 'low' else 'high' end as confidence,
      o, c, k, source_text, order_index from f2""",
    "crit": "select distinct job_id, segment_id from v7 where severity = 'critical'",
    "flags": """select f2.job_id, f2.segment_id, f2.k, f2.block_type, f2.source_text, f2.order_index,
      cr.segment_id is not null as critical, coalesce(f.severity in ('critical','major'), false) as blocking,
      coalesce(f.severity in ('critical','major') and f.proposed_translation is not null and f.category <> 'user_phrase_memory'
        and f2.o % 15 <> 0, false) as revise
      from f2 left join crit cr using (job_id, segment_id) left join f5 f using (job_id, segment_id)""",
    "routes": """select job_id, segment_id, critical or (blocking and not revise) as unresolved, revise from flags
      where critical or blocking""",
    "unres": "select job_id, segment_id from routes where unresolved",
    "dec": f"""select job_id, segment_id,
        case when changed and action <> 'keep_source' then 'edit' when action in ('accept','edit','keep_source') then action else 'edit' end as action,
        edited_text as text, note
      from (select *, {norm('edited_text')} <> {norm('original_text')} as changed from ({fx.F5_DECISIONS_SQL.format(pairs='f2')}))
      where action in ('accept','edit','keep_source') or changed or note is not null""",
    "after": """select t.job_id, t.segment_id, t.order_index, d.action, d.note,
        case d.action when 'keep_source' then t.source_text when 'edit' then d.text else t.translated_text end as text,
        case d.action when 'keep_source' then 'Operator kept source text.' when 'edit' then 'Operator edited translation.'
          when 'accept' then 'Operator accepted translation.' end as label,
        case when d.action is null then t.confidence when d.action = 'keep_source' then 'medium' else 'high' end as confidence
      from trans t left join (select dec.* from dec join unres using (job_id, segment_id)) d using (job_id, segment_id)""",
    "refine": f"""select t.job_id, t.segment_id, t.translated_text as replace_text,
        coalesce(case when f.proposed_translation <> '' and lower(f.proposed_translation) <> lower(t.translated_text) then f.proposed_translation end,
          case when f.translation_evidence <> '' and not contains(lower(t.translated_text), lower(f.translation_evidence))
            and not contains(lower(f.translation_evidence), lower(t.translated_text)) then f.translation_evidence end, '') as preferred_text
      from trans t left join f5 f using (job_id, segment_id)""",
    # Reuse over the documents.
    "grp": """select job_id, source_text, arg_min(segment_id, order_index) filter (where doc_id % 10 = 0) as mem_id,
      min(order_index) filter (where doc_id % 10 <> 0) as first_at,
      arg_min(segment_id, order_index) filter (where doc_id % 10 <> 0) as first_id from f1 group by all""",
    "cache": """select source_text, min({'j': job_id, 's': segment_id}) as origin from f1 where doc_id % 10 = 1 group by source_text""",
    "routed": """select f1.*, mem_id, first_id, cache.origin as origin,
      case when doc_id % 10 = 0 then 'existing' when mem_id is not null then 'memory'
        when cache.origin is not null and order_index = first_at then 'persistent' when cache.origin is not null then 'memory'
        when order_index = first_at then 'miss' else 'duplicate' end as route
      from f1 join grp using (job_id, source_text) left join cache using (source_text)""",
    "reps": """select source_text, arg_min({'j': job_id, 's': segment_id}, {'j': job_id, 'o': order_index}) as rep
      from routed where route in ('miss','duplicate') group by source_text""",
    "reused": """select routed.* exclude (route), case when route = 'miss' and rep.j <> job_id then 'persistent' else route end as route
      from routed left join reps using (source_text)""",
    "log": fx.F7_SQL.format(events="events"),
    "stores": "select *, event_id % 3 = 0 as old from log where op = 'store'",
    "stored": """select cache_key, arg_max(translated_text, {'u': updated_at, 'e': event_id}) as text,
      arg_max(cast(user_id as varchar), {'u': updated_at, 'e': event_id}) as origin_job_id,
      arg_max(cast(event_id as varchar), {'u': updated_at, 'e': event_id}) as origin_segment_id,
      coalesce(min(updated_at) filter (where old), min(updated_at)) as created, max(updated_at) as updated
      from stores group by cache_key""",
    "plog": """select case when user_id % 3 = 0 then 'German' else 'Polish' end as target_language, 'Fraza nr ' || (user_id % 40) as replace_text,
      case when event_id % 9 = 0 then 'FRAZA NR ' || (user_id % 40) when event_id % 10 = 1 then '' else 'Better ' || event_type end as preferred_text,
      event_type as approved_text, translated_text as source_text, event_id, updated_at from log""",
    "pkeyed": """select *, sha256('english' || chr(0) || lower(target_language) || chr(0) || lower(replace_text)) as cache_key from plog""",
    "pstored": """select cache_key, target_language, replace_text, arg_max({'p': preferred_text, 'a': approved_text, 's': source_text, 'e': event_id},
      {'u': updated_at, 'e': event_id}) as l from pkeyed
      where preferred_text <> '' and lower(preferred_text) <> lower(replace_text) group by all""",
    "phr": _phrases(),
    "match": """select f2.job_id, f2.segment_id, f2.k, f2.source_text as src, f2.translated_text as tgt, p.replace_text, p.preferred_text, p.approved_text, p.stored_no,
      case when contains(lower(f2.translated_text), lower(p.replace_text)) then 'target_phrase' else 'source_exact' end as reason
      from f2 join phr p on p.tl = 'Polish' and not contains(lower(f2.translated_text), lower(p.preferred_text))
        and (contains(lower(f2.translated_text), lower(p.replace_text)) or (p.source_text <> '' and lower(p.source_text) = lower(f2.source_text)))""",
    "top5": "select * from (select *, row_number() over (partition by job_id, segment_id order by stored_no desc) as newest from match) where newest <= 5",
    "proposed": """select *, case when reason = 'source_exact' and approved_text <> '' then approved_text
      else regexp_replace(tgt, replace_text, preferred_text, 'i') end as proposal from top5""",
    "applied": "select job_id, segment_id, count(*) as n from proposed where proposal <> tgt group by all",
    "rulerev": f"""select job_id, segment_id, order_index, o, c, source_text, translated_text,
      case when c % 9 = 0 then 1 else 0 end as low, case when {_same('source_text', 'translated_text')} and {_english('source_text')} then 1 else 0 end as unchanged
      from f2""",
    "counts": """select job_id, sum(s)::bigint as segments, sum(t)::bigint as translations, sum(r)::bigint as reviews from (
        select job_id, 1 as s, 0 as t, 0 as r from f2 where job_id % 11 <> 10
        union all select job_id, 0, 1, 0 from f2 where job_id % 5 <> 1 or segment_id < 'p001-b0004'
        union all select job_id, 0, 0, 1 from f2 where job_id % 7 <> 2 or segment_id < 'p001-b0006') group by job_id""",
    "states": """select *, case when job_id % 4 = 0 then job_id % 3 else 0 end as unresolved, case when job_id % 6 = 0 then 1 else 0 end as revise,
      job_id % 13 = 0 as has_output,
      case job_id % 6 when 0 then 'translating 1/8' when 1 then 'reviewing 2/8' when 2 then 'pipeline translated 8/8' when 3 then 'completed'
        when 4 then 'needs_human_review' else 'findings_resolved' end as status from counts""",
    "ready": """select *, not has_output and unresolved = 0 and segments > 0 and translations >= segments and reviews >= segments
      and status not in ('completed','completed_with_output_warnings','needs_human_review') as is_ready from states""",
    "expected": "select job_id, segment_id, order_index, 'PL: ' || source_text as translated_text from f1",
    "outputs": """select job_id, string_agg(translated_text, ' ' order by order_index) || case when job_id % 7 = 0 then ' {{TOKEN_1}}' else '' end as text
      from expected where order_index % 13 <> 5 group by job_id""",
    "lost": f"""select e.job_id, e.segment_id from expected e join outputs o using (job_id)
      where length({norm('e.translated_text')}) > 2
        and not contains(lower({norm('o.text')}), left(lower({norm('e.translated_text')}), 40))""",
    "pv": """select job_id, segment_id, page_number, order_index, source_text, 'PL: ' || source_text as translated_text,
      row_number() over (partition by job_id order by order_index) as number, count(*) over (partition by job_id) as total
      from f1""",
    # Layout: lines are known from the way the words were placed.
    "w": """select doc_id, i - 1 as k, word from (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from (
        select doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda x: x <> '') as ws from documents))""",
    "f6": fx.F6_SQL.format(div="//", w="w"),
    "outside": """select * from f6 where not (page_number <= 3 and (x0 + x1) / 2 between 72 and 300 and (top + bottom) / 2 between 200 and 260)""",
    "ln": """select *, row_number() over (partition by doc_id, page_number order by true_line) - 1 as line_no from (
      select doc_id, page_number, true_line, count(*) as words, string_agg(word, ' ' order by x0) as text, min(x0) as x0, min(top) as top,
        max(x1) as x1, max(bottom) as bottom, median(size) as font_size, arg_min(fontname, x0) as font_name,
        bool_or(contains(lower(fontname), 'bold')) as is_bold from outside group by all)""",
    "pm": "select doc_id, page_number, median(font_size) as median_size from ln where font_size <> 0 group by all",
    "gridrows": """select o_orderkey // 15 as doc_id, row_number() over (partition by o_orderkey // 15 order by o_orderkey) as row_index,
      [cast(o_orderkey as varchar), case when o_orderkey % 4 = 0 then '  ' else o_orderpriority end, ' ' || o_orderstatus || '  x '] as cells from orders""",
    "allrows": """select * from gridrows union all select distinct doc_id, 0, ['Key','Priority',''] from gridrows""",
    "cells": f"""select doc_id, 'p001-t01' as table_id, printf('p001-t01-r%03d-c%03d', row_index, column_index) as segment_id, row_index, column_index,
      source_text, case when row_index > 0 then ['Key','Priority',''][column_index + 1] end as column_header
      from (select doc_id, row_index, i - 1 as column_index, {norm('cell')} as source_text
        from (select doc_id, row_index, unnest(cells) as cell, generate_subscripts(cells, 1) as i from allrows)) where source_text <> ''""",
}

_UPPER = r"(regexp_matches({t}, '\p{{Lu}}') and not regexp_matches({t}, '[\p{{Ll}}\p{{Lt}}]'))"
_TITLE = (
    r"(regexp_matches({t}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]') and not regexp_matches({t}, "
    r"'(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}|[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]'))"
)


def _block_type(t: str, large: str = "false") -> str:
    bare = f"regexp_replace({t}, ':+$', '')"
    return (
        f"case when {large} then 'heading' when length({t}) <= 90 and ({_UPPER.format(t=t)} or {_TITLE.format(t=bare)}) then 'heading' "
        f"when regexp_matches({t}, '^[-•]') then 'list_item' else 'paragraph' end"
    )


CTES["items"] = f"""select doc_id, printf('p%03d-b%04d', ln.page_number, line_no) as segment_id, ln.page_number, top as top_key, 0 as kind, 0 as r, line_no as col,
      {_block_type(norm('text'), 'font_size <> 0 and median_size <> 0 and font_size >= median_size + 2')} as block_type, {norm('text')} as source_text
      from ln join pm using (doc_id, page_number) where {norm('text')} <> ''
      union all select doc_id, segment_id, 1, 200.0::double + row_index * 0.01::double + column_index * 0.0001::double, 1, row_index, column_index, 'table_cell', source_text from cells"""

_NOTE = "'Reused exact-match translation from '"


def _notes() -> str:
    cached = f"{_NOTE} || 'persistent cache job ' || origin.j || ' segment ' || origin.s || '.'"
    abroad = f"{_NOTE} || 'persistent cache job ' || rep.j || ' segment ' || rep.s || '.'"
    first = f"{_NOTE} || 'segment ' || first_id || '.'"
    return f"""case when route = 'existing' then '' when mem_id is not null then {_NOTE} || 'segment ' || mem_id || '.'
      when route = 'persistent' then {cached} when route = 'memory' then {cached} || '|' || {first}
      when route = 'miss' and rep.j = job_id then '' when route = 'miss' then {abroad}
      when rep.j = job_id then {first} else {abroad} || '|' || {first} end"""


def _usage_sql() -> str:
    def number(path: str, names) -> str:
        options = []
        for name in names:
            v = f"json_extract_string(raw, '{path}.{name}')"
            options.append(rf"case when regexp_matches({v}, '^-?\d+(\.\d+)?$') then trunc(cast({v} as double))::bigint end")
        return f"coalesce({', '.join(options)}, 0)"

    picks = []
    for path in USAGE_PATHS:
        i, o, t = (number(path, names) for names in (INPUT_NAMES, OUTPUT_NAMES, TOTAL_NAMES))
        total = f"case when {t} = 0 then {i} + {o} else {t} end"
        picks.append(
            f"case when {i} <> 0 or {o} <> 0 or {total} <> 0 then {{'i': {i}, 'o': {o}, 't': {total}}} end"
        )
    return f"coalesce({', '.join(picks)})"


_RAW = """select event_id, case event_id % 6
  when 0 then concat('{"usage_metadata":{"input_tokens":', event_id % 50, ',"output_tokens":', user_id % 9, ',"total_tokens":', event_id % 60, '}}')
  when 1 then concat('{"usage_metadata":null,"token_usage":{"prompt_tokens":', event_id % 50, ',"completion_tokens":"', user_id % 9, '"}}')
  when 2 then concat('{"usage":{"input_token_count":', event_id % 50, '.0,"output_token_count":', user_id % 9, ',"total_token_count":7}}')
  when 3 then concat('{"usage_metadata":{"input_tokens":0},"response_metadata":{"token_usage":{"prompt_tokens":', event_id % 50, '}}}')
  when 4 then concat('{"response_metadata":{"usage":{"prompt_tokens":', event_id % 50, ',"completion_tokens":', user_id % 9, '}}}')
  else '{"response_metadata":{}}' end as raw from events"""
CTES["raw"] = _RAW
# The report texts after the first cycle of the loop: proposals are taken up and judged again.
CTES["rev1"] = "select job_id, segment_id from routes where revise"
CTES["act"] = "select distinct job_id from rev1"
CTES["now"] = """select f2.job_id, f2.segment_id, f2.source_text, f2.c, f2.k, r.segment_id is not null as revised, a.job_id is not null as active,
    case when r.segment_id is not null then 'Propozycja ' || (c % 17) || ' 0,5 mg/kg' else f2.translated_text end as translated_text
    from f2 left join rev1 r using (job_id, segment_id) left join act a on a.job_id = f2.job_id"""
CTES["tok2"] = f"""select tok.* from tok left join rev1 using (job_id, segment_id) where tok.side = 'source' or rev1.segment_id is null
    union all select job_id, segment_id, 'target', ord, x.kind, x.t, x.n, 0 from (select job_id, segment_id, unnest(l) as x, generate_subscripts(l, 1) as ord from (
      select job_id, segment_id, [{{'kind': 'number', 't': cast(c % 17 as varchar), 'n': cast(c % 17 as varchar), 's': 0}}, {{'kind': 'number', 't': '0,5', 'n': '0.5', 's': 0}},
        {{'kind': 'unit', 't': 'mg/kg', 'n': 'mg/kg', 's': 0}}]::{_TOKEN} as l from now where revised))"""
CTES["cnt2"] = _COUNTS.format(tok="tok2")
CTES["crit2"] = f"""select distinct job_id, segment_id from (select job_id, segment_id, severity from ({_token_issues('cnt2')})
    union all select job_id, segment_id, 'critical' from now where {_SOURCE_NEG} and not ({_TARGET_NEG})) where severity = 'critical'"""
CTES["loop"] = f"""select n.job_id, n.segment_id, n.translated_text as text, case when revised then 1 else 0 end as attempts,
    case when active then case when (c % 9 = 0 and not revised) or ({_same('n.source_text', 'n.translated_text')} and {_english('n.source_text')}) then 'human_review' else 'accept' end
      when f.severity in ('critical','major') then 'human_review' when f.severity is not null then 'revise' else 'accept' end as verdict,
    cr.segment_id is not null as critical
    from now n left join f5 f using (job_id, segment_id) left join crit2 cr using (job_id, segment_id)"""

def _used_ctes(sql: str) -> list[str]:
    names = set(re.findall(r"[a-z_0-9]+", sql)) & set(CTES)
    return [n for n in CTES if n in names]


def _with(body: str) -> str:
    """Prefix a body with the CTEs it needs, in definition order."""
    needed: set[str] = set()
    todo = _used_ctes(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _used_ctes(CTES[name]) if n != name]
    ordered = [n for n in CTES if n in needed]
    head = ", ".join(f"{n} as materialized ({CTES[n]})" for n in ordered)
    return f"with {head} {body}" if head else body


def _reps() -> str:
    return "routed left join reps using (source_text)"


def _zeros(skip) -> str:
    return ", ".join(f"0::bigint as {m}" for m in METRICS if m not in skip)


def oracle_sql() -> dict[str, str]:
    issue_cols = "job_id, segment_id, severity, issue_type, source_value, translated_value, message"
    lang_case = "case lang when 'en' then 'English' when 'de' then '  german ' when 'fr' then 'FRENCH' when 'es' then 'Klingon' else lang end"
    lang_rows = ",".join(f"({i},{lit(n.lower())})" for i, n in enumerate(LANGUAGES))
    pol_case = "case lang when 'en' then ' Język  polski' when 'de' then 'Polski' when 'fr' then 'pl' else lang end"
    low_lang = f"lower({norm('language')})"
    more = """list_filter([case when len(alternatives) > 0 then 'alternatives=' || array_to_string(alternatives, ', ') end,
        case when len(forbidden) > 0 then 'forbidden=' || array_to_string(forbidden, ', ') end, case when retain then 'retain English when useful' end], lambda x: x is not null)"""
    suffix = f"case when len({more}) > 0 then ' (' || array_to_string({more}, '; ') || ')' else '' end"
    prompts = f"""(select i, source, '- ' || source || ' -> ' || preferred || {suffix} as polish, '- source term: ' || source || '; approved Polish equivalent: '
        || preferred || '; use as a domain concept anchor only for target language ''German''' || {suffix} as german from ({_terms()}))"""
    job_log = (
        "select cast(user_id as varchar) as job_id, event_type as status, 'in/' || event_id as source_path, 'out/' || event_id as output_path, "
        "translated_text as payload_json, updated_at, event_id % 2 as part, event_id from log"
    )
    redacted = f"""select doc_id, f.key as key, case
        when regexp_matches(lower(f.key), 'api_key|apikey|secret|password') or lower(f.key) in ('token','access_token','refresh_token','authorization') then '[redacted]'
        when starts_with(f.value, 'sk-') then '[redacted]' when length(f.value) > 4000 then left(f.value, 4000) || '…' else f.value end as value
      from (select doc_id, unnest([{{'key': 'text', 'value': text}}, {{'key': 'OPENAI_API_KEY', 'value': lang}}, {{'key': 'protected_tokens', 'value': source}},
        {{'key': 'Token', 'value': source}}, {{'key': 'client_secret_id', 'value': lang}},
        {{'key': 'note', 'value': case when doc_id % 7 = 0 then 'sk-' || source else source end}}]) as f from documents)"""
    reviews = "low + unchanged"
    fallback = "case job_id % 3 when 0 then 'accept' when 1 then 'revise' else 'human_review' end"
    audit = f"""select f2.job_id, count(*)::bigint as segments_total, count(u.segment_id)::bigint as segments_human_review_required,
        (select count(*) from v7 where v7.job_id = f2.job_id)::bigint as deterministic_issues,
        (select count(*) from v7 where v7.job_id = f2.job_id and severity = 'critical')::bigint as critical_deterministic_issues,
        (select count(*) from f5 where f5.job_id = f2.job_id)::bigint as review_findings,
        (select count(*) from f5 where f5.job_id = f2.job_id and severity in ('critical','major'))::bigint as critical_or_major_review_findings,
        0::bigint as translation_memory_hits, 0::bigint as persistent_translation_cache_hits, 0::bigint as translation_memory_misses,
        0::bigint as user_phrase_memory_hits, count(*) filter (where o % 4 <> 0)::bigint as llm_requests,
        coalesce(sum(o % 50) filter (where o % 4 <> 0), 0)::bigint as llm_input_tokens,
        coalesce(sum(c % 30) filter (where o % 4 <> 0), 0)::bigint as llm_output_tokens,
        coalesce(sum(o % 50 + c % 30) filter (where o % 4 <> 0), 0)::bigint as llm_total_tokens,
        (count(*) - count(u.segment_id))::bigint as segments_auto_accepted
      from f2 left join unres u using (job_id, segment_id) group by f2.job_id"""
    items = "(select job_id, segment_id, severity from v7 union all select job_id, segment_id, severity from f5)"
    queue = f"""select job_id, segment_id, row_number() over (partition by job_id order by segment_id) as queue_pos from (
        select u.job_id, u.segment_id, f.hit, coalesce(bool_or(f.hit) over (partition by u.job_id), false) as any_hit
        from unres u left join (select job_id, segment_id, bool_or(severity in ('critical','major','warning')) as hit from {items} group by all) f using (job_id, segment_id))
        where coalesce(hit, true) or not any_hit"""
    chosen = f"""select job_id, segment_id, row_number() over (partition by job_id order by segment_id) as queue_pos from (
        select u.job_id, u.segment_id, f.hit
        from unres u left join (select job_id, segment_id, bool_or(severity in ('major','minor')) as hit from {items} group by all) f using (job_id, segment_id))
        where coalesce(hit, true)"""
    rule_text = _ruled(_replaced("source_text"))
    undo_notes = "case when d.segment_id is null then concat_ws('|', a.label, a.note) when a.note = 'sprawdzone' and a.label is not null then 'sprawdzone' else '' end"

    bodies = {
        "s1_segment_source": "select job_id, page_number, segment_id, order_index, source_text from f1",
        "s2_words_outside_tables": "select doc_id, page_number, count(*) as words, sum(seq)::bigint as seq_sum, sum(length(word))::bigint as chars from outside group by all",
        "s3_line_assembly": "select doc_id, page_number, line_no, words, text from ln",
        "s4_line_features": "select doc_id, page_number, line_no, x0, top, x1, bottom, font_size, font_name, is_bold from ln",
        "s5_page_median_font": "select doc_id, page_number, median_size from pm",
        "s6_table_cells": "select doc_id, table_id, segment_id, row_index, column_index, source_text, column_header from cells",
        "s7_reading_order": "select doc_id, segment_id, row_number() over (partition by doc_id order by page_number, top_key, kind, r, col) - 1 as order_index, block_type, source_text from items",
        "s8_glossary_source": """select t.key, t.source, t.preferred, array_to_string(t.alternatives, '|') as alternatives, array_to_string(t.forbidden, '|') as forbidden,
            t.retain, t.preserve_abbreviation, t.short_form, (select count(*) from used u where u.key = t.key) as segments from terms t""",
        "s9_language_catalog": f"""select language, coalesce(i, 0)::bigint as language_index, count(*) as docs from (select {lang_case} as language from documents)
            left join (values {lang_rows}) v(i, name) on name = {low_lang} group by all""",
        "s10_job_store_upsert": f"""select job_id, arg_max(status, o) as status, coalesce(arg_min(source_path, updated_at) filter (where part = 0), arg_min(source_path, updated_at)) as source_path,
            arg_max(output_path, o) as output_path, arg_max(payload_json, o) as payload_json from (select *, {{'u': updated_at, 'p': part}} as o from ({job_log})) group by job_id""",
        "s11_job_store_load": f"select job_id, arg_max(status, updated_at) as status, arg_max(output_path, updated_at) as output_path from ({job_log}) group by job_id",
        "s11_latest_job": f"select job_id, status, output_path from ({job_log}) order by updated_at desc, job_id desc limit 1",
        "s12_restore_translations": f"""select job_id, segment_id, {_localized('source_text')} as translated_text,
            case when {_localized('source_text')} <> source_text then 1 else 0 end::bigint as notes from f2""",
        "s12_restore_jobs": """select job_id, case when job_id is not null then 'segments_translated' end as status, count(*) as segments, count(*) as translations, 0::bigint as reviews from f2 group by job_id""",
        "s13_report_sink": "select job_id, 0::bigint as part, segments_total, 'English' as source_language, 'Polish' as target_language, deterministic_issues as issues, review_findings as findings from (" + audit + ")",
        "s13_closed_report": f"""select j.job_id, segments_total, case j.job_id % 3 when 0 then 'unknown' when 1 then 'completed' else 'needs_human_review' end as status,
            case when j.job_id % 17 = 0 then 'missing' else sha256(source) end as source_sha256, sha256(outp) as output_sha256,
            case when outp is not null then lost = 0 and leaks = 0 end as ok, case when outp is not null then lost end as missing,
            case when outp is not null then leaks end as leaks, case when outp is not null then (lost > 0)::bigint + leaks end as messages
            from (select a.job_id, segments_total, source, outp, (a.job_id % 26 = 0)::bigint as leaks, (select count(*) from f2 where f2.job_id = a.job_id
                and length({norm('f2.translated_text')}) > 2 and not contains(lower({norm('outp')}), left(lower({norm('f2.translated_text')}), 40))) as lost
              from (select job_id, count(*) as segments_total, string_agg(source_text, ' ' order by order_index) as source,
                case when job_id % 13 = 0 then string_agg(translated_text, ' ' order by order_index) filter (where order_index <> 6) || case when job_id % 26 = 0 then ' {{{{ID_9}}}}' else '' end end as outp
                from f2 group by job_id) a) j""",
        "s14_fingerprint": "select o.doc_id, coalesce(sha256(d.text), 'missing') as sha256 from (select distinct o_custkey as doc_id from orders) o left join documents d using (doc_id)",
        "p1_normalize_ws": f"select doc_id, length({norm('text')}) as chars, sha256({norm('text')}) as sha from documents",
        "p2_normalize_phrase": f"select doc_id, length(t) as chars, sha256(t) as sha from (select doc_id, replace(lower({norm('text')}), 'ß', 'ss') as t from documents)",
        "p3_clean_phrase": f"select conv_id, turn, case when length({norm('text')}) <= 120 then {norm('text')} else '' end as phrase from conversations",
        "p4_short_text": f"select doc_id, {short('text', 220)} as short from documents",
        "p5_block_type": f"select job_id, segment_id, {_block_type('source_text')} as block_type from f1",
        "p6_context_attach": """select job_id, order_index, lag(source_text) over (partition by job_id order by order_index) as preceding_context,
            lead(source_text) over (partition by job_id order by order_index) as following_context from f1""",
        "p7_language_is_polish": f"""select language, {low_lang} in ('pl','polish','polski','język polski','jezyk polski') as is_polish,
            {low_lang} in ('polish','polski','pl') as decimal_comma, count(*) as docs from (select {pol_case} as language from documents) group by all""",
        "p8_redact": f"select doc_id, key, length(value) as chars, sha256(value) as sha from ({redacted})",
        "t1_extract_tokens": 'select job_id, segment_id, side, kind, text, start, start + length(text) as "end" from tok',
        "t2_normalize_token": "select kind, text, normalized, count(*) as n from tok group by all",
        "t3_token_ids": "select job_id, side, upper(replace(segment_id, '-', '_')) || '_' || ord as token_id, kind, normalized from tok",
        "t4_token_inventory": """select kind, normalized, count(*) as occurrences, count(distinct {'j': job_id, 's': segment_id}) as segments, count(distinct job_id) as jobs
            from tok where side = 'source' group by all""",
        "v1_missing_tokens": f"select {issue_cols} from v12 where issue_type <> 'unexpected_addition'",
        "v2_unexpected_additions": f"select {issue_cols} from v12 where issue_type = 'unexpected_addition'",
        "v3_negation": f"select {issue_cols} from v3",
        "v3_negation_documents": f"select job_id, segment_id, {_SOURCE_NEG} as negated from f1",
        "v4_relevant_terms": "select job_id, segment_id, source from used",
        "v5_approved_term": f"select {issue_cols} from v5",
        "v6_forbidden_term": """select job_id, segment_id, 'warning' as severity, 'forbidden_term' as issue_type, source as source_value, f as translated_value,
            'Termin ''' || f || ''' jest zabroniony dla ''' || source || '''.' as message
            from (select u.job_id, u.segment_id, u.source, unnest(u.forbidden) as f,
                case when f2.c % 3 = 0 then replace(u.translated_text, 'Migracja globalna', 'Ogólna migracja') else u.translated_text end as text
              from used u join f2 using (job_id, segment_id)) where contains(lower(text), lower(f))""",
        "v7_validate_corpus": f"select {issue_cols} from v7",
        "v8_prepare_segments": """select f2.job_id, f2.segment_id, count(t.kind) as tokens, coalesce(string_agg(t.kind || '=' || t.normalized, ';' order by t.ord), '') as list
            from f2 left join tok t on t.job_id = f2.job_id and t.segment_id = f2.segment_id and t.side = 'source' group by all""",
        "l1_localize_decimals": f"select job_id, segment_id, {_localized('source_text')} as source_local, translated_text as target_local from f2",
        "l2_structural_guard": """select job_id, segment_id, head, head || ((c % 100) % 10) || case when head in ('Value ', 'subsection ') then ',' else '.' end || (c % 100) as text
            from f2, (values ('Section '), ('see table '), ('pkt. '), ('Value '), ('subsection ')) h(head)""",
        "l3_apply_locale": f"""select job_id, segment_id, {_localized('source_text')} as text,
            case when {_localized('source_text')} = source_text then 'a' else 'a|Localized decimal separator for target locale.' end as notes from f2""",
        "x1_glossary_replace": f"select job_id, segment_id, {_replaced('source_text')} as text from f2",
        "x2_phrase_rules": f"select job_id, segment_id, {_ruled('source_text')} as text from f2",
        "x3_untranslated_flag": f"""select job_id, segment_id, {_english('source_text')} as english,
            {_english('translated_text')} and {_same('translated_text', 'source_text')} as untranslated from f2""",
        "x4_rule_translate": f"""select job_id, segment_id, {_localized('t')} as text, case when low then 'low' else 'high' end as confidence, low::bigint as uncertain,
            1 + ({_localized('t')} <> t)::bigint as notes
            from (select *, {_english('t')} and {_same('t', 'source_text')} as low from (select job_id, segment_id, source_text, {rule_text} as t from f2))""",
        "x5_translate_distinct": "select job_id, segment_id, route, case when origin is not null and mem_id is null and route in ('persistent','memory') then 'CACHE: ' else 'PL: ' end || source_text as text from reused",
        "x6_revise": f"""select f2.job_id, f2.segment_id,
            case when f.proposed_translation is not null then replace(f.proposed_translation, ' 0.5 ', ' 0,5 ') else {_localized("'RE: ' || f2.source_text")} end as text,
            case when f.proposed_translation is not null then 'medium' else 'high' end as confidence, case when f2.o % 15 = 0 then 2 else 1 end::bigint as attempts
            from f2 join f5 f using (job_id, segment_id)""",
        "x7_prompt_payload": f"select job_id, segment_id, 'Polish' as target, source_text, (select length(string_agg(polish, chr(10) order by i)) from {prompts})::bigint as glossary_chars from f2",
        "x8_terms_for_prompt": f"select u.job_id, u.segment_id, p.polish, p.german from used u join {prompts} p on p.source = u.source",
        "x9_token_estimate": f"""select job_id, segment_id, greatest(1, (length(to_json({{'source_language': 'English', 'target_language': 'Polish', 'domain': {lit(fx.CONFIG.domain)}, 'mode': {lit(fx.CONFIG.mode)},
            'segment': {{'segment_id': segment_id, 'source_text': source_text}}, 'glossary': g}})) + 12) // 4)::bigint as tokens from f1, (select string_agg(polish, chr(10) order by i) as g from {prompts})""",
        "x10_usage_extract": f"select event_id, u.i as input_tokens, u.o as output_tokens, u.t as total_tokens from (select event_id, {_usage_sql()} as u from raw)",
        "m1_cache_scope": "select s as scope, count(distinct source_text) as keys, count(distinct source_text) as sources from f2, (values ('de'), ('pl')) v(s) group by s",
        "m2_cache_key": f"select job_id, segment_id, sha256('{fx.SCOPE}' || chr(31) || source_text) as cache_key, sha256(source_text) as source_hash from f2",
        "m3_job_memory": "select job_id, sha256(source_text) as source_hash, arg_min(segment_id, order_index) as segment_id, 'PL: ' || source_text as text from f1 where doc_id % 10 = 0 group by job_id, source_text",
        "m4_cache_lookup": "select job_id, segment_id, 'CACHE: ' || source_text as text, cast(origin.j as varchar) as origin_job_id, origin.s as origin_segment_id from f1 join cache using (source_text)",
        "m5_reuse_routing": "select job_id, segment_id, route from routed",
        "m6_fan_out_copy": f"select job_id, segment_id, {_notes()} as notes, true as no_usage from {_reps()}",
        "m7_cache_upsert": "select cache_key, text, origin_job_id, origin_segment_id, strftime(created, '%Y-%m-%d %H:%M:%S') as created, strftime(updated, '%Y-%m-%d %H:%M:%S') as updated, 0::bigint as hits from stored",
        "m8_cache_touch": """select s.cache_key, count(l.event_id) as hits, strftime(coalesce(max(l.updated_at), any_value(s.created)), '%Y-%m-%d %H:%M:%S') as last_used
            from stored s left join log l on l.cache_key = s.cache_key and l.op = 'hit' group by s.cache_key""",
        "m7_cache_log": """select s.cache_key, any_value(s.text) as text, any_value(s.origin_job_id) as origin_job_id, strftime(any_value(s.updated), '%Y-%m-%d %H:%M:%S') as updated,
            count(l.event_id) as hits, strftime(coalesce(max(l.updated_at), any_value(s.created)), '%Y-%m-%d %H:%M:%S') as last_used
            from stored s left join log l on l.cache_key = s.cache_key and l.op = 'hit' group by s.cache_key""",
        "m9_cache_backfill": f"select cast(job_id as varchar) as job_id, segment_id, sha256('{_SCOPE_TESTS}' || chr(31) || source_text) as cache_key, sha256(source_text) as source_hash from f2",
        "m10_second_run": "select job_id, 0::bigint as memory_hits, count(*) as persistent_hits, 0::bigint as misses from f2 group by job_id",
        "m8_second_run_hits": f"select sha256('{fx.SCOPE}' || chr(31) || source_text) as cache_key, sha256(source_text) as source_hash, (2 * count(*) - 1)::bigint as hits from f2 group by source_text",
        "m10_reuse_counters": """select job_id, count(*) filter (where route in ('memory','duplicate')) as memory_hits, count(*) filter (where route = 'persistent') as persistent_hits,
            count(*) filter (where route = 'miss') as misses from reused group by job_id""",
        "h1_phrase_store": """select cache_key, target_language, lower(replace_text) as normalized_replace, lower(l.p) as normalized_preferred, replace_text, l.p as preferred_text,
            l.a as approved_text, l.s as source_text, cast(l.e as varchar) as origin_segment_id, 0::bigint as hits from pstored""",
        "h2_phrase_match": """select job_id, segment_id, row_number() over (partition by job_id, segment_id order by reason <> 'target_phrase', -length(replace_text), stored_no desc) - 1 as pos,
            reason, replace_text, preferred_text from top5""",
        "h2_phrase_match_corpus": f"""select * from (with own as materialized ({fx.CORPUS_PHRASES_SQL.format(pairs='f2').replace('as string', 'as varchar')}),
            met as (select f2.job_id, f2.segment_id, m.*, contains(lower(f2.translated_text), lower(m.replace_text)) as holds from f2 join own m
              on contains(lower(f2.translated_text), lower(m.replace_text)) or (m.source_text <> '' and lower(m.source_text) = lower(f2.source_text))
              where not contains(lower(f2.translated_text), lower(m.preferred_text))),
            best as (select *, row_number() over (partition by job_id, segment_id order by stored_no desc) as newest from met)
            select job_id, segment_id, row_number() over (partition by job_id, segment_id order by not holds, -length(replace_text), stored_no desc) - 1 as pos,
            case when holds then 'target_phrase' else 'source_exact' end as reason, replace_text, preferred_text from best where newest <= 5)""",
        "h3_phrase_apply": """select f2.job_id, f2.segment_id, case when a.n is null then f2.translated_text when x.proposal is not null then x.proposal
              else regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(f2.translated_text, 'Migracja globalna', 'Migracja całkowita', 'i'), 'poniżej', 'mniejsza niż', 'i'),
                'nie wykryto', 'nie stwierdzono', 'i'), 'Wynik', 'Rezultat', 'i'), 'Rozporządzenie', 'Regulacja', 'i'), 'patrz sekcja', 'zob. sekcja', 'i') end as text,
            case when a.n is null then 'medium' else 'high' end as confidence, coalesce(a.n, 0)::bigint as applied, coalesce(a.n, 0)::bigint as notes
            from f2 left join applied a using (job_id, segment_id) left join (select job_id, segment_id, proposal from proposed where reason = 'source_exact') x using (job_id, segment_id)""",
        "h4_phrase_findings": """select job_id, segment_id, 'major' as severity, 'user_phrase_memory' as category, case when reason = 'target_phrase' then replace_text else tgt end as translation_evidence,
            proposal as proposed_translation, 'Pamięć fraz operatora ma zatwierdzoną podmianę: użyj ''' || preferred_text || ''' zamiast ''' || replace_text || '''.' as explanation
            from proposed where proposal <> tgt""",
        "h5_verdict_merge": f"""select f2.job_id, f2.segment_id, case when f.severity in ('critical','major') then 'human_review'
            when f.severity is not null and f2.job_id % 3 = 0 then 'revise' else {fallback.replace('job_id', 'f2.job_id')} end as verdict from f2 left join f5 f using (job_id, segment_id)""",
        "h6_phrase_touch": "select s.cache_key, count(*) as hits, strftime(max(l.updated_at), '%Y-%m-%d %H:%M:%S') as last_used from pstored s join pkeyed l using (cache_key) group by s.cache_key",
        "h7_phrase_count": "select 'English' as source_language, target_language, count(*) as phrases from pstored group by target_language",
        "h8_phrase_from_decisions": f"""select cast(d.job_id as varchar) as job_id, d.segment_id, r.replace_text, r.preferred_text, {norm('d.text')} as approved_text, lower(f2.source_text) as normalized_source
            from dec d join refine r using (job_id, segment_id) join f2 using (job_id, segment_id)
            where d.action <> 'keep_source' and r.preferred_text <> '' and lower(r.preferred_text) <> lower(r.replace_text)""",
        "h9_local_phrase_rewrite": """select f2.job_id, f2.segment_id, regexp_replace(translated_text, 'poniżej', 'mniej niż', 'i') as text, 'medium' as confidence,
            (select count(*) from v7 where v7.job_id = f2.job_id and v7.segment_id = f2.segment_id)::bigint as issues,
            cr.segment_id is null as memory_saved from f2 left join crit cr using (job_id, segment_id)""",
        "h10_refinement_suggest": "select job_id, segment_id, replace_text, preferred_text from refine",
        "r1_rule_review": """select job_id, segment_id, 0::bigint as pos, 'major' as severity, 'untranslated_fragment' as category, source_text as source_evidence from rulerev where low = 1
            union all select job_id, segment_id, low::bigint, 'major', 'unchanged_source', source_text from rulerev where unchanged = 1""",
        "r2_verdict": "select job_id, segment_id, case when severity in ('critical','major') then 'human_review' else 'revise' end as verdict from f5",
        "r3_review_segments": f"""select r.job_id, r.segment_id, case when {reviews} + coalesce(a.n, 0) > 0 then 'human_review' else 'accept' end as verdict,
            ({reviews} + coalesce(a.n, 0))::bigint as findings from rulerev r left join applied a using (job_id, segment_id) where r.order_index <> 6""",
        "r3_review_trusted_memory": """select job_id, segment_id, case when findings > 0 then 'human_review' else 'accept' end as verdict, applied, findings from (
            select r.job_id, r.segment_id, coalesce(a.n, 0)::bigint as applied, (case when a.n is null then low + unchanged else 0 end)::bigint as findings
            from rulerev r left join applied a using (job_id, segment_id))""",
        "r4_resolve": "select job_id, segment_id, unresolved, revise from routes",
        "r4_resolve_strict": """select job_id, segment_id, strict or critical or (blocking and not revise) as unresolved, revise from (
            select *, block_type = 'table_cell' or contains(lower(source_text), 'regulation') as strict from flags) where strict or critical or blocking""",
        "r5_revise_loop": """select l.job_id, l.segment_id, text, attempts::bigint as attempts, verdict,
            l.critical or case when exists (select 1 from act a where a.job_id = l.job_id) then verdict = 'human_review' else coalesce(r.blocking, false) end as unresolved
            from loop l left join flags r using (job_id, segment_id)""",
        "r6_decisions_build": "select job_id, segment_id, action, text, note from dec",
        "r7_decisions_apply": "select job_id, segment_id, text, concat_ws('|', label, note) as notes, confidence from after",
        "r7_still_unresolved": "select u.job_id, u.segment_id from unres u anti join dec using (job_id, segment_id)",
        "r8_decisions_undo": f"""select a.job_id, a.segment_id, a.text, {undo_notes} as notes, case when d.segment_id is null then a.confidence else 'medium' end as confidence
            from after a left join dec d using (job_id, segment_id)""",
        "r8_reopened": "select job_id, segment_id, order_index from f2 where (job_id, segment_id) in (select (job_id, segment_id) from unres union select (job_id, segment_id) from dec)",
        "r9_findings_table": f"""select f.job_id, row_number() over (partition by f.job_id order by f.order_index, f.segment_id, f.pos) as number, f.segment_id, 1::bigint as page_number, f.severity, f.category,
            {short("case when f.source_evidence <> '' then f.source_evidence else t.source_text end", 220)} as source,
            {short("case when f.translation_evidence <> '' then f.translation_evidence else t.translated_text end", 260)} as translation,
            {short('f.explanation', 320)} as explanation, {short('f.proposed_translation', 260)} as proposal, 'high' as confidence from f5 f join trans t using (job_id, segment_id)""",
        "r10_segment_issues": """select job_id, segment_id, 'issue' as origin, severity, issue_type as type, message from v7
            union all select job_id, segment_id, 'finding', severity, category, explanation from f5""",
        "r11_review_queue": f"select job_id, segment_id, queue_pos from ({queue}) where queue_pos <= 3",
        "r11_review_queue_selected": f"select job_id, segment_id, queue_pos from ({chosen}) where queue_pos <= 2",
        "r12_auto_accept": """select t.job_id, case when u.segment_id is not null then 'high' else t.confidence end as confidence,
            case when u.segment_id is not null then 'Operator accepted translation.' else '' end as notes, count(*) as segments, 0::bigint as open
            from trans t left join unres u using (job_id, segment_id) group by 1, 2, 3""",
        "a1_audit_report": audit,
        "a1_audit_reuse": """select job_id, count(*)::bigint as segments_total, count(*) filter (where route in ('memory','duplicate')) as translation_memory_hits,
            count(*) filter (where route = 'persistent') as persistent_translation_cache_hits, count(*) filter (where route = 'miss') as translation_memory_misses from reused group by job_id""",
        "a2_token_usage_summary": """select user_id as job_id, operation, count(*) as requests, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
            sum(input_tokens + output_tokens)::bigint as total_tokens from log where op = 'store' group by rollup(user_id, operation)""",
        "a3_progress": """select job_id, segments, translations, reviews,
            case when segments <= 0 then 0 when translations >= segments then 100 else floor(translations * 100 / segments) end::bigint as translation_percent,
            case when segments <= 0 then 0 when reviews >= segments then 100 else floor(reviews * 100 / segments) end::bigint as review_percent,
            case when segments <= 0 then 0.0 else round(least(translations / segments, 1.0), 4) end::double as translation_ratio,
            least(translations, segments) + least(reviews, segments) as pipeline_current, greatest(segments * 2, 1) as pipeline_total from states""",
        "a4_ready_for_output": "select job_id, is_ready as ready from ready",
        "a5_can_resume": """select job_id, not (has_output or status = 'needs_human_review' or is_ready)
            and (segments = 0 or translations < segments or reviews < translations or status not in ('completed','completed_with_output_warnings')) as can_resume,
            segments > 0 and (translations < segments or reviews < translations) as needs_pipeline, translations > 0 and reviews >= translations as reviews_complete from ready""",
        "a6_status_normalize": """select job_id, case when starts_with(status, 'translating') and segments > 0 and translations >= segments then 'segments_translated'
            when starts_with(status, 'reviewing') and translations > 0 and reviews >= translations then 'translation_reviewed'
            when starts_with(status, 'pipeline') and segments > 0 and translations >= segments and reviews >= translations then 'translation_reviewed' else status end as status from states""",
        "a7_output_verification": """select o.job_id, count(l.segment_id) = 0 and any_value(o.job_id) % 7 <> 0 as ok, any_value(length(o.text))::bigint as extracted_text_chars,
            count(l.segment_id) as missing_segments, ((count(l.segment_id) > 0)::bigint + (any_value(o.job_id) % 7 = 0)::bigint) as messages
            from outputs o left join lost l using (job_id) group by o.job_id""",
        "a7_missing_segments": "select job_id, segment_id from lost",
        "a8_placeholder_leaks": "select job_id, case when job_id % 7 = 0 then '{{TOKEN_1}}' else '' end as leaks from outputs",
        "a9_translation_preview": f"select job_id, segment_id, page_number, order_index, {short('source_text', 500)} as source, {short('translated_text', 900)} as translation, number from pv",
        "a9_preview_tail": f"select job_id, segment_id, page_number, order_index, {short('source_text', 220)} as source, {short('translated_text', 320)} as translation, number from pv where number > total - 12",
        "a10_joined_text": "select job_id, order_index // 100 as part, string_agg('[page ' || page_number || ' | ' || segment_id || ']' || chr(10) || translated_text, chr(10) || chr(10) order by order_index) as text from pv group by all",
        "a11_job_routing": """select job_id, case when revise > 0 then 'revise_flagged_segments' when unresolved > 0 then 'human_review' else 'render_pdf' end as next_step,
            case when revise > 0 then 'revise_flagged_segments' else 'render_pdf' end as next_unattended from states""",
        "st1_incremental": "select job_id, segment_id, 'PL: ' || source_text as text, 'accept' as verdict from f1",
        "st2_stream_dedup": "select distinct 'k' || (user_id % 40) as cache_key, event_type from events",
        "st3_progress_stream": "select user_id as job_id, event_type as stage, max(event_id) as current, max(user_id * 2) as total, count(*) as events from events group by all",
        "s14_file_fingerprints": "select doc_id // 50 as file, octet_length(encode(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)))::bigint as length, "
        "sha256(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as sha256 from documents group by doc_id // 50",
        "u1_answered_calls": "select job_id, segment_id, 'PL: ' || source_text as text, 'client' as notes from f2",
        "u1_batch_client": "select f.j as job_id, f.s as segment_id, 'PL: ' || source_text as text, 'client' as notes from (select source_text, min({'j': job_id, 's': segment_id}) as f from f2 group by source_text)",
        "flagship_corpus_audit": f"""select job_id, count(*)::bigint as segments_total, (count(*) filter (where k in (1,4,7)))::bigint as segments_human_review_required,
            (count(*) filter (where k in (1,4,7)) + count(*) filter (where k = 4))::bigint as deterministic_issues,
            (count(*) filter (where k in (1,4,7)) + count(*) filter (where k = 4))::bigint as critical_deterministic_issues,
            (count(*) filter (where earlier = 0))::bigint as translation_memory_misses, (count(*) filter (where earlier > 0))::bigint as persistent_translation_cache_hits,
            (count(*) filter (where k not in (1,4,7)))::bigint as segments_auto_accepted,
            {_zeros(('segments_total', 'segments_human_review_required', 'deterministic_issues', 'critical_deterministic_issues', 'translation_memory_misses', 'persistent_translation_cache_hits'))}
            from (select *, row_number() over (partition by source_text order by job_id, order_index) - 1 as earlier from f2) group by job_id""",
    }
    return {name: _with(body) for name, body in bodies.items()}
