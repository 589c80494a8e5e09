"""SQL of the queries that SQL can express, for an independent engine."""

from __future__ import annotations

_BLANK = r"[\x20\x09-\x0D]+"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PROVIDER = r"(?:sk|pk|rk)[_-][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}"
# Kind, order, pattern, group of the value, least length of the value.
_KINDS = [("assign", 1, _ASSIGN, 2, 8), ("access", 2, "AKIA[A-Z0-9]+", 0, 16), ("hex", 3, "[0-9a-f]+", 0, 32), ("provider", 4, _PROVIDER, 0, 15)]


def _secrets() -> str:
    hits = " union all ".join(
        f"""select rid, doc_id, source, '{kind}' as kind, {k} as k, {least} as least,
          string_split_regex(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}', 0) as found, regexp_extract_all(t, '{pattern}', {group}) as vals from docs"""
        for kind, k, pattern, group, least in _KINDS
    )
    return f"""with docs as materialized (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
    hits as materialized ({hits}),
    sizes as (select * exclude (gaps, found), list_transform(gaps, lambda g: length(g)) as gl, list_transform(found, lambda f: length(f)) as fl, found from hits where len(found) > 0),
    each as (select rid, doc_id, source, kind, k, least, unnest(range(1, len(found) + 1)) as i, unnest(gl[1:len(fl)]) as g, unnest(fl) as f, unnest(vals) as v from sizes),
    placed as (select *, sum(g + f) over (partition by rid, k order by i) as e from each),
    spans as materialized (select *, cast(e - f as bigint) as s, cast(e as bigint) as en from placed where length(v) >= least),
    owned as (select v, count(distinct coalesce('s' || source, 'n')) as owners from spans group by v),
    live as (select spans.*, owners < 3 and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
        and len(list_filter(range(1, length(v) - 3), lambda p: v[p:p + 4] = repeat(v[p], 5))) = 0 as is_live from spans join owned using (v)),
    told as materialized (select * from live l where k < 4 or (is_live and not exists (select 1 from live b where b.rid = l.rid and b.k < 4 and b.s < l.en and l.s < b.en))),
    sums as (select rid, count(*) filter (where k = 1) as n_assign, count(*) filter (where k = 2) as n_access, count(*) filter (where k = 3) as n_hex,
        string_agg(kind || ':' || s || ':' || en, ',' order by s, k) filter (where k < 4) as base, string_agg(kind || ':' || s || ':' || en, ',' order by s, k) as spans from told group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join sums using (rid)"""


_LATTICE = """with recursive v as (select vec_id, embedding::double[] as e, coalesce(len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as ok from embeddings),
    links as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.ok and b.ok and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
      where list_cosine_similarity(a.e, b.e) >= 0.9),
    reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on l.a = r.b),
    degrees as (select a, count(*) as n from links group by a), firsts as (select a, min(b) as first from reach group by a)
    select vec_id, coalesce(n, 0) as n_links, first as component_id, first = vec_id as kept from v left join degrees d on d.a = vec_id join firsts f on f.a = vec_id"""

# Classes of characters as patterns of what does not belong to them.
_CLASSES = {
    "lower": r"\p{Ll}", "upper": r"\p{Lu}", "other_letter": r"\p{Lm}\p{Lo}\p{Lt}", "digit": r"\p{Nd}",
    "space": r"\x09-\x0D\x1C-\x1F\x{85}\p{Z}", "symbol": r"\p{S}#*%&",
}


def _quality() -> str:
    counts = ", ".join(f"length(regexp_replace(t, '[^{p}]', '', 'g')) as c_{c}" for c, p in _CLASSES.items())
    counts += r", length(regexp_replace(regexp_replace(t, '[#*%&]', '', 'g'), '[^\p{P}]', '', 'g')) as c_punctuation"
    names = [*_CLASSES, "punctuation", "other"]
    sums = ", ".join(f"sum(c_{c}) as r_{c}" for c in names)

    def apart(p: str, q: str) -> str:
        return f"case when {p} > 0 then {p} * log2({p} / (({p} + {q}) / 2)) else 0 end"

    pairs = [(f"(c_{c} / chars)", f"(r_{c} / all_chars)") for c in names]
    classes = " + ".join(f"{apart(p, q)} + {apart(q, p)}" for p, q in pairs)
    return rf"""with docs as materialized (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t, text is not null and lang is not null as known from documents),
    split as materialized (select rid, lang, known, list_filter(string_split_regex(t, '{_BLANK}'), lambda w: w <> '') as ws,
        list_filter(string_split_regex(lower(t), '{_BLANK}'), lambda w: w <> '') as lows, list_filter(string_split(t, chr(10)), lambda l: not regexp_matches(l, '^[\x20\x09-\x0D]*$')) as ls from docs),
    w as materialized (select rid, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from split),
    win as (select rid, i, word, lead(word) over o as w2, lead(word, 2) over o as w3 from w window o as (partition by rid order by i)),
    twice as (select rid, i, count(*) over (partition by rid, word, w2, w3) > 1 and w3 is not null as hit from win),
    cover as (select rid, hit or coalesce(lag(hit) over o, false) or coalesce(lag(hit, 2) over o, false) as covered from twice window o as (partition by rid order by i)),
    rep as (select rid, count(*) filter (where covered) as n_repeat_words from cover group by rid),
    classed as (select *, length(t) - c_lower - c_upper - c_other_letter - c_digit - c_space - c_symbol - c_punctuation as c_other from (select rid, lang, known, t, length(t) as chars, {counts} from docs)),
    low as materialized (select rid, lang, known, unnest(lows) as word from split),
    seen as (select lang, word, count(*) as n from low where known group by all),
    totals as (select lang, sum(n) as total from seen group by lang),
    top as materialized (select lang, word, n from (select *, row_number() over (partition by lang order by n desc, word) as place from seen where length(word) <= 6) join totals using (lang) where place <= 100),
    usual as (select lang, total, total - sum(n) as other from totals join top using (lang) group by lang, total),
    -- A text without one common word; its distance in words is the measure of the limit.
    bounds as (select lang, least(0.55, 0.95 * sqrt(greatest(0, (total - other) / total + {apart('1', 'other / total')} + {apart('other / total', '1')}) / 2)) as word_limit from usual),
    mine as (select rid, lang, word, count(*) as m from low join top using (lang, word) group by all),
    sizes as (select rid, lang, len(lows) as words from split),
    word_apart as (select s.rid, sum({apart('coalesce(m, 0) / words', 'n / total')} + {apart('n / total', 'coalesce(m, 0) / words')}) as js, sum(coalesce(m, 0)) as common
      from sizes s join top on top.lang = s.lang join usual u on u.lang = s.lang left join mine on mine.rid = s.rid and mine.word = top.word where words >= 50 group by s.rid),
    word_js as (select s.rid, sqrt(greatest(0, js + {apart('(words - common) / words', 'other / total')} + {apart('other / total', '(words - common) / words')}) / 2) as d
      from word_apart a join sizes s on s.rid = a.rid join usual u on u.lang = s.lang),
    class_ref as (select lang, sum(chars) as all_chars, {sums} from classed where known group by lang),
    class_js as (select rid, sqrt(greatest(0, {classes}) / 2) as d from classed join class_ref using (lang) join totals using (lang) where chars >= 200),
    base as (select rid, len(ws) as n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from split join docs using (rid) left join rep using (rid))
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
      n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, round(w.d, 6) as word_distance, round(c.d, 6) as class_distance,
      not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or coalesce(w.d > word_limit, false) or coalesce(c.d, 0) > 0.3) as kept
    from docs join base using (rid) left join word_js w using (rid) left join class_js c using (rid) left join bounds on bounds.lang = docs.lang"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _ranked() -> str:
    said = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}')"
    return f"""with docs as materialized (select row_number() over () as rid, doc_id, {said} as terms from documents),
    corpus as (select count(*) as docs_n, sum(len(terms))::bigint as all_n from docs where len(terms) > 0),
    occurring as materialized (select rid, unnest(terms) as term from docs), tf as materialized (select rid, term, count(*) as tf from occurring group by all),
    df as materialized (select term, count(*) as df from tf group by term),
    weights as materialized (select term, cast(floor(1000 * ln((2 * docs_n + 2) / (2 * df + 1))) as bigint) as w from df, corpus),
    norms as materialized (select rid, doc_id, 100 - 50 + ((50 * len(terms) * docs_n) // all_n) as m from docs, corpus where len(terms) > 0),
    items as materialized (select row_number() over () as iid, * from (select distinct item_id, text from benchmark)),
    asked as materialized (select distinct iid, unnest({said}) as term from items),
    scores as (select iid, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
      from asked join tf using (term) join weights using (term) join norms using (rid) group by all),
    ranked as (select iid, doc_id, score, row_number() over (partition by iid order by score desc, doc_id nulls last) as r
      from scores join norms using (rid) where score > 0)
    select item_id, cast(r as integer) as rank, doc_id, score from ranked join items using (iid) where r <= 50"""


def _spelling() -> str:
    # The checksum byte by byte through its table; letters up to U+00FF take one or two bytes.
    low = _LOWER.format("coalesce(text, '')")
    return f"""with recursive crc as materialized (select list(list_reduce(list_concat([i], range(8)), lambda a, x: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t
      from (select unnest(range(256)) as i)),
    occurring as materialized (select doc_id, unnest(regexp_extract_all({low}, '[a-zÀ-ÿ]+')) as run from documents),
    runs as materialized (select doc_id, run, count(*) as n from occurring group by all),
    coded as (select *, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [192 + (ord(c) >> 6)::bigint, 128 + (ord(c) & 63)::bigint] end)) as bytes from runs),
    hashed as materialized (select run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h from coded, crc),
    changed as (select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed),
    words as materialized (select word, sum(n)::bigint as n from changed group by word having length(word) >= 5 and sum(n) >= 3),
    places as materialized (select word, unnest(range(1, length(word) + 1)) as i from words),
    masked as materialized (select word, i, left(word, i - 1) as head, substr(word, i + 1) as tail from places),
    pairs as materialized (select distinct * from (
      select a.word as a, b.word as b from masked a join masked b on a.i = b.i and a.head = b.head and a.tail = b.tail and a.word <> b.word
      union all select m.word, w.word from masked m join words w on w.word = m.head || m.tail
      union all select w.word, m.word from masked m join words w on w.word = m.head || m.tail)),
    near as (select a as word, b as other, words.n as other_n, row_number() over (partition by a order by words.n desc, b) as r, count(*) over (partition by a) as n_near from pairs join words on word = b),
    judged as materialized (select words.word, words.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * words.n then other end as form, case when other_n >= 2 * words.n then other_n end as form_n
      from words left join near on near.word = words.word and r = 1),
    chain as (select word, word as root from judged union all select c.word, j.form from chain c join judged j on j.word = c.root where j.form is not null),
    ends as (select c.word, c.root from chain c join judged j on j.word = c.root where j.form is null)
    select word, form, root, n, n_near, form_n from judged join ends using (word)"""


ORACLES = {
    "op5_secret_scan": _secrets(), "op6_lattice_near_dedup": _LATTICE, "op7_quality_rules": _quality(),
    "op12_spelling_variants": _spelling(), "op13_ball_tree_search": _ranked(),
}
