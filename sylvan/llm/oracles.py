"""DuckDB statements for the operators that SQL can express, written from the contracts alone."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def rules_cte() -> str:
    """CTEs that end in ``judged``: doc_id, the counts, base_failed and kept per document."""
    values = {
        "symbol_share": "coalesce(n_symbols / nullif(word_chars, 0), 0.0)",
        "dup_line_share": "coalesce(n_dup_lines / nullif(n_lines, 0), 0.0)",
        "repeat_share": "coalesce(n_repeat_words / nullif(n_words, 0), 0.0)",
        "long_words": "coalesce(word_chars / nullif(n_words, 0), 0.0)",
        "short_words": "-coalesce(word_chars / nullif(n_words, 0), 0.0)",
    }
    # rules and cutoffs stated again: the statement must not follow the operator's table
    cutoffs = {
        "symbol_share": "0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5", "dup_line_share": "0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8",
        "repeat_share": "0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45", "long_words": "8, 9, 10, 12, 15, 20, 30, 50", "short_words": "-4, -3.5, -3, -2.5, -2, -1.5"}
    grid = " union all ".join(f"select {i} as rank, '{r}' as rule, unnest([{c}]::double[]) as cutoff" for i, (r, c) in enumerate(cutoffs.items()))
    value = " ".join(f"when '{r}' then {r}" for r in cutoffs)
    alpha, level = 0.02, "0.05 / 5"
    return rf"""
    raw as (select doc_id, lang, coalesce(text, '') as t, {_WORDS} as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
    grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from raw where len(w) > 2)),
    again as (select doc_id, g from grams group by all having count(*) > 1),
    spots as (select doc_id, i from grams join again using (doc_id, g)),
    rep as (select doc_id, count(distinct i + k) as n from spots, (values (0), (1), (2)) v(k) group by doc_id),
    counted as (select raw.doc_id, case when lang in ('en', 'de', 'fr', 'es') then lang else 'other' end as stratum,
        len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(lines) as n_lines
        from raw left join rep on raw.doc_id = rep.doc_id),
    measured as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {", ".join(f"{v} as {r}" for r, v in values.items())} from counted),
    good as (select doc_id from labels where doc_id is not null group by doc_id having max(case when quality = 1 then 1 else 0 end) = 1),
    grid as ({grid}),
    loose as (select *, row_number() over (partition by rule order by cutoff desc) as i, count(*) over (partition by rule) as m from grid),
    steps as (select rule, cutoff, row_number() over (order by i / m, rank, i) - 1 as step from loose),
    held as (select doc_id, stratum, n_words, {", ".join(cutoffs)} from measured join good using (doc_id) where not base_failed),
    firsts as (select stratum, h.doc_id, min(step) as first from held h left join steps on case rule {value} end > cutoff group by all),
    sizes as (select stratum, count(*) as n from firsts group by stratum),
    risk as (select stratum, step, any_value(n) as n, count(*) filter (first <= step) as k from firsts join sizes using (stratum) cross join (select distinct step from steps) group by stratum, step),
    tested as (select *, case when k >= n * {alpha} then 1.0 else list_sum(list_transform(range(0, k + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) end as p from risk),
    ends as (select stratum, coalesce(min(step) filter (p > {level}), (select count(*) from steps)) as passed from tested group by stratum),
    cuts as (select stratum, rule, min(cutoff) as cutoff from ends join steps on step < passed group by all),
    over_cut as (select distinct doc_id, rule from measured join cuts using (stratum) where case rule {value} end > cutoff),
    blame as (select doc_id, {", ".join(f"max(case when rule = '{r}' then 1 else 0 end) as has_{r}" for r in cutoffs)} from over_cut group by doc_id),
    judged as (select m.*, not base_failed and b.doc_id is null as kept, concat_ws(',', {", ".join(f"case when has_{r} = 1 then '{r}' end" for r in cutoffs)}) as rejected_by
        from measured m left join blame b on m.doc_id = b.doc_id)"""


def quality_rules() -> str:
    return f"with {rules_cte()} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by from judged"


def decontamination() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"list_filter(string_split_regex({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
    with d as (select doc_id, {words} as w from documents),
    b as (select item_id::varchar as item, {words} as w from benchmark),
    win as (select item, size, array_to_string(w[i:i + size - 1], ' ') as gram from (
        select item, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
    sizes as (select distinct size from win),
    spots as (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as gram from (
        select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
    hit as (select doc_id, i, spots.size, item from spots join win on spots.size = win.size and spots.gram = win.gram),
    pos as (select distinct doc_id, unnest(range(i, i + size)) as p from hit),
    npos as (select doc_id, count(*) as n_hit from pos group by doc_id),
    items as (select doc_id, list_sort(list(distinct item)) as items from hit group by doc_id)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
        sha256(array_to_string(coalesce(items, []), ',')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join npos on d.doc_id = npos.doc_id left join items on d.doc_id = items.doc_id"""


def url_filter() -> str:
    from . import url_filter as u

    low = f"translate(coalesce(url, ''), '{u.UPPER}', '{u.LOWER}')"
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    longest = sorted(u.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in longest)
    a = len(u.ALPHABET)

    def log_p(k: str) -> str:
        p0 = f"(c_{k} + 1) / (all_{k} + {a})"
        p1 = f"(case when b_n_{k} + b_t_{k} > 0 then (bc_{k} + b_t_{k} * {p0}) / (b_n_{k} + b_t_{k}) else {p0} end)"
        return f"ln(case when ab_n_{k} + ab_t_{k} > 0 then (n_{k} + ab_t_{k} * {p1}) / (ab_n_{k} + ab_t_{k}) else {p1} end)"

    both = lambda text: ", ".join(text.replace("@", k) for k in ("allow", "block"))
    return rf"""
    with cut as (select page_id, coalesce(url, '') as url, case when contains(coalesce(url, ''), '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
    part as (select page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
    rows_ as (select page_id, host, path, case {rule} end as rule, case {verdict} end as verdict, md5(url)[1] in ('0', '1', '2') as held,
        '^^' || regexp_replace(regexp_replace({low}, '[0-9]', '0', 'g'), '[^a-z0/._\-?=&#%:]', '~', 'g') || '$' as s from part),
    spread as (select page_id, case when not held then verdict end as v, s[i:i + 2] as gram from (select *, unnest(range(1, length(s) - 1)) as i from rows_)),
    g as (select gram, gram[1:2] as ab, gram[2:3] as bc, gram[2] as b, gram[3] as c, count(*) filter (v = 'allow') as n_allow, count(*) filter (v = 'block') as n_block from spread group by gram),
    bc as (select bc, b, c, {both("sum(n_@) as bc_@")} from g group by all),
    ab as (select ab, {both("sum(n_@) as ab_n_@, count(*) filter (n_@ > 0) as ab_t_@")} from g group by ab),
    b as (select b, {both("sum(bc_@) as b_n_@, count(*) filter (bc_@ > 0) as b_t_@")} from bc group by b),
    c as (select c, {both("sum(bc_@) as c_@")} from bc group by c),
    everything as (select {both("sum(n_@) as all_@")} from g),
    model as (select gram, {log_p("allow")} - {log_p("block")} as ratio from g join bc using (bc) join ab using (ab) join b on g.b = b.b join c on g.c = c.c, everything),
    scores as (select page_id, round(avg(ratio), 6) as score from spread join model using (gram) group by page_id),
    held as (select verdict, score from rows_ join scores using (page_id) where held and verdict is not null),
    cuts as (select round(0.05 * unnest(range(-20, 21)), 2)::double as x),
    errors as (select x, round(count(*) filter (verdict = 'allow' and score < x) / count(*) filter (verdict = 'allow') + count(*) filter (verdict = 'block' and score >= x) / count(*) filter (verdict = 'block'), 12) as e from cuts, held group by x),
    best as (select case when (select count(distinct verdict) from held) = 2 then first(x order by e, abs(x), x) end as x from errors)
    select page_id, host, path, rule, coalesce(verdict, case when best.x is null or score >= best.x then 'allow' else 'block' end) as verdict from rows_ join scores using (page_id), best"""


def licenses() -> str:
    from . import licenses as m

    text = lambda s: "'" + s.replace("'", "''") + "'"
    low = lambda s: f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    norm = lambda s: f"regexp_replace(regexp_replace({low(s)}, {text(m.DROPPED)}, ' ', 'g'), {text(m.EDGES)}, '', 'g')"
    values = lambda d: ", ".join(f"({text(k)}, {text(v)})" for k, v in d.items())
    # a sentence's identifier by joins with the tables of names and sentences
    known = lambda source, key: f"""select s.*, case when regexp_matches(n, {text(m.COPYRIGHT)}) then 'copyright' when regexp_matches(n, {text(m.SPDX)}) then 'spdx:' || a.id
        when regexp_matches(n, {text(m.GRANT)}) then 'grant:' || b.id else c.id end as id from (select *, {norm(key)} as n from {source}) s
        left join names a on a.name = regexp_extract(n, {text(m.SPDX)}, 1) left join names b on b.name = regexp_extract(n, {text(m.GRANT)}, 1) left join known c on c.name = n"""  # noqa: E731
    rest, got = "' ' || ids || ' '", "[]::varchar[]"
    steps, last = [], "seq0"
    for i, (name, seq) in enumerate(m.RULES, 1):
        pattern, left = text(m.rule_pattern(seq)), text(m.rule_left(seq).replace("$", "\\"))
        steps.append(f"seq{i} as (select doc_id, case when regexp_matches(rest, {pattern}) then regexp_replace(rest, {pattern}, {left}, 'g') else rest end as rest, case when regexp_matches(rest, {pattern}) then list_append(got, '{name}') else got end as got from {last})")
        last = f"seq{i}"
    return rf"""
    with names(name, id) as (values {values(m.NAMES)}), known(name, id) as (values {values(m.SENTENCES)}),
    chunk as (select doc_id, unnest(c) as c, generate_subscripts(c, 1) as i from (select doc_id, string_split_regex(regexp_replace(coalesce(text, ''), {text(m.END_MARK)}, '\1\2' || chr(10) || chr(10), 'g'), {text(m.BLANK)}) as c from documents)),
    whole as ({known("chunk", "c")}),
    line as (select doc_id, i, unnest(l) as l, generate_subscripts(l, 1) as j from (select doc_id, i, string_split(c, chr(10)) as l from whole where id is null and regexp_matches(lower(c), 'under|{m.CUE}'))),
    lines as ({known("line", "l")}),
    ids as (select doc_id, i, 0 as j, id from whole where id is not null union all select doc_id, i, j, id from lines where id is not null),
    per as (select doc_id, string_agg(id, ' ' order by i, j) as ids from ids group by doc_id),
    like_ as (select doc_id, count(*) as n from chunk where regexp_matches(c, '(?i){m.CUE}') group by doc_id),
    seq0 as (select doc_id, {rest} as rest, {got} as got from per),
    {", ".join(steps)},
    found as (select doc_id, list_sort(list_distinct(list_concat(got, list_transform(list_filter(string_split(rest, ' '), lambda x: regexp_matches(x, '^(?:grant|spdx):')), lambda x: regexp_replace(x, '^[a-z]+:', ''))))) as l from {last})
    select d.doc_id, coalesce(like_.n, 0)::bigint as n_license_like, coalesce(replace(per.ids, ' ', ','), '') as sentence_ids, coalesce(array_to_string(l, ','), '') as licenses
    from documents d left join per on d.doc_id = per.doc_id left join like_ on d.doc_id = like_.doc_id left join found on d.doc_id = found.doc_id"""


def secret_scan() -> str:
    """Windows are written out one by one, their characters counted anew: nothing is carried from window to window."""
    key = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = rf"""{key}["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, 0, 0), ("access", "AKIA[A-Z0-9]{16,}", 0, 0), ("hex", "[0-9a-f]{24,}", 0, 0),
             ("entropy_base64", "[A-Za-z0-9+/_-]{24,}", 24, 4.0), ("entropy_hex", "[0-9A-Fa-f]{20,}", 20, 3.0), ("entropy_upper", "[A-Z0-9]{20,}", 20, 3.7)]
    raw = " union all ".join(
        f"select doc_id, {i} as k, '{k}' as kind, {w} as w, {bits}::double as bits, string_split_regex(t, '{p}') as b, regexp_extract_all(t, '{p}') as m from docs where regexp_matches(t, '{p}')"
        for i, (k, p, w, bits) in enumerate(kinds))
    allowed = ["[A-Za-z+/_-]+", "[0-9+/_-]+", "(?:[A-Za-z]{0,15}[0-9]{0,4}[+/_-])*[A-Za-z]{0,15}[0-9]{0,4}",
               "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", ".*(?:EXAMPLE|example).*"]
    known = " or ".join(f"regexp_full_match(v, '{a}')" for a in allowed)
    before = r"(?:sha(?:1|224|256|384|512)|md5|commit|revision|integrity|base64)[\x20:=,\x22''-]*$"
    return rf"""
    with docs as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
    raw as ({raw.replace("select doc_id,", "select r,")}),
    one as (select r, k, kind, w, bits, unnest(b[1:len(m)]) as b, unnest(m) as v, generate_subscripts(m, 1) as i from raw),
    placed as (select *, (sum(length(b) + length(v)) over (partition by r, k order by i) - length(v))::bigint as s from one),
    base as (select r, k, kind, s, s + length(v) as e from placed where case k when 0 then length(regexp_extract(v, '{assign}', 1)) >= 6 when 1 then length(v) >= 20 when 2 then length(v) >= 24 end),
    cand as (select placed.*, s + length(v) as e from placed join docs using (r) where k > 2 and not ({known}) and not regexp_matches(lower(substr(t, greatest(s - 16, 0) + 1, s - greatest(s - 16, 0))), '{before}')),
    win as (select r, k, s, w, bits, o, substr(v, o, w) as x from (select *, unnest(range(1, length(v) - w + 2)) as o from cand)),
    chars as (select r, k, s, o, w, bits, ch, count(*) as c from (select *, unnest(string_split(x, '')) as ch from win) group by all),
    sums as (select r, k, s, o, sum(round(c * log2(c) * 1048576))::bigint as total, any_value(w) as w, any_value(bits) as bits from chars group by r, k, s, o),
    hot as (select distinct r, k, s from sums where total <= floor((log2(w) - bits) * w * 1048576)),
    tall as (select c.* from cand c join hot using (r, k, s)),
    first_ as (select * from tall where k = 3),
    second as (select * from tall t where k = 4 and not exists (select 1 from first_ f where f.r = t.r and f.s < t.e and t.s < f.e)),
    third as (select * from tall t where k = 5 and not exists (select 1 from (select * from first_ union all select * from second) f where f.r = t.r and f.s < t.e and t.s < f.e)),
    every as (select * from base union all select r, k, kind, s, e from first_ union all select r, k, kind, s, e from second union all select r, k, kind, s, e from third),
    per as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, count(*) filter (k > 2) as n_entropy,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from every group by r)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0) as n_entropy
    from docs left join per using (r)"""


def merkle_manifest(levels: int = 6) -> str:
    """Places by row numbers; ``levels`` levels in every tree, enough for 16 ** levels rows of a source."""
    value = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end"
    leaf = lambda text: "sha256(" + " || ".join([value("doc_id"), value("source"), value("lang"), value("n_chars"), value(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, b: {step}), 4294967295)"

    def tree(name: str, start: str) -> str:
        out, nodes = [], start
        for k in range(levels):
            out.append(f"{name}r{k} as (select g, pos // 16 as run, string_agg(h, '' order by pos) as slots, any_value(n) as n from {nodes} where n > 1 group by g, pos // 16)")
            out.append(f"{name}l{k + 1} as (select g, run as pos, sha256(slots) as h, (n + 15) // 16 as n from {name}r{k})")
            nodes = f"{name}l{k + 1}"
        tops = " union all ".join(f"select g, h from {t} where n = 1" for t in [start, *[f"{name}l{k + 1}" for k in range(levels)]])
        return ", ".join([*out, f"{name}top as ({tops})"])

    def way(table: str, name: str, g: str, pos: str) -> str:
        """Siblings and the fold along a way, one step after the other."""
        out = []
        for k in range(levels):
            p = f"({pos} // {16 ** k})"
            at = f"64 * ({p} % 16)"
            a, b = f"substr(r.slots, 1, {at})", f"substr(r.slots, {at} + 65)"
            out.append(f"""{name}w{k} as (select t.* exclude (sib, fold), sib || coalesce({a} || {b}, '') as sib, case when r.slots is null then fold else sha256({a} || fold || {b}) end as fold
                from {table} t left join {name}r{k} r on r.g = {g} and r.run = {p} // 16)""")
            table = f"{name}w{k}"
        return ", ".join(out)

    last = f"bw{levels - 1}"
    return f"""
    with d as (select doc_id, coalesce('=' || source, '-') as src, {leaf("text")} as h, case when doc_id is not null and ({crc}) % 5 = 0 then {leaf(low)} else {leaf("text")} end as other from documents),
    a0 as (select src as g, doc_id, h, other, row_number() over (partition by src order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by src) as n from d),
    {tree("a", "a0")},
    b0 as (select '' as g, g as src, h, row_number() over (order by g) - 1 as pos, count(*) over () as n from atop),
    {tree("b", "b0")},
    s as (select a0.*, b0.h as subroot, b0.pos as spos, '' as sib, other as fold from a0 join b0 on b0.src = a0.g),
    {way("s", "a", "t.g", "pos")},
    {way(f"aw{levels - 1}", "b", "''", "spos")}
    select doc_id, {last}.h as leaf, subroot, btop.h as root, sha256(sib) as proof_sha256, fold as folded_root, fold = btop.h as verified from {last}, btop"""
