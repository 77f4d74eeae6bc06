"""DuckDB SQL of the operators that SQL can say, written by hand from their rules."""

from __future__ import annotations

from . import line_rules as lr
from . import link_trust as lt
from . import merkle_manifest as mm
from . import phrase_setm as ps

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op5() -> str:
    gap, symbols = _quoted(lr.GAP), _quoted(lr.SYMBOLS)
    phrases = " or ".join(f"contains(lower(line), {_quoted(p)})" for p in lr.BOILERPLATE)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (
    select rid, list_filter(regexp_split_to_array(text, {gap}), lambda x: x <> '') as words from d
),
place as (select rid, words, unnest(range(1, len(words) - 1)) as k from w where len(words) >= 3),
win as (select rid, k, words[k] as a, words[k + 1] as b, words[k + 2] as c from place),
twice as (
    select rid, k from (select rid, k, count(*) over (partition by rid, a, b, c) as n from win) where n > 1
),
hit as (select rid, count(distinct k + o) as n from twice, (values (0), (1), (2)) t(o) group by rid),
line as (
    select rid, line, length(line) as chars,
        len(regexp_extract_all(line, {_quoted(lr.SEPARATED)})) as separators,
        len(regexp_extract_all(line, {symbols})) as symbols,
        regexp_matches(line, {_quoted(lr.CLOSED)}) as closed
    from (select rid, unnest(string_split(text, chr(10))) as line from d)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
judged as (
    select distinct rid, line, chars,
        (separators >= {lr.ENTRIES} and separators * {lr.ENTRY_CHARS} >= chars)
        or symbols * 100 > chars * {lr.SYMBOL_SHARE}
        or not closed or {phrases} as fails
    from line
),
lines as (
    select rid, count(*) as n_lines, count(distinct line) as n_distinct, sum(chars) as all_chars
    from line group by rid
),
kept_lines as (select rid, sum(chars) as chars from judged where not fails group by rid),
base as (
    select doc_id, len(words) as n_words, length(regexp_replace(text, {gap}, '', 'g')) as word_chars,
        len(regexp_extract_all(text, {symbols})) as n_symbols,
        coalesce(n_lines - n_distinct, 0) as n_dup_lines, coalesce(hit.n, 0) as n_repeat_words,
        coalesce(all_chars, 0) as all_chars, coalesce(kept_lines.chars, 0) as left_chars
    from d join w using (rid) left join hit using (rid) left join lines using (rid)
        left join kept_lines using (rid)
),
failed as (
    select *, n_words < {lr.MIN_WORDS} or n_repeat_words * 100 > n_words * {lr.REPEATED} as base_failed from base
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and (all_chars - left_chars) * 100 <= all_chars * {lr.LOSS} as kept
from failed
"""


def _case(rules, what) -> str:
    ranked = sorted(rules, key=lambda r: -len(r.name))
    whens = " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        f" then '{what(r)}'"
        for r in ranked
    )
    return f"case {whens} end"


def _spread(name: str, edges: str, seeds: str, rounds: int) -> str:
    """Rounds of the walk as one common table expression each."""
    parts = [
        f"{name}_links as (select src, count(*) as links from {edges} group by src)",
        f"{name}_0 as (select host, {lt.UNITS} // (select count(*) from {seeds}) as score from {seeds})",
        f"{name}_back as (select host, score * {100 - lt.DAMPING} // 100 as score from {name}_0)",
    ]
    for k in range(rounds):
        parts.append(
            f"""{name}_{k + 1} as materialized (
    select host, sum(score)::bigint as score from (
        select dst as host, (score * {lt.DAMPING} // 100) // links as score
        from {edges} join {name}_links using (src) join {name}_{k} on host = src
        union all select host, score from {name}_back
    ) where score > 0 or host in (select host from {seeds}) group by host)"""
        )
    return ",\n".join(parts)


def op2(rounds: int = lt.ROUNDS) -> str:
    host = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)"
    host = f"translate({host}, '{_UPPER}', '{_LOWER}')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1)"
    return f"""
with u as (select page_id, {host} as host, {path} as path, coalesce(html, '') as html from pages),
r as (
    select page_id, host, path, {_case(lt.RULES, lambda r: r.name)} as rule,
        {_case(lt.RULES, lambda r: r.verdict)} as by_rule from u
),
e as (
    select distinct src, dst from (
        select host as src, translate(unnest(regexp_extract_all(html, {_quoted(lt.LINK)}, 1)),
            '{_UPPER}', '{_LOWER}') as dst from u
    ) where src <> dst and src <> '' and dst <> ''
),
b as (select src as dst, dst as src from e),
blocked as (select distinct host from r where by_rule = 'block' and host <> ''),
trusted as (
    select distinct host from r where by_rule = 'allow' and host <> '' and host not in (select host from blocked)
),
{_spread("trust", "e", "trusted", rounds)},
{_spread("doubt", "b", "blocked", rounds)},
hosts as (
    select count(*) as n from (select src from e union select dst from e union select host from r
        where by_rule is not null and host <> '')
),
scored as (
    select r.*, coalesce(t.score, 0) as trust, coalesce(x.score, 0) as doubt,
        {lt.UNITS * lt.THRESHOLD} // greatest((select n from hosts), 1) as share
    from r left join trust_{rounds} t on t.host = r.host left join doubt_{rounds} x on x.host = r.host
)
select page_id, host, path, rule,
    coalesce(by_rule, case when doubt >= share and doubt > trust then 'block' else 'allow' end) as verdict
from scored
"""


def op12(longest: int = ps.LONGEST) -> str:
    """Grams of every length by list positions, then all cuts of each candidate."""
    words = [f"w{k}" for k in range(1, longest + 1)]
    grams = " union all ".join(
        f"select lang, {n} as size, {', '.join(f'w[k + {j}] as {w}' if j < n else f'null as {w}' for j, w in enumerate(words))}"
        f" from place where k + {n - 1} <= len(w)"
        for n in range(1, longest + 1)
    )

    def cut(n: int, k: int) -> str:
        first = " and ".join(f"l.w{j} = c.w{j}" for j in range(1, k + 1))
        rest = " and ".join(f"r.w{j - k} = c.w{j}" for j in range(k + 1, n + 1))
        return f"""select c.*, {k} as k, l.f as l, r.f as r from candidate c
            join f l on l.lang = c.lang and l.size = {k} and {first}
            join f r on r.lang = c.lang and r.size = {n - k} and {rest} where c.size = {n}"""

    def inside(n: int, longer: int, at: int) -> str:
        same = " and ".join(f"x.w{j + at} = c.w{j}" for j in range(1, n + 1))
        return f"""select c.phrase, c.lang from candidate c join candidate x
            on x.lang = c.lang and x.size = {longer} and {same} and 100 * x.a >= {ps.SHARE} * c.a where c.size = {n}"""

    sizes = range(2, longest + 1)
    cuts = " union all ".join(cut(n, k) for n in sizes for k in range(1, n))
    gone = " union all ".join(inside(n, m, at) for n in sizes for m in range(n + 1, longest + 1) for at in range(m - n + 1))
    return f"""
with piece as (
    select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents
),
words as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from piece),
place as (select lang, w, unnest(range(1, len(w) + 1)) as k from words),
gram as ({grams}),
f as (select lang, size, {", ".join(words)}, count(*) as f from gram group by all),
total as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
candidate as (
    select lang, size, {", ".join(words)}, concat_ws(' ', {", ".join(words)}) as phrase, f as a
    from f where size > 1 and f >= {ps.LEAST}
),
cut as (select *, (1000000::hugeint * a * a) // (l::hugeint * r) as score from ({cuts})),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
gone as ({gone}),
ranked as (
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
        phrase, a, l, r, score
    from low anti join gone using (lang, phrase)
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= {ps.TOP}
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit (polynomial 0xEDB88320)."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: {bits}))"


def op13() -> str:
    """Levels by recursion, then every leaf folded along its own path."""

    def leaf(**changed: str) -> str:
        values = [changed.get(name, f"{name}::varchar") for name in mm.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    even = f"coalesce({_crc32('doc_id::varchar')} % 2 = 0, false)"
    n = mm.ARITY

    def levels(bottom: str) -> str:
        return f"""select tree, 0 as lvl, pos, h from {bottom}
    union all
    select tree, lvl + 1, pos // {n}, sha256(string_agg(h, '' order by pos))
    from (select *, count(*) over (partition by tree) as m from {bottom}_node) where m > 1
    group by tree, lvl, pos // {n}"""

    def folds(bottom: str, first: str) -> str:
        return f"""{first}
    union all
    select f.rid, f.tree, f.lvl + 1, f.pos // {n},
        sha256(string_agg(case when x.pos = f.pos then f.h else x.h end, '' order by x.pos)),
        any_value(f.proof) || string_agg(case when x.pos = f.pos then '' else x.h end, '' order by x.pos)
    from {bottom}_fold f join {bottom}_node x on x.tree = f.tree and x.lvl = f.lvl and x.pos // {n} = f.pos // {n}
    join {bottom}_top t on t.tree = f.tree where f.lvl < t.lvl
    group by f.rid, f.tree, f.lvl, f.pos"""

    top = "select tree, lvl, h from {0}_node qualify lvl = max(lvl) over (partition by tree)"
    return f"""
with recursive hashed as (
    select row_number() over () as rid, doc_id, coalesce(':' || source, '-') as tree, {leaf()} as h,
        case when {even} then {leaf(text="replace(text, chr(10), '')")} else {leaf()} end as claimed
    from documents
),
leaf as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as pos from hashed),
leaf_node as ({levels("leaf")}),
leaf_top as ({top.format("leaf")}),
source as (select '' as tree, tree as name, row_number() over (order by tree) - 1 as pos, h from leaf_top),
source_node as ({levels("source")}),
source_top as ({top.format("source")}),
leaf_fold as ({folds("leaf", "select rid, tree, 0 as lvl, pos, claimed as h, '' as proof from leaf")}),
below as (select f.* from leaf_fold f join leaf_top t using (tree, lvl)),
source_fold as ({folds("source", "select b.rid, s.tree, 0 as lvl, s.pos, b.h, b.proof from below b join source s on s.name = b.tree")}),
done as (select f.* from source_fold f join source_top t using (tree, lvl))
select doc_id, leaf.h as leaf, leaf_top.h as subroot, source_top.h as root, sha256(done.proof) as proof_sha256,
    done.h as folded_root, done.h = source_top.h as verified
from leaf join done using (rid) join leaf_top on leaf_top.tree = leaf.tree cross join source_top
"""


ORACLE: dict[str, str] = {
    "op2_link_trust": op2(),
    "op5_line_rules": op5(),
    "op12_phrase_setm": op12(),
    "op13_merkle_manifest": op13(),
}
