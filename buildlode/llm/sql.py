"""Check SQL of the host rules and the conversation operators."""

from __future__ import annotations

from . import hostrules

WORD = "'[^ \\t-\\r]+'"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda z: ord(z)::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {codes}), lambda c, b: {bits}), 4294967295)"


_RULES = hostrules.RULES
_FAILED = ", ".join(f"count(*) filter (where {test}) as {rule}" for rule, test in _RULES.items())
_PRIORS = ", ".join(
    f"sum({r}) / sum(docs) as {r}_mean, sum({r} * {r} / docs) as {r}_squares" for r in _RULES
)
_WITHIN = ", ".join(
    f"""case when {r}_mean * (1 - {r}_mean) * (n - squares / n - (hosts - 1)) > 0
        then ({r}_squares - n * {r}_mean * {r}_mean - {r}_mean * (1 - {r}_mean) * (hosts - 1))
             / ({r}_mean * (1 - {r}_mean) * (n - squares / n - (hosts - 1))) else 0 end as {r}_within"""
    for r in _RULES
)
_STRENGTH = ", ".join(f"case when {r}_within > 0 then least(greatest(1 / {r}_within - 1, 1), n) else n end as {r}_strength" for r in _RULES)
_VERDICT = " or ".join(f"({r} + {r}_strength * {r}_mean) / (docs + {r}_strength) > {hostrules.HOST_CUT}" for r in _RULES)

HOST_SQL = f"""
with texts as (
    select row_number() over () as row, doc_id, coalesce(text, '') as text,
           nullif(regexp_extract(translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1), '') as host
    from documents
), worded as (
    select *, regexp_extract_all(text, {WORD}) as words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORD})) as lines
    from texts
), windows as (
    select row, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram, i
    from (select row, words, unnest(range(1, len(words) - 1)) as i from worded where len(words) > 2)
), covered as (
    select row, count(*) as n from (
        select distinct row, unnest([i, i + 1, i + 2]) as word
        from (select row, i, count(*) over (partition by row, gram) as times from windows) w where times > 1
    ) c group by row
), counted as (
    select doc_id, host, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, '[ \\t-\\r]', '', 'g')) as bigint) as word_chars,
           cast(length(text) - length(translate(text, '{hostrules.SYMBOLS}', '')) as bigint) as n_symbols,
           cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
           len(lines) as n_lines
    from worded left join covered using (row)
), hosts as (
    select host, count(*)::double as docs, {_FAILED} from counted where host is not null group by host
), sums as (
    select count(*)::double as hosts, sum(docs) as n, sum(docs * docs) as squares, {_PRIORS} from hosts
), spread as (select *, {_WITHIN} from sums), priors as (select *, {_STRENGTH} from spread), rejected as (
    select host as rejected from hosts, priors where {_VERDICT}
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_RULES['base']} as base_failed,
       not ({_RULES['base']}) and rejected is null as kept, host, rejected is not null as host_rejected
from counted left join rejected on host = rejected
"""


# Each search state keeps its cheapest edits so far as text: cost in nine digits, then the
# edits, so the least text is the least cost and, of those, the ASCII-least edits.
def _more(state: str, cost: str, edit: str) -> str:
    return f"(printf('%09d', cast(left({state}, 9) as bigint) + {cost}) || substr({state}, 10) || '{edit}')"


def _least(*options: str) -> str:
    return f"least({', '.join(options)})"


_OK = "fault not in ('blank', 'duplicate')"
_TRUNCATED = "case when fault = 'truncated' then 5 else 0 end"


def _if(test: str, value: str) -> str:
    return f"case when {test} then {value} end"


_STEP = f"""
    select w.conv_id, w.pos + 1 as pos,
           {_more('w.p0', '2', 'D')} as p0,
           {_least(_more('w.ps', '2', 'D'), _if(f"{_OK} and first = 's'", _more('w.p0', _TRUNCATED, 'K')))} as ps,
           {_least(_more('w.iu', '2', 'D'), _if(f"{_OK} and first = 'u'", _more('w.for_u', _TRUNCATED, 'K')), _if(_OK, _more('w.for_u', f'1 + {_TRUNCATED}', 'R')))} as pu,
           {_least(_more('w.ia', '2', 'D'), _if(f"{_OK} and first = 'a'", _more('w.iu', _TRUNCATED, 'K')), _if(_OK, _more('w.iu', f'1 + {_TRUNCATED}', 'R')))} as pa
    from opened w join faults f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos + 1
"""
# With up to two inserted turns before the next one.
_OPENED = f"""
    select *, {_least('pu', _more('p0', '5', 'I'), _more('ps', '5', 'I'), _more('pa', '5', 'I'))} as iu,
           {_least('pa', _more('pu', '5', 'I'), _more('p0', '10', 'II'), _more('ps', '10', 'II'))} as ia,
           {_least('p0', 'ps', _least('pa', _more('pu', '5', 'I'), _more('p0', '10', 'II'), _more('ps', '10', 'II')))} as for_u
"""

REPAIR_SQL = f"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           {crc32("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as k
    from conversations
), damaged as (
    select conv_id, turn, case when k = 4 then 'user' else role end as role,
           case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text,
           unnest(case when k = 3 then [0, 1] else [0] end) as copy
    from keyed where k <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as stripped
    from damaged
), timed as (
    select *, row_number() over (partition by conv_id, role, text order by pos) as times from placed
), faults as (
    select conv_id, turn, role, text, pos, left(role, 1) as first,
           case when stripped = '' then 'blank' when times > 1 then 'duplicate' when right(stripped, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
           left(lag(role) over (partition by conv_id order by pos), 1) || left(role, 1) as pair
    from timed
), ids as (
    select distinct conv_id from conversations
), walk as (
    select conv_id, 0::bigint as pos, '000000000' as p0, null::varchar as ps, null::varchar as pu, null::varchar as pa from ids
    union all
    select * from (with opened as ({_OPENED} from walk) {_STEP})
), last_step as (
    select conv_id, arg_max(least(p0, pa, {_more('pu', '5', 'I')}, {_more('ps', '10', 'II')}), pos) as best from walk group by conv_id
), audited as (
    select conv_id, cast(left(best, 9) as bigint) as cost, substr(best, 10) as audit from last_step
), edits as (
    select conv_id, audit, unnest(range(1, length(audit) + 1)) as step from audited
), taken as (
    select conv_id, step, substr(audit, step, 1) as edit,
           length(translate(left(audit, step), 'I', '')) as pos,
           length(translate(left(audit, step), 'D', '')) as made
    from edits
), lined as (
    select t.conv_id, t.step, t.edit, t.made, f.role, f.text,
           max(case when t.edit = 'K' and t.made = 1 and f.first = 's' then 1 else 0 end) over (partition by t.conv_id) as opens
    from taken t left join faults f on f.conv_id is not distinct from t.conv_id and f.pos = t.pos and t.edit <> 'I'
    where t.edit <> 'D'
), repaired as (
    select conv_id, string_agg(case when edit = 'K' then role when (made - opens) % 2 = 1 then 'user' else 'assistant' end
                               || ':' || coalesce(text, ''), chr(10) order by step) as lines
    from lined group by conv_id
), counted as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
           count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
           count(*) filter (where fault = 'truncated') as truncated,
           count(*) filter (where pos > 1 and pair not in ('su', 'ua', 'au')) as illegal
    from faults group by conv_id
)
select i.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, sha256(coalesce(lines, '')) as repaired_sha256
from ids i left join counted c on c.conv_id is not distinct from i.conv_id
     join audited a on a.conv_id is not distinct from i.conv_id
     left join repaired r on r.conv_id is not distinct from i.conv_id
"""

TRIE_SQL = f"""
with listed as (
    select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
    from conversations where conv_id is not null group by conv_id
), rebuilt as (
    select c.conv_id, list_concat(coalesce(list_slice(f.turns, 1, {crc32('cast(c.conv_id as varchar)')} % 4), []),
                                  list_slice(c.turns, {crc32('cast(c.conv_id as varchar)')} % 4 + 1, len(c.turns))) as turns
    from listed c left join listed f on f.conv_id = c.conv_id - c.conv_id % 20
), starts as (
    select conv_id, len(turns) as size, turns, unnest(range(0, len(turns) + 1)) as depth from rebuilt
), prefixes as (
    select conv_id, size, depth, case when depth = 0 then [] else list_slice(turns, 1, depth) end as path from starts
), nodes as (
    select path, depth, min(conv_id) as conv_id, count(*) as n_convs, case when depth = 0 then null else list_slice(path, 1, depth - 1) end as parent,
           case when depth = 0 then 0 else len(regexp_extract_all(path[depth].text, {WORD})) end as words,
           sha256(coalesce(string_agg(case when size = depth then cast(conv_id as varchar) end, ',' order by conv_id), '')) as ends_sha256
    from prefixes group by path, depth
), parents as (
    select parent, count(*) as n_children from nodes where parent is not null group by parent
), full_nodes as (
    select n.*, coalesce(p.n_children, 0) as n_children from nodes n left join parents p on p.parent = n.path
), above as (
    select n_children, n_convs, words, case when up = 0 then [] else list_slice(path, 1, up) end as path
    from (select *, unnest(range(0, depth + 1)) as up from full_nodes)
), below as (
    select path, count(*) filter (where n_children = 0) as n_leaves, cast(sum((n_convs - 1) * words) as bigint) as saved_tokens from above group by path
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
from full_nodes n join below b on b.path = n.path left join nodes p on p.path = n.parent
"""
