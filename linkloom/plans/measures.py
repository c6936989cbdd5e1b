"""Similarities over common subsequences in SQL, by bit-parallel arithmetic on 128-bit integers: the other side of the string measures' queries."""

from __future__ import annotations

from linkloom.plans.views import tokens_sql


def ratio_sql(a: str, b: str) -> str:
    """Twice the longest common subsequence over both lengths, for two columns; the shorter one may have up to 126 letters."""
    short, long = (f"(case when length({a}) <= length({b}) then {x} else {y} end)" for x, y in ((a, b), (b, a)))
    full = f"((1::hugeint << length({short})::int) - 1)"
    masks = f"list_transform(string_split({long}, ''), lambda ch: list_sum(list_transform(range(1, length({short}) + 1), lambda i: case when ({short})[i] = ch then 1::hugeint << (i - 1)::int else 0::hugeint end)))"
    row = f"list_reduce(list_concat([{full}], {masks}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"case when length({a}) + length({b}) = 0 then 1.0 when length({a}) = 0 or length({b}) = 0 then 0.0 else 2.0 * (length({short}) - bit_count({row})) / (length({a}) + length({b})) end"


def measures_sql(pairs: str, name: str, partial: bool = False) -> str:
    """CTEs that end in ``name`` (``a, b, ratio, tset, tsort, jw`` and ``partial``) over the distinct ``a, b`` of a select."""
    x, y = f"list_distinct({tokens_sql('a')})", f"list_distinct({tokens_sql('b')})"
    joined = lambda l: f"array_to_string(list_sort({l}), ' ')"
    out = (
        f"{name}_d as materialized (select distinct a, b from ({pairs})), "
        f"{name}_w as materialized (select a, b, {joined(f'list_intersect({x}, {y})')} as both_, {joined(f'list_filter({x}, lambda t: not list_contains({y}, t))')} as only_a, {joined(f'list_filter({y}, lambda t: not list_contains({x}, t))')} as only_b, len({x}) as na, len({y}) as nb, {joined(tokens_sql('a'))} as sa, {joined(tokens_sql('b'))} as sb from {name}_d), "
        f"{name}_s as materialized (select *, trim(both_ || ' ' || only_a) as la, trim(both_ || ' ' || only_b) as lb from {name}_w)"
    )
    tset = f"case when na = 0 or nb = 0 then 0.0 when both_ <> '' and (only_a = '' or only_b = '') then 1.0 else greatest({ratio_sql('la', 'lb')}, case when both_ <> '' then greatest({ratio_sql('both_', 'la')}, {ratio_sql('both_', 'lb')}) else 0.0 end) end"
    columns = f"a, b, {ratio_sql('a', 'b')} as ratio, {tset} as tset, {ratio_sql('sa', 'sb')} as tsort, case when a = '' or b = '' then 0.0 else jaro_winkler_similarity(a, b) end as jw"
    if not partial:
        return f"{out}, {name} as materialized (select {columns} from {name}_s)"
    return (
        f"{out}, {name}_p as materialized (select a, b, case when length(a) <= length(b) then a else b end as short, case when length(a) <= length(b) then b else a end as long from {name}_d), "
        f"{name}_q as materialized (select a, b, short, unnest(list_distinct(list_transform(range(1 - length(short), length(long)), lambda i: substr(long, (greatest(0, i) + 1)::bigint, (i + length(short) - greatest(0, i))::bigint)))) as win from {name}_p where short <> '' and not contains(long, short)), "
        f"{name}_r as materialized (select a, b, max({ratio_sql('short', 'win')}) as partial from {name}_q group by a, b), "
        f"{name} as materialized (select s.*, case when short = '' then (long = '')::int::double when contains(long, short) then 1.0 else {name}_r.partial end as partial from (select {columns} from {name}_s) s join {name}_p p on p.a = s.a and p.b = s.b left join {name}_r on {name}_r.a = s.a and {name}_r.b = s.b)"
    )
