"""DuckDB SQL fragments that restate the column functions, for the side-by-side checks.

Each function takes and returns SQL text. RE2 grammar; list lambdas in the ``lambda x: ...`` form.
"""

from __future__ import annotations

from linklake.functions.fixed import MULTI_SUFFIXES, STOPWORDS, TRACKING_PARAMS

#: White space and control characters at both ends, the same set as in functions.urls.EDGE.
_WS = r"[\s\x{00}-\x{20}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def trimmed(u: str) -> str:
    return f"regexp_replace({u}, '^{_WS}|{_WS}$', '', 'g')"


def scheme(t: str) -> str:
    return rf"lower(regexp_extract({t}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"


def absolute(u: str) -> str:
    t = trimmed(u)
    return f"(case when {t} = '' then null when {scheme(t)} = '' then 'https://' || {t} else {t} end)"


def is_web(a: str) -> str:
    return f"regexp_matches({a}, '^(?i:https?):')"


def web(a: str, group: int) -> str:
    return rf"regexp_extract({a}, '(?s)^(?i:https?):/*(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(?:\?([^#]*))?', {group})"


def host_of(a: str) -> str:
    h = rf"regexp_replace(lower({web(a, 1)}), '\.$', '')"
    return rf"(case when {is_web(a)} and not regexp_matches({h}, '[\s<>^|%]') then {h} else '' end)"


def host(u: str) -> str:
    return host_of(absolute(u))


def hostname(u: str) -> str:
    return rf"regexp_replace({host(u)}, '^www\.', '')"


def base_domain_of(h: str) -> str:
    parts = f"list_filter(string_split({h}, '.'), lambda p: p <> '')"
    tail = lambda k: f"array_to_string(list_slice({parts}, -{k}, -1), '.')"
    return rf"(case when {h} = '' or regexp_matches({h}, '^[0-9]+(\.[0-9]+){{3}}$') or len({parts}) <= 2 then {h} when {tail(2)} in ({strings(MULTI_SUFFIXES)}) then {tail(3)} else {tail(2)} end)"


def decoded(v: str) -> str:
    ok = rf"not regexp_matches({v}, '%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))')"
    return f"(case when {ok} then url_decode(replace({v}, '+', ' ')) else {v} end)"


def normalize(source: str, u: str, out: str, keep: str) -> str:
    """A SELECT over ``source`` with the columns ``keep`` and the canonical form of ``u`` as ``out``; staged in
    subqueries, as the expression would otherwise be repeated many times."""
    fields = f"list_filter(string_split({web('a', 4)}, '&'), lambda f: f <> '')"
    pair = f"{{'k': lower({decoded(chr(39).join(['regexp_extract(f, ', '(?s)^([^=]*)', ', 1)']))}), 'i': i, 'v': {decoded(chr(39).join(['regexp_extract(f, ', '(?s)^[^=]*=(.*)$', ', 1)']))}}}"
    return f"""
      select {keep}, case when a is null then '' when {is_web('a')} and h <> '' then
               s || '://' || h || (case when port in ('', ':') or (s = 'http' and port = ':80') or (s = 'https' and port = ':443') then '' else port end)
               || (case when p = '' then '/' when length(p) > 1 then coalesce(nullif(regexp_replace(p, '/+$', ''), ''), '/') else p end)
               || (case when q = '' then '' else '?' || q end)
             else lower(case when s0 = '' then t else a end) end as {out}
      from (select *, array_to_string(list_transform(list_sort(list_filter(ps, lambda x: x.k not in ({strings(TRACKING_PARAMS)}))),
                      lambda x: case when x.v = '' then x.k else x.k || '=' || x.v end), '&') as q
            from (select *, list_transform({fields}, lambda f, i: {pair}) as ps, {scheme('a')} as s, {web('a', 2)} as port, {web('a', 3)} as p,
                         regexp_replace(lower({web('a', 1)}), '\\s', '', 'g') as h
                  from (select *, {trimmed(u)} as t, {scheme(trimmed(u))} as s0, {absolute(u)} as a from {source})))"""


def tokens(t: str) -> str:
    low = f"lower(coalesce({t}, ''))"
    words = rf"list_transform(regexp_extract_all({low}, '[a-z0-9][a-z0-9+#._\-]+'), lambda w: regexp_replace(w, '[._\-]+$', ''))"
    runs = f"regexp_extract_all({low}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]{{2,}}')"
    pairs = f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))"
    return f"list_distinct(list_filter(list_concat({words}, {pairs}), lambda w: length(w) >= 2 and w not in ({strings(STOPWORDS)})))"


def squeezed(t: str) -> str:
    return f"regexp_replace(lower(coalesce({t}, '')), '[\\s\\x{{0b}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', '', 'g')"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0 else {both}::double / (len({a}) + len({b}) - {both}) end)"


def grams(s: str) -> str:
    """Numbered bigrams as text, so that a plain intersection counts repeats."""
    plain = f"list_sort(list_transform(range(1, length({s})), lambda i: substring({s}, i, 2)))"
    # bound once as a list of one list, or it would be sorted again for every gram
    return f"list_transform([{plain}], lambda o: list_transform(o, lambda g, i: g || '|' || (i - list_position(o, g))))[1]"


def dice_of(s: str, t: str) -> str:
    return f"(case when length({s}) < 2 or length({t}) < 2 then (case when {s} = {t} and {s} <> '' then 1.0 else 0.0 end) else 2.0 * len(list_intersect({grams(s)}, {grams(t)})) / (length({s}) + length({t}) - 2) end)"


def dice_sets(s: str, t: str, gs: str, gt: str) -> str:
    """As ``dice_of``, with the numbered bigrams of both texts at hand."""
    return f"(case when length({s}) < 2 or length({t}) < 2 then (case when {s} = {t} and {s} <> '' then 1.0 else 0.0 end) else 2.0 * len(list_intersect({gs}, {gt})) / (length({s}) + length({t}) - 2) end)"
