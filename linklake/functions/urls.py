"""URL expressions on Spark columns. All are JVM-side; none needs a Python worker.

One grammar serves Spark and the SQL checks: scheme, authority (user info dropped), host, port, path, query, fragment.
Not modelled: punycode, percent-encoding of raw characters, dot segments, numeric host forms, backslashes.
Null, blank and unparsable input: every function returns the defined value named in its docstring; none raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linklake.functions.fixed import LEGACY_SUFFIXES, MULTI_SUFFIXES, TRACKING_PARAMS

#: White space and control characters cut from both ends of an address.
EDGE = "".join(map(chr, [*range(33), 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))

_WEB = r"(?s)^(?i:(https?)):/*(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(?:\?([^#]*))?.*$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; Catalyst would repeat it at every use inside branches."""
    return F.transform(F.array(value), body).getItem(0)


def trimmed(u: Column) -> Column:
    return F.trim(u, F.lit(EDGE))


def scheme_of(u: Column) -> Column:
    """Lower-cased scheme without colon of trimmed text; '' if there is none."""
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def absolute(u: Column) -> Column:
    """Trimmed text, with ``https://`` in front where it has no scheme; null for null or blank."""
    return let(trimmed(u), lambda t: F.when(t == "", None).when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), t).otherwise(F.concat(F.lit("https://"), t)))


def is_web(a: Column) -> Column:
    return a.rlike(r"^(?i:https?):")


def _parts(a: Column) -> Column:
    """[scheme, host, port, path, query] of an absolute http(s) address, each '' if missing; one match does it."""
    return F.split(F.regexp_replace(a, _WEB, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001")


def _host(a: Column) -> Column:
    h = F.regexp_replace(F.lower(F.regexp_extract(a, _WEB, 2)), r"\.$", "")
    return F.when(is_web(a), let(h, lambda h: F.when(h.rlike(r"[\s<>^|%]"), "").otherwise(h))).otherwise(F.lit(""))


def host(u: Column) -> Column:
    """Lower-cased host of an http(s) address (scheme optional), without final dot; '' where there is none, null for null."""
    return let(absolute(u), lambda a: F.when(a.isNull(), F.when(u.isNotNull(), "")).otherwise(_host(a)))


def hostname(u: Column, strip_www: bool = True) -> Column:
    h = host(u)
    return F.regexp_replace(h, r"^www\.", "") if strip_www else h


def base_domain_of(h: Column, suffixes: list[str] = MULTI_SUFFIXES) -> Column:
    """Registrable domain of a host: numeric hosts and hosts of two labels or fewer as they are, '' for ''."""

    def cut(parts: Column) -> Column:
        n = F.size(parts)
        tail = lambda k: F.array_join(F.slice(parts, n - k + 1, F.lit(k)), ".")
        return F.when(n <= 2, h).when(tail(2).isin(suffixes), tail(3)).otherwise(tail(2))

    return F.when((h == "") | h.rlike(r"^[0-9]+(\.[0-9]+){3}$"), h).otherwise(let(F.filter(F.split(h, r"\."), lambda p: p != ""), cut))


def base_domain(u: Column) -> Column:
    return let(host(u), lambda h: base_domain_of(h))


def decoded(v: Column) -> Column:
    """Form-decoded value: ``+`` is a space, %XX its character; text with broken escapes stays as it is."""
    return F.when(~v.rlike("[%+]"), v).otherwise(F.coalesce(F.try_url_decode(v), v))


def normalize(u: Column, keep_tracking: bool = False, keep_params: list[str] | None = None, keep_trailing_slash: bool = False, ignore_scheme: bool = False) -> Column:
    """Canonical address: default port, fragment, tracking fields and trailing slashes dropped, fields sorted by key.

    Null gives ''. Text that is no http(s) address comes out trimmed and lower-cased.
    """
    drop = [] if keep_tracking else sorted(set(TRACKING_PARAMS) - {p.lower() for p in keep_params or []})

    def query(q: Column) -> Column:
        fields = F.transform(F.split(q, "&"), lambda f, i: F.struct(
            F.lower(decoded(F.substring_index(f, "=", 1))).alias("k"),
            i.alias("i"),
            F.when(f.contains("="), decoded(F.regexp_extract(f, "(?s)^[^=]*=(.*)$", 1))).otherwise("").alias("v"),
            f.alias("f"),
        ))
        kept = F.array_sort(F.filter(fields, lambda p: (p["f"] != "") & ~p["k"].isin(drop) if drop else p["f"] != ""))
        return F.array_join(F.transform(kept, lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")

    def web(p: Column) -> Column:
        scheme, h, port, path, q = F.lower(p[0]), F.regexp_replace(F.lower(p[1]), r"\s", ""), p[2], p[3], p[4]
        port = F.when(port.isin("", ":") | ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
        if not keep_trailing_slash:
            path = F.regexp_replace(path, "/+$", "")
        path = F.when(path == "", "/").otherwise(path)
        fields = F.when(q == "", "").otherwise(let(query(q), lambda x: F.when(x == "", "").otherwise(F.concat(F.lit("?"), x))))
        return F.concat(F.lit("//") if ignore_scheme else F.concat(scheme, F.lit("://")), h, port, path, fields)

    def whole(a: Column) -> Column:
        parts = let(_parts(a), lambda p: F.when(p[1] != "", web(p)))
        return F.when(a.isNull(), "").when(is_web(a), F.coalesce(parts, F.lower(trimmed(u)))).otherwise(F.lower(a))

    return let(absolute(u), whole)


def classify(u: Column) -> Column:
    """struct(kind, protocol, host): kind is empty, invalid, http or other; null counts as empty."""

    def of(a: Column) -> Column:
        h = _host(a)
        kind = F.when(a.isNull(), "empty").when(is_web(a), F.when(h == "", "invalid").otherwise("http")).otherwise("other")
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k.isin("empty", "invalid"), "").otherwise(F.concat(scheme_of(a), F.lit(":"))).alias("protocol"), F.when(k == "http", h).otherwise("").alias("host")))

    return let(absolute(u), of)


def is_valid(u: Column) -> Column:
    """Whether the text parses as an http(s) address; false for null."""
    return F.coalesce(classify(u)["kind"] == "http", F.lit(False))


def _strict(u: Column) -> Column:
    """Parts [scheme, host, port, path, query] of a text that is an http(s) address as it stands; null otherwise."""
    return let(trimmed(u), lambda t: F.when(is_web(t), let(_parts(t), lambda p: F.when(p[1] != "", p))))


def _shown_port(p: Column) -> Column:
    return F.when(p[2].isin("", ":") | ((F.lower(p[0]) == "http") & (p[2] == ":80")) | ((F.lower(p[0]) == "https") & (p[2] == ":443")), "").otherwise(p[2])


def legacy_exact(u: Column) -> Column:
    """Lower-cased address without fragment and without one trailing slash; other text trimmed and lower-cased."""

    def web(p: Column) -> Column:
        path = F.when(p[3] == "", "/").otherwise(p[3])
        whole = F.concat(p[0], F.lit("://"), p[1], _shown_port(p), path, F.when(p[4] == "", "").otherwise(F.concat(F.lit("?"), p[4])))
        return let(whole, lambda w: F.when((path != "/") & w.endswith("/"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))

    return F.lower(let(_strict(u), lambda p: F.coalesce(web(p), trimmed(u), F.lit(""))))


def legacy_base(u: Column) -> Column:
    """Host without ``www.`` and path without one trailing slash."""

    def web(p: Column) -> Column:
        path = F.when(p[3] == "", "/").otherwise(F.when(F.length(p[3]) > 1, F.regexp_replace(p[3], "/$", "")).otherwise(p[3]))
        return F.concat(F.regexp_replace(F.lower(p[1]), r"^www\.", ""), _shown_port(p), path)

    return let(_strict(u), lambda p: F.coalesce(web(p), F.lower(trimmed(u)), F.lit("")))


def legacy_hostname(u: Column) -> Column:
    """Lower-cased host of a full http(s) address; '' for everything else."""
    return let(_strict(u), lambda p: F.coalesce(F.lower(p[1]), F.lit("")))


def legacy_base_domain(h: Column) -> Column:
    return F.lower(base_domain_of(h, LEGACY_SUFFIXES))


def norm_host(h: Column) -> Column:
    """Lower case, final dot and leading ``www.`` dropped; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(h, F.lit(""))), r"\.$", ""), r"^www\.", "")


def api_base(s: Column) -> Column:
    """Trailing slashes dropped, one ``/v1`` at the end; null for blank."""
    t = F.regexp_replace(trimmed(s), "/+$", "")
    return F.when(t == "", None).when(t.rlike("(?i)/v1$"), F.regexp_replace(t, "/[Vv]1$", "/v1")).otherwise(F.concat(t, F.lit("/v1")))
