"""URL decomposition as Column expressions: everything stays in generated code, nothing throws on bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar of RFC 3986, appendix B, in pieces that both Spark and DuckDB understand.
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*[?]([^#]*)"
FRAGMENT = r"#(.*)$"
HOST = r"^(\[[^\]]*\]|[^:]*)"
PORT = r":([0-9]*)$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def _host_port(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^.*@", "")


def host(url: Column) -> Column:
    """Without user, port and the brackets of an IPv6 address; its case is kept."""
    return F.translate(F.regexp_extract(_host_port(url), HOST, 1), "[]", "")


def port(url: Column) -> Column:
    """As an int; null if there is none or it is over 65535."""
    text = F.regexp_extract(_host_port(url), PORT, 1)
    value = F.when((text != "") & (F.length(text) <= 9), text).cast("int")
    return F.when(value <= 65535, value)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    """Null for no query and for an empty one."""
    return F.nullif(F.regexp_extract(url, QUERY, 1), F.lit(""))


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, FRAGMENT, 1)


def percent_decoded(text: Column) -> Column:
    """%XX decoded, + kept; null where an escape is broken."""
    return F.when(F.instr(text, "%") == 0, text).otherwise(F.try_url_decode(F.regexp_replace(text, "[+]", "%2B")))


def form_decoded(text: Column) -> Column:
    """%XX and + decoded, as in query pairs; null where an escape is broken."""
    return F.try_url_decode(text)


def domain_of(url: Column) -> Column:
    return F.lower(host(url))


def url_records(pages: DataFrame, url: str = "url") -> DataFrame:
    """url, domain, url_protocol, url_path, url_query, url_port: the engine's table of candidate URLs."""
    u = F.col(url)
    return pages.select(u.alias("url"), domain_of(u).alias("domain"), scheme(u).alias("url_protocol"), path(u).alias("url_path"), query(u).alias("url_query"), port(u).alias("url_port"))


def path_segments(url_path: Column) -> Column:
    """Non-empty segments of a path without its outer slashes."""
    return F.filter(F.split(F.trim(url_path, F.lit("/")), "/"), lambda x: x != "")


def query_parts(url_query: Column) -> Column:
    """The non-empty pieces between ampersands."""
    return F.filter(F.split(url_query, "&"), lambda x: x != "")


def query_key(part: Column) -> Column:
    return F.split_part(part, F.lit("="), F.lit(1))


# --- semantic form and size of the V0 codec ----------------------------------------------------------------------------

# The flags and the dictionaries of the V0 wire format, each word's code being its place.
FLAG_PORT, FLAG_PATH, FLAG_QUERY, FLAG_FRAGMENT, FLAG_WWW = 1, 2, 4, 8, 16
SCHEMES = ["https", "http", "ftp", "ws", "wss"]
LABELS = ["com", "org", "net", "io", "in", "co", "uk", "www"]
PORTS = [80, 443, 8080, 8443, 3000, 5000, 8000, 9000]
SEGMENTS = ["api", "v1", "v2", "users", "user", "products", "product", "search"]
KEYS = ["id", "page", "q", "query", "search", "sort", "filter", "limit", "offset", "lang", "type", "token", "redirect", "utm_source", "utm_medium", "utm_campaign"]
FRAGMENTS = ["top", "home", "about", "contact", "pricing", "comments", "reviews", "login"]
MOST_PARTS, MOST_SHORT, MOST_LONG = 31, 63, 255


def semantic(url: Column) -> Column:
    """struct<scheme, host, port, path, query, fragment, flags>: www. is taken off into a flag, path and fragment are decoded."""
    h = host(url)
    www = F.lower(F.substring(h, 1, 4)) == "www."
    bare = F.when(www, F.substring(h, F.lit(5), F.length(h))).otherwise(h)
    p, n, q, f = percent_decoded(path(url)), port(url), query(url), percent_decoded(fragment(url))
    opaque = ~F.regexp_like(url, F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/")) & F.regexp_like(url, F.lit(SCHEME))
    p = F.when(opaque, F.lit("")).otherwise(p)
    flag = lambda there, value: F.when(there, value).otherwise(0)
    flags = flag(n.isNotNull(), FLAG_PORT) + flag(p != "", FLAG_PATH) + flag(q.isNotNull(), FLAG_QUERY) + flag(f != "", FLAG_FRAGMENT) + flag(www, FLAG_WWW)
    return F.struct(scheme(url).alias("scheme"), bare.alias("host"), n.alias("port"), p.alias("path"), q.alias("query"), f.alias("fragment"), flags.alias("flags"))


def semantic_url(s: Column) -> Column:
    """The URL that a semantic struct stands for; path and fragment stay decoded."""
    flag = lambda f: s["flags"].bitwiseAND(f) != 0
    part = lambda there, *text: F.when(there, F.concat(*text)).otherwise(F.lit(""))
    return F.concat(
        s["scheme"], F.lit("://"), part(flag(FLAG_WWW), F.lit("www.")), s["host"], part(flag(FLAG_PORT), F.lit(":"), s["port"].cast("string")),
        part(flag(FLAG_PATH), s["path"]), part(flag(FLAG_QUERY), F.lit("?"), s["query"]), part(flag(FLAG_FRAGMENT), F.lit("#"), s["fragment"]),
    )


def _sum(parts: Column, bits) -> Column:
    return F.aggregate(F.transform(parts, bits), F.lit(0), lambda a, x: a + x)


def v0_bits(s: Column) -> Column:
    """Length in bits of a semantic struct in the V0 format, in closed form; null where a limit of the format is exceeded."""
    name = s["scheme"]
    size = F.octet_length(name)
    code = F.when(name == "https", 1).when(name == "http", 2).when(name == "ftp", 3).when(name == "ws", 4).when(name == "wss", 5).otherwise(F.when(size <= MOST_LONG, 13 + 8 * size))
    word = lambda known, bits: lambda x: F.when(x.isin(known), bits).otherwise(F.when(F.octet_length(x) <= MOST_SHORT, 7 + 8 * F.octet_length(x)))

    trimmed = F.regexp_replace(s["host"], "[.]$", "")
    labels = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[.]"))
    label = lambda x: F.when(x.isin(LABELS), 4).when((x != "") & (F.octet_length(x) <= MOST_SHORT), 7 + 8 * F.octet_length(x))
    domain = F.when(F.size(labels) <= MOST_PARTS, 5 + _sum(labels, label))

    inner = F.regexp_replace(F.regexp_replace(s["path"], "^/", ""), "/$", "")
    segments = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "/"))
    route = F.when(s["path"] == "", 0).when(F.size(segments) <= MOST_PARTS, 7 + _sum(segments, word(SEGMENTS, 4)))

    def pair(x: Column) -> Column:
        at = F.instr(x, "=")
        key = F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise(x)
        value = F.octet_length(F.substring(x, at + 1, F.length(x)))
        return word(KEYS, 6)(key) + 1 + F.when(at > 0, F.when(value <= MOST_LONG, 8 + 8 * value)).otherwise(0)

    pairs = F.split(s["query"], "&")
    search = F.when(s["query"].isNull(), 0).when(F.size(pairs) <= MOST_PARTS, 5 + _sum(pairs, pair))
    size = F.octet_length(s["fragment"])
    anchor = F.when(s["fragment"] == "", 0).when(s["fragment"].isin(FRAGMENTS), 4).when(size <= MOST_LONG, 9 + 8 * size)
    door = F.when(s["port"].isNull(), 0).when(s["port"].isin(PORTS), 4).otherwise(17)
    return (11 + code + domain + door + route + search + anchor).cast("long")
