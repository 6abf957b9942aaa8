"""URL columns: safety, resolution, publishers."""

from pyspark.sql import Column, functions as F

from issueloom.functions.text import or_empty, strip
from issueloom.rules import (
    GENERIC_SOURCES, NO_SOURCE, PUBLISHER_RULES, SHORT_SOURCE_RULES, UNKNOWN_PUBLISHER)


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def host(url: Column) -> Column:
    return F.lower(_part(strip(url), "HOST"))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(_part(strip(url), "PROTOCOL")).isin("http", "https"), F.lit(False)) & F.coalesce(
        host(url) != "", F.lit(False))


def safe_url(url: Column) -> Column:
    """The URL itself when it is an absolute http(s) one, else blank."""
    return F.when(is_http(url), strip(url)).otherwise(F.lit(""))


def _bind(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once: the plan holds it once too, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _resolve(base: Column, ref: Column) -> Column:
    scheme = F.lower(_part(base, "PROTOCOL"))
    site = F.concat(scheme, F.lit("://"), _part(base, "AUTHORITY"))
    path = or_empty(_part(base, "PATH"))
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(site, ref))
        .when(ref.startswith("?"), F.concat(site, F.when(path == "", F.lit("/")).otherwise(path), ref))
        .otherwise(F.concat(site, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")), ref))
    )


def _fold_path(path: Column) -> Column:
    """The path with its `.` and `..` steps taken; steps above the root are dropped."""
    def step(done, part):
        return (F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
                .otherwise(F.array_append(done, part)))
    parts = F.split(path, "/")
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array(F.lit("")), step)
    ends_open = path.rlike(r"/\.\.?$")
    return F.when(path.contains("/."), F.array_join(F.when(ends_open, F.array_append(folded, F.lit(""))).otherwise(folded), "/")
                  ).otherwise(path)


def absolute_url(base: Column, ref: Column) -> Column:
    """Resolve `ref` on `base`, with `.` and `..` steps taken; blank unless the outcome is http(s)."""
    def folded(u):
        site = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", 1)
        path = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", 2)
        rest = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$", 3)
        return F.when(path == "", u).otherwise(F.concat(site, _bind(path, _fold_path), rest))

    def resolved(pair):
        flat = _bind(_resolve(pair["b"], pair["r"]), folded)
        return F.when((pair["r"] == "") | ~is_http(pair["b"]), F.lit("")).otherwise(_bind(flat, safe_url))
    return or_empty(_bind(F.struct(strip(base).alias("b"), strip(or_empty(ref)).alias("r")), resolved))


def publisher(url: Column) -> Column:
    """Publisher by the first rule whose host part occurs in the feed's host."""
    name = F.replace(host(url), F.lit("www."), F.lit(""))
    out = F.when(F.coalesce(name, F.lit("")) == "", F.lit(UNKNOWN_PUBLISHER))
    for part, label, _ in PUBLISHER_RULES:
        out = out.when(name.contains(part), F.lit(label))
    return out.otherwise(name)


def source_from_url(url: Column) -> Column:
    """Short source label of a link, else the first host label in capitals."""
    name = F.regexp_replace(host(url), r"^www\.", "")
    out = F.when(F.coalesce(name, F.lit("")) == "", F.lit(""))
    for part, label in SHORT_SOURCE_RULES:
        out = out.when(name.contains(part), F.lit(label))
    return out.otherwise(F.upper(F.substring_index(name, ".", 1)))


def display_source(source: Column, url: Column) -> Column:
    """Source label, with the publisher in front of bare section names."""
    name, owner = strip(or_empty(source)), source_from_url(url)
    return (
        F.when((name == "") & (owner == ""), F.lit(NO_SOURCE))
        .when(owner == "", name)
        .when(name == "", owner)
        .when(name.contains(owner) | owner.contains(name), name)
        .when(name.isin(GENERIC_SOURCES), F.concat(owner, F.lit(" · "), name))
        .otherwise(name)
    )


def _blocked_ipv4(name: Column) -> Column:
    octet = [F.split_part(name, F.lit("."), F.lit(i)).try_cast("int") for i in range(1, 5)]
    a, b = octet[0], octet[1]
    shaped = name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*octet) <= 255)
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    )
    return shaped & private


def _blocked_ipv6(name: Column) -> Column:
    address = F.lower(F.btrim(name, F.lit("[]")))
    mapped = F.regexp_extract(address, r"^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    return name.startswith("[") & (
        address.isin("::", "::1") | address.rlike("^(fe[89a-f]|ff|fc|fd)") | _blocked_ipv4(mapped)
    )


def is_blocked_host(name: Column) -> Column:
    """Hosts that must never be reached: local names and non-public address literals."""
    name = F.lower(F.rtrim(strip(or_empty(name)), F.lit(".")))
    return (
        name.isin("localhost", "localhost.localdomain") | name.endswith(".localhost") | name.endswith(".local")
        | _blocked_ipv4(name) | _blocked_ipv6(name)
    )


def url_admission(url: Column) -> Column:
    """`ok`, or why the URL is refused: `bad_url`, `unsafe`."""
    def verdict(u):
        unsafe = (or_empty(_part(u, "USERINFO")) != "") | is_blocked_host(_part(u, "HOST"))
        return F.when(~is_http(u), F.lit("bad_url")).when(unsafe, F.lit("unsafe")).otherwise(F.lit("ok"))
    return _bind(strip(url), verdict)
