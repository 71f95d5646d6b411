"""URL expressions: keys, hosts, domains, validity, link noise and priority."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions.text import contains_secret

# Hosts, file endings and words of links that lead to no product page.
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "weibo.com", "youtube.com")
STATIC_SUFFIXES = (
    ".7z .avi .css .dmg .eot .exe .gif .gz .ico .jpeg .jpg .js .map .mov .mp3 .mp4 .msi .png .rar .svg .tar .tgz .ttf .webm .webp .woff .woff2 .zip"
).split()
ACTION_TOKENS = "account console contact cookie dashboard legal login logout privacy register signin signup terms".split()
ACTION_TEXTS = (
    "contact us", "cookie policy", "legal notice", "privacy policy", "sign in", "sign up", "terms of service",
    "联系我们", "法律声明", "注册", "控制台", "登录", "登出", "退出登录", "隐私政策",
)
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
PARENT_PRIORITY = {"user_input": 30, "web_search": 20, "page_link": 10}
REGION_PRIORITY = {"nav": 10, "main": 10, "other": 5, "footer": 0}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


#: scheme, //authority, path, ?query, #fragment; the groups with their signs tell an empty part from none.
REFERENCE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(path: Column) -> Column:
    """An absolute path without its `.` and `..` segments: a fold over the segments with the kept ones as a stack; other paths as they are."""
    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda stack, s: F.when(s == ".", stack).when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(s))),
    )
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)  # a last dot names a folder
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), F.array_join(folder, "/"))).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """A reference against the absolute URL of its page (RFC 3986, 5.2), inside the JVM; NULL where either is NULL."""
    part = lambda url, k: F.regexp_extract(url, REFERENCE, k)
    (scheme_, site, path_, query_), (b_scheme, b_site, b_path, b_query) = ([part(u, k) for k in (1, 2, 3, 4)] for u in (reference, base))
    merged = F.when((b_site != "") & (b_path == ""), F.concat(F.lit("/"), path_)).otherwise(F.concat(F.regexp_replace(b_path, r"[^/]*$", ""), path_))
    inner = F.when(path_ == "", b_path).otherwise(without_dots(F.when(F.startswith(path_, F.lit("/")), path_).otherwise(merged)))
    rest = (
        F.when(scheme_ != "", F.concat(scheme_, site, without_dots(path_), query_))
        .when(site != "", F.concat(b_scheme, site, without_dots(path_), query_))
        .otherwise(F.concat(b_scheme, b_site, inner, F.when((path_ == "") & (query_ == ""), b_query).otherwise(query_)))
    )
    return F.when(base.rlike(REFERENCE) & reference.rlike(REFERENCE), F.concat(rest, part(reference, 5)))


def candidate(base: Column, href: Column) -> Column:
    """The URL that a link leads to: resolved, of http or https with a host, its scheme in small letters, no fragment, no empty query; NULL otherwise."""
    url = F.regexp_replace(drop_fragment(resolve(base, F.trim(href))), r"\?$", "")
    leads = (F.trim(href) != "") & scheme(url).isin("http", "https") & (host(url) != "")
    return F.when(F.coalesce(leads, F.lit(False)), F.concat(scheme(url), F.regexp_replace(url, r"^[^:]*", "")))


def url_key(url: Column) -> Column:
    """Small-letter scheme and authority, `/` for an empty path, the query kept, no fragment."""
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def is_valid(url: Column) -> Column:
    """http or https, a host, and a port that is a number up to 65535."""
    port = F.regexp_extract(authority(F.trim(url)), r":([^:\]]*)$", 1)
    ok = scheme(F.trim(url)).isin("http", "https") & (host(F.trim(url)) != "") & ((port == "") | (port.rlike(r"^[0-9]{1,5}$") & (F.try_to_number(port, F.lit("99999")) <= 65535)))
    return F.coalesce(ok, F.lit(False))


def is_global_v6(address: Column) -> Column:
    """Whether an IPv6 address lies outside the ranges that are private, local or set aside."""
    groups = F.split(address, ":")
    a, b = (F.try_to_number(F.conv(F.nullif(F.try_element_at(groups, F.lit(k)), F.lit("")), 16, 10), F.lit("99999")).cast("int") for k in (1, 2))
    a, b = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    zero = address.rlike(r"^(0{0,4}:)*:?(0{0,4}:)*(:?0{0,3}[01]?|:?(ffff|FFFF):.*)$")
    low = a.between(0xFC00, 0xFDFF) | a.between(0xFE80, 0xFEBF) | (a == 0x2002) | ((a == 0x2001) & ((b < 0x200) | (b == 0xDB8))) | ((a == 0x3FFF) & (b < 0x1000)) | ((a == 0x100) & address.rlike("^0?100::"))
    return address.rlike("^[0-9A-Fa-f:.]+$") & F.contains(address, F.lit(":")) & ~zero & ~low


def is_public(url: Column) -> Column:
    """No user information or secret, a usual port, and a global address or a dotted host that isn't local."""
    h = host(url)
    six = F.regexp_extract(h, r"^\[(.*)\]$", 1)
    port = F.regexp_extract(authority(url), r":([0-9]*)$", 1)
    octets = F.split(h, r"\.")
    a, b, c = (F.try_element_at(octets, F.lit(k)).try_cast("int") for k in (1, 2, 3))
    is_ip = h.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$")
    test_net = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    private = is_ip & (a.isin(0, 10, 127) | (a >= 240) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19)) | test_net)
    local = h.rlike(r"\.(localhost|local|internal)$") | ~F.contains(h, F.lit("."))
    ok = scheme(url).isin("http", "https") & ~F.contains(authority(url), F.lit("@")) & port.isin("", "80", "443") & F.when(six != "", is_global_v6(six)).otherwise(~private & ~local) & ~contains_secret(url)
    return F.coalesce(ok, F.lit(False))


def registrable_domain(hostname: Column) -> Column:
    labels = F.split(F.trim(F.lower(hostname), F.lit(".")), r"\.")
    n = F.size(labels)
    wide = (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    keep = F.when(n <= 2, n).when(wide, 3).otherwise(2)
    return F.array_join(F.slice(labels, n - keep + 1, keep), ".")


def match_kind(expected: Column, actual: Column) -> Column:
    """exact, equivalent (same but for letter case of the host and a slash at the end) or unmatched."""
    plain = lambda u: F.regexp_replace(url_key(u), r"/$", "")
    return F.when(expected == actual, "exact").when(plain(expected) == plain(actual), "equivalent").otherwise("unmatched")


def describe(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def is_noise(url: Column, description: Column, is_download: Column) -> Column:
    """Links without words, downloads, social hosts, static files, and account or legal actions."""
    h, p, low = host(url), F.lower(F.url_decode(F.regexp_replace(path(url), r"%(?![0-9A-Fa-f]{2})", "%25"))), F.lower(description)
    tokens = F.transform(F.filter(F.split(p, r"[/_.]+"), lambda t: t != ""), lambda t: F.replace(t, F.lit("-"), F.lit("")))
    social = reduce(or_, [(h == s) | F.endswith(h, F.lit(f".{s}")) for s in SOCIAL_HOSTS])
    static = reduce(or_, [F.endswith(p, F.lit(s)) for s in STATIC_SUFFIXES])
    action = F.arrays_overlap(tokens, F.array(*map(F.lit, ACTION_TOKENS)))
    said = reduce(or_, [F.contains(low, F.lit(t)) for t in ACTION_TEXTS])
    return (F.coalesce(description, F.lit("")) == "") | F.coalesce(is_download, F.lit(False)) | social | static | F.contains(p, F.lit("/cdn-cgi/l/email-protection")) | action | said


def link_priority(url: Column, final_url: Column, parent: Column, region: Column, evidence_hosts: Column) -> Column:
    """Which of the few candidate places a link takes: parent, host relation, region, depth and query."""
    target, own = host(url), host(final_url)
    relation = F.when(target == own, 30).when(registrable_domain(target) == registrable_domain(own), 20).when(F.array_contains(evidence_hosts, target), 15).otherwise(0)
    choose = lambda values, key, rest: reduce(lambda acc, kv: F.when(key == kv[0], kv[1]).otherwise(acc), values.items(), F.lit(rest))
    depth = F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))
    q = query(url)
    return (
        choose(PARENT_PRIORITY, parent, None) + relation + choose(REGION_PRIORITY, F.coalesce(region, F.lit("other")), 5) + 5
        + F.when(depth <= 2, 5).when(depth >= 6, -5).otherwise(0) - F.when(F.size(F.split(q, "&")) >= 3, 5).otherwise(0)
    ).cast("int")
