"""URL functions as column expressions; null where a URL cannot be parsed."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
#: Extensions of linked documents.
DOCUMENTS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "json", "xml", "txt", "md", "rtf")
#: Schemes a proxy may have.
PROXIES = ("http", "https", "socks5", "socks5h")
#: Address ranges that are not public.
PRIVATE_V4 = r"^(0|127|10)\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^169\.254\."
PRIVATE_V6 = r"(?i)^::$|^::1$|^fe80:|^f[cd]|^2001:db8:|^100::"


def _part(url: Column, group: int) -> Column:
    return F.when(url.rlike(_URL), F.regexp_extract(url, _URL, group))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port in lower case, without user and the scheme's own port."""
    host = F.lower(F.regexp_replace(_part(url, 2), r"^.*@", ""))
    return F.when(scheme(url) == "https", F.regexp_replace(host, r":443$", "")).when(scheme(url) == "http", F.regexp_replace(host, r":80$", "")).otherwise(host)


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d+$", "")


def path(url: Column) -> Column:
    """The path, `/` if empty, without `.` and `..` segments."""
    raw = _part(url, 3)
    return F.when(raw == "", "/").when(raw.rlike(_DOTS), _without_dots(raw)).otherwise(raw)


def _without_dots(raw: Column) -> Column:
    parts = F.split(raw, "/")
    up, here = (lambda s, n=n: s.rlike(rf"(?i)^(?:\.|%2e){{{n}}}$") for n in (2, 1))
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"),
        lambda done, s: F.when(up(s), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(here(s), done).otherwise(F.concat(done, F.array(s))),
    )
    end = F.when(raw.rlike(r"(?i)/(?:\.|%2e){1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def query(url: Column) -> Column:
    return _part(url, 4)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, one trailing slash less; the query stays, and
    what cannot be parsed stays as it is."""
    p = path(url)
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    return F.coalesce(F.concat(origin(url), p, F.coalesce(query(url), F.lit(""))), url)


def slug(url: Column) -> Column:
    return F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1))


def is_pdf(url: Column) -> Column:
    plain = F.regexp_replace(url, r"[?#].*$", "")
    return F.coalesce(F.lower(F.coalesce(path(url), plain)).endswith(".pdf"), F.lit(False))


def is_pdf_type(content_type: Column) -> Column:
    return F.coalesce(F.contains(F.lower(content_type), F.lit("application/pdf")), F.lit(False))


def document_extension(href: Column) -> Column:
    """`.ext` of a link to a document, absolute or relative; else null."""
    plain = F.coalesce(path(href), F.regexp_replace(href, r"[?#].*$", ""))
    ext = F.lower(F.regexp_extract(plain, r"\.([^./]*)$", 1))
    return F.when(ext.isin(*DOCUMENTS), F.concat(F.lit("."), ext))


def video_embed(src: Column) -> Column:
    """struct(src, provider) of a known player's address."""
    tube = F.regexp_extract(src, r"(?:youtube\.com/embed/|youtu\.be/)([A-Za-z0-9_-]+)", 1)
    vimeo = F.regexp_extract(src, r"vimeo\.com/(?:video/)?(\d+)", 1)
    return F.when(F.length(tube) > 0, F.struct(F.concat(F.lit("https://www.youtube.com/watch?v="), tube).alias("src"), F.lit("youtube").alias("provider"))).when(F.length(vimeo) > 0, F.struct(F.concat(F.lit("https://vimeo.com/"), vimeo).alias("src"), F.lit("vimeo").alias("provider")))


def srcset_largest(srcset: Column) -> Column:
    """The address with the largest width; without widths the largest density (none means 1x); of
    equals the first. One with another descriptor counts only where nothing else came before."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda x: F.trim(x)), lambda p: p != "")

    def own(p: Column, i: Column) -> Column:
        words = F.split(p, r"\s+")
        d = F.coalesce(F.nullif(F.try_element_at(words, F.lit(2)), F.lit("")), F.lit("1x"))
        w = F.regexp_extract(d, r"^(\d+)[wW]$", 1).try_cast("double")
        x = F.regexp_extract(d, r"^(\d+(?:\.\d+)?)[xX]$", 1).try_cast("double")
        return F.struct(w.alias("w"), x.alias("x"), (-i).alias("i"), F.element_at(words, 1).alias("url"))

    told = F.transform(parts, own)
    wide = F.array_max(F.filter(told, lambda t: t["w"] > 0))
    dense = F.array_max(F.filter(F.transform(told, lambda t: F.struct(t["x"].alias("x"), t["i"].alias("i"), t["url"].alias("url"))), lambda t: t["x"] > 0))
    return F.coalesce(wide["url"], dense["url"], F.try_element_at(told, F.lit(1))["url"])


def next_data_route(url: Column, build_id: Column) -> Column:
    p = F.regexp_replace(path(url), r"/$", "")
    return F.concat(origin(url), F.lit("/_next/data/"), build_id, F.when(p == "", "/index").otherwise(p), F.lit(".json"))


def percent_encoded(text: Column) -> Column:
    """As encodeURIComponent: a space is %20, and ! ' ( ) * ~ stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def is_same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or equal last two labels; addresses and single labels must be equal."""
    literal = r"^\d+\.\d+\.\d+\.\d+$|^[\d:\[\]]+$"
    la, lb = F.split(a, r"\."), F.split(b, r"\.")
    tail = (F.size(la) >= 2) & (F.size(lb) >= 2) & (F.slice(F.reverse(la), 1, 2) == F.slice(F.reverse(lb), 1, 2))
    return F.coalesce((a == b) | (~a.rlike(literal) & ~b.rlike(literal) & tail), F.lit(False))


def prism_url(domain: Column, source: Column, website: Column, url: Column) -> Column:
    base = F.when(domain.startswith("http"), domain).otherwise(F.concat(F.lit("https://"), domain))
    site = F.when(F.length(website) > 0, F.concat(F.lit("_website="), percent_encoded(website), F.lit("&"))).otherwise("")
    asked = F.concat(F.lit('{"canonical_url":"'), path(url), F.lit('"}'))
    return F.when(is_same_site(host(base), host(url)), F.concat(base, F.lit("/api/"), source, F.lit("?"), site, F.lit("query="), percent_encoded(asked)))


def wp_api_url(url: Column, detected: Column, custom_path: Column, use_wp: Column) -> Column:
    s = percent_encoded(slug(url))
    return F.coalesce(F.nullif(detected, F.lit("")), F.concat(origin(url), F.nullif(custom_path, F.lit("")), s), F.when(use_wp, F.concat(origin(url), F.lit("/wp-json/wp/v2/posts?slug="), s)))


def with_embed(api: Column) -> Column:
    return F.concat(api, F.when(F.contains(api, F.lit("?")), "&_embed").otherwise("?_embed"))


def has_truncation_marker(html: Column) -> Column:
    return html.rlike(r'href="[^"]*utm_campaign=api')


def is_private_ip(ip: Column) -> Column:
    mapped = F.lower(ip).startswith("::ffff:")
    v4 = F.when(mapped, F.substring(ip, 8, 64)).otherwise(ip)
    return F.when(mapped | ~F.contains(ip, F.lit(":")), v4.rlike(PRIVATE_V4)).otherwise(ip.rlike(PRIVATE_V6))


def proxy_allowed(proxy: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(proxy, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin(*PROXIES), F.lit(False))


def redact_proxy(proxy: Column) -> Column:
    """User and password as ***; what is no URL is named so."""
    both = F.regexp_replace(proxy, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@:]+:[^/@]+@", "$1***:***@")
    user = F.regexp_replace(both, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@:*]+@", "$1***@")
    return F.when(proxy.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), user).otherwise("<invalid-proxy-url>")


def redact_cache_key(key: Column) -> Column:
    """A key `preset|proxy` with its proxy redacted."""
    proxy = F.regexp_replace(key, r"^[^|]*\|", "")
    return F.when(~F.contains(key, F.lit("|")) | (proxy == "direct"), key).otherwise(F.concat(F.substring_index(key, "|", 1), F.lit("|"), redact_proxy(proxy)))


def resolve_preset(agent: Column) -> Column:
    return F.when(agent.rlike("(?i)android") & agent.rlike("(?i)chrome"), "chrome-android").when(agent.rlike("(?i)iphone") & agent.rlike("(?i)crios"), "chrome-ios").when(agent.rlike("(?i)iphone") & agent.rlike("(?i)safari"), "safari-ios")


def host_suffixes(url: Column) -> Column:
    """Lookup keys for site settings: host without www. and m., then its parents to two labels."""
    bare = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r"^m\.", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))


def resolve_one(base: str | None, href: str | None) -> str | None:
    """A link against its page; null unless the outcome has a scheme."""
    if href is None:
        return None
    try:
        out = urlsplit(urljoin(base or "", href.strip()))
        if not out.scheme:
            return None
        return urlunsplit((out.scheme.lower(), out.netloc.lower(), out.path or ("/" if out.netloc else ""), out.query, out.fragment))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve_one(b, h) for b, h in zip(base, href, strict=True)])


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: * within a segment, ** across, ?, {a,b} and [...]."""
    out, i = "^", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = end
        elif c == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out += "(?:" + "|".join(glob_regex(p)[1:-1] for p in glob[i + 1 : end].split(",")) + ")"
            i = end
        else:
            out += "\\" + c if c in r"\.+()|^$[]{}" else c
        i += 1
    return out + "$"
