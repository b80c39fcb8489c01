"""URLs of a site: resolving, allow-listing, and the ids and queries in them."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profile import DEFAULT, SiteProfile
from .jsre import js_trim, nonempty

URL = "struct<url: string, scheme: string, host: string, path: string>"
_PORTS = {"http": 80, "https": 443}
_BAD_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
#: URLs on a page, and of a page, that nothing has to be done to: small letters in hosts, no port, no dots to resolve.
_HOST = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_PLAIN = re.compile(rf"(?:(?:(https?):)?//({_HOST}))?(/(?:[A-Za-z0-9_~-][A-Za-z0-9_.~-]*+/)*+(?:[A-Za-z0-9_~-][A-Za-z0-9_.~-]*+)?)(\?[A-Za-z0-9_.=&~-]+)?")
_PLAIN_BASE = re.compile(rf"(https?)://({_HOST})(?:/[!-~]*)?")


def _no_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        low, last = p.lower().replace("%2e", "."), i == len(parts) - 1
        if low == "..":
            out[-1:] = []
        elif low != ".":
            out.append(p)
            continue
        if last:
            out.append("")
    return "/" + "/".join(out)


def resolve(link: str | None, base: str | None) -> tuple[str, str, str, str] | None:
    """A link on a page as browsers resolve it: url, scheme, host and path; None where it is no valid URL."""
    if link is None or base is None:
        return None
    plain, at = _PLAIN.fullmatch(link), _PLAIN_BASE.fullmatch(base)
    if plain and at:
        scheme, host = plain[1] or at[1], plain[2] or at[2]
        return f"{scheme}://{host}{plain[3]}{plain[4] or ''}", scheme, host, plain[3]
    link = re.sub(r"[\t\n\r]", "", link.strip("".join(map(chr, range(33)))))
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", link)
    if not scheme or scheme[1].lower() in _PORTS:
        cut = re.search(r"[?#]", link)
        at = cut.start() if cut else len(link)
        link = link[:at].replace("\\", "/") + link[at:]
    try:
        u = urlsplit(urljoin(base, link))
        name = u.scheme.lower()
        if name not in _PORTS:
            return (u.geturl(), name, "", u.path) if name else None
        host, port = (u.hostname or "").lower(), u.port
        host = host.encode("idna").decode() if not host.isascii() else host
    except (ValueError, UnicodeError):
        return None
    if not host or _BAD_HOST.search(host):
        return None
    user = u.netloc.rpartition("@")[0]
    netloc = (user + "@" if user else "") + host + (f":{port}" if port and port != _PORTS[name] else "")
    path = _no_dots(quote(u.path or "/", safe="/%:@!$&'()*+,;=~[]|^\\-._"))
    query = quote(u.query, safe="/?%:@!$&()*+,;=~[]|^\\{}`-._")
    fragment = quote(u.fragment, safe="/?%:@!$&'()*+,;=~[]|^\\{}#-._")
    return urlunsplit((name, netloc, path, query, fragment)), name, host, path


@functools.cache
def _resolver():
    @F.pandas_udf(URL)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for links, bases in parts:
            found = [resolve(x, y) or (None,) * 4 for x, y in zip(links, bases, strict=True)]
            yield pd.DataFrame(found, columns=["url", "scheme", "host", "path"])

    return run.asNondeterministic()  # evaluated once, where it stands


def resolve_url(link: Column, base: Column) -> Column:
    """The link's parts on the page ``base``; the url is null where the link is invalid."""
    return _resolver()(link.cast("string"), base.cast("string"))


def url_parts(url: Column) -> Column:
    """The same struct for URLs that are whole and hold no spaces, without Python."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return F.struct(
        url.alias("url"), F.lower(part("PROTOCOL")).alias("scheme"), F.lower(part("HOST")).alias("host"), part("PATH").alias("path")
    )


def on_site(host: Column, profile: SiteProfile = DEFAULT) -> Column:
    return F.coalesce((host == profile.site) | host.endswith(f".{profile.site}"), F.lit(False))


def is_file_host(host: Column, profile: SiteProfile = DEFAULT) -> Column:
    return F.coalesce(host.rlike(rf"\Afile[0-9]*\.{re.escape(profile.site)}\z"), F.lit(False))


def allowed(parts: Column, profile: SiteProfile = DEFAULT) -> Column:
    """https on the site or a subdomain, or http on a file host; parts is a struct as of ``resolve_url``."""
    secure = (parts["scheme"] == "https") & on_site(parts["host"], profile)
    plain = (parts["scheme"] == "http") & is_file_host(parts["host"], profile)
    return F.coalesce(secure | plain, F.lit(False))


def allowed_url(url: Column, profile: SiteProfile = DEFAULT) -> Column:
    return allowed(url_parts(url), profile)


def secure_url(url: Column, profile: SiteProfile = DEFAULT) -> Column:
    """http to https for file hosts; others as they are."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(is_file_host(host, profile), F.regexp_replace(url, r"\A(?i:http):", "https:")).otherwise(url)


def is_download(parts: Column, profile: SiteProfile = DEFAULT) -> Column:
    """An allowed URL whose path is that of a subtitle file or archive; its query doesn't matter."""
    return allowed(parts, profile) & F.coalesce(parts["path"].rlike(r"(?i)\A/download/.+\.(?:srt|zip|rar)\z"), F.lit(False))


def is_download_url(url: Column, profile: SiteProfile = DEFAULT) -> Column:
    return is_download(url_parts(url), profile)


def search_url(query: Column, page: Column, profile: SiteProfile = DEFAULT) -> Column:
    """The search page's URL; the first page has no number."""
    more = F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise("")
    return F.concat(F.lit(f"{profile.origin}/sub/?searchword="), F.url_encode(js_trim(query)), more)


def subtitle_id(path: Column) -> Column:
    """The id in a detail page's path, null if it has none; a string, for its leading zeros."""
    return F.coalesce(
        nonempty(F.regexp_extract(path, r"\A/xml/sub/[0-9]+/([0-9]+)\.xml\z", 1)),
        nonempty(F.regexp_extract(path, r"\A/sub/([0-9]+)(?:/|\.html?\z)", 1)),
    )


def decode_component(text: Column) -> Column:
    """Percent-decoded, null where malformed; a plus sign stays."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
