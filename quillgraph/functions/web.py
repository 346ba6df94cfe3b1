"""Column expressions over URLs, pages and HTTP headers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The links that the plain pattern finds, and the comments that mark content.
LINK = r"""<a.*?href=["']([^"]+[.\s]*?)["'].*?>[^<]+[.\s]*?</a>"""
OPEN, CLOSE = "<!-- CONTENT -->", "<!-- /CONTENT -->"
LINKS = "array<struct<pos:int,href:string,in_content:boolean>>"


def authority(url: Column) -> Column:
    """Host and port as they stand; empty without one."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def has_scheme(url: Column) -> Column:
    return F.regexp_like(url, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"))


def path(url: Column) -> Column:
    """The path, without query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def local_part(url: Column) -> Column:
    """Path, query and fragment: what robots rules are held against."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")


def identifier(url: Column) -> Column:
    """The number that ends the path before its first dot; null if it is none."""
    return F.element_at(F.split(F.split_part(path(url), F.lit("."), F.lit(1)), "/"), -1).try_cast("bigint")


def resolve(link: Column, source: Column) -> Column:
    """A link without a scheme takes the place of the last part of its source's path, whatever it looks like."""
    base = F.concat(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), F.regexp_replace(path(source), "[^/]*$", ""))
    return F.when(has_scheme(link), link).otherwise(F.concat(base, link))


def allowed_domain(url: Column, domains: list[str]) -> Column:
    return authority(url).isin(*domains)


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str | None, bool]] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [(len(self.found) + i, v, self.inside) for i, v in enumerate(v for k, v in attrs if k == "href")]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def handle_comment(self, data: str) -> None:
        self.inside = {"CONTENT": True, "/CONTENT": False}.get(data.strip(), self.inside)


def parsed_links(html: Column) -> Column:
    """Every href of every opening a-tag in order, and whether it stands between the content comments; self-closed tags are left out."""

    @F.pandas_udf(LINKS)
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in pages:
            out = []
            for page in part:
                p = _Links()
                p.feed(page or "")
                p.close()
                out.append([{"pos": a, "href": b, "in_content": c} for a, b, c in p.found])
            yield pd.Series(out, dtype=object)

    return of(html)


def scanned_links(html: Column) -> Column:
    """The same without a parser, inside the JVM: comments and a-tags are cut out in order and the last content comment is carried
    along. Entities in values stay as they are written, but for the ampersand's.
    """
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    pieces = F.regexp_extract_all(plain, F.lit(r"(?is)<!--.*?-->|<a\s[^>]*>"), F.lit(0))
    value = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    start = F.expr("named_struct('inside', false, 'found', cast(array() as array<struct<pos:int,href:string,in_content:boolean>>))")

    def step(state: Column, piece: Column) -> Column:
        mark = F.trim(F.regexp_extract(piece, r"(?s)^<!--(.*)-->$", 1))
        inside = F.when(mark == "CONTENT", True).when(mark == "/CONTENT", False).otherwise(state["inside"])
        counts = ~F.startswith(piece, F.lit("<!--")) & ~F.endswith(piece, F.lit("/>")) & F.regexp_like(piece, F.lit(r"(?i)\shref\b"))
        href = F.concat(*(F.regexp_extract(piece, value, i) for i in (1, 2, 3)))
        href = F.when(F.regexp_like(piece, F.lit(value)), F.replace(href, F.lit("&amp;"), F.lit("&")))
        link = F.struct(F.size(state["found"]).alias("pos"), href.alias("href"), state["inside"].alias("in_content"))
        return F.struct(inside.alias("inside"), F.when(counts, F.concat(state["found"], F.array(link))).otherwise(state["found"]).alias("found"))

    return F.aggregate(pieces, start, step)["found"]


def malformed(html: Column) -> Column:
    """Whether a tag is never closed, which the parser would pass over in silence."""
    return F.regexp_like(html, F.lit(r"<[A-Za-z/!][^<>]*(<|$)"))


def plain_links(html: Column, opening: str = OPEN, closing: str = CLOSE) -> tuple[Column, Column]:
    """Links by pattern, (content, other): the page is cut at the markers, odd parts are content."""
    parts = F.flatten(F.transform(F.split(html, _literal(opening), -1), lambda p: F.split(p, _literal(closing), -1)))
    return tuple(F.regexp_extract_all(F.array_join(_every_other(parts, odd), " "), F.lit(LINK), F.lit(1)) for odd in (1, 0))


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def _every_other(parts: Column, odd: int) -> Column:
    return F.filter(parts, lambda _, i: i % 2 == odd)


def links(html: Column) -> tuple[Column, Column]:
    """(content, other) links of a page: by the parser, or by pattern where the page is malformed."""
    found = parsed_links(html)
    plain = plain_links(html)
    by_parser = [F.transform(_inside(found, c), lambda x: x["href"]) for c in (True, False)]
    bad = malformed(html)
    return tuple(F.when(bad, p).otherwise(q) for p, q in zip(plain, by_parser, strict=True))


def _inside(found: Column, content: bool) -> Column:
    return F.filter(found, lambda x: x["in_content"] == content)


def unquoted(local: Column) -> Column:
    """Percent escapes decoded, but for an escaped slash, which becomes %2F; what is no escape stays as it is."""
    safe = F.regexp_replace(F.replace(local, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.regexp_replace(safe, "%2[fF]", "%252F"))


def content_type(header: Column) -> Column:
    """struct(media_type, encoding) of a Content-Type header."""
    h = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    return F.struct(F.trim(F.split_part(h, F.lit(";"), F.lit(1))).alias("media_type"), F.trim(F.regexp_extract(h, r""";.*charset=['"]?([^'"]*)['"]?""", 1)).alias("encoding"))


def expires(header: Column, now: Column | None = None) -> Column:
    """When a robots file runs out: its Expires date, UTC unless it says otherwise, else in seven days."""
    now = F.current_timestamp() if now is None else now
    plain = F.regexp_replace(F.regexp_replace(F.trim(header), r"^[A-Za-z]+, *", ""), "-", " ")
    zoned = F.when(F.regexp_like(plain, F.lit("[A-Za-z]{2,4}$")), plain).otherwise(F.concat(plain, F.lit(" GMT")))
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("dd MMM yyyy HH:mm:ss z")), now + F.expr("interval 7 days"))


def recrawl(timeout: Column, now: Column | None = None) -> Column:
    """Whether a seen URL is due again; a null timeout means never."""
    now = F.current_timestamp() if now is None else now
    return timeout.isNotNull() & F.coalesce(now > timeout, F.lit(False))
