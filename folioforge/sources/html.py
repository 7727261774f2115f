"""HTML source: titles, authors, and pages as Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import bound_batches

_SKIP = {"script", "style", "nav", "footer", "aside", "form", "noscript", "template", "button", "svg", "head"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "wbr", "source", "col", "area", "base", "embed", "track", "param"}
_BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "header"}


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, page_title): the first heading's text, else the title's."""
    part = lambda tag: F.trim(F.regexp_extract("html", rf"<{tag}[^>]*>([^<]*)</{tag}>", 1))
    return pages.select("page_id", F.when(part("h1") != "", part("h1")).otherwise(part("title")).alias("page_title"))


def without_site(title: Column) -> Column:
    """A title without the site's name: its longest part between marks."""
    parts = F.transform(F.split(title, r"\s+[:|–—-]\s+"), lambda x: F.trim(x))
    return F.element_at(F.array_sort(parts, lambda a, b: F.length(b) - F.length(a)), 1)


def authors(html: Column) -> Column:
    """Distinct authors of a page's byline in order, eight at most."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<[^>]*class\s*=\s*["'][^"']*\b(?:author|editor)\b[^"']*["'][^>]*>\s*(?:<[^>]*>\s*)*([^<]+)<"""), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")), 1, 8)


def tidy(markdown: Column) -> Column:
    """Markdown without inline images, heading attributes and runs of blank lines."""
    out = F.regexp_replace(markdown, r"!\[([^\]]*)\]\(data:[^)]*\)", "[figure: $1]")
    out = F.regexp_replace(out, r"(?m)^(#{1,6} .*?)\s*\{[^}\n]*\}[ \t]*$", "$1")
    out = F.regexp_replace(out, r"(?m)^(#{1,6}) +[*_]{1,2}(.+?)[*_]{1,2}[ \t]*$", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \n"))


class _Writer(HTMLParser):
    """Writes Markdown as tags come; what stands in skipped elements is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.line, self.skip, self.mark, self.pre = [], "", 0, "", 0
        self.lists: list[list] = []

    def flush(self) -> None:
        text = self.line.strip("\n") if self.pre else re.sub(r"\s+", " ", self.line).strip()
        if text:
            self.lines.append(self.mark + text)
        self.line, self.mark = "", ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush()
            self.mark = "#" * int(tag[1]) + " "
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.mark = "  " * (len(self.lists) - 1) + ("- " if kind[0] == "ul" else f"{kind[1]}. ")
        elif tag == "pre":
            self.flush()
            self.lines.append("```")
            self.pre += 1
        elif tag in ("td", "th"):
            self.line += " | "
        elif tag == "br":
            self.line += "\n"
        elif tag in _BLOCKS:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag not in _VOID:
            if tag == "pre" and self.pre:
                self.flush()
                self.lines.append("```")
                self.pre -= 1
            elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
                self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.line += data


def markdown(page: str | None) -> str:
    """One page as Markdown; its article or main part where it has one."""
    if not page:
        return ""
    body = re.search(r"(?is)<(article|main)\b.*</\1>", page)
    writer = _Writer()
    writer.feed(body[0] if body else page)
    writer.flush()
    return unescape("\n\n".join(writer.lines))


def to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown) of (page_id, html)."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "markdown": [markdown(h) for h in batch["html"]]})

    made = pages.select("page_id", "html").mapInPandas(run, "page_id bigint, markdown string")
    return made.select("page_id", tidy(F.col("markdown")).alias("markdown"))
