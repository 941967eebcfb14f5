"""Raw HTML pages to question rows: the one place markup is walked in Python.

Spark partitions the pages; each Arrow batch is walked by ``html.parser``.  A page that
breaks a rule yields a row with ``ok = false`` and the reason, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemloom.session import bounded_batches

# ---- fixed values: rich-text tags and their Markdown wrappers ----
WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
RICH_TAGS = ("p", "a", "br", *WRAP)
VOID_TAGS = ("br", "img", "meta", "link", "hr", "input", "use", "source", "wbr")
BLANKS = re.compile("[ \t\xa0]+")
#: Pages that a task holds as extracted rows at a time.
PIECE = 64
ESCAPED = re.compile(r"(?<![A-Za-z0-9])_|[\\*`\[\]<>]")


@dataclass(frozen=True)
class PageLayout:
    """Where things are: the tag holding rich text, the title tag, what to skip."""

    body: str = "article"
    title: str = "h1"
    skip: tuple[str, ...] = ("script", "style", "nav", "footer")
    transparent: tuple[str, ...] = ("article", "h1", "div", "ul", "ol", "li", "span", "section")


@dataclass
class _Frame:
    tag: str
    href: str = ""
    parts: list[str] = field(default_factory=list)
    plain: list[str] = field(default_factory=list)


def tidy(text: str) -> str:
    """Single blanks in lines, none at their ends, and one empty line at most between two."""
    lines = [" ".join(word for word in BLANKS.split(line) if word) for line in text.split("\n")]
    kept = [line for i, line in enumerate(lines) if line or (i and lines[i - 1])]
    return "\n".join(kept).strip()


def flatten(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()


class RichText(HTMLParser):
    """Streams one page into Markdown, plain text, a title and first-seen links."""

    def __init__(self, layout: PageLayout):
        super().__init__(convert_charrefs=True)
        self.layout, self.stack = layout, [_Frame("")]
        self.links: dict[str, None] = {}
        self.unknown: str | None = None
        self.title = ""
        self.bodies: list[tuple[str, str]] = []
        self.skipping, self.inside = 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in self.layout.skip:
            self.skipping += 1
            return
        if self.skipping:
            return
        if tag == self.layout.body:
            self.inside += 1
        if not self.inside:
            return
        if tag not in RICH_TAGS and tag not in self.layout.transparent:
            self.unknown = self.unknown or tag
        if tag == "p" and any(f.tag == "p" for f in self.stack):
            self._close_to("p")
        if tag == "br":
            self.stack[-1].parts.append("\n")
            self.stack[-1].plain.append("\n")
        elif tag not in VOID_TAGS:
            href = (dict(attrs).get("href") or "").strip() if tag == "a" else ""
            if href:
                self.links.setdefault(href)
            self.stack.append(_Frame(tag, href))

    def handle_endtag(self, tag):
        if tag in self.layout.skip:
            self.skipping = max(0, self.skipping - 1)
            return
        if self.skipping or not self.inside:
            return
        if any(f.tag == tag for f in self.stack):
            self._close_to(tag)
        if tag == self.layout.body:
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and not self.skipping:
            in_code = any(f.tag == "code" for f in self.stack)
            self.stack[-1].parts.append(data if in_code else ESCAPED.sub(r"\\\g<0>", data))
            self.stack[-1].plain.append(data)

    def _close_to(self, tag):
        while len(self.stack) > 1:
            frame = self.stack.pop()
            md, plain = self._render(frame)
            self.stack[-1].parts.append(md)
            self.stack[-1].plain.append(plain)
            if frame.tag == self.layout.body:
                self.bodies.append((tidy(md), flatten(plain)))
            if frame.tag == tag:
                break

    def _render(self, frame: _Frame) -> tuple[str, str]:
        md, plain = "".join(frame.parts), "".join(frame.plain)
        inner = md.strip()
        if frame.tag == "p":
            return inner + "\n\n", plain + "\n"
        if frame.tag in WRAP:
            return (f"{WRAP[frame.tag]}{inner}{WRAP[frame.tag]}" if inner else ""), plain
        if frame.tag == "a":
            return (f"[{inner}]({frame.href})" if frame.href else inner), plain
        if frame.tag == self.layout.title:
            self.title = flatten(plain)
            return inner + "\n\n", plain + "\n"
        return md, plain


EXTRACTED = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("problem", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body_md", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
    ]
)


def _extract(page_id: int, url: str, html: str | None, layout: PageLayout) -> tuple:
    parser = RichText(layout)
    try:
        parser.feed(html or "")
        parser.close()
        if parser.inside:
            parser._close_to(layout.body)
    except Exception as error:  # noqa: BLE001 - quarantined, not raised
        return (page_id, url, False, f"unreadable: {error}", None, None, None, [])
    if len(parser.bodies) != 1:
        problem = f"expected 1 <{layout.body}>, found {len(parser.bodies)}"
        return (page_id, url, False, problem, None, None, None, [])
    if parser.unknown:
        problem = f"unexpected tag <{parser.unknown}> in rich text"
        return (page_id, url, False, problem, None, None, None, [])
    md, plain = parser.bodies[0]
    return (page_id, url, True, None, parser.title, md, plain, list(parser.links))


def extract_pages(pages: DataFrame, layout: PageLayout = PageLayout()) -> DataFrame:
    """(page_id, url, html) -> rich text, title and links, or the reason there is none."""
    names = [f.name for f in EXTRACTED.fields]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), PIECE):
                piece = frame.iloc[at : at + PIECE]
                rows = [_extract(*r, layout) for r in zip(piece["page_id"], piece["url"], piece["html"])]
                yield pd.DataFrame(rows, columns=names)

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInPandas(batches, EXTRACTED)


def quarantine(extracted: DataFrame) -> DataFrame:
    return extracted.where(~F.col("ok")).select("page_id", "url", "problem")


def lossless_check(extracted: DataFrame, stripped, by: str = "url") -> DataFrame:
    """Per file: fields compared and mismatches of plain source text vs stripped Markdown."""
    return (
        extracted.where("ok")
        .withColumn("__same", F.col("body_text") == stripped)
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("__same")).alias("mismatches"))
    )
