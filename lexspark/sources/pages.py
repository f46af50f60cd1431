"""Fetched pages: HTML to Markdown, and what is done with each kind of body."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import chunking, policy

#: Elements that are left out, those that stand alone, and those without an end.
DROPPED = ("script", "style", "noscript", "nav", "header", "footer", "head", "template", "iframe")
BLOCKS = ("p", "div", "article", "section", "main", "aside", "ul", "ol", "table", "blockquote", "figure", "form", "body")
VOID = ("br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr")


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped = 0
        self.lists: list[list] = []
        self.links: list[tuple[int, str]] = []
        self.pre = 0
        self.cells: list[str] | None = None

    def _break(self, n: int = 2) -> None:
        while self.out and not self.out[-1].strip(" "):
            self.out.pop()
        if self.out:
            have = len(self.out[-1]) - len(self.out[-1].rstrip("\n"))
            self.out.append("\n" * max(0, n - have))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.skipped += 1
        if self.skipped:
            return
        if re.fullmatch("h[1-6]", tag):
            self._break()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self._break(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            self._break(1)
            if self.lists:
                self.lists[-1][1] += 1
            kind, n = self.lists[-1] if self.lists else ("ul", 0)
            self.out.append("  " * max(0, len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- "))
        elif tag == "pre":
            self._break()
            self.out.append("```\n")
            self.pre += 1
        elif tag == "tr":
            self._break(1)
            self.out.append("|")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag in BLOCKS:
            self._break()
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self._break()
            self.out.append("* * *")
            self._break()
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append((len(self.out), dict(attrs).get("href") or ""))
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.skipped = max(0, self.skipped - 1)
            return
        if self.skipped or tag in VOID:
            return
        if re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            self._break(1 if self.lists else 2)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self._break(1)
            self.out.append("```")
            self._break()
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            text = "".join(self.out[at:]).strip()
            self.out[at:] = [f"[{text}]({href})" if href and text else text]

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if not self.pre:
            data = re.sub(r"[ \t\r\n\f]+", " ", data)
            if not self.out or self.out[-1].endswith(("\n", " ")):
                data = data.lstrip(" ")
        if data:
            self.out.append(data)


def markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +\n", lambda m: "  \n" if len(m[0]) == 3 else "\n", "".join(parser.out))).strip()


@F.arrow_udf(T.StringType())
def html_to_markdown(html: pa.Array) -> pa.Array:
    return chunking.in_parts(html, lambda x: None if x is None else markdown(x), pa.string())


def route(media_type: Column, body: Column) -> Column:
    """What becomes of a body: reject, json, markdown (of HTML) or plaintext."""
    kind = F.trim(F.substring_index(F.lower(F.coalesce(media_type, F.lit(""))), ";", 1))
    return F.when(policy.is_binary(media_type, body), "reject").when(F.contains(kind, F.lit("json")), "json").when(F.contains(kind, F.lit("html")), "markdown").otherwise("plaintext")


def page_chunks(pages: DataFrame, key: str = "page_id", html: str = "html", media_type: str = "") -> DataFrame:
    """key, chunk_no, title, content, has_code of fetched bodies, each by its route: HTML as Markdown sections, JSON and plain
    text as they are chunked. Without a column of media types all are HTML; rejected bodies have no chunks."""
    kind = route(F.col(media_type), F.col(html)) if media_type else F.lit("markdown")
    routed = pages.select(key, F.col(html).alias("body"), kind.alias("route"))
    made = routed.where("route = 'markdown'").select(key, F.posexplode(chunking.markdown_chunks(html_to_markdown("body"))).alias("chunk_no", "c")).select(key, "chunk_no", "c.title", "c.content", "c.has_code")
    if not media_type:
        return made
    json = routed.where("route = 'json'").select(key, "body", chunking.json_text_chunks(F.col("body")).alias("c"))
    parts = json.where("c is not null").select(key, F.posexplode("c").alias("chunk_no", "c")).select(key, "chunk_no", "c.title", "c.content", "c.has_code")
    plain = routed.where("route = 'plaintext'").select(key, "body").union(json.where("c is null").select(key, "body"))
    return made.unionByName(parts).unionByName(chunking.plain_pieces(plain, key, "body").withColumn("has_code", F.lit(False)))
