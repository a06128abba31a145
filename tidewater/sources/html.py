"""Pages as rows: fields by native functions where patterns do, else by the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def decoded(text: pd.Series) -> pd.Series:
    """Without character references: named ones, decimal and hexadecimal numbers. One that is cut before its semicolon is text."""
    return text.map(lambda t: None if t is None else REFERENCE.sub(lambda m: unescape(m[0]), t).replace("\xa0", " "))


def stripped(markup: Column) -> Column:
    """Without tags, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(markup, "<[^>]*>", " ")), r"\s+", " "))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.heading, self.body, self.links, self.inside = [], [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "p", "div", "li"):
            self.body.append("\n")
        if tag == "a":
            self.links.append(dict(attrs).get("href") or "")
        if tag in ("title", "h1", "script", "style", "nav"):
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        if "script" in self.inside or "style" in self.inside:
            return
        if "title" in self.inside:
            self.title.append(data)
        elif "h1" in self.inside:
            self.heading.append(data)
        elif "nav" not in self.inside:
            self.body.append(data)


def pages(rows: DataFrame) -> DataFrame:
    """(page_id, title, heading, n_links, body) of page_id, html; null html gives empty fields."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["page_id"], frame["html"]):
                reader = _Reader()
                reader.feed(html or "")
                text = [" ".join("".join(x).split()) for x in (reader.title, reader.heading)]
                body = "\n".join(line for line in (" ".join(x.split()) for x in "".join(reader.body).split("\n")) if line)
                out.append((page, *text, len(reader.links), body))
            yield pd.DataFrame(out, columns=["page_id", "title", "heading", "n_links", "body"])

    return rows.select("page_id", "html").mapInPandas(run, "page_id long, title string, heading string, n_links int, body string")


class _Channel(HTMLParser):
    """Posts of a channel page: elements with data-post, their text block, the first time with a datetime, pictures."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.posts: list[dict] = []
        self.depth = self.text_at = 0

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if found.get("data-post"):
            self.posts.append({"post": found["data-post"], "text": [], "at": "", "images": 0})
        if not self.posts:
            return
        post = self.posts[-1]
        if tag == "br" and self.text_at:
            post["text"].append("\n")
        if tag == "time" and found.get("datetime") and not post["at"]:
            post["at"] = found["datetime"]
        post["images"] += "background-image" in found.get("style", "") or tag == "img"
        if tag == "div":
            self.depth += 1
            if "message_text" in found.get("class", "") and not self.text_at:
                self.text_at = self.depth

    def handle_endtag(self, tag):
        if tag == "div" and self.depth:
            if self.depth == self.text_at:
                self.text_at = 0
            self.depth -= 1

    def handle_data(self, data):
        if self.text_at and self.posts:
            self.posts[-1]["text"].append(data)


def channel_posts(rows: DataFrame, channel: str) -> DataFrame:
    """(page_id, message_id, published_at, text, images) of the posts of one channel in pages (page_id, html).

    A post that a page repeats is its last; posts of other channels, or without a number, do not count; a time that cannot be
    read is 0. Null html has no posts.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, body in zip(frame["page_id"], frame["html"]):
                reader, own = _Channel(), {}
                reader.feed(body or "")
                for post in reader.posts:
                    name, _, number = post["post"].partition("/")
                    if name.lower() == channel.lower() and number.isdigit():
                        try:
                            at = int(datetime.fromisoformat(post["at"]).timestamp())
                        except ValueError:
                            at = 0
                        text = "\n".join(" ".join(x.split()) for x in "".join(post["text"]).split("\n")).strip()
                        own[int(number)] = (page, int(number), at, text, post["images"])
                out += own.values()
            yield pd.DataFrame(out, columns=["page_id", "message_id", "published_at", "text", "images"])

    return rows.select("page_id", "html").mapInPandas(run, "page_id long, message_id long, published_at long, text string, images int")


def overlay_detail(cards: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Listing cards with what their detail page says, where it says anything."""
    rest = [c for c in cards.columns if c != key]
    a, b = cards.alias("a"), details.alias("b")
    said = [F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")), F.col(f"a.{c}")).alias(c) if c in details.columns else F.col(f"a.{c}") for c in rest]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"a.{key}"), *said)
