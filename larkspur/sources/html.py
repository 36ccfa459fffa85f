"""Product fields of HTML pages, and page state kept as an index-referenced JSON array."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = "title string, heading string, links array<string>, images array<string>, meta map<string,string>"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = {"title": "", "heading": "", "links": [], "images": [], "meta": {}}
        self.open = None

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag in ("title", "h1"):
            self.open = "title" if tag == "title" else "heading"
        elif tag == "a" and "href" in at:
            self.found["links"].append(at["href"])
        elif tag == "img":
            best = largest_source(at.get("srcset", "")) or at.get("src")
            if best:
                self.found["images"].append(best)
        elif tag == "meta" and (name := at.get("property") or at.get("name")):
            self.found["meta"][name] = at.get("content", "")

    def handle_endtag(self, tag):
        if tag in ("title", "h1"):
            self.open = None

    def handle_data(self, data):
        if self.open:
            self.found[self.open] += data


def largest_source(srcset: str) -> str | None:
    """The candidate of a srcset with the largest width or density."""
    best = None
    for part in srcset.split(","):
        url, _, size = part.strip().partition(" ")
        number = float(size.strip(" wx") or 1) if size.strip(" wx").replace(".", "", 1).isdigit() or not size else 0.0
        if url and (best is None or number > best[0]):
            best = (number, url)
    return best[1] if best else None


def parse_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    return page.found


def page_fields(df: DataFrame, *, html_col: str = "html") -> DataFrame:
    """The input with a struct `page` of title, heading, links, images and meta."""

    @F.pandas_udf(PAGE)
    def parse(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(p) for p in pages], columns=["title", "heading", "links", "images", "meta"])

    return df.withColumn("page", parse(html_col))


def site_fields(pages: DataFrame, profiles: dict[str, dict[str, str]], *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page columns, site, fields): each page's product fields by the profile of its site.

    profiles: site to (field to pattern with one group); "*" is for sites without one. A site is the
    host's ending. Tags inside a field go, a field that isn't found is left out.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"//([^/:?#]*)", 1))
    site, fields = F.lit("*"), F.lit(None).cast("map<string,string>")

    def told(patterns: dict[str, str]):
        found = F.create_map(*[c for name, pattern in patterns.items() for c in (F.lit(name), F.trim(F.regexp_replace(F.regexp_extract(F.col(html_col), pattern, 1), "<[^>]*>", "")))])
        return F.map_filter(found, lambda k, v: v != "")

    fields = told(profiles["*"]) if "*" in profiles else fields
    for name, patterns in profiles.items():
        if name != "*":
            own = F.endswith(host, F.lit(name))
            site, fields = F.when(own, name).otherwise(site), F.when(own, told(patterns)).otherwise(fields)
    return pages.withColumns({"site": site, "fields": fields})


def decode_state(raw: str | None):
    """The object of a JSON array whose dicts and lists hold positions in the array; None if it is malformed."""
    try:
        cells = json.loads(raw or "")
    except ValueError:
        return None
    if not isinstance(cells, list) or not cells:
        return None
    built: dict[int, object] = {}

    def value(at):
        if not isinstance(at, int) or isinstance(at, bool) or not 0 <= at < len(cells):
            return None
        if at not in built:
            cell = cells[at]
            if isinstance(cell, dict):
                built[at] = target = {}
                target.update((k, value(v)) for k, v in cell.items())
            elif isinstance(cell, list):
                built[at] = target = []
                target.extend(value(v) for v in cell)
            else:
                built[at] = cell
        return built[at]

    return value(0)


def decoded_state(df: DataFrame, *, state_col: str) -> DataFrame:
    """The input with `state`: the decoded object as JSON text, null where it is malformed."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if (v := decode_state(r)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True))

    return df.withColumn("state", decode(state_col))
