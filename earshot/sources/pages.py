"""Transcript pages: reading them, their metadata and their blocks. The DOM needs Python; all else is relational."""

from __future__ import annotations

import gzip
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns and names in transcript pages.
BODY_ID, BODY_CLASS = "article-body-transcript", "article-body"
PARTICIPANTS_ID, TRANSCRIPT_ID = "call-participants", "full-conference-call-transcript"
DATE = r"([A-Z][a-z]{2,8})\.? (\d{1,2}), (\d{4})"
TIME = r"(?i)(\d{1,2})(?::(\d{2}))? ?([ap])\.?m"
QUARTER = r"(?iU)\b(Q[1-4])\s+(?:FY\s*)?((?:19|20)\d{2})\b"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Years that a date may have.
FIRST_YEAR, LAST_YEAR = 1678, 2261

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: A heading, paragraph or list item of the article in page order: its id, its text with a space between elements and
#: without, its first strong and em text, and whether it stands in the list of participants.
BLOCK = "struct<kind: string, id: string, text: string, tight: string, strong: string, em: string, listed: boolean>"
#: What a page's first row has beside the page's own columns.
HEAD = "struct<error: string, stamps: array<string>>"
_BLOCK_FIELDS = ("kind", "id", "text", "tight", "strong", "em", "listed")
#: Pages whose rows make a batch.
PAGES = 128


def clean(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split())


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.down = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in page order."""
        stack = [iter(self.down)]
        while stack:
            n = next(stack[-1], None)
            if n is None:
                stack.pop()
            elif isinstance(n, Node):
                yield n
                stack.append(iter(n.down))

    def strings(self) -> Iterator[str]:
        stack = [iter(self.down)]
        while stack:
            n = next(stack[-1], None)
            if n is None:
                stack.pop()
            elif isinstance(n, Node):
                stack.append(iter(n.down))
            else:
                yield n

    def text(self, between: str = " ") -> str:
        return clean(between.join(self.strings()))

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def by_id(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.attrs.get("id") == name), None)

    def after(self) -> list[Node]:
        """Element siblings behind this one."""
        here = self.up.down if self.up else []
        return [n for n in here[next(i for i, n in enumerate(here) if n is self) + 1 :] if isinstance(n, Node)] if here else []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)

    def _end(self, tag: str) -> None:
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS or tag == "li":
            n = self.at
            while n.up is not None and n.tag not in ("div", "ul", "ol", "body", "article", "section", "td"):
                if n.tag == "p" or tag == "li" and n.tag == "li":
                    self.at = n.up
                    break
                n = n.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.down.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._end(tag)

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.at.down.append(data)


def tree(source: str) -> Node:
    b = _Builder()
    b.feed(source)
    b.close()
    return b.root


def _article(page: Node) -> Node | None:
    return page.by_id(BODY_ID) or next((n for n in page.walk() if BODY_CLASS in n.attrs.get("class", "").split()), None)


def article_body(page: Node) -> Node:
    body = _article(page)
    if body is None:
        raise ValueError("no article body")
    return body


def stamps(page: Node) -> list[str]:
    """Texts that may tell the call's day and time, the likeliest first."""
    marked = page.by_id("date")
    if marked is None:
        early = [n for n in page.walk() if n.tag == "p"][:6]
        return [n.text() for n in early if "call" in n.text("").lower()]
    if marked.tag == "h2":  # a heading: the date is in what follows it
        return [(marked.after() or [marked])[0].text()]
    apart = page.by_id("time") if marked.tag == "span" else None
    return [" ".join([marked.text(), *([apart.text("")] if apart is not None else [])])]


def blocks(body: Node) -> Iterator[dict]:
    """The article's headings, paragraphs and list items as BLOCKs."""
    lists: set[int] = set()
    for n in body.walk():
        if n.tag == "h2" and n.attrs.get("id") == PARTICIPANTS_ID and not lists:
            for beside in n.after():
                if beside.tag == "h2":
                    break
                lists.add(id(beside))
        if n.tag in ("h2", "p", "li"):
            inside = n
            while n.tag == "li" and inside is not None and not (inside.tag == "ul" and id(inside) in lists):
                inside = inside.up
            strong, em = n.first("strong"), n.first("em")
            listed = inside is not None and id(inside) in lists and n.tag != "h2"
            yield {
                "kind": n.tag, "id": n.attrs.get("id"), "text": n.text(), "tight": n.text("") if listed or n.tag == "h2" else None,
                "strong": strong.text("") if strong is not None else "", "em": em.text("") if em is not None else None, "listed": listed,
            }


def read_page(source: str | bytes | None) -> tuple[list[str], list[dict]]:
    """Stamps and blocks of one page, packed by gzip or not. Raises ValueError if there is none or it has no article."""
    if isinstance(source, (bytes, bytearray)):
        source = gzip.decompress(source).decode()
    if source is None:
        raise ValueError("no page")
    page = tree(source)
    return stamps(page), list(blocks(article_body(page)))


def read_blocks(pages: DataFrame, call: str = "url", html_col: str = "html") -> DataFrame:
    """Each page, one for each value of `call`, as rows: one at pos -1 with the page's other columns and `head`, then one
    for each block, with call, pos and `block`; the rest is null in them.

    Python reads a page here once, and what follows are windows and groups by call. Pages that can't be read have an
    error in head and no blocks. Gzipped bytes are unpacked.
    """
    own = [c for c in pages.columns if c not in (call, html_col)]
    slim = pages.select(F.col(call).alias("call"), F.col(html_col).alias("html"), *(F.col(c).alias(f"own{i}") for i, c in enumerate(own)))
    types = dict(slim.dtypes)
    schema = ", ".join([f"call {types['call']}", f"head {HEAD}", "pos int", f"block {BLOCK}", *(f"own{i} {types[f'own{i}']}" for i in range(len(own)))])
    text = pa.string()
    block_type = pa.struct([(f, pa.bool_() if f == "listed" else text) for f in _BLOCK_FIELDS])
    head_type = pa.struct([("error", text), ("stamps", pa.list_(text))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                page, head, pos, found = [], [], [], []
                for i, source in enumerate(part.column(1).to_pylist()):
                    try:
                        (when, rows), error = read_page(source), None
                    except (ValueError, OSError, AttributeError, EOFError) as e:
                        when, rows, error = [], [], type(e).__name__
                    page += [i] * (1 + len(rows))
                    head += [{"error": error, "stamps": when}, *[None] * len(rows)]
                    pos += range(-1, len(rows))
                    found += [None, *rows]
                first = pa.array([i if k < 0 else None for i, k in zip(page, pos)], pa.int32())
                columns = [part.column(0).take(pa.array(page, pa.int32())), pa.array(head, head_type), pa.array(pos, pa.int32()), pa.array(found, block_type)]
                yield pa.RecordBatch.from_arrays([*columns, *(c.take(first) for c in part.columns[2:])], ["call", "head", "pos", "block", *part.schema.names[2:]])

    out = slim.mapInArrow(read, schema)
    return out.select(F.col("call").alias(call), "head", "pos", "block", *(F.col(f"own{i}").alias(c) for i, c in enumerate(own)))


def _title() -> Column:
    return F.when(F.col("block.kind") == "h2", F.lower("block.tight"))


#: Whether a row of read_blocks is a heading of the one layout or the other.
def _headed() -> Column:
    return F.coalesce(_title().startswith("prepared remarks"), F.lit(False))


def _titled() -> Column:
    return F.coalesce((F.col("block.kind") == "h2") & (F.col("block.id") == TRANSCRIPT_ID), F.lit(False))


def with_layout(blocks: DataFrame, call: str = "url") -> DataFrame:
    """blocks with the layout of their page: legacy with a heading of prepared remarks, current with one of the transcript only, else null."""
    by = Window.partitionBy(call)
    return blocks.withColumn("layout", F.when(F.max(_headed()).over(by), "legacy").when(F.max(_titled()).over(by), "current"))


def call_columns(head: Column, layout: Column) -> dict[str, Column]:
    """error, layout, call_date and call_time_et of a page by its head and the layout that its headings show.

    The first stamp with a date counts. A date that isn't one, as of an unknown month or a 31st of February, makes the
    page unreadable (ValueError), as does a page without the headings of either layout. Without a date both are null.
    """
    stamp = F.try_element_at(F.filter(head["stamps"], lambda s: s.rlike(DATE)), F.lit(1))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.regexp_extract(stamp, DATE, 1), 1, 3)).cast("int")
    day, year = F.regexp_extract(stamp, DATE, 2).try_cast("int"), F.regexp_extract(stamp, DATE, 3).try_cast("int")
    first = F.when((month > 0) & year.between(FIRST_YEAR, LAST_YEAR), F.make_date(year, month, F.lit(1)))
    date = F.when(first.isNotNull() & day.between(1, F.day(F.last_day(first))), F.date_add(first, day - 1).cast("string"))
    hour = F.pmod(F.regexp_extract(stamp, TIME, 1).try_cast("int"), F.lit(12)) + F.when(F.lower(F.regexp_extract(stamp, TIME, 3)) == "p", 12).otherwise(0)
    minute = F.regexp_extract(stamp, TIME, 2)
    clock = F.when(stamp.rlike(TIME), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.when(minute == "", "00").otherwise(minute)))
    error = F.coalesce(head["error"], F.when(layout.isNull() | (stamp.isNotNull() & date.isNull()), F.lit("ValueError")))
    good = lambda c: F.when(error.isNull(), c)
    return {"error": error, "layout": good(layout), "call_date": good(date), "call_time_et": good(F.when(date.isNotNull(), clock))}


def page_records(blocks: DataFrame, call: str = "url") -> DataFrame:
    """A row for each page of read_blocks: its own columns, call_columns and the number of its blocks (0 if unreadable)."""
    own = [c for c in blocks.columns if c not in (call, "head", "pos", "block")]
    top = F.first(F.when(F.col("pos") < 0, F.struct("head", *own)), ignorenulls=True)
    per = blocks.groupBy(call).agg(top.alias("_top"), F.max(_headed()).alias("_headed"), F.max(_titled()).alias("_titled"), F.count("block").alias("_n"))
    found = call_columns(F.col("_top.head"), F.when(F.col("_headed"), "legacy").when(F.col("_titled"), "current"))
    out = per.select(call, *(F.col("_top")[c].alias(c) for c in own), *(c.alias(k) for k, c in found.items()), "_n")
    return out.withColumn("blocks", F.when(F.col("error").isNull(), F.col("_n")).otherwise(0)).drop("_n")


def read_gzip_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of gzipped page files, as bytes; read_blocks unpacks them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("content").alias("html"))


def extract_metadata(pages: DataFrame, html_col: str = "html", title_suffix: str = "") -> DataFrame:
    """pages with ticker, company, title and fiscal_quarter ("Q1 2024" or "") from head and meta elements, "" where missing,
    and has_article, whether there is an article."""

    @F.pandas_udf("struct<ticker: string, company: string, title: string, has_article: boolean>")
    def meta(html: pd.Series) -> pd.DataFrame:
        rows = []
        for h in html:
            page = tree(h or "")
            tags = {n.attrs.get("name", ""): n.attrs.get("content", "").strip() for n in page.walk() if n.tag == "meta"}
            title = page.first("title")
            text = " ".join(s.strip() for s in title.strings()).strip() if title is not None else ""
            rows.append((tags.get("primary_tickers", "").split(",")[0].strip().upper(), tags.get("primary_tickers_companies", "").split(",")[0].strip(), text.removesuffix(title_suffix).strip(), _article(page) is not None))
        return pd.DataFrame(rows, columns=["ticker", "company", "title", "has_article"])

    out = pages.withColumn("_m", meta(html_col)).withColumns({c: F.col(f"_m.{c}") for c in ("ticker", "company", "title", "has_article")}).drop("_m")
    quarter = F.concat(F.upper(F.regexp_extract("title", QUARTER, 1)), F.lit(" "), F.regexp_extract("title", QUARTER, 2))
    return out.withColumn("fiscal_quarter", F.when(F.col("title").rlike(QUARTER), quarter).otherwise(""))
