"""Main text of web pages by removal of site templates.

Elements that name themselves (menus, headers, footers, sidebars, notices, adverts, forms, comments) go by
their tag, role, class or id. Templates that don't are found by counting: the subtrees of the main text are
hashed, and Spark counts for each host below how many different parents a subtree occurs. Parents, not
pages, so that the paragraphs of an article that many pages copy count once. A subtree that recurs on many
pages of its host is deleted; running text (paragraphs, headings, list items) only if it recurs on more than
half of them, since articles quote and copy each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import kept, table
from tillscope.llm.markup import Page

#: Different parents below which a subtree must occur on a host, and the share of the host's pages from
#: which on running text is a template too.
LEAST_PAGES, SHARE = 8, 0.5


def with_site(pages: DataFrame) -> DataFrame:
    """site (hash of the host; NULL where the URL names none), page (hash of the html), html."""
    host = F.lower(F.regexp_extract(F.trim("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.when(host != "", F.xxhash64(host)).alias("site"), F.unhex(F.md5(html)).alias("page"), html.alias("html"))


def subtree_rows(sited: DataFrame) -> DataFrame:
    """site, page, node (hash of a subtree of the main text) and above (hash of its parent; 0: the page)."""
    schema = pa.schema([("site", pa.int64()), ("page", pa.binary()), ("node", pa.int64()), ("above", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for site, page, html in zip(*(c.to_pylist() for c in batch.columns)):
                hashes, above, _ = Page(html).subtrees()
                for node, parent in {(h, a) for h, a in zip(hashes, above) if h}:
                    for column, value in zip(out, (site, page, node, parent)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
    return sited.where("site is not null").select("site", "page", "html").mapInArrow(run, "site long, page binary, node long, above long")


def recurring(rows: DataFrame, least_pages: int, share: float) -> DataFrame:
    """site and node of the subtrees that recur on `least_pages` pages of their site and, if they are
    running text (an odd hash), on more than the share of its different pages."""
    told = rows.select("site", "node", "above").distinct()
    found = told.where("above <> 0").groupBy("site", "node").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    sites = told.where("above = 0").groupBy("site").agg(F.count("*").alias("pages"))
    text = F.col("node").bitwiseAND(1) == 1
    return found.join(sites, "site").where(~text | (F.col("n") > share * F.col("pages"))).select("site", "node")


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    The text is that of the article elements; where a page has none (or empty ones), of the main element;
    else of the whole page. NULL, empty and broken html: what text there is, else ''. A page without URL or
    host is no part of a site, so nothing of it recurs. Rows that repeat are each returned and count once.
    Very long pages are read whole. Ties can't occur; an empty table gives no rows; other columns are not read.
    """
    sited = with_site(pages)
    rows = kept(subtree_rows(sited), "subtrees")
    templates = kept(recurring(rows, least_pages, share), "templates")
    hits = rows.select("site", "page", "node").distinct().join(templates, ["site", "node"])
    hits = kept(hits.groupBy("site", "page").agg(F.collect_list("node").alias("nodes")), "hits")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, nodes = (batch.column(i).to_pylist() for i in (2, 3))
            texts = [Page(h).text(set(n or ())) for h, n in zip(html, nodes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)
    told = sited.join(hits, ["site", "page"], "left").select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "nodes")
    return told.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `pages`. Cases: see `main_text`."""
    return main_text(table(spark, sf_dir, "pages"))
