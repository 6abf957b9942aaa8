"""Feed lists and landed feed files."""

from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from issueloom.functions.dates import published_at
from issueloom.functions.html import item_image
from issueloom.functions.text import clean_text, is_blank, or_empty, strip
from issueloom.functions.urls import host, publisher, safe_url
from issueloom.schema import ARTICLES


def parse_feed_lines(lines: DataFrame) -> DataFrame:
    """(url, is_active) of a feed list in `line`, `line_no`: the first entry per URL counts.

    A `#` line is a switched-off feed when the rest, after an optional word "disabled", is a URL; else a comment.
    """
    line = strip(F.col("line"))
    off = line.startswith("#")
    rest = strip(F.regexp_replace(strip(F.ltrim(line, F.lit("#"))), "(?i)^disabled", ""))
    entries = lines.select(safe_url(F.when(off, rest).otherwise(line)).alias("url"), (~off).alias("is_active"), "line_no")
    first = entries.filter(F.col("url") != "").groupBy(F.lower("url").alias("key")).agg(
        F.min(F.struct("line_no", "url", "is_active")).alias("e"))
    return first.select("e.url", "e.is_active")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """A feed list is one small file, so its line order is the order of one partition."""
    lines = spark.read.option("wholetext", "true").text(path)
    numbered = lines.select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line"))
    return parse_feed_lines(numbered)


def active_feeds(feeds: DataFrame) -> DataFrame:
    """Active URLs, one spelling per URL whatever its case."""
    return feeds.filter("is_active").groupBy(F.lower("url").alias("key")).agg(F.min("url").alias("url")).select("url")


def active_articles(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Articles of an active feed or of a publisher with an active feed; all of them when no feed is active."""
    on = active_feeds(feeds)
    urls = on.select(F.lower("url").alias("_feed")).distinct().withColumn("_by_feed", F.lit(True))
    names = on.select(F.lower(publisher(F.col("url"))).alias("_name")).distinct().withColumn("_by_name", F.lit(True))
    none = on.agg((F.count("*") == 0).alias("_none"))  # one row
    return (
        articles.join(urls, F.lower("feed_url") == F.col("_feed"), "left")
        .join(names, F.lower(publisher(F.col("feed_url"))) == F.col("_name"), "left")
        .join(F.broadcast(none))
        .filter(F.coalesce("_by_feed", "_by_name", "_none"))
        .select(*articles.columns)
    )


def valid_items(items: DataFrame) -> DataFrame:
    return items.filter(~is_blank(F.col("title")) & ~is_blank(F.col("url")))


_KEPT = ("type", "medium", "url", "src", "href")
ELEMENT = T.StructType([T.StructField("depth", T.IntegerType())] + [T.StructField(n, T.StringType()) for n in ("name", *_KEPT, "text")])
FEED = T.StructType([T.StructField("channel", T.StringType()), T.StructField("kind", T.StringType()),
                     T.StructField("items", T.ArrayType(T.ArrayType(ELEMENT)))])


class _Feed:
    """The items of one feed document, each as its elements in document order: depth, local name, attributes and text."""

    def __init__(self, document: str):
        self.path: list[str] = []
        self.text: list[str] = []
        self.channel: list[str] = []
        self.items: list[list[list]] = []
        self.entries: list[list[list]] = []
        self.inside: list[tuple[int, list, list]] = []  # open items: (depth, elements, open elements)
        reader = expat.ParserCreate(namespace_separator=" ")
        reader.buffer_text = True
        reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = self._start, self._end, self.text.append
        reader.Parse(document, True)

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        local = name.rpartition(" ")[2]
        for depth, elements, unfinished in self.inside:
            element = [len(self.path) - depth, local, *[attributes.get(k) for k in _KEPT], None]
            elements.append(element)
            unfinished.append((element, len(self.text)))
        if name == "item" or len(self.path) == 1 and local == "entry":
            elements = []
            (self.items if name == "item" else self.entries).append(elements)
            self.inside.append((len(self.path), elements, []))
        self.path.append(name)
        if len(self.path) == 3 and self.path[1:] == ["channel", "title"] and not self.channel:
            self.title = len(self.text)

    def _end(self, name: str) -> None:
        if len(self.path) == 3 and self.path[1:] == ["channel", "title"] and not self.channel:
            self.channel.append("".join(self.text[self.title:]))
        self.path.pop()
        if self.inside and self.inside[-1][0] == len(self.path):
            self.inside.pop()
        for depth, _, unfinished in self.inside:
            element, first = unfinished.pop()
            if element[0] == 1:  # only the item's own children are read as text
                element[-1] = "".join(self.text[first:])


@pandas_udf(FEED)
def read_feed(documents: pd.Series) -> pd.DataFrame:
    """Channel title and items of feed documents; entries where there are no items. A document that is no XML has none."""
    rows = []
    for document in documents:
        try:
            feed = _Feed(document)
        except expat.ExpatError:
            rows.append((None, None, []))
            continue
        rows.append((feed.channel[0] if feed.channel else None, "item" if feed.items else "entry", feed.items or feed.entries))
    return pd.DataFrame(rows, columns=["channel", "kind", "items"])


def _child(name: str) -> Column:
    """Text of the item's first child of that local name, in any spelling."""
    return F.get(F.filter("item", lambda e: (e["depth"] == 1) & (F.lower(e["name"]) == name)), 0)["text"]


def _read_items(spark: SparkSession, path: str, feed_urls: DataFrame, as_of: Column) -> DataFrame:
    """Articles of landed feed files, with `kind`.

    A file is read once and whole, as a feed is one document: RSS items wherever they stand, or the Atom entries under the root
    where there are none. What a field is made of follows document order, in any namespace and, for images, at any depth.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("feed_file"), read_feed("value").alias("read"))
    items = files.select("feed_file", F.col("read.channel").alias("channel_title"), F.col("read.kind").alias("kind"),
                         F.explode("read.items").alias("item")).join(feed_urls, "feed_file", "left")
    link = clean_text(_child("link"))
    target = F.get(F.filter("item", lambda e: (e["depth"] == 1) & (e["name"] == "link")), 0)["href"]
    url = F.when(link != "", link).otherwise(or_empty(target))
    channel = clean_text(F.col("channel_title"))
    media = F.transform("item", lambda e: F.struct(
        e["name"].alias("name"), F.coalesce(e["type"], e["medium"]).alias("type"), e["url"].alias("url"), e["src"].alias("src")))
    described = F.coalesce(_child("description"), _child("content"))
    raw_time = F.coalesce(_child("pubdate"), _child("published"), _child("updated"))
    shaped = items.select(
        "kind", clean_text(_child("title")).alias("title"), url.alias("url"),
        F.when(channel != "", channel).otherwise(or_empty(host(F.col("feed_url")))).alias("source"),
        clean_text(F.coalesce(_child("author"), _child("creator"))).alias("author"), F.col("feed_url"),
        clean_text(F.coalesce(_child("description"), _child("summary"), _child("content"))).alias("summary"),
        F.lit(False).alias("is_excluded"), item_image(media, described, url).alias("image_url"), F.lit("").alias("content"),
        F.lit(None).cast("timestamp").alias("content_fetched_at"), F.lit("").alias("content_fetch_status"),
        F.lit("").alias("content_fetch_error"), published_at(or_empty(raw_time), as_of).alias("published_at"),
        as_of.alias("first_seen_at"), as_of.alias("updated_at"), F.lit(None).cast("array<double>").alias("embedding"))
    return valid_items(shaped).withColumn("id", F.sha2("url", 256)).select(*ARTICLES.fieldNames(), "kind")


def read_rss(spark: SparkSession, path: str, feed_urls: DataFrame, as_of: Column) -> DataFrame:
    """Articles of landed RSS files only."""
    return _read_items(spark, path, feed_urls, as_of).filter("kind = 'item'").drop("kind")


def read_atom(spark: SparkSession, path: str, feed_urls: DataFrame, as_of: Column) -> DataFrame:
    """Articles of landed Atom files only: the ones without any `item`."""
    return _read_items(spark, path, feed_urls, as_of).filter("kind = 'entry'").drop("kind")


def read_feed_files(spark: SparkSession, path: str, feed_urls: DataFrame, as_of: Column) -> DataFrame:
    """Articles of landed feed files of both kinds. `feed_urls` maps feed_file to the feed's own URL."""
    return _read_items(spark, path, feed_urls, as_of).drop("kind")
