"""Named queries: how each runs on Spark, and the SQL that states the same result."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from issueloom.functions.dates import korea_date
from issueloom.operators.dedupe import effective_members
from issueloom.operators.embedding import ensure_embeddings
from issueloom.operators.grouping import finalize_groups, group_issues, vector_nodes
from issueloom.plans.brief_feed import briefs
from issueloom.plans.daily import DailyIssues, Summaries, daily_candidates, daily_issues, daily_summaries
from issueloom.session import materialize
from issueloom.sources.tables import LATIN_CATEGORY_RULES, articles_from_documents, events_as_log

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`, with its oracle if there is one."""
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


_KNOWN: dict[tuple, "Tables"] = {}


def tables(spark: SparkSession, sf_dir: str) -> "Tables":
    """One `Tables` per application and folder: queries share what they derive, as the stages of one run do."""
    return _KNOWN.setdefault((spark.sparkContext.applicationId, sf_dir), Tables(spark, sf_dir))


def forget() -> None:
    """Drop everything derived so far, so that the next query pays for all it needs."""
    _KNOWN.clear()


def once(fn):
    """Derive a table the first time it is asked for."""
    def kept(self):
        if fn.__name__ not in self.derived:
            self.derived[fn.__name__] = fn(self)
        return self.derived[fn.__name__]
    return kept


class Tables:
    """The supplied tables under one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._read, self.derived = spark, sf_dir, {}, {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._read[name]

    @property
    def articles(self) -> DataFrame:
        return articles_from_documents(self.read("documents"), self.read("labels"))

    @property
    def embedded(self) -> DataFrame:
        return ensure_embeddings(self.articles)

    @property
    def members(self) -> DataFrame:
        """Articles grouped by the first word of their title: sizes range from one to a hot group."""
        word = F.lower(F.substring_index("title", " ", 1))
        return self.articles.select(F.sha2(word, 256).alias("group_id"), F.col("id").alias("article_id"))

    @once
    def groups(self) -> tuple[DataFrame, DataFrame]:
        groups, kept = finalize_groups(self.members, self.articles, LATIN_CATEGORY_RULES)
        return materialize(groups, "groups"), kept

    @once
    def effective(self) -> DataFrame:
        return materialize(effective_members(self.members, self.articles), "effective")

    @once
    def briefs(self) -> tuple[DataFrame, DataFrame]:
        """(briefs, brief articles) of all groups."""
        return materialize(briefs(self.groups()[0], self.effective(), self.articles, self.as_of), "briefs"), self.effective()

    @once
    def vectors(self) -> DataFrame:
        """Vectors of all articles with what grouping reads beside them: texts are hashed once."""
        return materialize(self.embedded.select("id", "published_at", "first_seen_at", "is_excluded", "embedding"), "vectors")

    @once
    def day_nodes(self) -> DataFrame:
        return vector_nodes(self.vectors(), korea_date(F.col("published_at")), stored=True)

    @once
    def day_groups(self) -> DataFrame:
        return materialize(group_issues(self.embedded, nodes=self.day_nodes()), "day-groups")

    @once
    def candidates(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        groups, members = self.groups()
        return daily_candidates(groups, members, self.articles)

    @once
    def issues(self) -> DailyIssues:
        groups, members = self.groups()
        return daily_issues(groups, members, self.articles)

    @once
    def summaries(self) -> Summaries:
        groups, members = self.groups()
        return daily_summaries(groups, members, self.articles, self.as_of)

    @property
    def as_of(self):
        return F.timestamp_seconds(F.lit(AS_OF))

    @property
    def pages(self) -> DataFrame:
        return self.read("pages")

    @property
    def event_log(self) -> DataFrame:
        return events_as_log(self.read("events"))


def epoch(column: str):
    """Timestamps leave a query as epoch seconds: the same number in every session time zone."""
    return F.unix_seconds(F.col(column))
