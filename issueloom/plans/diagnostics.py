"""The state of all stores on one row, with warnings and recent events beside it."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from issueloom.operators import metrics as M
from issueloom.operators.dedupe import effective_articles
from issueloom.session import materialize
from issueloom.sources.store import recent_events


@dataclass
class Diagnostics:
    metrics: DataFrame
    statuses: DataFrame
    providers: DataFrame
    categories: DataFrame
    warnings: DataFrame
    events: DataFrame


def diagnostics(articles: DataFrame, groups: DataFrame, summaries: DataFrame, feeds: DataFrame, runs: DataFrame,
                events: DataFrame, as_of: Column, **limits) -> Diagnostics:
    """`runs` is the pipeline run table; its newest row is the one judged."""
    narrow = articles.drop("content", "embedding")
    row = materialize(M.store_metrics(narrow, effective_articles(narrow), groups, summaries, feeds), "metrics")
    last = runs.orderBy(F.desc("started_at"), F.asc("run_id")).limit(1)
    return Diagnostics(row, M.status_counts(narrow), M.provider_counts(summaries), M.category_distribution(groups),
                       M.warnings(row, last, as_of, **limits), recent_events(events, 20))
