"""Article search for editors: a page of hits with the facets around it."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from issueloom.operators.search import (
    article_group, article_list_item, category_facet, paginate, search_articles, source_facet)
from issueloom.sources.store import by_recency


@dataclass
class ArticleSearch:
    items: DataFrame
    numbers: dict
    categories: DataFrame
    sources: DataFrame


def article_search(articles: DataFrame, groups: DataFrame, members: DataFrame, page: int = 1, size: int = 20, **filters
                   ) -> ArticleSearch:
    hits = search_articles(article_group(articles, groups, members), **filters)
    rows, numbers = paginate(hits, by_recency(), page, size, key=["id"], by=["published_at", "first_seen_at", "id"])
    return ArticleSearch(rows.select(*article_list_item()), numbers, category_facet(groups), source_facet(articles))
