"""Scans, worklists, upserts and duplicate removal."""

import uuid

from pyspark.sql import functions as F

from issueloom.functions.text import is_blank
from issueloom.operators.categorize import article_category
from issueloom.operators.dedupe import effective_articles
from issueloom.operators.embedding import clusterable
from issueloom.operators.metrics import backfill_report, image_backfill_report
from issueloom.registry import sql as q
from issueloom.registry.base import AS_OF, epoch, query
from issueloom.session import run_folder
from issueloom.sources import store
from issueloom.sources.feeds import active_articles, valid_items
from issueloom.sources.tables import LATIN_CATEGORY_RULES

RECENCY = "published_at desc, first_seen_at desc, id"

@query("a6_article_scan", q.with_articles(f"""
select id, title, source, author, feed_url, is_excluded, image_url, content_fetch_status,
  {q.epoch('published_at')} as published, {q.epoch('first_seen_at')} as first_seen, {q.epoch('updated_at')} as updated
from articles"""))
def article_scan(t):
    return store.newest_articles(t.articles).select(
        "id", "title", "source", "author", "feed_url", "is_excluded", "image_url", "content_fetch_status",
        epoch("published_at").alias("published"), epoch("first_seen_at").alias("first_seen"),
        epoch("updated_at").alias("updated"))


@query("a7_recent_articles", q.with_articles(f"select id, title from articles order by {RECENCY} limit 500"))
def recent(t):
    return store.processing_window(t.articles, 100).select("id", "title")


@query("a8_recent_groups", q.with_groups("""
select group_id, category, score, article_count from groups order by latest_published_at desc, group_id limit 100"""))
def recent_groups(t):
    groups, _ = t.groups()
    return store.recent_groups(groups, 100).select("group_id", "category", "score", "article_count")


@query("a9_articles_by_ids", q.with_articles(
    "select id, title, summary from articles where id in (select article_id from raw_members where group_id in "
    "(select group_id from raw_members group by 1 having count(*) > 3))", q.MEMBERS))
def by_ids(t):
    big = t.members.groupBy("group_id").count().filter("count > 3")
    ids = t.members.join(big, "group_id", "left_semi")
    return store.articles_by_ids(t.articles, ids).select("id", "title", "summary")


@query("a10_a11_summary_upsert", """
select key, event_id as kept from (
  select *, row_number() over (partition by key order by is_new desc, ts desc, event_id desc) as rn from (
    select event_id, ts, strftime(ts, '%Y-%m-%d') as key, event_id % 4 = 0 as is_new from events)) where rn = 1""")
def summary_upsert(t):
    rows = t.event_log.select(
        F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("created_at").cast("timestamp_ntz")), "yyyy-MM-dd")
        .alias("date"), F.col("created_at").alias("generated_at"), F.col("event_id").alias("kept"))
    merged = store.upsert_summaries(rows.filter("kept % 4 <> 0"), rows.filter("kept % 4 = 0"))
    return merged.select(F.col("date").alias("key"), "kept")


@query("a10_newest_summaries", """
select strftime(ts, '%Y-%m-%d') as date, max(floor(epoch(ts))::bigint) as generated from events
group by 1""")
def newest_summaries(t):
    rows = t.event_log.select(
        F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("created_at").cast("timestamp_ntz")), "yyyy-MM-dd")
        .alias("date"), F.col("created_at").alias("generated_at"))
    kept = store.upsert_summaries(rows, rows.limit(0))
    return store.newest_summaries(kept).select("date", epoch("generated_at").alias("generated"))


@query("a10_summary_by_key", """
select strftime(ts, '%Y-%m-%d') as date, max(floor(epoch(ts))::bigint) as generated from events
where strftime(ts, '%Y-%m-%d') = '2024-01-05' group by 1""")
def one_summary(t):
    rows = t.event_log.select(
        F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("created_at").cast("timestamp_ntz")), "yyyy-MM-dd")
        .alias("date"), F.col("created_at").alias("generated_at"))
    return store.summary_by_key(store.upsert_summaries(rows, rows.limit(0)), "2024-01-05").select(
        "date", epoch("generated_at").alias("generated"))


@query("a12_article_upsert", q.with_articles("""
select id, case when doc_id % 5 = 0 then 'New ' || title else title end as title,
  case when doc_id % 5 = 0 then '' else content end as content from articles"""))
def article_upsert(t):
    a = t.articles
    new = a.filter("doc_id % 5 = 0").withColumns(
        {"title": F.concat(F.lit("New "), "title"), "content": F.lit("")})
    older = new.withColumns({"title": F.lit("old"), "updated_at": F.expr("updated_at - interval 1 day")})
    return store.upsert_articles(a.filter("doc_id % 3 <> 0 or doc_id % 5 <> 0"), older.unionByName(new)).select("id", "title", "content")


@query("a16_recent_events",
       "select event_id, event_type as type, props as details from events order by ts desc, event_id desc limit 20")
def recent_events(t):
    return store.recent_events(t.event_log, 20).select("event_id", "type", "details")


@query("a17_page_scan", "select page_id, url, length(html)::int as size from pages")
def page_scan(t):
    return t.pages.select("page_id", "url", F.length("html").alias("size"))


@query("c1_valid_items", q.with_articles("""
select id, title from (select id, case when doc_id % 9 = 0 then ' ' else title end as title,
  case when doc_id % 11 = 0 then '' else url end as url from articles) where trim(title) <> '' and trim(url) <> ''"""))
def valid(t):
    items = t.articles.withColumns({
        "title": F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.col("title")),
        "url": F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("url"))})
    return valid_items(items).select("id", "title")


@query("c2_clusterable", q.with_articles(
    "select id from articles where not is_excluded and doc_id % 2 = 0"))
def clusterable_articles(t):
    half = t.articles.withColumn("embedding", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1.0))))
    return clusterable(half).select("id")


@query("c3_active_articles", q.with_articles(f"""
select id from articles where feed_url = 'https://wire1.example/rss'
  or {q.publisher('feed_url')} in ('wire2.example', '연합뉴스')"""))
def active(t):
    feeds = t.spark.createDataFrame(
        [("HTTPS://wire1.example/rss", True), ("https://wire2.example/other", True),
         ("https://wire3.example/rss", False), ("https://www.yna.co.kr/rss/news.xml", True)], "url string, is_active boolean")
    return active_articles(t.articles, feeds).select("id")


@query("c4_missing_content", q.with_articles(
    f"select id from articles where content_fetch_status = '' order by {RECENCY} limit 50"))
def missing_content(t):
    return store.missing_content(t.articles, 50).select("id")


@query("c5_missing_images", q.with_articles(
    f"select id from articles where image_url = '' order by {RECENCY} limit 50"))
def missing_images(t):
    return store.missing_images(t.articles, 50).select("id")


@query("d4_merge_ingest", q.with_articles(f"""
select id, case when fresh then 'Re: ' || title else title end as title,
  case when fresh and doc_id % 3 = 0 and stored then author when fresh then 'feed' else author end as author,
  case when fresh and not stored then '' else content end as content,
  case when fresh and not stored then '' else content_fetch_status end as content_fetch_status,
  case when fresh then false else is_excluded end as is_excluded,
  case when fresh and doc_id % 6 = 0 and stored then image_url when fresh and doc_id % 6 = 0 then ''
    when fresh then 'https://img.example/new.jpg' else image_url end as image_url,
  case when fresh and not stored then {AS_OF} else {q.epoch('first_seen_at')} end as first_seen,
  case when fresh then {AS_OF} else {q.epoch('updated_at')} end as updated
from (select *, doc_id % 4 <> 0 as stored, doc_id % 3 = 0 or doc_id % 5 = 0 as fresh from articles)
where stored or fresh"""))
def ingest(t):
    as_of = F.timestamp_seconds(F.lit(AS_OF))
    d = F.col("doc_id")
    items = t.articles.filter("doc_id % 3 = 0 or doc_id % 5 = 0").withColumns({
        "title": F.concat(F.lit("Re: "), "title"), "author": F.when(d % 3 == 0, F.lit(" ")).otherwise(F.lit("feed")),
        "image_url": F.when(d % 6 == 0, F.lit("")).otherwise(F.lit("https://img.example/new.jpg")),
        "content": F.lit(""), "content_fetch_status": F.lit(""), "is_excluded": F.lit(False), "first_seen_at": as_of})
    # a blank author of an unknown article stays what the feed said
    items = items.withColumn("author", F.when((d % 3 == 0) & (d % 4 == 0), F.lit("feed")).otherwise(F.col("author")))
    # an earlier copy of each item must lose against the later one
    older = items.withColumns({"title": F.lit("older"), "updated_at": F.col("first_seen_at") - F.expr("INTERVAL 90 DAYS")})
    merged = store.merge_ingest(t.articles.filter("doc_id % 4 <> 0"), items.unionByName(older), as_of)
    return merged.select("id", "title", "author", "content", "content_fetch_status", "is_excluded", "image_url",
                         epoch("first_seen_at").alias("first_seen"), epoch("updated_at").alias("updated"))


@query("f1_effective_articles", q.with_articles(
    f"select id, title, source, {q.epoch('published_at')} as published from effective", q.EFFECTIVE))
def effective(t):
    return effective_articles(t.articles).select("id", "title", "source", epoch("published_at").alias("published"))


ARTICLE_CATEGORY_SQL = f"""
{q.CATEGORY_RULES},
article_hits as (
  select a.id, r.rule_order, count(distinct r.word) as score from articles a join rules r
    on contains(lower(a.source || ' ' || a.title || ' ' || a.summary || ' ' || a.content), r.word) group by all),
article_category as (
  select a.id, coalesce(arg_min(r.category, (-score, h.rule_order)), '사회') as category
  from articles a left join article_hits h on h.id = a.id
  left join (select distinct rule_order, category from rules) r on r.rule_order = h.rule_order group by a.id)"""


@query("h4_article_category", q.with_articles("select id, category from article_category", ARTICLE_CATEGORY_SQL))
def article_categories(t):
    return article_category(t.articles, LATIN_CATEGORY_RULES).select("id", "category")


@query("h4_group_category", q.with_groups("select group_id, category from groups"))
def group_categories(t):
    groups, _ = t.groups()
    return groups.select("group_id", "category")


@query("i5_finalize_groups", q.with_groups(f"""
select group_id, category, article_count, array_to_string(sources, '|') as sources, score, seed_title, seed_summary,
  representative_title, summary, {q.epoch('latest_published_at')} as latest from groups"""))
def finalized(t):
    groups, _ = t.groups()
    return groups.select("group_id", "category", "article_count", F.array_join("sources", "|").alias("sources"), "score",
                         "seed_title", "seed_summary", "representative_title", "summary",
                         epoch("latest_published_at").alias("latest"))


@query("e14_backfill_report", q.with_articles("""
select 50 as requested, least(50, count(*) filter (content_fetch_status = ''))::int as processed,
  count(*) filter (content_fetch_status = '') as before_missing,
  count(*) filter (content_fetch_status = '' and doc_id % 20 <> 0) as after_missing,
  count(*) filter (content_fetch_status = 'success' or doc_id % 20 = 0) as success,
  count(*) filter (content_fetch_status = 'failed') as failed from articles"""))
def backfill(t):
    before = t.articles
    after = before.withColumn("content_fetch_status", F.when(
        F.col("doc_id") % 20 == 0, F.lit("success")).otherwise(F.col("content_fetch_status")))
    return backfill_report(before, after, 50)


@query("e14_image_backfill_report", q.with_articles("""
select 50 as requested, least(50, count(*) filter (image_url = ''))::int as processed,
  count(*) filter (image_url = '') as before_missing, count(*) filter (image_url = '' and doc_id % 8 <> 0) as after_missing,
  count(*) filter (image_url <> '' or doc_id % 8 = 0) as with_image from articles"""))
def image_backfill(t):
    before = t.articles
    after = before.withColumn("image_url", F.when(F.col("doc_id") % 8 == 0, F.lit("https://i.example/x.png")).otherwise(F.col("image_url")))
    return image_backfill_report(before, after, 50)


@query("a14_article_files", q.with_articles("select id, title, url, content from articles"))
def article_files(t):
    """Articles written and read back, by day."""
    path = f"{run_folder(t.spark)}/articles-{uuid.uuid4().hex}"
    store.write_articles(t.articles.drop("doc_id", "lang"), path)
    return store.read_articles(t.spark, path).select("id", "title", "url", "content")


@query("a14_import_summaries", """
with d as (select ts::date as day, count(*) as n, max(ts) as last, count(distinct user_id) as users, list(distinct event_type order by event_type) as kinds,
    list(distinct event_id order by event_id) as ids from events group by 1),
s as (select strftime(day, '%Y-%m-%d') as date, case when day(day) % 2 = 0 then floor(epoch(last))::bigint else 1706659200 end as generated,
    case when day(day) % 3 = 0 then 'external' else 'manual' end as provider, case when day(day) % 4 = 0 then 'model-1' else '' end as model,
    case when day(day) % 5 = 0 then '' else n || ' events' end as headline, n::int as issue_count, case when day(day) % 5 = 0 then 0 else users::int end as source_count,
    case when day(day) % 6 = 0 then '' else array_to_string(kinds, '|') end as titles, case when day(day) % 6 = 0 then [] else ids end as ids, day from d)
select date, generated, provider, model, headline, issue_count, source_count, titles, len(ids)::bigint as n_articles,
  coalesce(list_sum(ids), 0)::bigint as sum_articles from s""")
def imported_summaries(t):
    """The events of every day written as a summary file by hand, fields left out here and there, and imported."""
    base = f"{run_folder(t.spark)}/summaries-{uuid.uuid4().hex}"
    e = t.read("events").select(F.to_date("ts").alias("day"), "ts", "user_id", "event_type", "event_id")
    days = e.groupBy("day").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.countDistinct("user_id").alias("users"),
                                F.array_sort(F.collect_set("event_type")).alias("kinds"),
                                F.array_sort(F.collect_set("event_id")).alias("ids"))  # the events of a day make one file
    d = F.dayofmonth("day")
    ids = F.transform("ids", lambda i: i.cast("string"))
    issues = F.transform("kinds", lambda k, i: F.struct(k.alias("Title"), F.when(i == 0, ids).otherwise(F.array().cast("array<string>")).alias("ArticleIds")))
    text = F.to_json(F.struct(
        F.concat(F.lit(" "), F.date_format("day", "yyyy-MM-dd"), F.lit(" ")).alias("Date"),
        F.when(d % 2 == 0, F.concat(F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("GeneratedAt"),
        F.when(d % 3 == 0, F.lit("external")).when(d % 3 == 1, F.lit(" ")).alias("Provider"), F.when(d % 4 == 0, F.lit("model-1")).alias("Model"),
        F.when(d % 5 != 0, F.concat(F.col("n").cast("string"), F.lit(" events"))).alias("Headline"), F.col("n").alias("IssueCount"),
        F.when(d % 5 != 0, F.col("users")).alias("SourceCount"), F.when(d % 6 != 0, issues).alias("TopIssues")))
    days.select(text.alias("value"), "day").write.partitionBy("day").text(base)
    summaries, articles = store.import_summaries(t.spark, f"{base}/day=*", t.as_of)
    linked = articles.groupBy("date").agg(F.count("*").alias("k"), F.sum(F.col("article_id").cast("bigint")).alias("s"))
    return summaries.join(linked, "date", "left").select(
        "date", epoch("generated_at").alias("generated"), "provider", "model", "headline", "issue_count", "source_count",
        F.array_join(F.transform("top_issues", lambda i: i["title"]), "|").alias("titles"), F.coalesce("k", F.lit(0)).alias("n_articles"),
        F.coalesce("s", F.lit(0)).alias("sum_articles"))
