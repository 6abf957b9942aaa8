"""The brief feed, search, facets, edits, tracking and weekly summaries."""

from pyspark.sql import Window, functions as F

from issueloom.functions.dates import day_key, weekly_key
from issueloom.operators import edits as E
from issueloom.operators import search as S
from issueloom.operators import tracking as T
from issueloom.operators.keywords import newest_members
from issueloom.plans import weekly
from issueloom.plans.article_search import article_search
from issueloom.plans.brief_feed import brief_feed
from issueloom.plans.local_text import local_category_summary, local_week_summary
from issueloom.plans.prompt import render_prompt
from issueloom.registry import issues as R
from issueloom.registry import sql as q
from issueloom.registry.base import epoch, query
from issueloom.session import materialize
from issueloom.sources.store import by_recency


def briefs_sql(groups="groups", members="members"):
    return f"""
brief_facts as (
  select m.group_id, max(m.published_at) as newest, count(*)::int as article_count,
    arg_min({q.plain('a.summary')}, m.pos) filter ({q.plain('a.summary')} <> '') as feed_summary,
    coalesce(arg_min(a.image_url, m.pos) filter (trim(a.image_url) <> ''), '') as image_url,
    list({{'title': {q.plain('a.title')}, 'source': {q.plain('a.source')}, 'publisher': {q.publisher('a.feed_url')}, 'url': a.url}}
      order by m.pos) filter (m.pos <= 8) as links
  from {members} m join articles a on a.id = m.article_id group by m.group_id),
brief_sources as (
  select group_id, list(source_name order by pos) as sources from (
    select *, row_number() over (partition by group_id, lower(source_name) order by pos) as k from {members}) where k = 1 group by 1),
brief_publishers as (
  select group_id, list(p order by pos) as publishers from (
    select *, row_number() over (partition by group_id, p order by pos) as k from (
      select m.group_id, m.pos, {q.publisher('a.feed_url')} as p from {members} m join articles a on a.id = m.article_id)) where k = 1 group by 1),
briefs as materialized (
  select *, case when impact >= 80 then 'hot' else 'normal' end as heat from (
    select g.group_id, {q.plain('g.representative_title')} as title, g.category, array_to_string(s.sources[1:2], ', ') as source,
      p.publishers, greatest(1, case when m - floor(m) = 0.5 then 2 * round(m / 2) else round(m) end)::int as minutes,
      {q.impact('f.article_count', 'len(s.sources)', q.low_value(q.plain('g.representative_title'), "array_to_string(s.sources, ' ')"))} as impact,
      case when f.feed_summary is null then f.article_count || '개 관련 기사가 묶인 이슈입니다. 자세한 내용은 원문 링크에서 확인해 주세요. 확인 출처 '
          || len(s.sources) || '개.' when length(f.feed_summary) > 220 then trim(substr(f.feed_summary, 1, 220)) || '...'
        else f.feed_summary end as summary,
      f.image_url, list_filter(string_split({q.plain('g.representative_title')}, ' '), lambda w: length(w) >= 2)[1:4] as keywords,
      f.article_count, f.newest as latest_published_at, f.links, g.latest_published_at as stored_latest
    from {groups} g join (select *, (epoch_us(timestamp '2024-01-31') - epoch_us(newest)) / 1e6 / 60 as m from brief_facts) f using (group_id)
    join brief_sources s using (group_id) join brief_publishers p using (group_id)))
"""


BRIEFS = briefs_sql()
BRIEF_SQL = f"""select group_id, title, category, source, array_to_string(publishers, '|') as publishers, minutes, impact, heat, summary,
  image_url, array_to_string(keywords, '|') as keywords, article_count, {q.epoch('latest_published_at')} as latest,
  array_to_string(list_transform(links, lambda l: concat_ws('~', l.title, l.source, l.publisher, l.url)), '|') as links from briefs"""


def flat_briefs(briefs):
    return briefs.select(
        "group_id", "title", "category", "source", F.array_join("publishers", "|").alias("publishers"), "minutes", "impact",
        "heat", "summary", "image_url", F.array_join("keywords", "|").alias("keywords"), "article_count",
        epoch("latest_published_at").alias("latest"),
        F.array_join(F.transform("related_links", lambda l: F.concat_ws("~", l["title"], l["source"], l["publisher"], l["url"])), "|")
        .alias("links"))


@query("b25_b33_briefs", q.with_groups(BRIEF_SQL, BRIEFS))
def all_briefs(t):
    return flat_briefs(t.briefs()[0])


@query("j1_f10_brief_feed", q.with_groups(f"""
{BRIEF_SQL.replace('from briefs', 'from (select * from briefs order by stored_latest desc, group_id limit 100) briefs')}""",
    f"""
read_groups as (select * from groups order by latest_published_at desc, group_id limit 200),
visible_members as (
  select *, row_number() over (partition by group_id order by published_at desc, first_seen_at desc, article_id) as pos from (
    select m.group_id, m.article_id, {q.plain('a.source')} as source_name, a.published_at, a.first_seen_at,
      row_number() over (partition by m.group_id, {q.DUP_KEY.replace("source", "a.source").replace("title", "a.title").replace("author", "a.author")}
        order by a.published_at desc, a.first_seen_at desc, a.id) as rn
    from members m join read_groups using (group_id) join articles a on a.id = m.article_id
    where not a.is_excluded and a.source in ('wire0', 'wire2')) where rn = 1)""",
    briefs_sql("read_groups", "visible_members")))
def feed(t):
    groups, members = t.groups()
    feeds = t.spark.createDataFrame([("https://wire0.example/rss", True), ("https://wire2.example/other", True),
                                     ("https://wire3.example/rss", False)], "url string, is_active boolean")
    return flat_briefs(brief_feed(groups, members, t.articles, feeds, t.as_of, 100)[0])


@query("d1_group_articles", q.with_groups("select group_id, article_id, pos::int as pos, title from members m join articles a on a.id = m.article_id"))
def group_articles(t):
    rows = newest_members(t.effective())
    return rows.join(t.articles.select(F.col("id").alias("article_id"), "title"), "article_id").select(
        "group_id", "article_id", "pos", "title")


ARTICLE_GROUP = """
article_group as (
  select a.*, g.group_id, g.category, g.representative_title, g.summary as group_summary, g.article_count, g.score
  from articles a left join (
    select m.article_id, arg_min(m.group_id, (-epoch_us(g.latest_published_at), g.group_id)) as group_id
    from raw_members m join groups g using (group_id) group by 1) f on f.article_id = a.id
  left join groups g on g.group_id = f.group_id)
"""


def placed_articles(t):
    groups, _ = t.groups()
    return S.article_group(t.articles, groups, t.members)


@query("d3_b27_article_list", q.with_groups(f"""
select id, {q.plain('title')} as title, source, author, coalesce(group_id, '') as group_id, coalesce(category, '미분류') as category,
  is_excluded, case when content_fetch_status = '' then 'pending' else content_fetch_status end as content_fetch_status,
  {q.strip('content')} <> '' as has_content, image_url <> '' as has_image,
  case when length({q.plain('summary')}) > 180 then {q.strip(f"substr({q.plain('summary')}, 1, 180)")} || '...' else {q.plain('summary')} end as summary_preview,
  case when length({q.plain('content')}) > 220 then {q.strip(f"substr({q.plain('content')}, 1, 220)")} || '...' else {q.plain('content')} end as content_preview
from article_group""", ARTICLE_GROUP))
def article_list(t):
    return placed_articles(t).select(*S.article_list_item()).drop(
        "url", "feed_url", "published_at", "updated_at", "content_fetch_error")


@query("b27_article_detail", q.with_groups(f"""
select id, {q.plain('summary')} as summary, {q.plain('content')} as content, image_url, coalesce(group_id, '') as group_id,
  {q.plain('representative_title')} as group_title, {q.plain('group_summary')} as group_summary, article_count as group_articles, score as group_score
from article_group""", ARTICLE_GROUP))
def article_details(t):
    d = placed_articles(t).select(*S.article_detail())
    return d.select("id", "summary", "content", "image_url", "group_id", F.col("grp.title").alias("group_title"),
                    F.col("grp.summary").alias("group_summary"), F.col("grp.article_count").alias("group_articles"),
                    F.col("grp.score").alias("group_score"))


@query("c11_search_articles", q.with_groups(f"""
select 'excluded' as filter, id from article_group where is_excluded
union all select 'category', id from article_group where lower(coalesce(category, '')) = 'world'
union all select 'source', id from article_group where lower(source) = 'wire3'
union all select 'status', id from article_group where content_fetch_status = ''
union all select 'text', id from article_group
  where contains(lower({q.plain("title || ' ' || source || ' ' || author || ' ' || url || ' ' || summary || ' ' || feed_url")}), 'tion')
union all select 'all', id from article_group where not is_excluded and category = 'tech' and source = 'wire1'
  and content_fetch_status = 'success' and contains(lower(title || ' ' || summary), 'an')""", ARTICLE_GROUP))
def searched(t):
    a = materialize(placed_articles(t).select(
        "id", "title", "source", "author", "url", "summary", "feed_url", "is_excluded", "content_fetch_status", "grp"), "placed")
    found = {"excluded": dict(excluded=True), "category": dict(category="WORLD"), "source": dict(source="Wire3"),
             "status": dict(status="Pending"), "text": dict(text=" TION ")}
    parts = [S.search_articles(a, **f).select(F.lit(n).alias("filter"), "id") for n, f in found.items()]
    parts.append(S.search_articles(a, excluded=False, category="tech", source="wire1", status="success").filter(
        F.contains(F.lower(F.concat_ws(" ", "title", "summary")), F.lit("an"))).select(F.lit("all").alias("filter"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("j5_f9_article_search", q.with_groups("""
select id, 3 as page, greatest(1, ceil(n / 25.0))::int as page_count, n::int as total_count from (
  select *, count(*) over () as n, row_number() over (order by published_at desc, first_seen_at desc, id) as k from article_group where source = 'wire2')
where k > 50 and k <= 75""", ARTICLE_GROUP))
def search_page(t):
    groups, _ = t.groups()
    result = article_search(t.articles, groups, t.members, page=3, size=25, source="wire2")
    n = result.numbers
    return result.items.select("id", F.lit(n["page"]).alias("page"), F.lit(n["page_count"]).alias("page_count"),
                               F.lit(n["total_count"]).alias("total_count"))


@query("f9_deep_page", q.with_articles("""
select id, k::bigint as place, page, page_count from (
  select id, row_number() over (order by published_at desc, first_seen_at desc, id) as k, count(*) over () as n from articles),
  (select unnest(range(1, 3)) as which),
  lateral (select case which when 1 then ceil(n / 20.0)::int else (ceil(n / 20.0) / 2)::int end as page, ceil(n / 20.0)::int as page_count)
where k > (page - 1) * 20 and k <= page * 20"""))
def deep_pages(t):
    """The last page and the one in the middle of all articles, each out of the ranges of keys that hold it."""
    out, whole = None, -(-t.articles.count() // 20)
    for page in (10**9, round(whole / 2)):
        rows, n = S.paginate(t.articles, by_recency(), page, 20, key=["id"], by=["published_at", "first_seen_at", "id"], shallow=0, slice_rows=150)
        first = (n["page"] - 1) * n["page_size"]
        order = Window.orderBy(*by_recency())  # over one page
        part = rows.select("id", (F.row_number().over(order) + first).cast("bigint").alias("place"), F.lit(n["page"]).alias("page"),
                           F.lit(n["page_count"]).alias("page_count"))
        out = part if out is None else out.unionByName(part)
    return out


HAY = ("lower(title || ' ' || category || ' ' || source || ' ' || array_to_string(list_distinct(publishers), ' ') || ' ' || summary || ' ' || "
       "array_to_string(list_transform(links, lambda l: l.title || ' ' || l.source || ' ' || l.publisher), ' ') || ' ' || array_to_string(keywords, ' '))")


@query("c12_search_briefs", q.with_groups(f"""
select 'category' as filter, group_id from briefs where category = 'economy'
union all select 'text', group_id from briefs where contains({HAY}, 'wire3.example')
union all select 'today', group_id from briefs where {q.korea_date('latest_published_at')} = date '2024-01-31'
union all select 'yesterday', group_id from briefs where {q.korea_date('latest_published_at')} = date '2024-01-30'
union all select 'week', group_id from briefs where latest_published_at >= timestamp '2024-01-24'
union all select 'publisher', group_id from briefs where list_contains(publishers, 'wire4.example')
union all select 'size', group_id from briefs where article_count >= 3""", BRIEFS))
def searched_briefs(t):
    briefs, _ = t.briefs()
    found = {"category": dict(category="economy"), "text": dict(text="WIRE3.example "), "today": dict(preset="today"),
             "yesterday": dict(preset="yesterday"), "week": dict(preset="week"), "publisher": dict(publisher="wire4.example"),
             "size": dict(min_articles=3)}
    out = None
    for name, f in found.items():
        part = S.search_briefs(briefs, t.as_of, **f).select(F.lit(name).alias("filter"), "group_id")
        out = part if out is None else out.unionByName(part)
    return out


SORTS = {"latest": "latest_published_at desc, impact desc", "oldest": "latest_published_at", "impact_desc": "impact desc, latest_published_at desc",
         "impact_asc": "impact, latest_published_at desc", "articles_desc": "article_count desc, impact desc, latest_published_at desc",
         "articles_asc": "article_count, latest_published_at desc"}


@query("f8_sort_briefs", q.with_groups(" union all ".join(
    f"select * from (select '{m}' as mode, group_id from briefs order by {o}, group_id limit 10)" for m, o in SORTS.items()), BRIEFS))
def sorted_briefs(t):
    briefs, _ = t.briefs()
    out = None
    for mode in SORTS:
        page, _ = S.paginate(briefs, S.brief_order(mode), 1, 10, 10, 10)
        part = page.select(F.lit(mode).alias("mode"), "group_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("f8_sort_by_title")
def sorted_by_title(t):
    briefs, _ = t.briefs()
    return briefs.orderBy(*S.brief_order("title")).select("group_id", "title")


@query("f11_top_briefs", q.with_groups("""
select category, group_id, place::int as place from (select *, row_number() over (partition by category order by impact desc,
  latest_published_at desc, group_id) as place from briefs) where place <= 4""", BRIEFS))
def weightiest(t):
    return S.top_briefs(t.briefs()[0]).select("category", "group_id", "place")


@query("g1_distinct_ci", q.with_articles("""
select feed_url, arg_min(word, pos) as word from (
  select feed_url, word, lower(word) as k, doc_id as pos from (select doc_id, feed_url, split_part(title, ' ', 1) as word from articles) where word <> '')
group by feed_url, k"""))
def first_spellings(t):
    words = t.articles.select("doc_id", "feed_url", F.substring_index("title", " ", 1).alias("word"))
    return S.distinct_ci(words, "word", F.col("doc_id"), ["feed_url"]).select("feed_url", "word")


@query("g2_category_facet", q.with_groups("""
select distinct category from (select category from groups union all select unnest(['정치/정책', '경제/산업', '사회', '국제', 'IT/과학',
  '문화/연예', '스포츠', '생활/건강', '지역']))"""))
def categories(t):
    return S.category_facet(t.groups()[0])


@query("g3_source_facet", q.with_articles("select distinct source from articles"))
def sources(t):
    return S.source_facet(t.articles)


@query("g5_brief_facets", q.with_groups("""
select distinct 'publisher' as kind, unnest(publishers) as name from briefs
union all select distinct 'source', unnest(string_split(source, ', ')) from briefs
union all select distinct 'source', l.source from (select unnest(links) as l, source as s from briefs)
  where l.source not in (select unnest(string_split(source, ', ')) from briefs)""", BRIEFS))
def facets(t):
    briefs, _ = t.briefs()
    return S.publisher_facet(briefs).select(F.lit("publisher").alias("kind"), F.col("publisher").alias("name")).unionByName(
        S.source_name_facet(briefs).select(F.lit("source").alias("kind"), F.col("source").alias("name")))


TODAY = f"""
first_issues as (
  select row_number() over () as issue, keywords, names from (
    select arg_min(keywords, (-epoch_us(latest_published_at), group_id)) as keywords,
      arg_min(list_distinct(list_concat(string_split(source, ', '), list_transform(links, lambda l: l.source))),
        (-epoch_us(latest_published_at), group_id)) as names
    from briefs where {q.korea_date('latest_published_at')} = date '2024-01-30'
    group by source, lower({q.strip("regexp_replace(regexp_replace(title, ' +', ' ', 'g'), '[^\\p{L}\\p{N} ]', '', 'g')")}))),
today_words as (select issue, names, unnest(list_distinct(keywords)) as keyword from first_issues)
"""


@query("e15_today_keywords", q.with_groups("""
select keyword, count(distinct issue) as issues, count(distinct s) as sources
from (select keyword, issue, unnest(names) as s from today_words) group by keyword
having count(distinct issue) >= 5 and count(distinct s) >= 3 order by issues desc, sources desc, keyword limit 16""", BRIEFS, TODAY))
def todays(t):
    return S.today_keywords(t.briefs()[0], t.as_of - F.expr("INTERVAL 1 DAY"))


@query("e15_today_keywords_few", q.with_groups("""
select keyword, count(distinct issue) as issues, count(distinct s) as sources
from (select keyword, issue, unnest(names) as s from today_words) group by keyword
having count(distinct issue) >= 1 and count(distinct s) >= 1 order by issues desc, sources desc, keyword limit 16""", BRIEFS, TODAY))
def todays_few(t):
    return S.today_keywords(t.briefs()[0], t.as_of - F.expr("INTERVAL 1 DAY"), min_issues=1, min_sources=1)


@query("e16_feed_metrics", q.with_groups(f"""
select count(*) as topics, count(*) filter ({q.korea_date('latest_published_at')} = date '2024-01-31') as today,
  avg(impact) filter ({q.korea_date('latest_published_at')} = date '2024-01-31') as mean_impact from briefs where category = 'world'""", BRIEFS))
def feed_numbers(t):
    return S.feed_metrics(t.briefs()[0], t.as_of, "world")


@query("e17_weekly_stats", q.with_groups("""
select b.category, case when b.category = 'tech' then 7 else count(*) end::int as issue_count,
  case when b.category = 'tech' then 9 else sum(article_count) end::int as article_count,
  count(distinct s)::int as source_count, avg(impact) as mean_impact,
  case when b.category = 'tech' then 'Stored lead' else arg_min(title, (-impact, -epoch_us(latest_published_at), group_id)) end as top_title
from briefs b join (select category, unnest(string_split(source, ', ')) as s, group_id as gid from briefs) x on x.category = b.category and x.gid = b.group_id
group by b.category""".replace("count(*) end", "count(distinct group_id) end").replace("sum(article_count) end", "sum(article_count / len(string_split(source, ', '))) end")
    .replace("avg(impact) as", "sum(impact / len(string_split(source, ', '))) / count(distinct group_id) as"), BRIEFS))
def week_numbers(t):
    stored = t.spark.createDataFrame([("tech", 7, 9, "Stored lead"), ("economy", 0, 0, None)],
                                     "category string, issue_count int, article_count int, title string")
    return S.weekly_stats(t.briefs()[0], stored).withColumn("mean_impact", F.col("mean_impact"))


@query("j8_local_category_summary", q.with_groups("""
select category, category || '에서 ' || n || '개 이슈가 확인됐습니다. 현재 가장 주목도가 높은 이슈는 ' || top || '입니다.' as daily,
  '최근 7일 동안 ' || category || ' 카테고리에서는 ' || n || '개 이슈가 확인됐고, ' || s || '개 출처에서 관련 흐름이 포착됐습니다. 가장 주목도가 높은 흐름은 '
    || top || '입니다.' as weekly
from (select b.category, format('{:,}', count(*)) as n, any_value(s) as s, arg_min(title, (-impact, -epoch_us(latest_published_at), group_id)) as top
  from briefs b join (select category, count(distinct s) as s from (select category, unnest(string_split(source, ', ')) as s from briefs) group by 1) x
    using (category) group by b.category)""", BRIEFS))
def local_texts(t):
    briefs, _ = t.briefs()
    return local_category_summary(briefs).withColumnRenamed("summary", "daily").join(
        local_week_summary(briefs, "최근 7일").withColumnRenamed("summary", "weekly"), "category")


@query("b30_article_edits", q.with_articles("""
select id, case when doc_id % 10 = 0 then 'New  title' else title end as title, source,
  case when doc_id % 10 = 0 then '' when doc_id % 10 = 5 then 'Bold' else author end as author,
  case when doc_id % 10 = 5 then 'kept & short' else summary end as summary,
  case when doc_id % 10 = 5 then true else is_excluded end as is_excluded,
  case when doc_id % 5 = 0 then 1706659200 else floor(epoch(updated_at)) end::bigint as updated from articles"""))
def edited(t):
    d = F.col("doc_id")
    some = t.articles.filter(d % 5 == 0).select(
        "id", F.when(d % 10 == 0, F.lit(" New <b>title</b>")).otherwise(F.lit(" ")).alias("title"),
        F.lit("").alias("source"), F.when(d % 10 == 0, F.lit("")).otherwise(F.lit("<i>Bold</i>")).alias("author"),
        F.when(d % 10 == 5, F.lit("kept &amp; short")).alias("summary"), F.when(d % 10 == 5, F.lit(True)).alias("is_excluded"))
    out = E.apply_article_edits(t.articles, some, t.as_of)
    return out.select("id", "title", "source", "author", "summary", "is_excluded", epoch("updated_at").alias("updated"))


@query("b31_group_edits", q.with_groups("""
select group_id, case when relabelled then 'moved' when article_count > 2 then 'big' else category end as category,
  case when article_count > 2 then 'Renamed' else representative_title end as representative_title,
  case when article_count > 2 then '' else summary end as summary
from groups left join (select distinct group_id, true as relabelled from raw_members m join articles a on a.id = m.article_id
  where a.doc_id % 50 = 0 and group_id in (select group_id from groups)) using (group_id)"""))
def group_edits(t):
    groups, _ = t.groups()
    edits = groups.filter("article_count > 2").select(
        "group_id", F.lit("big").alias("category"), F.lit("Renamed").alias("representative_title"), F.lit("").alias("summary"))
    asked = t.articles.filter("doc_id % 50 = 0").select("id", F.lit("moved").alias("category"))
    out = E.relabel_by_article(E.apply_group_edits(groups, edits), t.members, asked)
    return out.select("group_id", "category", "representative_title", "summary")


@query("d13_prune_groups", q.with_groups(f"""
select g.group_id, g.category, count(*)::int as article_count, max(a.published_at) as latest_at, count(distinct a.source)::int as sources
from groups g join members m using (group_id) join articles a on a.id = m.article_id where a.doc_id % 4 <> 0 group by all""".replace(
    "max(a.published_at) as latest_at", f"{q.epoch('max(a.published_at)')} as latest")))
def pruned(t):
    groups, members = t.groups()
    now = t.articles.withColumn("is_excluded", F.col("is_excluded") | (F.col("doc_id") % 4 == 0))
    left, _ = E.prune_groups(groups, members, now)
    return left.select("group_id", "category", "article_count", epoch("latest_published_at").alias("latest"),
                       F.size("sources").alias("sources"))


# ---- summaries: external text, weeks, tracking ---------------------------------------------------------------
TOP_ROWS = (*R.UP_TO_ISSUES, R.KEPT, R.TOP)


@query("d12_merge_reply", q.with_groups("""
select strftime(t.period, '%Y-%m-%d') as date, t.place::int as place, t.title,
  case when t.period <= date '2024-01-15' and t.place = 1 then 'rewritten' when t.parts = 1 then t.summary else t.summary end as summary
from top_issues t""", *TOP_ROWS))
def replied(t):
    s = R.summaries_of(t).summaries
    title = F.lower(F.get("top_issues", 0)["title"])
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct(
        F.lit(" A headline ").alias("headline"), F.lit("").alias("summary"),
        F.array(F.struct(title.alias("title"), F.lit(" rewritten ").alias("summary")),
                F.struct(title.alias("title"), F.lit(" ").alias("summary"))).alias("topIssues"))), F.lit(" done"))
    replies = s.filter("date <= '2024-01-15'").select("date", reply.alias("reply"), F.lit("m").alias("model"))
    out = E.merge_reply(s, replies, "external", t.as_of)
    return out.select("date", F.posexplode("top_issues").alias("i", "x")).select(
        "date", (F.col("i") + 1).alias("place"), "x.title", "x.summary")


@query("b32_render_prompt", q.with_groups("""
select strftime(t.period, '%Y-%m-%d') as date, '요약 대상: 전날' || chr(10) || '기간 키: ' || strftime(t.period, '%Y-%m-%d') || chr(10) || '전체 이슈 수: ' || t.n_issues
  || chr(10) || '전체 기사 수: ' || t.n_articles || chr(10) || '전체 출처 수: ' || t.n_sources || chr(10) || chr(10) || '카테고리 분포:' || chr(10) || coalesce(shares, '')
  || chr(10) || chr(10) || '주요 이슈:' || chr(10) || coalesce(lines, '') as prompt
from (select period, count(distinct c.group_id) as n_issues, count(distinct m.article_id) as n_articles, count(distinct lower(m.source_name)) as n_sources
  from candidates c left join members m using (group_id) group by period) t
left join (select period, string_agg('- ' || category || ': 이슈 ' || issue_count || '건, 기사 ' || article_count || '건', chr(10) order by place) as shares
  from top_categories where place <= 8 group by period) s using (period)
left join (select period, string_agg(place || '. [' || category || '] ' || title || chr(10) || '기사수: ' || articles || ', 점수: ' || score || ', 출처: '
      || case when len(sources) = 0 then '출처 없음' else array_to_string(sources[1:4], ', ') end || chr(10) || '주요 키워드: '
      || case when len(keywords) = 0 then '키워드 없음' else array_to_string(keywords[1:8], ', ') end || chr(10) || '기존 요약: ' || summary || chr(10)
      || '근거 기사:' || chr(10) || coalesce(proof, '근거 기사 없음'), chr(10) || chr(10) order by place) as lines
  from top_issues left join (
    select period, place, string_agg('- 근거 ' || pos || ': ' || source || chr(10) || '  제목: ' || title || chr(10) || '  RSS 요약: ' || brief || chr(10)
        || '  본문 일부: ' || excerpt, chr(10) order by pos) as proof from prompt_evidence group by all) e using (period, place)
  where place <= 12 group by period) i using (period)""", *TOP_ROWS, R.TOP_ARTICLES, f"""
prompt_evidence as (
  select period, place, pos, {q.plain('source')} as source, {q.plain('title')} as title,
    {q.cut(q.cut(q.plain('summary'), 350), 350)} as brief, {q.cut(q.cut(q.plain('content'), 1000), 900)} as excerpt from (
    select x.period, x.place, a.*, row_number() over (partition by x.period, x.place
      order by {q.strip('a.content')} = '', a.published_at desc, a.id) as pos
    from (select distinct period, place, article_id from top_articles) x join articles a on a.id = x.article_id) where pos <= 2)"""))
def prompts(t):
    s = R.summaries_of(t)
    return render_prompt(s.summaries, s.evidence)


def weeks(t):
    ends = [("2024-01-07",), ("2024-01-14",), ("2024-01-21",), ("2024-01-28",), ("2024-02-04",), ("2024-03-03",)]
    return t.spark.createDataFrame(ends, "e string").select(F.to_date("e").alias("week_end"))


@query("g8_week_days", q.with_groups("""
select e as week_end, d::date as day, coalesce(n, 0)::int as issues from (
  select (date '2024-01-07' + (i * 7)::int)::date as e from (select unnest(range(5)) as i)) w, lateral (select unnest(generate_series(e - interval 6 days, e, interval 1 day)) as d) x
left join (select period, count(*) as n from candidates group by 1) c on c.period = d::date""", *R.BASE))
def spine(t):
    candidates, _, _ = R.candidate_parts(t)
    counts = candidates.groupBy("period").agg(F.count("*").cast("int").alias("issues"))
    return weekly.week_days(weeks(t).filter("week_end < '2024-02-10'")).join(
        counts, F.col("day") == F.col("period"), "left").select("week_end", "day", F.coalesce("issues", F.lit(0)).alias("issues"))


WEEK = """
week_rows as (
  select *, (period + (7 - isodow(period))::int)::date as week_end, lower(title) as k from top_issues
  where period between date '2024-01-01' and date '2024-02-04'),
week_sources as (
  select week_end, k, list(source order by period, place, i)[1:4] as sources from (
    select *, row_number() over (partition by week_end, k, lower(source) order by period, place, i) as n from (
      select week_end, k, period, place, unnest(sources) as source, unnest(range(len(sources))) as i from week_rows)) where n = 1 group by all),
week_words as (
  select week_end, k, lower(w) as lw, count(*) as n, arg_min(w, (period, place, i)) as w from (
    select week_end, k, period, place, unnest(keywords) as w, unnest(range(len(keywords))) as i from week_rows) where trim(w) <> '' group by all),
week_keywords as (
  select week_end, k, list(w order by n desc, w)[1:8] as keywords from week_words group by all),
week_articles as (
  select r.week_end, r.k, count(distinct a.article_id)::int as articles from week_rows r
  join top_articles a on a.period = r.period and a.place = r.place group by all),
week_issues as (
  select * from (
    select *, row_number() over (partition by week_end order by score desc, articles desc, k) as wplace from (
      select r.week_end, r.k, arg_min(title, (-r.score, -r.articles, r.period, r.place)) as title,
        arg_min(category, (-r.score, -r.articles, r.period, r.place)) as category, any_value(a.articles) as articles,
        arg_min(summary, (-r.score, -r.articles, r.period, r.place)) as summary, any_value(w.keywords) as keywords,
        least(100, max(r.score) + least(20, (count(*) - 1) * 5))::int as score, any_value(s.sources) as sources
      from week_rows r join week_articles a using (week_end, k) join week_sources s using (week_end, k)
        left join week_keywords w using (week_end, k) group by all)) where wplace <= 20),
week_categories as (
  select *, coalesce(lead || ' 이슈를 중심으로 ', category || ' 분야에서 ') || issue_count || '개 이슈와 ' || article_count || '개 기사가 확인됐습니다.' as text from (
    select c.*, row_number() over (partition by c.week_end order by issue_count desc, c.category) as place,
      (select arg_min(i.title, i.wplace) from week_issues i where i.week_end = c.week_end and i.category = c.category) as lead
    from (select (period + (7 - isodow(period))::int)::date as week_end, category, sum(issue_count)::int as issue_count,
        sum(article_count)::int as article_count from top_categories where period <= date '2024-02-04' group by all) c) where place <= 5)
"""
WEEK_PARTS = (*TOP_ROWS, R.TOP_ARTICLES, WEEK)


@query("e10_weekly_issues", q.with_groups("""
select week_end, wplace::int as place, title, category, articles as article_count, score, array_to_string(sources, '|') as sources,
  array_to_string(coalesce(keywords, []::varchar[]), '|') as keywords, summary from week_issues""", *WEEK_PARTS))
def week_issues(t):
    s = R.summaries_of(t)
    chosen = weekly.week_summaries(weeks(t), s.summaries)
    out = weekly.weekly_issues(weekly.daily_issue_rows(chosen), s.issue_articles)
    return out.select("week_end", "place", "title", "category", "article_count", "score", F.array_join("sources", "|").alias("sources"),
                      F.array_join("keywords", "|").alias("keywords"), "summary")


@query("e11_d9_j3_weekly_summaries", q.with_groups("""
select 'weekly:' || strftime(t.week_end - 6, '%Y-%m-%d') || ':' || strftime(t.week_end, '%Y-%m-%d') as date,
  strftime(t.week_end - 6, '%Y-%m-%d') || '~' || strftime(t.week_end, '%Y-%m-%d') || ' 주간 주요 이슈 ' || n_issues || '건' as headline,
  t.days || '개 일간 요약을 바탕으로 정리했습니다. ' || array_to_string(c.names[1:3], ', ') || ' 분야의 비중이 컸습니다. 가장 반복적으로 확인된 이슈는 '
    || first_title || '입니다.' as summary,
  t.issue_count, t.article_count, greatest(named, best_day)::int as source_count, array_to_string(c.texts, '|') as categories
from (select (period + (7 - isodow(period))::int)::date as week_end, count(*)::int as days, sum(issue_count)::int as issue_count,
    sum(article_count)::int as article_count, max(source_count) as best_day from (
      select period, count(distinct c.group_id)::int as issue_count, count(distinct m.article_id)::int as article_count,
        count(distinct lower(m.source_name))::int as source_count from candidates c left join members m using (group_id) group by period)
    where period <= date '2024-02-04' group by all) t
join (select week_end, count(*) as n_issues, arg_min(title, wplace) as first_title from week_issues group by all) i using (week_end)
join (select week_end, count(distinct s) as named from (select week_end, unnest(sources) as s from week_issues) group by all) s using (week_end)
join (select week_end, list(category order by place) as names, list(text order by place) as texts from week_categories group by all) c using (week_end)
union all
select 'weekly:2024-02-26:2024-03-03', '2024-02-26~2024-03-03 주간 요약 준비 중', '해당 주간에 생성된 일간 요약이 아직 없습니다.', 0, 0, 0, ''""", *WEEK_PARTS))
def week_summaries(t):
    s = R.summaries_of(t)
    out = weekly.weekly_summaries(weeks(t), s.summaries, s.issue_articles, t.as_of)
    return out.select("date", "headline", "summary", "issue_count", "article_count", "source_count",
                      F.array_join(F.transform("categories", lambda c: c["summary"]), "|").alias("categories"))


@query("j4_plan_summaries", """
with d as (select distinct ts::date as day from events),
k as (select strftime(day, '%Y-%m-%d') as key, day(day) % 3 as m, false as weekly from d
  union all select 'weekly:' || strftime(day - 6, '%Y-%m-%d') || ':' || strftime(day, '%Y-%m-%d'), day(day) % 3, true from d)
select key, case when m = 0 then false when weekly then m = 1 else m = 2 end as reuse from k""")
def planned(t):
    days = t.event_log.select(F.to_date(F.convert_timezone(None, F.lit("UTC"), F.col("created_at").cast("timestamp_ntz"))).alias("d")).distinct()
    keys = days.select(day_key(F.col("d")).alias("key"), "d").unionByName(
        days.select(weekly_key(F.date_sub("d", 6), F.col("d")).alias("key"), "d"))
    stored = keys.filter("day(d) % 3 <> 0").select(
        F.col("key").alias("date"), F.when(F.expr("day(d) % 3 = 1"), "local").otherwise("external").alias("provider"))
    return weekly.plan_summaries(keys.select("key"), stored, external="external")


def tracked_inputs(t):
    """Issues of the daily summaries, cut loose from their articles for every third, with a title to find them by."""
    s = R.summaries_of(t)
    briefs, shown = t.briefs()
    rows = s.summaries.select("date", F.posexplode("top_issues").alias("i", "x")).select(
        F.concat_ws("#", "date", (F.col("i") + 1).cast("string")).alias("issue_key"), (F.col("i") + 1).alias("place"), "date", "x.*")
    linked = s.issue_articles.filter("place % 3 <> 0").select(
        F.concat_ws("#", "date", F.col("place").cast("string")).alias("issue_key"), "article_id")
    return rows, linked, briefs, shown


@query("d10_track_by_ids", q.with_groups("""
select distinct strftime(t.period, '%Y-%m-%d') || '#' || t.place as issue_key, m.group_id
from top_articles t join members m using (article_id) where t.place % 3 <> 0""", *TOP_ROWS, R.TOP_ARTICLES))
def tracked_by_ids(t):
    _, linked, _, shown = tracked_inputs(t)
    return T.track_by_ids(linked, shown)


def normal(x):
    return f"lower({q.strip(f"regexp_replace(regexp_replace({x}, {q.SPACES}, ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', '', 'g')")})"


TITLE_MATCH = f"""
wanted as (
  select strftime(period, '%Y-%m-%d') || '#' || place as issue_key,
    case when place % 2 = 0 then 'tech' else category end as category,
    case when place % 3 = 0 then {normal("split_part(title, ' ', 1) || ' ' || split_part(title, ' ', 2)")} else {normal('title')} end as t
  from top_issues),
found as (select group_id, category as bc, {normal('title')} as bt, latest_published_at from briefs),
matches as (
  select issue_key, group_id, latest_published_at, case when t = bt and category = bc then 1 when t = bt then 2 else 3 end as rule
  from wanted join found on t = bt or (category = bc and t <> '' and (contains(bt, t) or contains(t, bt))))
"""


@query("d11_track_by_title", q.with_groups("""
select issue_key, arg_min(group_id, (rule, -epoch_us(latest_published_at), group_id)) as group_id from matches group by 1""",
    *TOP_ROWS, BRIEFS, TITLE_MATCH))
def tracked_by_title(t):
    rows, _, briefs, _ = tracked_inputs(t)
    first_two = F.substring_index("title", " ", 2)
    issues = rows.select("issue_key", F.when(F.col("place") % 2 == 0, "tech").otherwise(F.col("category")).alias("category"),
                         F.when(F.col("place") % 3 == 0, first_two).otherwise(F.col("title")).alias("title"))
    return T.track_by_title(issues, briefs)


@query("e18_j9_tracked_issues", q.with_groups(f"""
select issue_key, any_value(title) as title, any_value(category) as category, any_value(articles) as article_count,
  count(distinct url)::int as link_count, list_sort(list(distinct p)) as publishers, list_sort(list(distinct url)) as urls from (
  select strftime(t.period, '%Y-%m-%d') || '#' || t.place as issue_key, t.title, t.category, t.articles, u.url, unnest(b.publishers) as p
  from top_issues t join (select distinct period, place, group_id from top_articles join members using (article_id)) x using (period, place)
  join briefs b on b.group_id = x.group_id, lateral (select unnest(b.links).url as url) u where t.place % 3 <> 0) group by 1
union all
select issue_key, b.title, b.category, b.article_count, len(links)::int, list_sort(publishers),
  list_sort(list_transform(links, lambda l: l.url))
from (select issue_key, arg_min(group_id, (rule, -epoch_us(latest_published_at), group_id)) as group_id
      from (select strftime(period, '%Y-%m-%d') || '#' || place as issue_key, group_id, b.latest_published_at,
              case when {normal("t.title")} <> {normal("b.title")} then 3 when t.category = b.category then 1 else 2 end as rule
            from top_issues t join briefs b on {normal("t.title")} = {normal("b.title")} or (t.category = b.category
              and {normal("t.title")} <> '' and (contains({normal("b.title")}, {normal("t.title")}) or contains({normal("t.title")}, {normal("b.title")})))
            where place % 3 = 0) group by 1)
join briefs b using (group_id)""", *TOP_ROWS, R.TOP_ARTICLES, BRIEFS))
def tracked(t):
    rows, _, briefs, shown = tracked_inputs(t)
    every = R.summaries_of(t).issue_articles.filter("place % 3 <> 0").select(
        F.concat_ws("#", "date", F.col("place").cast("string")).alias("issue_key"), "article_id")
    merged, _ = T.tracked_issues(rows.drop("date", "place"), every, briefs, shown)
    return merged.select("issue_key", "title", "category", "article_count", "link_count", F.array_sort("publishers").alias("publishers"),
                         F.array_sort(F.transform("related_links", lambda l: l["url"])).alias("urls"))


