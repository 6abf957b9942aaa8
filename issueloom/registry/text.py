"""Scalar text, URL, date and score queries."""

from pyspark.sql import functions as F

from issueloom.functions import dates, html, narrative, signals, text, urls
from issueloom.operators.search import content_status
from issueloom.registry import sql as q
from issueloom.registry.base import epoch, query

PAGE = q.clean("html")


@query("b1_clean_text", f"select page_id, {PAGE} as cleaned from pages")
def clean_pages(t):
    return t.pages.select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("b2_normalize_text",
       f"select page_id, {q.strip(f'regexp_replace({PAGE}, {q.SPACES}, chr(32), chr(103))')} as normal from pages")
def normalize_pages(t):
    return t.pages.select("page_id", text.normalize_text(F.col("html")).alias("normal"))


DOC = q.plain("text")


@query("b3_compact", f"""
select doc_id, {q.cut('c', 350)} as c350, {q.cut('c', 900)} as c900, {q.cut('c', 1000)} as c1000,
  {q.cut('c', 2500)} as c2500 from (select doc_id, {DOC} as c from documents)""")
def compact_documents(t):
    return t.read("documents").select(
        "doc_id", *[text.compact(F.col("text"), n).alias(f"c{n}") for n in (350, 900, 1000, 2500)])


@query("b4_preview", f"""
select doc_id, case when length(c) > 180 then {q.strip('substr(c, 1, 180)')} || '...' else c end as p180,
  case when length(c) > 220 then {q.strip('substr(c, 1, 220)')} || '...' else c end as p220
from (select doc_id, {DOC} as c from documents)""")
def preview_documents(t):
    return t.read("documents").select(
        "doc_id", *[text.preview(F.col("text"), n).alias(f"p{n}") for n in (180, 220)])


@query("b5_compact_display", f"""
select doc_id, case when length(c) > 260 then rtrim(substr(c, 1, 260), {q.WS} || ',.·-') || '...' else c end as shown
from (select doc_id, {q.strip(f"regexp_replace(text, {q.SPACES}, ' ', 'g')")} as c from documents)""")
def compact_display_documents(t):
    return t.read("documents").select("doc_id", text.compact_display(F.col("text")).alias("shown"))


@query("b6_article_id", "select page_id, sha256(url) as article_id from pages")
def article_ids(t):
    return t.pages.select("page_id", F.sha2("url", 256).alias("article_id"))


@query("b7_published_at", """
select event_id, case when event_id % 4 = 3 then 1706659200 else epoch(date_trunc('second', ts))::bigint end as published
from events""")
def published(t):
    """The event times written out as RFC 822, ISO and junk, and read back."""
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "E, d MMM yyyy HH:mm:ss 'GMT'"))
        .when(F.col("event_id") % 4 == 1, F.concat(local, F.lit("Z")))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", "dd MMM yyyy HH:mm:ss '+0000'"))
        .otherwise(F.lit("yesterday"))
    )
    as_of = F.timestamp_seconds(F.lit(1706659200))
    return (t.read("events").select("event_id", dates.published_at(raw, as_of).alias("at"))
            .select("event_id", epoch("at").alias("published")))


@query("b9_absolute_url", """
with b as (select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme,
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as site, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path
  from pages)
select page_id, scheme || '://' || site || '/img/a.png' as rooted,
  scheme || '://' || site || regexp_replace(path, '[^/]*$', '') || 'b.png' as relative,
  scheme || '://' || site || '/y.png' as above, scheme || '://' || site || '/a/f.png?q=../z' as deep,
  scheme || '://' || site || regexp_replace(path, '[^/]*$', '') || 'e/' as open_end,
  scheme || '://cdn.example/c.png' as schemeless, 'https://cdn.example/d.png' as full, '' as refused from b""")
def resolved(t):
    refs = dict(rooted="/img/a.png", relative="b.png", above="../" * 12 + "y.png",
                deep="/a/b/c/d/./e/../../../.././f.png?q=../z", open_end="e/g/..", schemeless="//cdn.example/c.png",
                full="https://cdn.example/d.png", refused="javascript:void(0)")
    return t.pages.select("page_id", *[urls.absolute_url(F.col("url"), F.lit(r)).alias(n) for n, r in refs.items()])


@query("b10_safe_url", """
select page_id, case when page_id % 3 = 0 then '' else url end as safe from pages""")
def safe(t):
    broken = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?:", "ftp:")).otherwise(F.col("url"))
    return t.pages.select("page_id", urls.safe_url(broken).alias("safe"))


@query("b11_publisher", f"""
select page_id, {q.publisher('url')} as page_publisher,
  case page_id % 3 when 0 then '연합뉴스' when 1 then 'BBC' else '알 수 없음' end as feed_publisher from pages""")
def publishers(t):
    feed = (F.when(F.col("page_id") % 3 == 0, F.lit("https://www.yna.co.kr/rss/news.xml"))
            .when(F.col("page_id") % 3 == 1, F.lit("http://feeds.bbci.co.uk/news/rss.xml")).otherwise(F.lit("no url")))
    return t.pages.select("page_id", urls.publisher(F.col("url")).alias("page_publisher"),
                          urls.publisher(feed).alias("feed_publisher"))


HOST_LABEL = "upper(split_part(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', ''), '.', 1))"


@query("b12_source_from_url", f"select page_id, {HOST_LABEL} as label from pages")
def source_labels(t):
    return t.pages.select("page_id", urls.source_from_url(F.col("url")).alias("label"))


@query("b13_display_source", f"""
select page_id, case page_id % 4 when 0 then p when 1 then p || ' · 속보' when 2 then p || ' wire' else 'Other' end as shown
from (select page_id, {HOST_LABEL} as p from pages)""")
def display_sources(t):
    label = urls.source_from_url(F.col("url"))
    source = (F.when(F.col("page_id") % 4 == 0, F.lit(" ")).when(F.col("page_id") % 4 == 1, F.lit("속보"))
              .when(F.col("page_id") % 4 == 2, F.concat(label, F.lit(" wire"))).otherwise(F.lit("Other")))
    return t.pages.select("page_id", urls.display_source(source, F.col("url")).alias("shown"))


@query("b14_duplicate_key", q.with_articles(f"select doc_id, {q.DUP_KEY} as dup_key from articles"))
def duplicate_keys(t):
    return t.articles.select("doc_id", text.duplicate_key(*map(F.col, ("source", "title", "author"))).alias("dup_key"))


@query("b15_normalize_title", f"""
select doc_id, lower({q.strip(f"regexp_replace(regexp_replace(text, {q.SPACES}, ' ', 'g'), '[^\\p{{L}}\\p{{N}} ]', '', 'g')")})
  as normal from documents""")
def normal_titles(t):
    return t.read("documents").select("doc_id", text.normalize_title(F.col("text")).alias("normal"))


@query("b16_b17_impact_heat", f"""
select event_id, {q.impact('a', 's', "event_type = 'view'")} as impact,
  case when {q.impact('a', 's', "event_type = 'view'")} >= 80 then 'hot' else 'normal' end as heat
from (select event_id, event_type, (user_id % 30)::int as a, (event_id % 7)::int as s from events)""")
def impacts(t):
    a, s = (F.col("user_id") % 30).cast("int"), (F.col("event_id") % 7).cast("int")
    score = signals.impact(a, s, F.col("event_type") == "view")
    return t.read("events").select("event_id", score.alias("impact"), signals.heat(score).alias("heat"))


@query("b18_low_value", """
select doc_id, doc_id % 5 in (0, 1, 2) as low from documents""")
def low_values(t):
    d = F.col("doc_id") % 5
    title = (F.when(d == 0, F.concat(F.lit("[포토] "), "lang")).when(d == 1, F.concat(F.col("lang"), F.lit(" 화보")))
             .otherwise(F.col("lang")))
    source = F.when(d == 2, F.lit("ET포토")).otherwise(F.col("source"))
    return t.read("documents").select("doc_id", signals.is_low_value(title, F.array(source)).alias("low"))


@query("b19_minutes_since", """
select event_id, greatest(1, case when m - floor(m) = 0.5 then 2 * round(m / 2) else round(m) end)::int as minutes
from (select event_id, (1706659200::bigint * 1000000 - epoch_us(ts)) / 1e6 / 60 as m from events)""")
def minutes(t):
    created = t.event_log
    return created.select(
        "event_id", dates.minutes_since(F.col("created_at"), F.timestamp_seconds(F.lit(1706659200))).alias("minutes"))


@query("b21_korea_dates", f"""
select event_id, {q.korea_date('ts')} as day, {q.korea_date('ts')} - 1 as yesterday,
  {q.korea_date('ts')} - isodow({q.korea_date('ts')})::int as week_end from events""")
def korea_dates(t):
    at = F.col("created_at")
    return t.event_log.select("event_id", dates.korea_date(at).alias("day"), dates.korea_yesterday(at).alias("yesterday"),
                              dates.last_week_end(at).alias("week_end"))


@query("b22_weekly_key", f"""
select event_id, 'weekly:' || strftime(e - 6, '%Y-%m-%d') || ':' || strftime(e, '%Y-%m-%d') as key,
  e - 6 as week_start, e as week_end
from (select event_id, ({q.korea_date('ts')} - isodow({q.korea_date('ts')})::int)::date as e from events)""")
def weekly_keys(t):
    end = dates.last_week_end(F.col("created_at"))
    keyed = t.event_log.select("event_id", dates.weekly_key(F.date_sub(end, 6), end).alias("key"))
    return keyed.select("event_id", "key", dates.parse_weekly_key(F.col("key")).alias("r")).select(
        "event_id", "key", F.col("r.start").alias("week_start"), F.col("r.end").alias("week_end"))


@query("b23_content_status", q.with_articles(
    "select doc_id, case when trim(content_fetch_status) = '' then 'pending' else content_fetch_status end as status "
    "from articles"))
def statuses(t):
    return t.articles.select("doc_id", content_status(F.col("content_fetch_status")).alias("status"))


@query("b24_best_summary", q.with_articles("""
select doc_id, case when doc_id % 12 = 0 then '3 related articles were detected in this issue group.'
    when doc_id % 6 = 0 then summary else substr(content, 1, 900) end as brief,
  case when doc_id % 12 = 0 then null when doc_id % 6 = 0 then summary else substr(content, 1, 700) end as seed
from articles"""))
def best_summaries(t):
    d = F.col("doc_id")
    body = F.when(d % 12 == 0, F.lit(None)).when(d % 6 == 0, F.lit(" ")).otherwise(F.col("content"))
    feed = F.when(d % 12 != 0, F.col("summary"))
    return t.articles.select("doc_id", narrative.seed_summary(body, feed).alias("seed"),
                             narrative.brief_summary(body, feed, F.lit(3)).alias("brief"))


@query("b26_title_keywords", q.with_articles(
    "select doc_id, list_filter(string_split(title, ' '), lambda w: length(w) >= 2)[1:4] as keywords from articles"))
def title_words(t):
    return t.articles.select("doc_id", text.title_keywords(F.col("title")).alias("keywords"))


ADMIT = """case when page_id % 8 = 0 then 'bad_url' when page_id % 8 <= 4 then 'unsafe' else 'ok' end"""


@query("c6_url_admission", f"select page_id, {ADMIT} as verdict from pages")
def admissions(t):
    k = F.col("page_id") % 8
    tail = F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1)
    url = (
        F.when(k == 0, F.concat(F.lit("mailto:"), "url")).when(k == 1, F.concat(F.lit("http://127.0.0.1:8080"), tail))
        .when(k == 2, F.concat(F.lit("https://user:pw@news.example"), tail))
        .when(k == 3, F.concat(F.lit("https://printer.LOCAL"), tail))
        .when(k == 4, F.concat(F.lit("http://172.20.1.9"), tail)).when(k == 5, F.concat(F.lit("http://172.32.1.9"), tail))
        .otherwise(F.col("url"))
    )
    return t.pages.select("page_id", urls.url_admission(url).alias("verdict"))


@query("h1_tokens", f"select doc_id, {q.tokens('text')} as tokens from documents")
def token_lists(t):
    return t.read("documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))


BODY_SQL = f"""
with stripped as (
  select page_id, regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>',
    '', 'gs') as h from pages),
parts as (
  select page_id, unnest(regexp_extract_all(h, '<article[^>]*>(.*)</article>', 1, 's')) as part, 0 as min_len from stripped),
texts as (
  select page_id, {q.strip(f"regexp_replace({q.decoded("regexp_replace(part, '<[^>]*>', '', 'g')")}, {q.SPACES}, ' ', 'g')")} as body
  from parts)
select page_id, substr(max_by(body, length(body)), 1, 12000) as body from texts group by page_id"""


#: Markup put behind the article of a page, by page_id modulo 5, with the text that must come out of it.
LONG = " ".join(["line"] * 6000)
DECOY = LONG[:6000]
NESTED = {
    1: (f'<div class="article-body"><div>cap</div>{LONG}<div><div>x</div></div> end</div>', f"cap{LONG}x end"),
    2: (f'<section><article>a<article>b</article>{LONG}</article></section>', f"ab{LONG}"),
    3: (f'<div id="dic_area"><div><p>q</p></div><br/>{LONG}', f"q{LONG}"),
    # no container by these attributes, and none inside a comment, a script or a menu
    4: (f'<div data-class="article-body">{DECOY}</div><!--<article>{DECOY}</article>--><nav><article>{DECOY}</article></nav>'
        f'<script>"<article>{DECOY}</article>"</script>', None),
}


@query("h5_extract_body", f"""
with base as ({BODY_SQL})
select page_id, case page_id % 5 {" ".join(f"when {k} then substr('{want}', 1, 12000)" for k, (_, want) in NESTED.items() if want)}
  else body end as body from base""")
def bodies(t):
    more = F.lit("")
    for k, (markup, _) in NESTED.items():
        more = F.when(F.col("page_id") % 5 == k, F.lit(markup)).otherwise(more)
    return t.pages.select("page_id", html.extract_body(F.concat("html", more)).alias("body"))
