"""Keywords, roll-ups, issues and daily summaries."""

from pyspark.sql import Window, functions as F

from issueloom.functions import signals
from issueloom.functions.dates import korea_date
from issueloom.functions.text import tokens
from issueloom.operators import issues as I
from issueloom.operators import keywords as K
from issueloom.operators import rollup as R
from issueloom.operators.categorize import article_category
from issueloom.operators.dedupe import effective_articles
from issueloom.operators.grouping import finalize_groups
from issueloom.plans import daily
from issueloom.plans.incremental import day_states, refresh
from issueloom.registry import sql as q
from issueloom.registry.base import epoch, query
from issueloom.rules import TOPIC_RULES
from issueloom.session import materialize
from issueloom.sources.tables import LATIN_CATEGORY_RULES

KEYWORDS = f"""
texts as (
  select group_id, {q.plain('representative_title')} as t, 4 as w from groups union all
  select group_id, {q.plain('seed_title')}, 3 from groups union all
  select group_id, {q.plain('summary')}, 2 from groups union all
  select m.group_id, {q.plain('a.title')}, 3 from members m join articles a on a.id = m.article_id where pos <= 8 union all
  select m.group_id, {q.plain('a.summary')}, 2 from members m join articles a on a.id = m.article_id where pos <= 8 union all
  select m.group_id, {q.cut(q.plain('a.content'), 2500)}, 1 from members m join articles a on a.id = m.article_id where pos <= 8),
weights as materialized (
  select group_id, keyword, sum(w)::int as weight from (select group_id, w, unnest({q.tokens('t')}) as keyword from texts)
  where {q.keyword_ok('keyword')} group by all),
top8 as (
  select group_id, list(keyword order by weight desc, keyword) as keywords from (
    select *, row_number() over (partition by group_id order by weight desc, keyword) as k from weights) where k <= 8
  group by group_id)
"""

CANDIDATES = f"""
labelled as (
  select g.*, {q.korea_date('latest_published_at')} as period, coalesce(t.keywords, []::varchar[]) as keywords,
    len(g.sources)::int as n_sources from groups g left join top8 t using (group_id)),
distribution as (
  select period, category, keyword, sum(weight)::int as total from weights join labelled using (group_id) group by all),
keyword_scores as (
  select l.period, l.group_id, sum(d.total)::int as keyword_score from (
    select period, category, group_id, unnest(keywords[1:6]) as keyword from labelled) l
  join distribution d using (period, category, keyword) group by all),
candidates as materialized (
  select *, (score + least(40, case when r - floor(r) = 0.5 then 2 * round(r / 2) else round(r) end)::int
      + least(20, n_sources * 4) + least(15, article_count * 2))::int as selection_score,
    row_number() over (partition by period order by score desc, article_count desc, latest_published_at desc, group_id) - 1 as idx
  from (
    select l.*, coalesce(k.keyword_score, 0) as keyword_score, sqrt(coalesce(k.keyword_score, 0)::double) * 4 as r,
      {q.low_value("l.representative_title || ' ' || l.seed_title", "array_to_string(l.sources, ' ')")} as is_low
    from labelled l left join keyword_scores k using (period, group_id)))
"""

PAIRS = f"""
paired as (
  select group_id, list_sort(list(keyword order by weight desc, keyword)[1:8]) as ks from (
    select *, row_number() over (partition by group_id order by weight desc, keyword) as k from weights
    where {q.rollup_ok('keyword')}) where k <= 12 group by group_id),
pair_rows as (
  select c.period, c.group_id, c.idx, a.k as k1, b.k as k2 from candidates c
  join (select group_id, unnest(ks) as k from paired) a using (group_id)
  join (select group_id, unnest(ks) as k from paired) b using (group_id) where a.k < b.k)
"""

COMPONENTS = """
totals as (select period, count(*)::int as total from candidates group by period),
postings as (
  select period, k1, k2, list_sort(list(group_id)) as members, min(idx) as first_idx from pair_rows group by all),
components as (
  select p.period, members, min((k1, k2)) as pair, any_value(first_idx) as first_idx, any_value(total) as total
  from postings p join totals t using (period)
  where len(members) >= 3 and len(members) <= least(300, greatest(30, total // 8)) group by p.period, members),
member_rows as (
  select period, sha256(array_to_string(members, ',')) as component, unnest(members) as group_id, pair, first_idx, total
  from components),
prioritised as (
  select r.period, r.component, any_value(r.total) as total, any_value(r.pair) as pair, any_value(r.first_idx) as first_idx,
    count(distinct r.group_id) as n, max(c.selection_score) as best, count(distinct m.article_id) as a,
    (select count(distinct lower(s)) from (select unnest(flatten(list(c.sources))) as s)) as s
  from member_rows r join candidates c using (period, group_id) left join members m on m.group_id = r.group_id
  group by r.period, r.component),
turns as materialized (
  select *, (least(600, n * 6) + least(200, a * 2) + least(120, s * 12) + least(120, best))::int as priority,
    row_number() over (partition by period
      order by least(600, n * 6) + least(200, a * 2) + least(120, s * 12) + least(120, best) desc, first_idx, pair) as turn
  from prioritised)
"""

# component by component in turn: what is free decides
ROLLUPS = """
facts as (
  select c.period, c.group_id, c.is_low, list(distinct m.article_id) filter (m.article_id is not null) as arts,
    any_value(c.sources) as srcs
  from candidates c left join members m using (group_id) group by all),
rollup_scan(period, step, taken, won) as (
  select distinct period, 0::bigint, []::varchar[], []::varchar[] from turns
  union all
  select s.period, s.step + 1,
    case when ok then list_concat(s.taken, free) else s.taken end,
    case when ok then list_concat(s.won, list_transform(free, lambda g: component || ':' || g)) else s.won end
  from (
    select s.period, s.step, s.taken, s.won, t.component,
      list(f.group_id) filter (not list_contains(s.taken, f.group_id)) as free,
      count(*) filter (not list_contains(s.taken, f.group_id)) >= 3
      and count(*) filter (not list_contains(s.taken, f.group_id)) <= greatest(250, any_value(t.total) // 8)
      and not bool_and(f.is_low) filter (not list_contains(s.taken, f.group_id))
      and (count(*) filter (not list_contains(s.taken, f.group_id)) >= 5
        or len(list_distinct(flatten(list(f.arts) filter (not list_contains(s.taken, f.group_id))))) >= 5
        or len(list_distinct(flatten(list(f.srcs) filter (not list_contains(s.taken, f.group_id))))) >= 3) as ok
    from rollup_scan s join turns t on t.period = s.period and t.turn = s.step + 1
    join member_rows r on r.period = t.period and r.component = t.component
    join facts f on f.period = r.period and f.group_id = r.group_id
    group by s.period, s.step, s.taken, s.won, t.component) s),
merged as materialized (
  select period, split_part(w, ':', 1) as component, split_part(w, ':', 2) as group_id from (
    select period, unnest(arg_max(won, step)) as w from rollup_scan group by period))
"""

ISSUES = f"""
merged_rows as (select m.component, c.* from merged m join candidates c using (period, group_id)),
merged_lead as (
  select period, component, arg_min(representative_title, (is_low, -selection_score, -n_sources, -article_count,
      -epoch_us(latest_published_at), group_id)) as title,
    arg_min(selection_score, (is_low, -selection_score, -n_sources, -article_count, -epoch_us(latest_published_at), group_id)) as lead_score,
    count(*)::int as parts, max(latest_published_at) as latest_published_at, bool_and(is_low) as is_low
  from merged_rows group by all),
merged_category as (
  select period, component, arg_min(category, (-w, -n, category)) as category from (
    select period, component, category, sum(selection_score) as w, count(*) as n from merged_rows group by all) group by all),
merged_sources as (
  select period, component, list(source order by idx, pos) as sources from (
    select *, row_number() over (partition by period, component, lower(source) order by idx, pos) as k from (
      select period, component, idx, unnest(sources) as source, unnest(range(len(sources))) as pos from merged_rows))
  where k = 1 group by all),
merged_articles as (
  select r.period, r.component, count(distinct m.article_id)::int as article_count
  from merged_rows r join members m using (group_id) group by all),
merged_keywords as (
  select period, component, list(keyword order by weight desc, keyword)[1:8] as keywords from (
    select period, component, keyword, sum(weight) as weight from merged_rows join weights using (group_id)
    where {q.rollup_ok('keyword')} group by all) group by all),
issues as materialized (
  select period, group_id as issue_id, {q.plain('representative_title')} as title, category, {q.plain('summary')} as summary,
    article_count as articles, sources[1:4] as sources, n_sources as source_count, score, selection_score, keywords,
    latest_published_at, is_low, 1 as parts
  from candidates where (period, group_id) not in (select period, group_id from merged)
  union all
  select l.period, l.component, {q.plain('l.title')}, c.category,
    {q.plain('l.title')} || '을 포함해 같은 사건 흐름으로 보이는 ' || l.parts || '개 이슈가 함께 확인됐습니다. '
      || case when len(coalesce(k.keywords, [])) = 0 then '반복 키워드는 아직 충분하지 않습니다'
         else '반복 키워드는 ' || array_to_string(k.keywords[1:6], ', ') || '입니다' end || '.',
    a.article_count, s.sources[1:4], len(s.sources)::int,
    least(100, {q.impact('a.article_count', 'len(s.sources)', q.low_value('l.title', "array_to_string(s.sources, ' ')"))}
      + least(20, (l.parts - 1) * 3))::int,
    (l.lead_score + least(120, l.parts * 6) + least(80, a.article_count * 2) + least(60, len(s.sources) * 8))::int,
    coalesce(k.keywords, []), l.latest_published_at, l.is_low, l.parts
  from merged_lead l join merged_category c using (period, component) join merged_sources s using (period, component)
  join merged_articles a using (period, component) left join merged_keywords k using (period, component))
"""

SUBJECTS, EVENTS = TOPIC_RULES[0][1], TOPIC_RULES[0][2]


def any_word(x, words):
    return "(" + " or ".join(f"contains({x}, {q.lit(w)})" for w in words) + ")"


KEPT = f"""
issue_texts as (
  select *, title || ' ' || summary || ' ' || array_to_string(keywords, ' ') as text,
    row_number() over (partition by period order by is_low, parts > 1 desc, parts desc, selection_score desc, len(sources) desc,
      articles desc, latest_published_at desc, issue_id) as rank from issues),
issue_words as (
  select period, issue_id, rank, list_distinct(list_filter({q.tokens('text')}, lambda k: {q.rollup_ok('k')})) as words,
    {any_word('text', SUBJECTS)} and {any_word('text', EVENTS)} as topic from issue_texts),
alike as materialized (
  select a.period, a.issue_id as later, b.issue_id as earlier from issue_words a join issue_words b
    on a.period = b.period and b.rank < a.rank
  where (a.topic and b.topic) or len(list_intersect(a.words, b.words)) >= 4
    or len(list_filter(list_intersect(a.words, b.words), lambda w: length(w) >= 4)) >= 2),
issue_scan(period, step, kept) as (
  select distinct period, 0::bigint, []::varchar[] from issue_words
  union all
  select s.period, s.step + 1, case when exists (
      select 1 from alike p where p.period = s.period and p.later = v.issue_id and list_contains(s.kept, p.earlier))
    then s.kept else list_append(s.kept, v.issue_id) end
  from issue_scan s join issue_words v on v.period = s.period and v.rank = s.step + 1),
kept as materialized (
  select * from issues where (period, issue_id) in (
    select (period, issue_id) from (select period, unnest(arg_max(kept, step)) as issue_id from issue_scan group by period)))
"""

TOP = """
top_categories as (
  select * from (
    select *, row_number() over (partition by period order by issue_count desc, category) as place from (
      select period, category, count(distinct group_id)::int as issue_count, count(distinct article_id)::int as article_count
      from candidates left join members using (group_id) group by all)) where place <= 5),
category_leads as (
  select t.*, coalesce(i.title, c.title) as lead_title, coalesce(i.keywords, c.keywords) as lead_keywords
  from top_categories t
  left join (select period, category, arg_min(title, (is_low, -selection_score, -len(sources), -articles,
      -epoch_us(latest_published_at), issue_id)) as title,
    arg_min(keywords, (is_low, -selection_score, -len(sources), -articles, -epoch_us(latest_published_at), issue_id)) as keywords
    from kept group by all) i using (period, category)
  left join (select period, category, arg_min(representative_title, (is_low, -selection_score, -n_sources, -article_count,
      -epoch_us(latest_published_at), group_id)) as title,
    arg_min(keywords, (is_low, -selection_score, -n_sources, -article_count, -epoch_us(latest_published_at), group_id)) as keywords
    from candidates group by all) c using (period, category)),
top_issues as (
  select * from (
    select *, row_number() over (partition by period order by category_issues desc, is_low, selection_score desc,
        len(sources) desc, articles desc, latest_published_at desc, issue_id) as place from (
      select k.*, coalesce(t.issue_count, 0) as category_issues, row_number() over (partition by k.period, k.category
          order by is_low, selection_score desc, len(sources) desc, articles desc, latest_published_at desc, issue_id) as n
      from kept k left join top_categories t using (period, category)) where n <= 4) where place <= 20)
"""

BASE = (KEYWORDS, CANDIDATES)
UP_TO_ISSUES = (*BASE, PAIRS, COMPONENTS, ROLLUPS, ISSUES)


def candidate_parts(t):
    return t.candidates()


def issue_parts(t):
    return t.issues()


@query("e1_e2_effective_scores", q.with_groups(f"""
select group_id, article_count as articles, len(sources)::int as sources, score as effective_score from groups"""))
def effective_scores(t):
    return I.effective_scores(t.groups()[0], t.effective()).select(
        "group_id", F.col("effective_articles").alias("articles"), F.col("effective_sources").alias("sources"),
        "effective_score")


@query("e3_period_totals", q.with_groups("""
select period, count(distinct c.group_id)::int as issue_count, count(distinct m.article_id)::int as article_count,
  count(distinct lower(m.source_name))::int as source_count from candidates c left join members m using (group_id) group by period""", *BASE))
def totals(t):
    candidates, effective, _ = candidate_parts(t)
    return I.period_totals(candidates, effective)


@query("e4_category_counts", q.with_groups("""
select period, category, count(distinct c.group_id)::int as issue_count, count(distinct m.article_id)::int as article_count
from candidates c left join members m using (group_id) group by all""", *BASE))
def category_counts(t):
    candidates, effective, _ = candidate_parts(t)
    return I.category_counts(candidates, effective)


@query("e5_keyword_distribution", q.with_groups("select * from distribution", *BASE))
def distribution(t):
    candidates, _, weights = candidate_parts(t)
    return K.keyword_distribution(weights, candidates)


@query("e6_c7_keyword_weights", q.with_groups("select * from weights", KEYWORDS))
def weights(t):
    return K.keyword_weights(t.groups()[0], t.effective(), t.articles)


@query("c8_rollup_keywords", f"""
select doc_id, list_distinct(list_filter({q.tokens('text')}, lambda k: {q.rollup_ok('k')})).list_sort() as keywords from documents""")
def rollup_words(t):
    return t.read("documents").select(
        "doc_id", F.array_sort(K.rollup_keywords_of(tokens(F.col("text")))).alias("keywords"))


@query("c9_topic_match", f"""
select doc_id, {any_word('lower(text)', ['the ', 'que', 'und'])} and {any_word('lower(text)', ['tion', 'eaux'])} as matched from documents""")
def topics(t):
    return t.read("documents").select("doc_id", I.topic_match(
        F.col("text"), ["the ", "que", "und"], ["tion", "eaux"]).alias("matched"))


@query("c10_groups_in_range", q.with_groups(f"""
select group_id, {q.korea_date('latest_published_at')} as period from groups
where {q.korea_date('latest_published_at')} between date '2024-01-10' and date '2024-01-20'"""))
def groups_in_range(t):
    groups, _ = t.groups()
    return I.in_range(groups, F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")).select("group_id", "period")


@query("h8_f2_group_keywords", q.with_groups("select group_id, keywords from top8", KEYWORDS))
def group_keywords(t):
    return K.top_keywords(K.keyword_weights(t.groups()[0], t.effective(), t.articles), 8)


@query("d7_f7_selection_score", q.with_groups(
    "select period, group_id, score as effective_score, keyword_score, selection_score, is_low as low from candidates", *BASE))
def selection(t):
    candidates, _, _ = candidate_parts(t)
    return candidates.select("period", "group_id", "effective_score", "keyword_score", "selection_score", "low")


@query("f6_rank_candidates", q.with_groups("select period, group_id, idx::int as index from candidates", *BASE))
def ranked_candidates(t):
    candidates, _, _ = candidate_parts(t)
    return I.rank_candidates(candidates).select("period", "group_id", "index")


@query("d6_keyword_pairs", q.with_groups("select period, group_id, k1, k2 from pair_rows", *BASE, PAIRS))
def keyword_pairs(t):
    candidates, _, weights = candidate_parts(t)
    return R.keyword_pairs(candidates, weights)


@query("g7_pair_components", q.with_groups(
    "select period, component, group_id, (pair).k1 as k1, (pair).k2 as k2 from (select period, component, group_id, "
    "{'k1': pair[1], 'k2': pair[2]} as pair from member_rows)", *BASE, PAIRS, COMPONENTS))
def pair_components(t):
    candidates, _, weights = candidate_parts(t)
    totals = candidates.groupBy("period").agg(F.count("*").cast("int").alias("total"))
    return R.pair_components(R.keyword_pairs(candidates, weights), totals)


@query("e8_rollup_priority", q.with_groups(
    "select period, component, priority from turns", *BASE, PAIRS, COMPONENTS))
def priorities(t):
    return daily.components_in_turn(*candidate_parts(t)).select("period", "component", "priority").distinct()


@query("e9_i7_select_rollups", q.with_groups(
    "select period, component, group_id from merged", *BASE, PAIRS, COMPONENTS, ROLLUPS))
def rollups(t):
    return R.select_rollups(daily.components_in_turn(*candidate_parts(t)))


ISSUE_SQL = """select period, issue_id, title, category, summary, articles, array_to_string(sources, '|') as sources, source_count,
  score, selection_score, array_to_string(keywords, '|') as keywords, is_low as low, parts::int as parts, {latest} as latest from {source}"""


def flat_issues(issues):
    return issues.select(
        "period", "issue_id", "title", "category", "summary", "articles", F.array_join("sources", "|").alias("sources"),
        "source_count", "score", "selection_score", F.array_join("keywords", "|").alias("keywords"), "low", "parts",
        epoch("latest_published_at").alias("latest"))


@query("e7_i8_issue_candidates", q.with_groups(
    ISSUE_SQL.format(latest=q.epoch("latest_published_at"), source="issues"), *UP_TO_ISSUES))
def issue_candidates(t):
    return flat_issues(issue_parts(t).issues)


@query("i6_g6_dedupe_issues", q.with_groups(
    ISSUE_SQL.format(latest=q.epoch("latest_published_at"), source="kept"), *UP_TO_ISSUES, KEPT))
def deduped(t):
    return flat_issues(I.dedupe_issues(issue_parts(t).issues))


@query("g6_similar_issues", q.with_groups("select period, later, earlier from alike", *UP_TO_ISSUES, KEPT))
def similar(t):
    ranked = I.rank_issues(issue_parts(t).issues)
    nodes = I.story_nodes(ranked)
    return I.similar_issues(nodes, nodes).select(F.col("window").alias("period"), "later", "earlier")


@query("f4_d8_category_leads", q.with_groups("""
select period, category, issue_count, article_count, place::int as place, lead_title, array_to_string(lead_keywords, '|') as lead_keywords
from category_leads""", *UP_TO_ISSUES, KEPT, TOP))
def category_leads(t):
    d = issue_parts(t)
    led = I.category_lead(I.top_categories(d.candidates, d.effective), I.dedupe_issues(d.issues), d.candidates)
    return led.select("period", "category", "issue_count", "article_count", "place", "lead_title",
                      F.array_join("lead_keywords", "|").alias("lead_keywords"))


@query("f3_top_issues", q.with_groups(
    "select period, place::int as place, issue_id, title, category, articles, score, selection_score from top_issues",
    *UP_TO_ISSUES, KEPT, TOP))
def best_issues(t):
    d = issue_parts(t)
    top = I.top_issues(I.dedupe_issues(d.issues), I.category_counts(d.candidates, d.effective).filter("1 = 0")
                       .unionByName(I.top_categories(d.candidates, d.effective).drop("place")))
    return top.select("period", "place", "issue_id", "title", "category", "articles", "score", "selection_score")


SUMMARY_SQL = """
select strftime(p.period, '%Y-%m-%d') as date,
  strftime(p.period, '%Y-%m-%d') || ' 전날 주요 이슈 ' || p.issue_count || '건' as headline,
  case when c.names is null then '특정 카테고리 쏠림은 크지 않았습니다' else array_to_string(c.names[1:3], ', ') || ' 분야의 비중이 컸습니다' end
  || '. ' || coalesce('가장 주목할 이슈는 ' || t.titles[1] || '입니다', '대표 이슈는 아직 정리되지 않았습니다')
  || '. 아래 주요 이슈를 훑으면 전날 뉴스 흐름을 빠르게 파악할 수 있습니다.' as summary,
  p.issue_count, p.article_count, p.source_count, array_to_string(c.names, '|') as categories,
  array_to_string(c.texts, '|') as category_texts, array_to_string(t.titles, '|') as titles
from (
  select period, count(distinct c.group_id)::int as issue_count, count(distinct m.article_id)::int as article_count,
    count(distinct lower(m.source_name))::int as source_count from candidates c left join members m using (group_id) group by period) p
left join (select period, list(category order by place) as names, list(lead_title || ' 이슈가 가장 두드러졌고, 이 카테고리에서 '
    || issue_count || '개 이슈가 확인됐습니다.' || case when len(lead_keywords) = 0 then '' else ' 주요 키워드는 '
    || array_to_string(lead_keywords[1:4], ', ') || '입니다.' end order by place) as texts from category_leads group by period) c using (period)
left join (select period, list(title order by place) as titles from top_issues group by period) t using (period)"""


def summaries_of(t):
    return t.summaries()


@query("j2_b29_daily_summaries", q.with_groups(SUMMARY_SQL, *UP_TO_ISSUES, KEPT, TOP))
def daily_summaries(t):
    return summary_texts(summaries_of(t).summaries)


def summary_texts(summaries):
    return summaries.select(
        "date", "headline", "summary", "issue_count", "article_count", "source_count",
        F.array_join(F.transform("categories", lambda c: c["category"]), "|").alias("categories"),
        F.array_join(F.transform("categories", lambda c: c["summary"]), "|").alias("category_texts"),
        F.array_join(F.transform("top_issues", lambda i: i["title"]), "|").alias("titles"))


@query("j2_incremental_days", q.with_groups(SUMMARY_SQL, *UP_TO_ISSUES, KEPT, TOP))
def refreshed(t):
    """Summaries stored before the articles of one day came in, brought up to date: only days whose groups differ are written anew."""
    groups, members = t.groups()
    early = t.articles.filter(korea_date(F.col("published_at")) != F.lit("2024-01-15").cast("date"))
    was, kept = finalize_groups(t.members, early, LATIN_CATEGORY_RULES)
    was = materialize(was, "groups")
    stored = daily.daily_summaries(was, kept, early, t.as_of)
    states = materialize(day_states(was, kept, early), "day-states")
    return summary_texts(refresh(groups, members, t.articles, t.as_of, stored, states).summaries.filter("date not like 'weekly:%'"))


TOP_ARTICLES = """
issue_parts as (
  select period, component as issue_id, group_id from merged union all
  select period, group_id, group_id from candidates where (period, group_id) not in (select period, group_id from merged)),
top_articles as (
  select distinct t.period, t.place, t.issue_id, m.article_id from top_issues t join issue_parts p using (period, issue_id)
  join members m on m.group_id = p.group_id)
"""


@query("j2_issue_articles", q.with_groups("""
select strftime(period, '%Y-%m-%d') as date, place::int as place, article_id from top_articles""", *UP_TO_ISSUES, KEPT, TOP, TOP_ARTICLES))
def issue_articles(t):
    return summaries_of(t).issue_articles


@query("f5_evidence", q.with_groups(f"""
select strftime(period, '%Y-%m-%d') as date, place::int as place, pos::int as pos, title, source, summary, excerpt, url from (
  select t.period, t.place, {q.plain('a.title')} as title, {q.plain('a.source')} as source, {q.cut(q.plain('a.summary'), 350)} as summary,
    {q.cut(q.plain('a.content'), 1000)} as excerpt, a.url, row_number() over (partition by t.period, t.issue_id
      order by {q.strip('a.content')} = '', a.published_at desc, a.id) as pos
  from top_articles t join articles a on a.id = t.article_id) where pos <= 2""", *UP_TO_ISSUES, KEPT, TOP, TOP_ARTICLES))
def evidence(t):
    return summaries_of(t).evidence


# ---- the smallest end-to-end slice: article -> category -> counts -> score -> top of each category ----
@query("slice_top_articles", q.with_articles(f"""
select category, source, articles, impact, place::int as place from (
  select *, row_number() over (partition by category order by impact desc, articles desc, source) as place from (
    select category, source, count(*)::int as articles, {q.impact('count(*)', '1')} as impact
    from effective e join article_category c using (id) group by category, source)) where place <= 4""",
    q.EFFECTIVE, f"""{q.CATEGORY_RULES},
article_hits as (
  select a.id, r.rule_order, count(distinct r.word) as score from articles a join rules r
    on contains(lower(a.source || ' ' || a.title || ' ' || a.summary || ' ' || a.content), r.word) group by all),
article_category as (
  select a.id, coalesce(arg_min(r.category, (-score, h.rule_order)), '사회') as category
  from articles a left join article_hits h on h.id = a.id
  left join (select distinct rule_order, category from rules) r on r.rule_order = h.rule_order group by a.id)"""))
def slice_top(t):
    rows = article_category(effective_articles(t.articles), LATIN_CATEGORY_RULES)
    counts = rows.groupBy("category", "source").agg(F.count("*").cast("int").alias("articles"))
    scored = counts.withColumn("impact", signals.impact(F.col("articles"), F.lit(1)))
    order = Window.partitionBy("category").orderBy(F.desc("impact"), F.desc("articles"), "source")
    return scored.withColumn("place", F.row_number().over(order)).filter("place <= 4")
