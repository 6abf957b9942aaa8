"""SQL fragments the oracles are put together from. They state results in DuckDB's own words."""

from issueloom.functions.text import WHITESPACE
from issueloom.rules import (
    COUNTED_UNIT_PATTERN, LOW_VALUE_WORDS, PUBLISHER_RULES, ROLLUP_STOPWORDS, STOPWORDS, TOKEN_PATTERN)
from issueloom.sources.tables import LATIN_CATEGORY_RULES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(lit(w) for w in items) + ")"


WS = lit(WHITESPACE)
SPACES = r"'[\t-\r\x{85}\p{Z}]+'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def decoded(x: str) -> str:
    """The entities that occur in the supplied pages; the ampersand last, so nothing is decoded twice."""
    for name, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {lit(char)})"
    return x


def clean(x: str) -> str:
    tagless = f"regexp_replace({decoded(x)}, '<[^>]*>', ' ', 'g')"
    return strip(f"regexp_replace({tagless}, '\\r\\n|[\\r\\n\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g')")


def plain(x: str) -> str:
    """`clean` for text known to hold neither entities nor tags (the documents)."""
    return strip(f"regexp_replace({x}, '\\r\\n|[\\r\\n\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g')")


def cut(x: str, n: int) -> str:
    return f"(case when length({x}) > {n} then rtrim(substr({x}, 1, {n}), {WS}) || '...' else {x} end)"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TOKEN_PATTERN)})"


def epoch(x: str) -> str:
    return f"floor(epoch({x}))::bigint"


def korea_date(x: str) -> str:
    return f"({x} + interval 9 hours)::date"


def low_value(title: str, sources: str) -> str:
    text = f"lower(concat_ws(' ', {sources}, {title}))"
    return "(" + " or ".join(f"contains({text}, {lit(w)})" for w in LOW_VALUE_WORDS) + ")"


def impact(a: str, s: str, low: str | None = None) -> str:
    cap = f"(case when {s} <= 1 then 55 when {s} = 2 then 68 when {s} = 3 then 78 else 100 end)"
    score = f"(case when {a} <= 0 then 0 else least(100, 30 + {a}*4 + {s}*3, {cap}) end)"
    if low:
        score = f"(case when {low} then least({score}, 45) else {score} end)"
    return f"({score})::int"


def publisher(url: str) -> str:
    host = f"replace(lower(regexp_extract({url}, '^[a-zA-Z]+://([^/:?#]+)', 1)), 'www.', '')"
    cases = " ".join(f"when contains({host}, {lit(p)}) then {lit(n)}" for p, n, _ in PUBLISHER_RULES)
    return f"(case when {host} = '' then '알 수 없음' {cases} else {host} end)"


def keyword_ok(k: str) -> str:
    return (f"(length({k}) between 2 and 30 and not regexp_full_match({k}, '[0-9]+') and {k} not in {words(STOPWORDS)} "
            f"and not ({k} like '%기자' and length({k}) <= 5))")


def rollup_ok(k: str) -> str:
    return (f"({keyword_ok(k)} and not regexp_matches({k}, {lit(COUNTED_UNIT_PATTERN)}) "
            f"and not (regexp_matches({k}, '[0-9]') and length({k}) <= 4) "
            f"and not (regexp_full_match({k}, '[ -~]+') and length({k}) <= 3) and {k} not in {words(ROLLUP_STOPWORDS)})")


ARTICLES = """
toxic as (select doc_id, max(toxic) as toxic from labels group by doc_id),
articles as (
  select d.doc_id, sha256('https://wire.example/' || d.doc_id) as id,
    trim(split_part(substr(text, 1, 400), '.', 1)) as title,
    'https://wire.example/' || d.doc_id as url,
    'wire' || (substr(source, 4)::int % 5) as source,
    case when d.doc_id % 3 = 0 then '' else 'desk' || (d.doc_id % 2) end as author,
    'https://wire' || (substr(source, 4)::int % 5) || '.example/rss' as feed_url,
    case when d.doc_id % 7 = 0 then '' else substr(text, 1, 300) end as summary,
    coalesce(toxic, 0) = 1 as is_excluded,
    case when d.doc_id % 4 = 0 then '' else 'https://img.example/' || d.doc_id || '.jpg' end as image_url,
    text as content,
    case when d.doc_id % 10 = 0 then '' when d.doc_id % 10 <= 3 then 'failed' else 'success' end
      as content_fetch_status,
    '' as content_fetch_error,
    timestamp '2024-01-01' + to_seconds(d.doc_id * 7919 % 2592000) as published_at,
    timestamp '2024-01-01' + to_seconds(d.doc_id * 7919 % 2592000 + 300) as first_seen_at,
    timestamp '2024-01-01' + to_seconds(d.doc_id * 7919 % 2592000 + 600) as updated_at,
    lang
  from documents d left join toxic t on d.doc_id = t.doc_id)
"""

DUP_KEY = f"""
  lower({plain('source')}) || '|' || regexp_replace(lower({plain('title')}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') || '|' ||
  case when {strip('author')} = '' then 'unknown' else lower({plain('author')}) end"""

EFFECTIVE = f"""
effective as (
  select * exclude (rn) from (
    select *, row_number() over (partition by {DUP_KEY} order by published_at desc, first_seen_at desc, id) as rn
    from articles where not is_excluded)
  where rn = 1)
"""

CATEGORY_RULES = "rules(rule_order, category, word) as (values " + ", ".join(
    f"({order}, {lit(category)}, {lit(word)})"
    for order, (category, rule_words) in enumerate(LATIN_CATEGORY_RULES) for word in rule_words) + ")"


def with_articles(select: str, *ctes: str) -> str:
    return "with recursive " + ",\n".join([ARTICLES, *ctes]) + "\n" + select


MEMBERS = """
raw_members as (select sha256(lower(split_part(title, ' ', 1))) as group_id, id as article_id from articles)
"""

# Repeats inside a group, the group's articles in order, its sources, its seed and its category.
GROUPS = f"""
members as (
  select group_id, article_id, pos, source_name, published_at, first_seen_at from (
    select *, row_number() over (partition by group_id order by published_at desc, first_seen_at desc, article_id) as pos
    from (
      select m.group_id, m.article_id, {plain('a.source')} as source_name, a.published_at, a.first_seen_at,
        row_number() over (partition by m.group_id, {DUP_KEY.replace("source", "a.source").replace("title", "a.title").replace("author", "a.author")}
          order by a.published_at desc, a.first_seen_at desc, a.id) as rn
      from raw_members m join articles a on a.id = m.article_id where not a.is_excluded)
    where rn = 1)),
source_list as (
  select group_id, list(source_name order by pos) as sources from (
    select *, row_number() over (partition by group_id, lower(source_name) order by pos) as k from members
    where source_name <> '') where k = 1 group by group_id),
{CATEGORY_RULES},
hits as (
  select m.group_id, r.rule_order, count(distinct r.word) as score
  from members m join articles a on a.id = m.article_id
  join rules r on contains(lower(a.source || ' ' || a.title || ' ' || a.summary || ' ' || a.content), r.word)
  group by all),
categories as (
  select group_id, arg_min(c.category, (-score, h.rule_order)) as category
  from hits h join (select distinct rule_order, category from rules) c using (rule_order) group by group_id),
groups as (
  select g.*, case when low then least(score0, 45) else score0 end as score from (
    select n.group_id, coalesce(c.category, '사회') as category, n.article_count,
      coalesce(s.sources, []::varchar[]) as sources, n.latest_published_at,
      {impact('n.article_count', 'len(coalesce(s.sources, []::varchar[]))')} as score0,
      {low_value('a.title', "array_to_string(coalesce(s.sources, []::varchar[]), ' ')")} as low,
      a.title as seed_title, case when {strip('a.content')} <> '' then substr(a.content, 1, 700) else a.summary end as seed_summary,
      a.title as representative_title,
      case when {strip('a.content')} <> '' then substr(a.content, 1, 900) else a.summary end as summary
    from (select group_id, count(*)::int as article_count, max(published_at) as latest_published_at,
            max(case when pos = 1 then article_id end) as seed_id from members group by group_id) n
    join articles a on a.id = n.seed_id left join source_list s on s.group_id = n.group_id
    left join categories c on c.group_id = n.group_id) g)
"""


def with_groups(select: str, *ctes: str) -> str:
    return with_articles(select, MEMBERS, GROUPS, *ctes)
