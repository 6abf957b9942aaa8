"""The queries of this package over whole tables, and the SQL that states a result where SQL can."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from issueloom.llm import align, bpe, decontam, hosts, licenses, neardup, passages, pii, quality, runs, shards, suffixes, topk

RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op8_jump_shards", f"""
with recursive crc_table as (
  select list(c order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c
    from (select range::bigint as i from range(256)))),
d as (select row_number() over () as n, doc_id, encode(coalesce(text, '')) as b from documents),
walk as (
  select n, (case when coalesce(doc_id, 0) < 0 then coalesce(doc_id, 0)::hugeint + 18446744073709551616
             else coalesce(doc_id, 0)::hugeint end)::uhugeint as k, 0::bigint as spot, 0::bigint as nxt from d
  union all
  select n, k2, nxt, floor((nxt + 1) * (2147483648.0::double / ((k2 // 8589934592) + 1)::double))::bigint
  from (select n, nxt, ((k * {shards.FACTOR}::uhugeint + 1) % 18446744073709551616::uhugeint) as k2
        from walk where nxt <= 40)),
placed as (
  select n, (max(spot) filter (spot < 40))::integer as shard, max(spot)::integer as grown_shard from walk group by n),
sized as (
  select d.doc_id, octet_length(b) + 16 as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
           range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i:i]))::bigint)),
           lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) as text_crc32, shard, grown_shard
  from d join placed using (n), crc_table)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard
from sized""")
def op8(spark, sf_dir):
    return shards.shard_documents(table(spark, sf_dir, "documents"), 40)


@query("op7_personal_data")
def op7(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


#: Word lists and shingle sets of a table (id, text) in SQL: A-Z in lower case, words parted by the six ASCII spaces.
def shingles_sql(table: str, key: str) -> str:
    return f"""
  select {key} as id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i:
           array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from (select {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {table})"""


@query("op10_odd_sketch_near_duplicates", f"""
with recursive sets as ({shingles_sql("documents", "doc_id")}),
x as (select id, unnest(s) as g from sets), sized as (select id, len(s) as n from sets),
pairs as (select a.id as a, b.id as b, count(*) as shared from x a join x b on a.g = b.g and a.id < b.id group by all),
links as (select a, b from pairs join sized p on p.id = a join sized q on q.id = b
          where 100 * shared >= 75 * (p.n + q.n - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select id, id as r from sets union select reach.id, both_ways.b from reach join both_ways on reach.r = both_ways.a)
select id as doc_id, n as n_shingles, c as component_id, id = c as kept
from sized join (select id, min(r) as c from reach group by id) using (id)""")
def op10(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_contaminated_documents", f"""
with docs as ({shingles_sql("documents", "doc_id")}), items as ({shingles_sql("benchmark", "item_id")}),
x as (select id, unnest(s) as g from docs), y as (select id, unnest(s) as g, len(s) as n from items)
select x.id as doc_id, y.id as item_id, n as n_item, count(*) as n_shared
from x join y using (g) group by all having 100 * count(*) >= 75 * n""")
def op3(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_quality")
def op5(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_exact_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank,
  vec_id, score from scored)
select * from ranked where rank <= 10""")
def op2(spark, sf_dir):
    return topk.exact_top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings")))


@query("op9_repeated_bytes")
def op9(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_repeated_passages")
def op4(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op6_license_notices")
def op6(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return align.alignment_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES),
                                  public_tokenizers.PATTERN)


@query("op12_host_rules", f"""
with lists as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from documents),
windows as (select r, unnest(range(1, len(w) - 6)) as i, w from lists where len(w) >= 8),
named as (select r, i, count(*) over (partition by r, w[i:i + 7]) as c from windows),
inside as (select r, count(distinct i + j) as n from named, range(0, 8) x(j) where c > 1 group by r),
counts as (select r, doc_id, host, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
    len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from lists left join inside using (r)),
rules as (select host, rule, count(*)::double as n, (count(*) filter (bad))::double as k from (
  select host, unnest([{", ".join(f"'{r}'" for r in hosts.RULES)}]) as rule,
         unnest([{", ".join(f"({c})" for c in hosts.RULES.values())}]) as bad
  from counts where host is not null and trim(host) <> '') group by all),
moments as (select rule, sum(k) / sum(n) as p, sum(n) - sum(n * n) / sum(n) as spread, sum(k * k / n) - sum(k) * sum(k) / sum(n) as between_hosts,
  count(*) as h from rules group by rule),
shares as (select rule, p, case when spread > 0 and p > 0 and p < 1
  then ((between_hosts - p * (1 - p) * (h - 1)) / spread) / (p * (1 - p)) else 0 end as rho from moments),
prior as (select rule, p, case when rho > 0 then greatest({hosts.LEAST_STRENGTH}, least({hosts.MOST_STRENGTH}, 1 / rho - 1))
  else {hosts.MOST_STRENGTH} end as m from shares),
gone as (select distinct host from rules join prior using (rule) where round((k + m * p) / (n + m), 9) > {hosts.HOST_LIMIT})
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
  {" or ".join(f"({c})" for c in hosts.BASE_RULES.values())} as base_failed, gone.host is not null as host_rejected,
  not ({" or ".join(f"({c})" for c in hosts.BASE_RULES.values())}) and gone.host is null as kept
from counts left join gone on counts.host = gone.host""")
def op12(spark, sf_dir):
    return hosts.judge(table(spark, sf_dir, "documents"))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """A tenth of the documents with a periodic end, as fixed by the crc of their ids: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    placed = chosen.withColumn("n", F.size("w")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)")).withColumn(
        "p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    changed = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    return runs.run_digest(runs.find_runs(with_periodic_ends(table(spark, sf_dir, "documents"))))
