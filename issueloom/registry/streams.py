"""Streams over the landed tables, run to the end of what is there."""

import uuid

from pyspark.sql import functions as F

from issueloom.registry import sql as q
from issueloom.registry.base import epoch, query
from issueloom.session import run_folder
from issueloom.sources.partitioned import read_store
from issueloom.streaming import articles as S


def event_stream(t):
    schema = t.read("events").schema
    return S.landed(t.spark, t.sf_dir, schema, "events.parquet").withColumn(
        "at", F.to_timestamp(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))))


def finished(t, stream, keys):
    base = f"{run_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    S.run_to_table(stream, f"{base}/table", f"{base}/state", keys).awaitTermination()
    return S.latest_snapshot(t.spark, f"{base}/table", stream.schema)


@query("k2_stream_dedupe", q.with_articles("select id, floor(epoch(published_at))::bigint as published, title from articles"))
def deduped(t):
    """The article table landed twice over, in files of both, and streamed: each id once."""
    base = f"{run_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    a = t.articles.drop("doc_id", "lang")
    for _ in range(2):
        a.write.mode("append").parquet(f"{base}/landing")
    # as many files as the table has splits, in four batches
    files = -(-len(t.spark.read.parquet(f"{base}/landing").inputFiles()) // 4)
    first = S.stream_dedupe(S.landed(t.spark, f"{base}/landing", files=files)).select("id", "published_at", "title")
    first.writeStream.format("parquet").option("path", f"{base}/table").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(first.schema).parquet(f"{base}/table").select("id", epoch("published_at").alias("published"), "title")


@query("k3_stream_daily_counts", f"""
select {q.korea_date('ts')} as day, event_type, count(*) as arrivals from events group by all""")
def daily(t):
    out = finished(t, S.daily_counts(event_stream(t), "at", ["event_type"]), ["w", "event_type"])
    day = F.to_date(F.convert_timezone(None, F.lit("Asia/Seoul"), F.col("w.start").cast("timestamp_ntz")))
    return out.select(day.alias("day"), "event_type", "arrivals")


@query("k4_stream_week_counts", f"""
select ({q.korea_date('ts')} - i::int + 6)::date as last_day, count(*) as arrivals from events, (select unnest(range(7)) as i) group by all""")
def weekly(t):
    out = finished(t, S.week_counts(event_stream(t), "at", []), ["w"])
    end = F.convert_timezone(None, F.lit("Asia/Seoul"), F.col("w.end").cast("timestamp_ntz"))
    return out.select(F.date_sub(F.to_date(end), 1).alias("last_day"), "arrivals")


@query("k5_stream_stale_sources", """
select user_id, floor(epoch(max(ts)))::bigint as last_seen from events group by user_id
having max(ts) < timestamp '2024-01-31' - interval 12 hours""")
def stale(t):
    seen = finished(t, S.last_seen(event_stream(t), "at", "user_id"), ["user_id"])
    return S.stale_sources(seen, t.as_of).select("user_id", epoch("last_seen").alias("last_seen"))


@query("k5_stream_silences", """
with e as (select user_id, ts, lead(ts) over (partition by user_id order by ts) as n from events),
w as (select max(ts) - interval 2 hours as mark from events)
select user_id, floor(epoch(ts))::bigint as last_seen, floor(epoch(ts + interval 12 hours))::bigint as silent_from from e, w
where (n is null or n > ts + interval 12 hours) and ts + interval 12 hours < mark""")
def fell_silent(t):
    base = f"{run_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    found = S.silences(event_stream(t), "at", "user_id")
    found.writeStream.format("parquet").option("path", f"{base}/table").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(found.schema).parquet(f"{base}/table").select(
        "user_id", epoch("last_seen").alias("last_seen"), epoch("silent_from").alias("silent_from"))


@query("k1_stream_ingest", q.with_articles("""
select id, case when doc_id % 2 = 0 or doc_id % 3 = 0 then title else 'early' end as title, source,
  floor(epoch(published_at))::bigint as published, floor(epoch(first_seen_at))::bigint + case when doc_id % 3 = 0 then 86400 else 0 end as first,
  1706659200::bigint as seen, length(content)::bigint as n_content from articles"""))
def ingested(t):
    """The article table landed in two loads, some articles in both, and streamed into a partitioned store.

    What arrives again keeps its first sighting and body and takes the new title.
    """
    base = f"{run_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    a, third = t.articles.drop("lang"), F.col("doc_id") % 3 == 0
    early = a.filter(~third).withColumn("title", F.lit("early"))
    late = a.filter(third | (F.col("doc_id") % 2 == 0)).withColumns({
        "first_seen_at": F.col("first_seen_at") + F.expr("INTERVAL 1 DAY"), "content": F.when(third, F.col("content")).otherwise("")})
    for load in (early, late):
        load.drop("doc_id").write.mode("append").parquet(f"{base}/landing")
        source = S.landed(t.spark, f"{base}/landing")
        S.stream_ingest(source, f"{base}/store", f"{base}/state", as_of=t.as_of).awaitTermination()
    return read_store(t.spark, f"{base}/store").select(
        "id", "title", "source", epoch("published_at").alias("published"), epoch("first_seen_at").alias("first"),
        epoch("updated_at").alias("seen"), F.length("content").cast("bigint").alias("n_content"))
