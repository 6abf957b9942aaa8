"""Headline queries, timed to the last row, as one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import time

from issueloom.registry import load
from issueloom.session import discard, local_session

HEADLINE = ["f1_effective_articles", "h2_hash_embedding", "i3_group_issues", "e6_c7_keyword_weights",
            "j1_f10_brief_feed", "h5_extract_body", "e9_i7_select_rollups", "j2_b29_daily_summaries"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registry, seconds = load(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # the first query must not pay for the start of the session
    for name in HEADLINE:
        registry.forget()  # every query derives all it needs by itself
        begin = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 2)
    discard(spark)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(seconds.values()), 2), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
