"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from tidemill.queries import QUERIES
from tidemill.session import session

HEADLINE = (
    "flagship_tumbling", "filter_compare", "group_aggregates", "cube", "nearest_rank", "star_revenue", "join_interval", "join_as_of", "point_in_time", "window_hopping",
    "window_session", "window_trailing", "window_count", "downsample", "series_rollup", "snapshot_diff", "log_compaction", "running_total", "cep_pattern", "z_score", "iqr",
    "knn", "keyword_search", "chunk_fixed", "token_frequency", "cdc_apply", "stream_tumbling",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
