"""Time the headline queries; prints one JSON line.

Every query is built and run whole (result to the `noop` sink) twice in one session.
`queries` and the sum hold the first run, which also pays for code generation;
`second_runs` the other.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duelframe.catalog.queries import PLAIN  # noqa: E402
from duelframe.session import build_session  # noqa: E402

HEADLINE = [
    "normalised_matches",
    "richest_row_dedup",
    "long_team_rows",
    "rolling_games",
    "rolling_overall",
    "rolling_venue",
    "match_level_features",
    "asof_rating_both_sides",
    "rating_fill_current",
    "interval_from_events",
    "odds_coalesce_join",
    "resolve_second_source",
    "top_n_per_country",
    "season_split",
    "result_metrics",
    "over_metrics",
    "prob_correlation",
    "betting_result",
    "betting_over",
    "prediction_report",
    "training_base",
    "training_features",
]


def timed(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    PLAIN["result_targets"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    first = {name: timed(PLAIN[name], spark, sf_dir) for name in wanted}
    second = {name: timed(PLAIN[name], spark, sf_dir) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(first.values()), 3),
                "unit": "sec",
                "queries": first,
                "second_runs": second,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
