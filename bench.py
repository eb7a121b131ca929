"""Headline queries of the research engine; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Each query runs once to warm up and
then three times; the median counts. Beside the queries, which derive eight instruments, some run over 200, and
``duckdb`` has the seconds that DuckDB takes for the same SQL with as many threads (the last of two runs).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.functions import indicators as ind  # noqa: E402
from tidemark.operators import outcomes as oc  # noqa: E402
from tidemark.operators import patterns as pt  # noqa: E402
from tidemark.plans import catalogue  # noqa: E402
from tidemark.session import local_session  # noqa: E402
from tidemark.sources.bars import derive_bars  # noqa: E402

HEADLINE = (
    "bars_derive", "feat_initial", "feat_market", "pi_bollinger", "feat_macd", "strategy_prior_high_20_summary", "outcome_paths", "exit_policy_summary",
    "pattern_lifecycle_states", "stop_policy_summary", "managed_exit_summary", "strategy_family", "universe_history", "quality_issues", "composite_evidence", "parameter_surface", "performance_readout", "month_bootstrap_ci", "random_timing_null", "resample_weekly", "split_adjust",
    "pi_frame", "surface_reading", "timeframe_report", "replay_statuses",
)


def timed(run, repeats: int = 3) -> float:
    run()
    out = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        out.append(time.perf_counter() - start)
    return median(out)


def over_200(spark, folder: str) -> dict:
    """The same operators over 200 instruments."""
    bars = derive_bars(spark, folder, 200)
    hits = pt.bases(bars, 20, 0.08, "NONE").where("qualified and cc > hc_most").select("instrument_id", "signal_index", "trade_date")
    return {
        "bars_derive_200": bars,
        "feat_market_200": ind.with_market(bars),
        "outcome_paths_200": oc.outcome_paths(hits, bars, (5, 20)),
        "pattern_lifecycle_states_200": pt.lifecycle_states(bars),
    }


def duckdb_seconds(folder: str, cores: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": cores})
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    out, sql = {}, catalogue.oracle_sql()
    for name in HEADLINE:
        if name in sql:
            for _ in range(2):
                start = time.perf_counter()
                con.sql(sql[name]).fetchall()
                out[name] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, partitions=8, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    seconds = {name: round(timed(lambda q=queries[name]: q(spark, folder).write.format("noop").mode("overwrite").save()), 3) for name in HEADLINE}

    wide = {name: round(timed(lambda d=d: d.write.format("noop").mode("overwrite").save()), 3) for name, d in over_200(spark, folder).items()}

    # the one recorded reference figure: writing a feature snapshot in long form, here of 200 instruments
    names = ["sma_50", "sma_200", "atr_14", "return_60", "avg_dollar_volume_20", "rolling_range_pct_30"]
    with tempfile.TemporaryDirectory() as out:
        long = ind.to_long(ind.with_initial(derive_bars(spark, folder, 200)), names)
        took = timed(lambda: long.write.mode("overwrite").parquet(f"{out}/features"))
        rows = spark.read.parquet(f"{out}/features").count()
    seconds["feature_snapshot_write_200"] = round(took, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None, "cores": int(cores), "instruments_200": wide, "duckdb": duckdb_seconds(folder, int(cores)), "feature_rows": rows, "feature_rows_per_sec": round(rows / took)}))


if __name__ == "__main__":
    main()
