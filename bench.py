"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import checks, profile
from tabloom.plans import catalog
from tabloom.sources.store import materialise

HEADLINE = (
    "flagship_windows", "pit_std", "pit_nunique", "pit_last", "join_asof", "duplicate_rows", "conversion_apply", "split_rows", "split_ids", "folds_grouped",
    "profile_table", "profile_top_values", "profile_distribution", "check_hidden_missing", "check_drift", "check_spellings", "check_near_copies",
    "features_family", "features_segments", "encode_woe", "expression_language", "measure_separation", "measure_spearman", "binning_proposals", "stability_numeric", "text_words", "selection",
)


#: The published figure for a profile with its checks is for a table of so many rows and columns.
ROWS, COLUMNS = 100_000, 200


def wide_table(spark: SparkSession) -> DataFrame:
    """Numbers of few and of many values, texts, dates, with gaps."""
    def column(i: int) -> Column:
        h = F.pmod(F.xxhash64("id", F.lit(i)), F.lit((7, 97, 5_000, 1 << 40)[i % 4]))
        value = (h.cast("double") / 8, h, F.concat(F.lit("v"), F.pmod(h, F.lit(40))), F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(h, F.lit(900)).cast("int")))[min(i * 10 // COLUMNS % 5, 3)]
        return F.when(F.pmod(F.xxhash64("id", F.lit(-i)), F.lit(10)) > i % 3 - 1, value).alias(f"c{i:03}")

    return spark.range(ROWS).select(*[column(i) for i in range(COLUMNS)])


def wide_profile(df: DataFrame) -> list:
    """The profile of every column, the column rules on it, hidden codes and heavy zeros."""
    found = materialise(profile.profile(df), "bench-profile")
    numbers = [f.name for f in df.schema.fields if profile.numeric(profile.kind_of(f.dataType))]
    return [*checks.column_rules(found).collect(), *checks.hidden_missing(df, numbers).collect()]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, times = catalog.queries(), {}
    queries[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # code and file caches
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    table = materialise(wide_table(spark), "bench-wide")
    began = time.perf_counter()
    wide_profile(table)
    times["wide_profile_checks"] = round(time.perf_counter() - began, 3)
    sys.stdout.write(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
