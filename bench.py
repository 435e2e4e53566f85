"""Times the headline queries and prints one line of JSON.

Each query runs once to warm up and twice timed into a sink that discards rows; the better
time counts.  `raw` holds the same statements given straight to Spark SQL, where Spark's
dialect takes them: the difference is the engine's own cost.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from tidewater import catalogue

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: The statements of the baseline table.
BASELINE = {
    "scan_count": "SELECT COUNT(*) AS n FROM lineitem",
    "filter": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05",
    "group_agg": "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS s, AVG(l_extendedprice) AS a, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "stddev_group": "SELECT l_suppkey, STDDEV(l_quantity) AS s, VARIANCEP(l_quantity) AS v FROM lineitem GROUP BY l_suppkey",
    "count_distinct": "SELECT COUNT(DISTINCT l_partkey) AS n FROM lineitem",
    "inner_join": "SELECT COUNT(*) AS n, SUM(l.l_quantity) AS s FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey",
    "left_join_group": "SELECT c.c_nationkey, COUNT(o.o_orderkey) AS n FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey",
    "full_join": "SELECT COUNT(*) AS n FROM orders AS o FULL JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey",
    "theta_join": "SELECT COUNT(*) AS n FROM supplier AS s JOIN customer AS c ON s.s_acctbal > c.c_acctbal",
    "cross_join": "SELECT COUNT(*) AS n FROM nation CROSS JOIN customer",
    "flagship": catalogue.FLAGSHIP,
}


def timed(run) -> float:
    start = time.perf_counter()
    df: DataFrame = run()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = catalogue.session(spark, SF)
    for t in catalogue.TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    queries, raw = {}, {}
    for name, text in BASELINE.items():
        timed(lambda: engine.sql(text))  # noqa: B023
        queries[name] = round(min(timed(lambda: engine.sql(text)) for _ in range(2)), 4)  # noqa: B023
        plain = text.replace("VARIANCEP(", "VAR_POP(")
        raw[name] = round(min(timed(lambda: spark.sql(plain)) for _ in range(2)), 4)  # noqa: B023
    print(json.dumps({"metric": "total_seconds", "value": round(sum(queries.values()), 4), "unit": "sec", "queries": queries, "raw": raw, "sf": SF}))


if __name__ == "__main__":
    main()
