"""Layout of the inputs derived from the given tables."""

import pytest
from pyspark.sql import functions as F

from leadweave.workload.fixtures import table

ROWS = {
    "customer": ["id AS c_custkey", "'Customer ' || id AS c_name", "CAST(id % 3 AS INT) AS c_nationkey"],
    "supplier": ["id AS s_suppkey", "'Supplier ' || id AS s_name", "CAST(id % 3 AS INT) AS s_nationkey"],
}


@pytest.mark.parametrize("name, source", [("directory_pages", "customer"), ("place_pages", "supplier"), ("feed_pages", "supplier")])
def test_pages_made_from_one_split_are_read_by_many_tasks(spark, tmp_path, name, source):
    spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "'Nation ' || id AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    # Rows repeat, and one has no key.
    rows = spark.range(0, 400, 1, 1).selectExpr("CASE WHEN id < 399 THEN id DIV 2 END AS id").selectExpr(*ROWS[source])
    rows.write.parquet(f"{tmp_path}/{source}.parquet")
    pages = table(spark, str(tmp_path), name).where("html NOT LIKE '%Another page%'")
    sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 200
    # A row without key has no nation here and makes no page.
    assert sum(sizes) == 399 and pages.distinct().count() == 200
