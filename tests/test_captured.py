"""Captured pages as a data source: rows, pushed filters, partitions of sites, and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from ratingloom.sources import captured


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("captures"))
    rows = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("s"), F.col("id") % 3, F.lit(".example")).alias("domain"), F.concat(F.lit("https://www.s"), F.col("id") % 3, F.lit(".example/p/"), "id").alias("url"), F.repeat(F.lit("x"), 10).alias("html"))
    rows.coalesce(1).write.partitionBy("domain").parquet(f"{place}/by_site")
    rows.drop("domain").repartitionByRange(3, "page_id").write.parquet(f"{place}/flat")
    captured.register(spark)
    return place


def read(spark, path):
    return spark.read.format("captured_pages").load(path)


@pytest.mark.parametrize("layout", ["by_site", "flat"])
def test_rows(spark, store, layout):
    got = read(spark, f"{store}/{layout}")
    assert got.columns == ["page_id", "domain", "url", "html"] and got.count() == 300
    assert got.filter("domain = 's1.example'").count() == 100 and got.filter("domain = 's1.example' and page_id > 200").count() == 33
    assert got.filter("domain in ('s0.example', 's2.example') and length(html) = 10").count() == 200 and got.filter("domain = 'none.example'").count() == 0


def test_filters_are_pushed(spark, store):
    plan = read(spark, f"{store}/by_site").filter("domain = 's1.example' and html like 'x%'")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith(html" in plan
    assert "domain#" not in plan.split("Filter", 1)[-1].split("\n")[0], "the filter on domain is the source's own"


def test_partitions_of_sites(store):
    reader = captured.CapturedReader(f"{store}/by_site")
    assert list(reader.pushFilters([EqualTo(("domain",), "s1.example"), EqualTo(("html",), "x")])) == [EqualTo(("html",), "x")]
    assert {captured.site_of(p.path) for p in reader.partitions()} == {"s1.example"}
    flat = captured.CapturedReader(f"{store}/flat")
    every = len(flat.partitions())
    assert list(flat.pushFilters([GreaterThan(("page_id",), 250)])) == [] and len(flat.partitions()) < every
    some = captured.CapturedReader(f"{store}/flat")
    assert list(some.pushFilters([In(("page_id",), (1, 2))])) == [] and len(some.partitions()) == 1
    assert sum(b.num_rows for p in some.partitions() for b in some.read(p)) == 2


def test_stream(spark, store, tmp_path):
    captured.register(spark)
    place = f"{tmp_path}/arrivals"
    one = read(spark, f"{store}/flat").filter("page_id < 10").drop("domain")
    one.write.mode("append").parquet(place)
    stream = spark.readStream.format("captured_pages").load(place).writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        stream.processAllAvailable()
        assert spark.table("arrived").count() == 10
        read(spark, f"{store}/flat").filter("page_id >= 290").drop("domain").write.mode("append").parquet(place)
        stream.processAllAvailable()
        assert spark.table("arrived").count() == 20 and spark.table("arrived").select("page_id").distinct().count() == 20
    finally:
        stream.stop()
