"""Queries that take all rows of their inputs."""

from pyspark.sql import functions as F

from polisgrid.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_line_numbers_are_hits(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").join(spark.read.parquet(f"{SF}/supplier.parquet"), F.expr("l_suppkey = s_suppkey"))
    assert QUERIES["vertex_hits"](spark, SF).agg({"hits": "sum"}).first()[0] == 3 * lines.count()


def test_all_sites_are_entries(spark):
    got = {(r.source, r.site) for r in QUERIES["entry_coverage"](spark, SF).collect()}
    sites = [r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()]
    assert {(s, s) for s in sites} <= got
