"""Queries whose lookups have no bound on lengths."""

from stockwright.operators import analysis
from stockwright.plans import catalogue


def test_keywords_of_any_number_of_lengths_match(spark):
    phrase = lambda n: " ".join([f"w{n}"] * n)
    keywords = spark.createDataFrame([(f"c{n}", n, phrase(n)) for n in range(1, 81)], "category string, place int, keyword string")
    items = spark.createDataFrame([(n, phrase(n), "") for n in range(1, 81)], "id int, name string, text string")
    got = {r.id: r.category for r in analysis.classify(items, keywords, "id", "name", "text").collect()}
    assert got == {n: f"c{n}" for n in range(1, 81)}


def test_file_key_of_a_very_long_url(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://" + "x" * 100_001 + "/a"), (2, "a/b")], "page_id long, url string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert {r.page_id: r.is_key for r in catalogue.QUERIES["p19_file_keys"](spark, str(tmp_path)).collect()} == {1: True, 2: True}
