"""The first ten queries against brute force over a whole small table (TEST_SF_DIR)."""

import os

import duckdb
import pandas as pd
import pytest

from stockwright.llm import registry
from tests.llm import brute

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{DIR}/documents.parquet")
    return sorted(zip(d.doc_id.tolist(), d.text.tolist(), strict=True))


def got(spark, name, *columns):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, DIR).select(*columns).collect())


def test_op1(spark, docs):
    assert got(spark, "op1_simhash_dedup", "doc_id", "fingerprint", "component_id") == sorted(brute.near_duplicates(docs))


def test_op2(spark, docs):
    assert got(spark, "op2_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == brute.without_windows(docs)


def test_op3(spark, docs):
    assert got(spark, "op3_sharding", "doc_id", "size", "text_crc32", "shard", "slot") == brute.sharded(docs)
    assert {tuple(r) for r in registry.QUERIES["op3_sharding"](spark, DIR).select("law", "grown_shard").collect()} == {("bytes", None)}


def test_op4(spark):
    pages = pd.read_parquet(f"{DIR}/pages.parquet")
    want = []
    for i, u in zip(pages.page_id.tolist(), pages.url.tolist(), strict=True):
        host, path = brute.parsed(u)
        rule = brute.rule(host, path)
        want.append((i, host, path, rule, brute.RULES.get(rule)))
    rows = got(spark, "op4_url_filters", "page_id", "host", "path", "rule", "verdict")
    assert [r[:4] for r in rows] == [w[:4] for w in want]
    assert all(r[4] == w[4] if w[4] else r[4] in ("allow", "block") for r, w in zip(rows, want, strict=True))


def test_op5(spark, docs):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(spark, "op5_quality_rules", *names) == brute.quality(docs)


def test_op6(spark, docs):
    assert got(spark, "op6_sentencepiece", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == brute.pieces(docs)


def test_op7(spark, docs):
    assert got(spark, "op7_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == brute.tokens(docs)


def test_op8(spark, docs):
    b = pd.read_parquet(f"{DIR}/benchmark.parquet")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got(spark, "op8_decontamination", *names) == brute.contamination(docs, list(zip(b.item_id.tolist(), b.text.tolist(), strict=True)))


def test_op9(spark, docs):
    assert got(spark, "op9_secret_scans", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == brute.secrets(docs)


def test_op10(spark, docs):
    assert got(spark, "op10_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.without_bytes(docs)


def sql_rows(df):
    # whole numbers beside nulls are floats in one of the frames
    cell = lambda v: "~" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    ours, theirs = registry.QUERIES[name](spark, DIR).toPandas(), con.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sql_rows(ours) == sql_rows(theirs)
