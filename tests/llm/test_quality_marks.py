"""The quick test for lines that may fail never passes over a line that does."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockwright.llm import quality as Q

PIECES = ["word", "Été", "12", "7", "|", "›", "•", "-", "*", "#", "!!", "!!!", "...", "…", "https://a.b/c", "www.x.org", " ", "  ", "\t", "\x0b", "1234567", "$%", "Privacy Policy", "alle rechte vorbehalten", "é.", "—", "¡", "○ a", "&", "3a", "\u00a0"]


def fails_and_may(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    lines = df.select("i", F.explode(F.split("t", "\n")).alias("l")).where(F.length(F.btrim("l", F.lit(Q.WS))) > 0)
    bad = {r.i for r in lines.where(Q.line_fails(F.col("l"))).select("i").distinct().collect()}
    may = {r.i for r in df.where(Q.may_fail(F.col("t"), F.lower("t"))).collect()}
    return bad, may


def test_made_lines(spark):
    r = random.Random(3)
    texts = ["\n".join("".join(r.choice((" ", "")) + r.choice(PIECES) for _ in range(r.randrange(0, 9))) for _ in range(r.randrange(1, 4))) for _ in range(4000)]
    bad, may = fails_and_may(spark, texts)
    assert len(bad) > 500 and bad <= may and len(may) < len(texts)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=25), min_size=50, max_size=120))
def test_any_lines(spark, texts):
    bad, may = fails_and_may(spark, texts)
    assert bad <= may
