"""Line-first quality rules, as DataFrame expressions only.

Every line is judged by itself; lines that fail are dropped, and a document that would lose too much of its text is
rejected. Null and empty texts have no words: they fail the base rules and are rejected, never an error. Repeated rows are
judged row by row, extra columns are ignored by ``quality_report`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.common import WS, WS_RUN, table, words

#: Phrases that mark a line of up to MOST_BOILERPLATE words as boilerplate, compared in lower case.
BOILERPLATE = (
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum",
    "javascript is disabled", "enable javascript", "subscribe to our newsletter", "sign up for our", "click here to", "use of cookies",
    "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "cookies verwenden",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions générales",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal",
)
MOST_BOILERPLATE = 30
#: A document that loses more than this share of its words to failing lines is rejected.
MOST_LOST = 0.5
#: A line fails if over this share of its characters are symbols, or digits, or of its words are separators, or links.
MOST_SYMBOLS, MOST_DIGITS, MOST_SEPARATORS, MOST_LINKS = 0.1, 0.5, 0.25, 0.5
#: Words up to which a list entry is navigation, and a line that ends in an ellipsis is a teaser.
SHORT_ENTRY, SHORT_TEASER = 4, 10
SYMBOLS = "#*$%&|<>"
BULLET = r"^[\x20\x09-\x0D]*[•‣●○▪◦*-][\x20\x09-\x0D]"
LINK = r"(?:^|[\x20\x09-\x0D])(?:https?://|www\.)"
ELLIPSIS = r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a navigation, punctuation or boilerplate rule.

    Navigation: separators between words, short list entries, mostly links. Punctuation: many symbols, digits or exclamation
    marks, no letter at all, a short line that breaks off in an ellipsis. Each rule starts with a cheap search that a clean line
    fails, so that the costlier counts run on few lines.
    """
    n_words = F.size(F.split(F.btrim(line, F.lit(WS)), WS_RUN))
    separators = F.size(F.split(line, r"(?:^|[\x20\x09-\x0D])[|›»•·>]+(?=[\x20\x09-\x0D]|$)")) - 1
    navigation = line.rlike("[|›»•·>]") & (separators >= 2) & (separators >= n_words * MOST_SEPARATORS)
    entry = line.rlike(BULLET) & (n_words <= SHORT_ENTRY)
    links = line.rlike("://|www") & ((F.size(F.split(line, LINK)) - 1) > n_words * MOST_LINKS)
    symbols = line.rlike("[#*$%&|<>]") & ((F.length(line) - F.length(F.translate(line, SYMBOLS, ""))) > F.length(line) * MOST_SYMBOLS)
    digits = line.rlike("[0-9]") & ((F.length(line) - F.length(F.translate(line, "0123456789", ""))) > F.length(line) * MOST_DIGITS)
    shouting = F.contains(line, F.lit("!!")) & (n_words >= 4) & ((F.size(F.split(line, "!!+")) - 1) * 3 > n_words)
    teaser = line.rlike(ELLIPSIS) & (n_words <= SHORT_TEASER)
    return navigation | entry | links | symbols | digits | shouting | teaser | ~line.rlike(r"\p{L}") | (has_boilerplate(F.lower(line)) & (n_words <= MOST_BOILERPLATE))


def has_boilerplate(low: Column) -> Column:
    return reduce(or_, [F.contains(low, F.lit(x)) for x in BOILERPLATE])


def may_fail(text: Column, low: Column) -> Column:
    """False only if no line of the text can fail: each rule needs one of these marks."""
    return text.rlike(r"[|›»•·>#*$%&<…‣●○▪◦]|!!|\.\.\.|://|www\.|[0-9][^\n]*[0-9]|(?:^|\n)(?:[\x20\x09\x0B-\x0D]*-|[^\p{L}\n]*(?:\n|$))|^[0-9]") | has_boilerplate(low)


def _measured(docs: DataFrame) -> DataFrame:
    """Adds the base measures to (row, text); each select is a step that Catalyst evaluates once."""
    step = docs.select("row", "text", F.lower("text").alias("low"))
    step = step.select("row", "text", F.coalesce(may_fail(F.col("text"), F.col("low")), F.lit(False)).alias("may"), words(F.col("text")).alias("w"), F.split(F.coalesce("text", F.lit("")), "\n").alias("all_lines"))
    step = step.select("row", "text", "w", "may", F.filter("all_lines", lambda x: F.length(F.btrim(x, F.lit(WS))) > 0).alias("lines"))
    step = step.select("*", F.size("w").alias("n"), F.when(F.size("w") > 2, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("g"))
    step = step.select("*", (F.size(F.array_distinct("g")) < F.size("g")).alias("again"))
    # only texts in which a window repeats pay for more: equal hashes meet when sorted
    step = step.select("*", F.when(F.col("again"), F.sort_array("g")).alias("sorted"))
    step = step.select("*", F.array_distinct(F.filter("sorted", lambda h, k: (k > 0) & (h == F.get("sorted", k - 1)))).alias("twice"))
    # few repeated hashes are looked up at each place; many would make that quadratic, so there the places are sorted along
    step = step.select("*", F.when(F.size("twice") > 24, F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("hp"))
    here = lambda x, k: F.coalesce(F.get("hp", k)["h"] == x["h"], F.lit(False))
    few = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.array_contains("twice", F.get("g", i)))
    many = F.sort_array(F.transform(F.filter("hp", lambda x, k: here(x, k - 1) | here(x, k + 1)), lambda x: x["i"]))
    step = step.select("*", F.when(F.size("twice") > 24, many).when(F.col("again"), few).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    step = step.select("row", "text", "w", "lines", "n", "again", "at", F.when(F.col("may"), F.concat_ws("\n", F.filter("lines", line_fails))).otherwise("").alias("bad"))
    return step.select(
        "row", "text", "lines", "n",
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("dup_lines"),
        F.when(F.col("again"), covered).otherwise(0).cast("long").alias("repeat_words"),
        F.coalesce(F.size(words(F.col("bad"))), F.lit(0)).cast("long").alias("lost"),
    )


def judged(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, lines, measures, base_failed, kept): ``row`` packs all columns of docs, so that no name clashes."""
    measured = _measured(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")))
    base_failed = (F.col("n") < 50) | (F.col("repeat_words") * 100 > F.col("n") * 50)
    return measured.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & (F.col("lost") <= F.col("n") * MOST_LOST))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base measures, base_failed, kept and the words that failing lines hold.

    Null and empty texts: no words, zero measures, base_failed. A null id is passed on.
    """
    zero = F.lit(0).cast("long")
    return judged(docs, text_col).select(
        F.col("row")[id_col].alias("doc_id"), F.col("n").cast("long").alias("n_words"), F.coalesce("word_chars", zero).alias("word_chars"),
        F.coalesce("symbols", zero).alias("n_symbols"), "dup_lines", "repeat_words", "base_failed", "kept", F.col("lost").alias("n_lost"),
    ).withColumnsRenamed({"dup_lines": "n_dup_lines", "repeat_words": "n_repeat_words"})


def clean_documents(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents that are kept, with all their columns, without the lines that fail; chars_col follows the text.

    Null, empty and blank texts are rejected. Rows are judged one by one, so rows that repeat stay or go together; an empty table gives no
    rows; other columns pass as they are, whatever their names.
    """
    # a filter that the optimizer may move below the measures would repeat them inside itself; one on a value that is bound
    # to the running task stays where it is
    kept = judged(docs, text_col).withColumn("stays", F.col("kept") & (F.spark_partition_id() >= 0)).where("stays")
    rest = F.concat_ws("\n", F.filter(F.split("text", "\n"), lambda x: (F.length(F.btrim(x, F.lit(WS))) == 0) | ~line_fails(x)))
    kept = kept.select("row", F.when(F.col("lost") > 0, rest).otherwise(F.col("text")).alias("text"))
    new = {text_col: F.col("text")} | ({chars_col: F.length("text").cast(docs.schema[chars_col].dataType)} if chars_col in docs.columns else {})
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
