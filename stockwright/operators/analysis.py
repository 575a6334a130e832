"""Facets, identity resolution, keyword classes and scores."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwright.functions.text import LARGE_WIDTH, gtin, image_url, query_pairs


def facets(filtered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n): the distinct non-null values of several columns, in one pass over the rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    return filtered.select(pairs).where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def resolve(candidates: DataFrame, by_gtin: DataFrame, by_url: DataFrame, by_number: DataFrame) -> DataFrame:
    """Each candidate (candidate_id, gtin, url, manufacturer, number) with the part it names and whether its identifiers disagree.

    by_gtin (gtin, id), by_url (url, id), by_number (manufacturer, number, id): the least id wins in each; a GTIN beats a url,
    which beats the manufacturer's number.
    """
    df = candidates.join(by_gtin.groupBy("gtin").agg(F.min("id").alias("g")), "gtin", "left")
    df = df.join(by_url.groupBy("url").agg(F.min("id").alias("u")), "url", "left")
    df = df.join(by_number.groupBy("manufacturer", "number").agg(F.min("id").alias("m")), ["manufacturer", "number"], "left")
    distinct = F.size(F.array_distinct(F.array_compact(F.array("g", "u", "m"))))
    return df.select("candidate_id", F.coalesce("g", "u", "m").alias("part_id"), (distinct > 1).alias("conflict"))


# Keywords of a category that don't count where the text about them speaks of something else.
EXCEPT = (
    ("wheels", ("wheel", "wheels"), ("steering wheel", "steering wheels", "wheel cleaner", "wheel polish", "wheel wax")),
    ("suspension", ("spring", "springs"), ("valve spring", "valve springs")),
    ("body", ("license plate",), ("license plate frame", "license plate relocator")),
)
_TOKEN = r"(?U)\w+|\W+"


def classify(items: DataFrame, keywords: DataFrame | Sequence[tuple[str, int, str]], key: str, name: str, text: str, other: str = "other", exceptions: Sequence = EXCEPT, most_keywords: int = 20_000) -> DataFrame:
    """(key, category): twice the distinct keywords found in the name plus those in the text; the first category of the best
    score, ``other`` where none is found, null where both texts are blank.

    keywords (category, place, keyword) are matched as whole words or phrases that begin and end with a letter, digit or
    underscore. exceptions (category, its keywords, phrases): these don't count where name or text hold one of the phrases.
    Items are cut into word runs that meet the keywords by equality, so that the work follows the text and not items times
    keywords. Up to most_keywords are broadcast, more are joined by a shuffle.
    """
    spark = items.sparkSession
    kind = "category string, place int, keyword string"
    if isinstance(keywords, DataFrame):
        first = keywords.select("category", "place", "keyword").limit(most_keywords + 1).collect()
        few = len(first) <= most_keywords
    else:
        first, few = list(keywords), len(keywords) <= most_keywords
    table = spark.createDataFrame([tuple(r) for r in first], kind) if few or not isinstance(keywords, DataFrame) else keywords
    kw = table.select("category", "place", F.lower("keyword").alias("keyword")).distinct()
    if few or not isinstance(keywords, DataFrame):
        lengths = sorted({len(re.findall(r"\w+", r[2])) for r in first})
    else:
        lengths = sorted(r[0] for r in kw.select(F.size(F.regexp_extract_all("keyword", F.lit(r"(?U)\w+"), 0))).distinct().collect())

    def runs(c: str) -> Column:
        # words at even places, what is between them at odd ones
        tokens = F.regexp_extract_all(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"(?U)^\W+", ""), F.lit(_TOKEN), 0)
        n_words = F.floor((F.size(tokens) + 1) / 2).cast("int")

        def of(n: int) -> Column:
            made = F.transform(F.sequence(F.lit(0), n_words - n), lambda i: F.array_join(F.slice(tokens, 2 * i + 1, 2 * n - 1), ""))
            return F.when(n_words >= n, made).otherwise(F.array().cast("array<string>"))

        made = [of(n) for n in lengths if n]
        return F.array_distinct(F.concat(*made)) if made else F.array().cast("array<string>")

    both = F.lower(F.concat_ws(" ", name, text))
    said = F.array(*[F.when(reduce(or_, [F.contains(both, F.lit(p)) for p in phrases]), F.lit(c)) for c, _, phrases in exceptions]) if exceptions else F.array().cast("array<string>")
    found = items.select(key, F.array_compact(said).alias("said"), F.explode(F.array(F.struct(F.lit(2).alias("weight"), runs(name).alias("r")), F.struct(F.lit(1).alias("weight"), runs(text).alias("r")))).alias("x"))
    found = found.select(key, "said", "x.weight", F.explode("x.r").alias("keyword")).join(F.broadcast(kw) if few else kw, "keyword")
    for c, words, _ in exceptions:
        found = found.where(~((F.col("category") == c) & F.col("keyword").isin(*words) & F.array_contains("said", c)))
    scored = found.groupBy(key, "category", "place").agg(F.sum("weight").alias("score"))
    best = scored.groupBy(key).agg(F.max_by("category", F.struct("score", -F.col("place"))).alias("category"))
    blank = (F.trim(F.coalesce(name, F.lit(""))) == "") & (F.trim(F.coalesce(text, F.lit(""))) == "")
    return items.select(key, blank.alias("_blank")).join(best, key, "left").select(key, F.when(~F.col("_blank"), F.coalesce("category", F.lit(other))).alias("category"))


def multiset_score(predicted: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True positives, precision, recall and F1 of two multisets; 0 where a ratio has no denominator."""
    keys = list(keys)
    p, t = predicted.groupBy(*keys).agg(F.count("*").alias("n_p")), truth.groupBy(*keys).agg(F.count("*").alias("n_t"))
    both = p.join(t, keys, "full_outer").agg(F.sum(F.least(F.coalesce("n_p", F.lit(0)), F.coalesce("n_t", F.lit(0)))).alias("tp"), F.sum("n_p").alias("np"), F.sum("n_t").alias("nt"))
    return ratios(both.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "np", "nt")]))


def value_score(joined: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Scores over the rows whose truth is known: precision over those predicted, recall over all."""
    known = joined.where(F.col(truth).isNotNull())
    return ratios(known.agg(F.count_if(F.col(predicted) == F.col(truth)).alias("tp"), F.count(predicted).alias("np"), F.count("*").alias("nt")))


def micro_score(predicted: DataFrame, truth: DataFrame, entity: str, keys: Sequence[str]) -> DataFrame:
    """Scores of many multisets, one for each entity, by the sums of their counts; entities of either side are the sample."""
    scores = multiset_score(predicted, truth, [entity, *keys])
    sample = predicted.select(entity).unionByName(truth.select(entity)).agg(F.countDistinct(entity).alias("sample_size"))
    return sample.join(F.broadcast(scores))  # two single rows


def verified_counts(expected: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """(name, expected, found, ok) from two tables (name, n); a missing one counts as none."""
    e, f = expected.select(name, F.col("n").alias("expected")), found.select(name, F.col("n").alias("found"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return e.join(f, name, "full_outer").select(name, n("expected").alias("expected"), n("found").alias("found"), (n("expected") == n("found")).alias("ok"))


def crawl_rates(processed: Column, total: Column, seconds: Column) -> Column:
    """struct<percent, per_minute, eta_seconds>, rounded halves up; 0 where there is nothing to divide by."""
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    percent = F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), half_up(processed / total * 100)))).otherwise(0).cast("long")
    rate = F.when(seconds > 0, half_up(processed / seconds * 60)).otherwise(0)
    left = F.when(total > 0, F.greatest(F.lit(0), total - processed)).otherwise(0)
    eta = F.when((rate > 0) & (left > 0), half_up(left / rate * 60)).otherwise(0)
    return F.struct(percent.alias("percent"), rate.alias("per_minute"), eta.alias("eta_seconds"))


def by_gtin(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """(candidate_id, part_id): the canonical part with the candidate's GTIN, digits only; a part that is stored with just
    these digits comes before one that is stored in another form, then the least id. candidates (candidate_id, gtin), parts
    (id, gtin, canonical_part_id).
    """
    canon = parts.where("canonical_part_id is null").select(gtin(F.col("gtin")).alias("k"), "id", F.col("gtin").alias("stored")).where("k is not null")
    best = canon.groupBy("k").agg(F.min_by("id", F.struct(F.col("stored") != F.col("k"), F.col("id"))).alias("part_id"))
    return candidates.select("candidate_id", gtin(F.col("gtin")).alias("k")).join(best, "k", "left").select("candidate_id", "part_id")


def owned_by_url(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """(candidate_id, part_id): the creator's own part of least id that is listed at the candidate's url; it bars a new one.
    candidates (candidate_id, user_id, url), listed (url, user_id, id).
    """
    own = listed.where("url is not null").groupBy("user_id", F.trim("url").alias("u")).agg(F.min("id").alias("part_id"))
    return candidates.select("candidate_id", "user_id", F.nullif(F.trim("url"), F.lit("")).alias("u")).join(own, ["user_id", "u"], "left").select("candidate_id", "part_id")


def retailer_of(candidates: DataFrame, retailers: DataFrame) -> DataFrame:
    """(candidate_id, retailer_id, action): by domain as given, then with or without www., then by name; ``found``,
    ``backfilled`` where the retailer of that name had no domain, ``created`` where there is none.
    candidates (candidate_id, name, domain), retailers (retailer_id, name, domain).
    """
    own = F.nullif(F.lower(F.trim("domain")), F.lit(""))
    stored = retailers.where("domain is not null").groupBy(F.lower("domain").alias("v")).agg(F.min("retailer_id").alias("at"))
    asked = candidates.select("candidate_id", F.lower(F.trim("name")).alias("n"), own.alias("d"))
    other = F.when(F.startswith("d", F.lit("www.")), F.expr("substring(d, 5)")).otherwise(F.concat(F.lit("www."), F.col("d")))
    spelled = asked.where("d is not null").select("candidate_id", F.posexplode(F.array("d", other)).alias("place", "v"))
    by_domain = spelled.join(stored, "v").groupBy("candidate_id").agg(F.min_by("at", "place").alias("at"))
    by_name = retailers.groupBy(F.lower("name").alias("n")).agg(F.min(F.struct("retailer_id", "domain")).alias("r"))
    df = asked.join(by_domain, "candidate_id", "left").join(by_name, "n", "left")
    fills = F.col("at").isNull() & F.col("r").isNotNull() & F.col("d").isNotNull() & F.col("r.domain").isNull()
    found = F.coalesce(F.col("at"), F.col("r.retailer_id"))
    return df.select("candidate_id", found.alias("retailer_id"), F.when(found.isNull(), "created").when(fills, "backfilled").otherwise("found").alias("action"))


def _least_two(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, least, next): the least id and the least other one of rows with the same identifiers; next is null if there is none."""
    known = stored.where(reduce(and_, [F.col(k).isNotNull() for k in ["id", *by]])).select(*by, "id")
    least = known.groupBy(*by).agg(F.min("id").alias("least"))
    rest = known.join(least, [*by]).where("id > least").groupBy(*by).agg(F.min("id").alias("next"))
    return least.join(rest, [*by], "left")


def identifier_conflicts(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """(candidate_id, identifier, existing_id) of candidates with an identifier that a stored part of another id has: gtin
    before manufacturer_part_number, then the least id. Both tables have (id, gtin, manufacturer, number), null where unknown.

    A candidate meets the two least ids of its identifier, of which one at least isn't its own, and not all that share it.
    """
    c = candidates.where("id is not null").select(F.col("id").alias("candidate_id"), "gtin", "manufacturer", "number")
    g = c.join(_least_two(stored, ["gtin"]), ["gtin"]).select("candidate_id", F.lit(0).alias("place"), "least", "next")
    m = c.join(_least_two(stored, ["manufacturer", "number"]), ["manufacturer", "number"]).select("candidate_id", F.lit(1).alias("place"), "least", "next")
    other = F.when(F.col("least") != F.col("candidate_id"), F.col("least")).otherwise(F.col("next"))
    first = g.unionByName(m).select("candidate_id", "place", other.alias("id")).where("id is not null").groupBy("candidate_id").agg(F.min(F.struct("place", "id")).alias("x"))
    return first.select("candidate_id", F.when(F.col("x.place") == 0, "gtin").otherwise("manufacturer_part_number").alias("identifier"), F.col("x.id").alias("existing_id"))


def images_to_fetch(items: DataFrame, cached: DataFrame, key: str, urls: str, most: int = 12) -> DataFrame:
    """(key, image): of the first ``most`` urls of an item, the widest of each canonical address, the first of equals, at the
    address of its large form, unless the canonical address is in cached (canonical).
    """
    some = items.select(key, F.posexplode(F.slice(urls, 1, most)).alias("place", "url")).where("url is not null and trim(url) <> ''")
    width = F.coalesce(F.get(F.filter(query_pairs(F.col("url"), ()), lambda p: p["k"] == "width"), 0)["v"].try_cast("int"), F.lit(0))
    widest = some.groupBy(key, image_url(F.col("url")).alias("canonical")).agg(F.max_by("url", F.struct(width, -F.col("place"))).alias("url"))
    return widest.join(cached, "canonical", "left_anti").select(key, image_url(F.col("url"), LARGE_WIDTH).alias("image"))


def ratios(counts: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, n_p, n_t = F.col("tp"), F.col("np"), F.col("nt")
    df = counts.select(tp.alias("true_positives"), div(tp, n_p).alias("precision"), div(tp, n_t).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


# What a baseline of scores must have.
SIGNALS, HARNESS_VERSION, METRICS = ("car", "manufacturer", "category"), 1, ("precision", "recall", "f1")


def baseline_violations(baselines: DataFrame) -> DataFrame:
    """baselines, texts of JSON objects in ``json``, with ``violations``: what keeps each from being compared with, in order; none if it is well.

    Required are harness_version, signal, sample_size and generated_at, and the metrics, numbers from 0 to 1; an integer isn't a boolean,
    a text or a number with a point.
    """
    fields = ("harness_version", "signal", "sample_size", "generated_at", *METRICS)
    parsed = baselines.withColumn("_v", F.try_parse_json("json"))
    of = lambda k: F.try_variant_get("_v", f"$.{k}", "variant")
    # each field's value and its type, as the text of JSON has them
    read = [F.struct(F.regexp_extract(F.schema_of_variant(of(k)), "^[A-Z]+", 0).alias("kind"), of(k).alias("value")).alias(f"_{k}") for k in fields]
    parsed = parsed.select(*baselines.columns, F.schema_of_variant("_v").alias("_kind"), *read)
    kind = lambda k: F.col(f"_{k}.kind")
    number = lambda k: F.try_variant_get(f"_{k}.value", "$", "double")
    text = lambda k: F.try_variant_get(f"_{k}.value", "$", "string")
    absent = lambda k: F.coalesce(kind(k), F.lit("VOID")).isin("VOID", "")
    tests = [(F.coalesce(~F.startswith("_kind", F.lit("OBJECT")), F.lit(True)), "not an object")]
    tests += [(absent(k), f"{k} missing") for k in fields]
    tests += [(~absent(k) & (kind(k) != "BIGINT"), f"{k} no integer") for k in ("harness_version", "sample_size")]
    tests += [((kind("harness_version") == "BIGINT") & (number("harness_version") != HARNESS_VERSION), "harness_version differs")]
    tests += [(~absent("signal") & ~F.coalesce((kind("signal") == "STRING") & text("signal").isin(*SIGNALS), F.lit(False)), "signal unknown")]
    tests += [((kind("sample_size") == "BIGINT") & (number("sample_size") < 0), "sample_size negative")]
    tests += [(~absent("generated_at") & ~F.coalesce((kind("generated_at") == "STRING") & (text("generated_at") != ""), F.lit(False)), "generated_at no time")]
    numeric = lambda k: kind(k).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    tests += [(~absent(k) & ~F.coalesce(numeric(k) & number(k).between(0, 1), F.lit(False)), f"{k} not in [0, 1]") for k in METRICS]
    return parsed.select(*baselines.columns, F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(w)) for t, w in tests])).alias("violations"))
