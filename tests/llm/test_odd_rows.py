"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each of the ten operators."""

import hashlib
import random

import pytest

from stockwright.llm import decontaminate, pieces, quality, secrets, sharding, simhash, substrings, suffixes, tokens, urls
from stockwright.llm.components import components
from tests.llm import brute

LONG = " ".join(f"w{i % 3001}x{i % 7}" for i in range(60_000))
#: Column names that the operators use inside, and one that differs from another in case only.
SCHEMA = "doc_id long, text string, lang string, row string, n int, f0 long, d long, did long, th long, spans string, key string, `first` string"
REST = ("en", "r", 1, 2, 3, 4, 5, "s", "k", "f")
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (None, None), (5, LONG), (6, LONG + " end"), (7, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *REST) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("a", "one two"), ("b", None), (None, "w0x0"), ("c", ""), ("a", "one two")], "item_id string, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_simhash(docs, none):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (None, 1), (5, 5), (6, 5), (7, 5)}
    assert simhash.near_duplicates(docs).count() == len(TEXTS) and rows(simhash.near_duplicates(none)) == []
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5] and rows(simhash.representatives(none)) == []


def test_substrings(docs, none):
    got = [(r.row.doc_id, r.n_words, r.n_removed) for r in substrings.without_repeats(docs).collect()]
    long = sorted(x for x in got if x[1] > 2)
    text = dict(TEXTS)
    want = [x[:3] for x in brute.without_windows([(5, text[5]), (6, text[6]), (7, text[7])])]
    assert long == want and len(got) == len(TEXTS)
    assert all(x[2] == 0 for x in got if x[1] <= 2) and rows(substrings.without_repeats(none)) == []


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(TEXTS) and {r.size for r in got if r.doc_id in (1, 2)} == {8}
    for s in {r["shard"] for r in got}:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r.doc_id in (5, 7)}) == 1 and rows(sharding.shard_documents(none, 4)) == []


def test_urls(spark):
    links = [("http://example.com/en/x", "http://a.org/"), ("http://a.org/", "http://b.org/p?q=1"), ("http://c.com/", "http://d.org/"), ("http://e.net/es/", "http://d.org/"), ("http://f.org/", None), ("http://g.org/", "http://g.org/")]
    node = urls.normal_url
    link = spark.createDataFrame(links, "x string, y string").select(node("x").alias("a"), node("y").alias("b"))
    pages = [(1, "https://A.org"), (2, "http://b.org/p?q=1#top"), (3, "http://d.org/"), (4, None), (5, "no address"), (6, "http://g.org"), (7, "http://example.com/en/x"), (7, "http://example.com/en/x"), (None, "http://www.example.com/en/"), (8, "")]
    page = spark.createDataFrame([(*p, "h", "o", "n", "s") for p in pages], "page_id long, url string, host string, own string, node string, spread string")
    want = [
        (1, "a.org", "", None, "block"), (2, "b.org", "/p", None, "block"), (3, "d.org", "/", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "g.org", "", None, "allow"),
        (7, "example.com", "/en/x", "example.com/en/", "block"), (7, "example.com", "/en/x", "example.com/en/", "block"), (None, "www.example.com", "/en/", "www.example.com/en/", "allow"), (8, "", "", None, "allow"),
    ]
    assert rows(urls.url_verdicts(page, link)) == sorted(want, key=repr)
    assert rows(urls.url_verdicts(page.limit(0), link)) == [] and urls.url_verdicts(page, link.limit(0)).where("verdict = 'block'").count() == 2


def test_links_of_pages(spark):
    html = [
        ("http://a.org/x/y", '<link rel="canonical" href="../z">'), ("http://b.org/x/y", "<LINK href='/z' REL=canonical>"), ("http://c.org/x/y", '<link rel="canonical" href="w">'),
        ("http://d.org/", '<meta http-equiv="refresh" content="0; url=http://e.org/n">'), ("http://f.org/", '<meta property="og:url" content="//h.org/q/">'), ("http://i.org/", '<link rel="stylesheet" href="/s.css">'), (None, '<link rel="canonical" href="/z">'), ("http://j.org/", None), ("http://k.org/", ""),
        ("http://l.org/a?x=1", "<link rel='alternate Canonical' href=?y=2&amp;z=3><link rel=canonical href=/q/./r/../s>"), ("http://m.org/a/b/c", '<meta content="3;URL=\'../../../d\'" http-equiv=Refresh>'), ("http://n.org/", "<!-- <link rel=canonical href=/no> --><link rel=canonical href=#top><link rel=canonical href=mailto:a@b><link data-href=/no rel=canonical href='HTTPS://N.org/yes/'>"),
        ("http://o.org/p", '<link rel="canonical" href="http://o.org/x/../p/#here">'), ("http://p.org/a/..", '<link rel="canonical" href="b/.">'),
    ]
    got = rows(urls.alias_links(spark.createDataFrame(html, "url string, html string")))
    assert got == [
        ("a.org/x/y", "a.org/z"), ("b.org/x/y", "b.org/z"), ("c.org/x/y", "c.org/x/w"), ("d.org", "e.org/n"), ("f.org", "h.org/q"),
        ("l.org/a?x=1", "l.org/a?y=2&z=3"), ("l.org/a?x=1", "l.org/q/s"), ("m.org/a/b/c", "m.org/d"), ("n.org", "n.org/yes"), ("p.org", "p.org/a/b"),
    ]


def test_components_are_those_of_brute_force(spark):
    r = random.Random(8)
    edges = [(f"n{r.randrange(150):03d}", f"n{r.randrange(150):03d}") for _ in range(110)] + [("hub", f"n{k:03d}") for k in range(0, 60)] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute.closed({x for e in real for x in e}, real)


def test_decisions_spread_over_declared_links(spark):
    """Pages with redirects and canonical links, and the verdicts that brute force gives them."""
    link = lambda to: f'<html><head><link rel="canonical" href="{to}"></head>'
    pages = [
        (1, "http://example.com/en/a", link("http://one.org/a")), (2, "http://one.org/a", "<p>"), (3, "http://two.org/b?x=1&y=2", link("http://one.org/c/../a")),
        (4, "http://three.org/", '<meta http-equiv=refresh content="0;url=http://two.org/b?x=1&amp;y=2">'), (5, "http://four.org/", link("http://a.com/")), (6, "http://five.net/es/x", link("http://four.org/")), (7, "http://six.org/", link("http://seven.org/")), (8, "http://www.example.com/en/z", link("http://one.org/a")),
    ]
    page = spark.createDataFrame(pages[:7], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.url_verdicts(page, urls.alias_links(page)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow"}
    page = spark.createDataFrame(pages, "page_id long, url string, html string")  # an explicit allow frees the aliases
    got = {r.page_id: r.verdict for r in urls.url_verdicts(page, urls.alias_links(page)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow"}


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.quality_report(docs).where("doc_id is not null").collect()}
    assert [got[k].n_words for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 2, 60_000] and [got[k].base_failed for k in (1, 2, 3, 4)] == [True] * 4
    assert got[1].word_chars == got[1].n_symbols == got[1].n_dup_lines == got[1].n_repeat_words == 0
    clean = quality.clean_documents(docs)
    assert clean.columns == docs.columns and rows(quality.clean_documents(none)) == [] == rows(quality.quality_report(none))


PROSE = {
    "en": "The old mill by the river was sold last year to a young couple from the town.", "de": "Die alte Mühle am Fluss wurde im letzten Jahr an ein junges Paar aus der Stadt verkauft.",
    "fr": "Le vieux moulin au bord de la rivière a été vendu l'an dernier à un jeune couple.", "es": "El viejo molino junto al río fue vendido el año pasado a una joven pareja.",
}
NOISE = {
    "en": ["Home | About | Contact", "All rights reserved.", "1234 5678", "Read more ..."], "de": ["Start » Über » Kontakt", "Alle Rechte vorbehalten.", "www.beispiel.de", "- Impressum"],
    "fr": ["Accueil › Nous › Contact", "Tous droits réservés.", "Lire la suite…", "• Aide"], "es": ["Inicio · Nosotros · Contacto", "Aviso legal y cookies", "¡¡ vale !! ahora !! ya !!", "99,90 $ %%%"],
}


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_line_rules_of_each_language(spark, lang):
    """Prose stays whole, noise goes line by line, a document that is mostly noise is rejected."""
    r, words = random.Random(2), PROSE[lang].rstrip(".").split()
    sentence = lambda: " ".join(r.sample(words, len(words))) + "."
    prose = [sentence() for _ in range(8)]
    long = sentence() + " privacy policy, alle Rechte vorbehalten, tous droits réservés, aviso legal " + " ".join(sentence() for _ in range(3))
    noise = NOISE[lang] * 12
    rows_ = [(1, "\n".join(prose)), (2, "\n".join([prose[0], *NOISE[lang], *prose[1:]])), (3, "\n".join([*[f"{x} {k}" if "|" in x else x for k, x in enumerate(noise)], PROSE[lang]])), (4, "\n".join([long, *prose]))]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_lost > 0) for r in quality.quality_report(docs).collect()}
    assert got[1] == (True, False) and got[2] == (True, True) and got[4] == (True, False) and got[3][0] is False
    clean = {r.doc_id: r.text for r in quality.clean_documents(docs).collect()}
    assert clean[2] == rows_[0][1] and clean[1] == rows_[0][1] and 3 not in clean


def test_pieces(docs, none):
    got = pieces.encoding_digest(docs).collect()
    assert len(got) == len(TEXTS) and {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2)} == {(0, sha(""), sha(""))}
    assert {r.decoded_sha256 for r in got if r.doc_id == 6} == {sha(LONG + " end")} and rows(pieces.encoding_digest(none)) == []
    whole = {r.doc_id: r for r in pieces.encode_documents(docs).where("doc_id > 0").collect()}
    assert whole[1].ids == [] and whole[1].decoded == "" and whole[5].decoded == LONG


def test_pieces_remembers_parts_that_come_again():
    """A worker without other stages knows 200,000 parts when they come again."""
    m = pieces.PieceModel(pieces.default_model(), pieces.PARTS)
    asked = []
    m.known.work = lambda part: asked.append(part) or ("1", 1, part)
    for _ in range(2):
        for k in range(200_000):
            m.known[str(k)]
    assert len(asked) == 200_000


def test_tokens(docs, none):
    got = {(r.doc_id, r.n_bytes, r.n_tokens > 0, r.over_limit) for r in tokens.count_tokens(docs).collect()}
    n = len(LONG)
    assert got == {(1, 0, False, False), (2, 0, False, False), (3, 4, False, False), (4, 7, True, False), (None, 7, True, False), (None, 0, False, False), (5, n, True, True), (6, n + 4, True, True), (7, n, True, True)}
    assert rows(tokens.count_tokens(none)) == []


def test_decontamination(docs, none, items):
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items).where("doc_id < 6").collect()}
    assert got == {(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 2, 2, 1, True), (5, 60_000, 0, 0, False)}
    assert rows(decontaminate.contamination(none, items)) == [] and decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 3


def test_secrets(spark, docs, none):
    assert {(r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.find_secrets(docs).collect()} == {(0, 0, 0, sha(""), "")}
    assert rows(secrets.find_secrets(none)) == [] and secrets.redact(docs).columns == docs.columns
    assert rows(secrets.redact(docs).select("doc_id", "text")) == rows(docs.select("doc_id", "text"))
    some = spark.createDataFrame([(1, "é password = hunter2 AKIA" + "A1" * 9)], "doc_id long, text string")
    assert secrets.find_secrets(some).first().spans == "assign:2:20,access:21:43"


def test_suffixes(docs, none):
    got = sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept).decode())) for r in suffixes.without_repeats(docs).collect() if r.row.doc_id)
    want = brute.without_bytes([(i, t) for i, t in TEXTS if i and i < 5]) + brute.without_bytes([(5, LONG), (6, LONG + " end"), (7, LONG)])
    assert got == sorted(want) and rows(suffixes.without_repeats(none)) == []
