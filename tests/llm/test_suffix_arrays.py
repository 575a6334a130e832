"""Suffix arrays against sorting; anchors whose neighbourhoods differ, few and very many, against brute force."""

import random

import pytest

from stockwright.llm import suffixes as S
from tests.llm import brute


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    r = random.Random(seed)
    n, kinds = r.randrange(1, 60), r.choice((1, 2, 3, 20))
    text = [r.randrange(1, kinds + 1) for _ in range(n)]
    if seed % 3 == 0:
        text = (text[: r.randrange(1, 5)] * n)[:n]
    text.append(0)
    assert S.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("seed", range(12))
def test_repeated_windows(seed):
    r = random.Random(seed)
    anchor = bytes(r.choice(b"xyz") for _ in range(S.ANCHOR))
    near = lambda n, base: bytes(c if r.random() < 0.99 else r.choice(b"ab") for c in base)[:n]
    bases = [(bytes(r.choice(b"ab\0") for _ in range(168)), bytes(r.choice(b"ab") for _ in range(168))) for _ in range(3)]
    left, right = [], []
    for _ in range(20):
        a, b = r.choice(bases)
        left.append(near(168, a)[168 - r.randrange(0, 169) :])
        right.append(anchor + near(r.randrange(0, 169), b))
    low, high = S.repeated_windows(left, right)
    for k in range(20):
        have = [x for x in range(169) if len(left[k]) >= x and len(right[k]) >= 200 - x]
        window = lambda j, x: left[j][len(left[j]) - x :] + right[j][: 200 - x]
        same = [x for x in have if any(j != k and len(left[j]) >= x and len(right[j]) >= 200 - x and window(j, x) == window(k, x) for j in range(20))]
        assert (low[k], high[k]) == ((same[0], same[-1]) if same else (-1, -1))


@pytest.mark.parametrize(("many_local", "most"), [(32, 4000), (2, 4000), (32, 3), (1, 1)])
def test_a_hot_anchor(spark, many_local, most):
    """A line that stands in all texts, with different neighbours: how an anchor is split changes nothing."""
    r = random.Random(6)
    footer = "This very line stands at the end of each of the texts, whatever they say before and after it, word by word."
    line = lambda n: "".join(r.choice("abcdefg ") for _ in range(n))
    some = [line(150) for _ in range(6)]
    docs = [(k, line(300) + r.choice(some)[: r.randrange(0, 150)] + footer + r.choice(some)[: r.randrange(0, 150)] + line(100)) for k in range(60)]
    docs += [(60, docs[0][1]), (61, "\u00e9" * 250), (62, "\u00e9" * 150), (63, None), (64, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((x.row.doc_id, x.n_bytes, x.n_removed, x.n_spans, brute.sha(bytes(x.kept))) for x in S.without_repeats(df, many_local=many_local, most=most).collect())
    assert got == brute.without_bytes(docs)
