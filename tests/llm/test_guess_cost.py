"""Guess costs against all cuts of short values, their growth, and planted secrets of every kind."""

import itertools
import math
import random
import time

import pytest

from stockwright.llm import secrets as S

WORDS = ("sun", "shine", "ab", "password", "a1")


def own_costs(value, words):
    """{(i, j): the least cost of value[i:j] as one span}, kind by kind."""
    n, low = len(value), "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(S.UNLEET)
    out = {}

    def offer(i, j, c):
        out[i, j] = min(c, out.get((i, j), math.inf))

    for i, j in itertools.combinations(range(n + 1), 2):
        offer(i, j, sum(map(S.char_cost, value[i:j])))
        upper = S.TWO if value[i:j] != low[i:j] else 0.0
        for k, w in enumerate(words):
            if low[i:j] == w:
                offer(i, j, math.log10(k + 2) + upper)
            elif plain[i:j] == w:
                offer(i, j, math.log10(k + 2) + S.TWO + upper)
        for unit in range(1, min(S.UNIT, (j - i) // 2) + 1):
            times, rest = divmod(j - i, unit)
            if not rest and j - i >= 3 and value[i:j] == value[i : i + unit] * times and value[j : j + unit] != value[i : i + unit]:
                offer(i, j, sum(map(S.char_cost, value[i : i + unit])) + math.log10(times + 1))
    for i in range(n):
        for step in (1, -1, "walk"):
            goes = lambda k: (low[k], low[k + 1]) in S.NEIGHBOURS if step == "walk" else low[k].isalnum() and low[k + 1].isalnum() and ord(low[k + 1]) - ord(low[k]) == step
            j = i + 1
            while j < n and goes(j - 1):
                j += 1
            if j - i >= 3:
                offer(i, j, S.walk_cost(j - i) if step == "walk" else S.sequence_cost(j - i))
        if (m := S.DATE.match(value, i)) and m.end() - i >= 4:
            offer(i, m.end(), S.date_cost(m.end() - i))
    return out


def least_of_all_cuts(value, words):
    own, n = own_costs(value, words), len(value)
    best = math.inf
    for cuts in itertools.product((0, 1), repeat=n - 1):
        ends = [0, *[k + 1 for k, c in enumerate(cuts) if c], n]
        best = min(best, sum(own[i, j] + S.KIND for i, j in zip(ends, ends[1:], strict=False)))
    return best


def values():
    r = random.Random(11)
    fixed = ["sunshine1", "SunSh1ne99", "aaaaaaa", "abababab", "qwerty", "asdf1234", "2024-01-15", "x1x1x1", "abcabcab", "zyxw", "P@ssword", "\u00e9\u00e9\u00e9", "İİİab", "1999", "a", "19991999", "abcdefgfedc"]
    return fixed + ["".join(r.choice("ab1S2s") for _ in range(r.randrange(1, 11))) for _ in range(60)]


@pytest.mark.parametrize("value", values())
def test_cost_is_the_least_of_all_cuts(value):
    assert S.Guesser(WORDS).costs(value)[0] == pytest.approx(least_of_all_cuts(value, WORDS))


def test_costs_of_ends_are_those_of_the_ends_alone():
    costs = S.guesser().costs("password=hunter2xkqj")
    assert all(costs[k] == pytest.approx(S.guess_cost("password=hunter2xkqj"[k:])) for k in range(19)) and costs[-1] == 0


@pytest.mark.parametrize("value", ["1" * 100_000, "x1" * 50_000, "q8Zk-w3Xv_" * 10_000, "password" * 12_500, "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000))])
def test_a_very_long_value_is_whole_and_linear(value):
    S.guesser()
    began = time.process_time()
    assert S.guess_cost(value) > 0
    assert time.process_time() - began < 4  # about 0.5 s on a machine of usual speed


def test_contexts_within_contexts_share_one_pass():
    text = "token=" * 20_000 + "end"
    began = time.process_time()
    values = list(S.context_values(text, S.guesser()))
    assert len(values) == 20_000 - 1 and time.process_time() - began < 20  # the last value is too short


def test_every_context_value_is_scored_and_planted_secrets_are_found(spark):
    texts = [
        "api_key = 'Zk8vQ2mX7pLw3'", "AKIA" + "Q7" * 8, "sha " + "0a1b" * 6, "passphrase: qvzkwxjmpbtrhlfd", "password: changeme", None, "", "no secret here",
        "pwd=Qv7-zKw3!xJ9 and token: 8f3kQz9LmW2x", "x" * 300_000 + " secret=" + "Zq9" * 20_000,
    ]
    got = {r.doc_id: r for r in S.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    assert got[0].spans == "assign:0:24,guess:11:24" and got[1].spans == "access:0:20" and got[2].spans == "hex:4:28" and got[3].spans == "guess:12:28"
    assert (got[4].spans, got[4].n_values) == ("assign:0:18", 1) and got[4].most_log10 < 8
    assert [(got[k].spans, got[k].n_values, got[k].most_log10) for k in (5, 6, 7)] == [("", 0, None)] * 3
    assert got[8].spans == "guess:4:16,assign:21:40,guess:28:40" and got[8].n_values == 2
    assert got[9].n_assign == 1 and got[9].most_log10 is not None


def test_a_dictionary_of_ones_own(spark):
    counts = spark.createDataFrame([("vorbelian", 9), ("zug", 9), ("rare", 1), (None, 99)], "word string, n long")
    assert S.ranked_words(counts, 2) == ["vorbelian", "zug"]
    docs = spark.createDataFrame([(1, "passphrase: vorbelianzugvorbelian")], "doc_id long, text string")
    assert S.find_secrets(docs).first().spans != "" and S.find_secrets(docs, words=["vorbelian", "zug"]).first().spans == ""
    with pytest.raises(ValueError):
        S.find_secrets(docs, words=["w"] * (S.MOST_WORDS + 1))
