"""Secret scans: fixed patterns, and values in credential contexts that a guesser would need long to find.

The cost of a value is the least product of guesses over all ways to cut it into known words, dates, repeats, keyboard walks,
character sequences and brute-force spans, found by dynamic programming from the value's end. Every span also costs the choice
of its kind. A walk, sequence or repeat goes on as far as the value does so. All of a value is cut, however long; the work
grows with its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.common import table
from stockwright.llm.pieces import SPACE, _fields, default_model

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: What stands before a value that is meant to be secret, in English, German, French and Spanish. The scheme of a header is passed over, and
#: counts by itself before what looks like a token; behind :// a value is a password only if @ follows, and no port with a path.
#: Words that prose uses otherwise, such as key, stand for a secret only together with another.
CONTEXT = re.compile(
    r"""\b(?:pass(?:phrase|code|word|wd)?|pwd|credentials?|auth(?:orization)?|bearer|private_?key|access_?key|secret(?:_?key)?|client_?secret|(?:auth|access|refresh)_?token|token|api_?key)"""
    r"""["']?(?:\x20*[:=]{1,2}\x20*|\x20is\x20)["']?(?:(?:bearer|basic)\x20+)?(?!(?:bearer|basic)(?:\s|$))"""
    r"""|\b(?:passwort|kennwort|(?:zugangs|geheimer\x20|api-)schl[üÜ]ssel|mot\x20de\x20passe|mdp|cl[éÉ]\x20(?:secr[èÈ]te|priv[éÉ]e|api|d['’]acc[èÈ]s)|contrase[ñÑ]a|clave\x20(?:secreta|privada|api|de\x20acceso))"""
    r"""["']?[\x20\u00a0\u202f]*[:=]{1,2}[\x20\u00a0\u202f]*["']?"""
    r"""|\bbearer\x20+(?=[A-Za-z0-9._~+/=-]{16})(?=[A-Za-z._~+/=-]*[0-9])"""
    r"""|(://)[^\s:/@"']+:(?!\d{1,5}/)""",
    re.I | re.A,
)
STOP = re.compile(r"""[\s"'<>,;@]""", re.A)
#: Cheap signs, in lower case, without which CONTEXT can't match.
SIGNS = (b"pass", b"pwd", b"credential", b"auth", b"bearer", b"key", b"secret", b"token", b"://", b"kennwort", b"schl\xc3", b"mdp", b"cl\xc3", b"contrase", b"clave ")
#: Least code points of a value, and log10 of the guesses from which it counts as a secret.
LEAST_VALUE, LEAST_LOG10 = 6, 8.0
#: Common words of passwords and prose in order of rank.
COMMON = (
    "password", "the", "and", "admin", "welcome", "login", "letmein", "qwerty", "secret", "test", "user", "guest", "root", "master", "hello",
    "love", "monkey", "dragon", "sun", "shine", "summer", "winter", "spring", "autumn", "default", "change", "changeme", "pass", "word", "example",
    "your", "here", "token", "key", "api", "none", "null", "true", "false", "required", "field", "reset", "forgot", "protected", "strong", "this", "that", "with", "for", "from",
)
#: Least letters of a word of the vocabulary, and the words that a dictionary may have: the most frequent ones.
LEAST_WORD, MOST_WORDS = 4, 50_000
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEIGHBOURS = {(a, b) for row in ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
NEIGHBOURS |= {p for up, low in zip(ROWS, ROWS[1:], strict=False) for i in range(len(low)) for j in (i, i + 1) if j < len(up) for p in ((up[j], low[i]), (low[i], up[j]))}
DATE = re.compile(r"(?:(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d)")
UNLEET = str.maketrans("4301$57@!", "aeoisstai")
#: A repeat is a unit of up to so many characters, again and again; longer ones are spans of their own.
UNIT = 16
#: log10 of the choice among the six kinds of spans, and of one between two, for upper case or other signs for letters.
KIND, TWO = math.log10(6), math.log10(2)


def vocabulary() -> list[str]:
    """COMMON, then the words of the encoder's vocabulary, frequent ones first."""
    with open(default_model(), "rb") as f:
        pieces = [dict(_fields(v))[1].decode() for field, v in _fields(f.read()) if field == 1]
    words = [p[1:].lower() for p in pieces if p.startswith(SPACE) and len(p) > LEAST_WORD and p[1:].isalpha()]
    return [*COMMON, *words]


def ranked_words(words: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """The ``most`` frequent words of a table (word, n), equally frequent ones in order, for a dictionary of one's own."""
    return [r.word for r in words.where("word is not null").orderBy(F.desc("n"), "word").select("word").limit(most).collect()]


def char_cost(c: str) -> float:
    """log10 of the choices for one character that nothing explains."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26 if c.islower() else 52)
    return math.log10(95) if c.isascii() else 3.0


def walk_cost(n: int) -> float:
    return math.log10(40) + n * 0.4


def sequence_cost(n: int) -> float:
    return math.log10(20) + math.log10(n)


def date_cost(n: int) -> float:
    return math.log10(365 * 60) if n > 4 else math.log10(120)


class Guesser:
    """Costs of values for a dictionary, whose words are in order of rank."""

    def __init__(self, words: Sequence[str]):
        self.cost = {w: math.log10(k + 2) for k, w in enumerate(dict.fromkeys(w.lower() for w in words if w))}
        self.finder = ahocorasick.Automaton()
        for w, c in self.cost.items():
            self.finder.add_word(w, (len(w), c))
        if self.cost:
            self.finder.make_automaton()

    def word_spans(self, value: str, low: str) -> list[list[tuple[int, float]]]:
        """For each place, the ends and costs of the known words there, upper case and signs for letters included."""
        out: list[list[tuple[int, float]]] = [[] for _ in value]
        plain = low.translate(UNLEET)
        for text, leet in ((low, False), (plain, True)) if self.cost else ():
            if leet and plain == low:
                break
            for last, (n, cost) in self.finder.iter(text):
                i, j = last + 1 - n, last + 1
                if leet and plain[i:j] == low[i:j]:
                    continue
                out[i].append((j, cost + leet * TWO + (TWO if value[i:j] != low[i:j] else 0.0)))
        return out

    def costs(self, value: str) -> list[float]:
        """log10 of the guesses for the value from each place to its end; 0 for nothing."""
        n = len(value)
        low = value.lower()
        if len(low) != n:  # a letter may become two
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        spans = self.word_spans(value, low)
        brute = [0.0]
        for c in value:
            brute.append(brute[-1] + char_cost(c))
        for i, j, own in repeats(value, brute):
            spans[i].append((j, own))
        best = [0.0] * (n + 1)
        behind = math.inf  # the least of best[j] + brute[j] over the ends j of a brute-force span
        walk, up, down = n, n, n  # where the walk, and the sequences, end that go on from a place
        for i in range(n - 1, -1, -1):
            behind = min(behind, best[i + 1] + brute[i + 1])
            least = behind - brute[i]
            for j, own in spans[i]:
                if (c := own + best[j]) < least:
                    least = c
            if i + 1 < n:
                a, b = low[i], low[i + 1]
                walk = walk if (a, b) in NEIGHBOURS else i + 1
                step = ord(b) - ord(a) if a.isalnum() and b.isalnum() else 0
                up, down = up if step == 1 else i + 1, down if step == -1 else i + 1
            if walk - i >= 3:
                least = min(least, walk_cost(walk - i) + best[walk])
            for j in (up, down):
                if j - i >= 3:
                    least = min(least, sequence_cost(j - i) + best[j])
            if value[i].isdigit() and (m := DATE.match(value, i)) and m.end() - i >= 4:
                least = min(least, date_cost(m.end() - i) + best[m.end()])
            best[i] = least + KIND
        return best


def repeats(value: str, brute: list[float]) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of repeats from each place: the same unit again and again costs one of them, times the count.

    A unit that is itself a repeat of a shorter one, which goes as far, is passed over: it costs no less.
    """
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    ends: dict[int, np.ndarray] = {}
    for unit in range(1, min(UNIT, n // 2) + 1):
        differ = np.append(codes[unit:] != codes[:-unit], True)
        place = np.where(differ, np.arange(len(differ)), n)
        run = np.minimum.accumulate(place[::-1])[::-1] - np.arange(len(differ))  # equal characters from here on
        count = run // unit
        end = np.arange(len(run)) + unit * (count + 1)
        valid = (count >= 1) & (unit * (count + 1) >= 3)
        ends[unit] = np.zeros(n, np.int64)
        ends[unit][: len(run)] = np.where(valid, end, 0)
        for d in range(1, unit):
            if unit % d == 0:
                valid &= ends[d][: len(run)] < end
        for i in np.flatnonzero(valid).tolist():
            yield i, int(end[i]), brute[i + unit] - brute[i] + math.log10(int(count[i]) + 2)


@lru_cache(maxsize=1)
def guesser() -> Guesser:
    """A worker's guesser with the default dictionary."""
    return Guesser(vocabulary())


def guess_cost(value: str) -> float:
    """log10 of the guesses for a value, by the default dictionary."""
    return guesser().costs(value)[0]


def context_values(text: str, costs: Guesser) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of every value in a credential context, in order; contexts inside a value count too.

    Values that end at one place share one pass, so that contexts within contexts don't cost more.
    """
    first = end = cut = -1
    known: list[float] = []
    for m in CONTEXT.finditer(text):
        a = m.end()
        if a >= end:
            stop = STOP.search(text, a)
            end = stop.start() if stop else len(text)
            first, cut, known = a, -1, []
        if m[1] and text[end : end + 1] != "@":
            continue
        if cut < 0:
            cut = first + len(text[first:end].rstrip(".,;:!?)]}"))
        if cut - a >= LEAST_VALUE:
            known = known or costs.costs(text[first:cut])
            yield a, cut, known[a - first]


def scanned(text: str, least: float = LEAST_LOG10, costs: Guesser | None = None) -> tuple[list[tuple[int, int, int]], list[float]]:
    """(start, kind, end) of all spans in code points, ordered by start, then kind; and the costs of all values in a context.

    A value in a context is a span if its cost is at least ``least``, be it part of another span or not; but a context inside
    such a value is part of it.
    """
    found, values = [], []
    raw = text.encode("utf-8", "surrogatepass").lower()
    near = any(k in raw for k in SIGNS)
    if near:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"akia" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if near:
        at = 0
        for a, b, cost in context_values(text, costs or guesser()):
            values.append(cost)
            if a >= at and cost >= least:
                found.append((a, 3, b))
                at = b
    return sorted(found), values


def spans_of(text: str, least: float = LEAST_LOG10, costs: Guesser | None = None) -> list[tuple[int, int, int]]:
    return scanned(text, least, costs)[0]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_FOUND = (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_values", "long"), ("most_log10", "double"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_LOG10, words: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_values, most_log10) of every document: the last two are the
    number of values in credential contexts, and the greatest log10 of their guesses, null without one.

    words: a dictionary in order of rank, MOST_WORDS at most; by default ``vocabulary``. Null texts are empty: no spans. Extra
    columns are dropped, repeated rows repeat, null ids pass, an empty table gives no rows.
    """
    if words is not None and len(words) > MOST_WORDS:
        raise ValueError(f"a dictionary may have {MOST_WORDS} words")
    held = None if words is None else docs.sparkSession.sparkContext.broadcast(list(words))
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = guesser() if held is None else Guesser(held.value)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                s, values = scanned(t, least, costs) if t else ([], [])
                kinds = [k for _, k, _ in s]
                base = written([x for x in s if x[1] < 3])
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), written(s), len(values), round(max(values), 6) if values else None))
            cols = list(zip(*out, strict=True)) or [[]] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, arrow[k]) for c, (_, k) in zip(cols, _FOUND, strict=True)]], names=["doc_id", *[n for n, _ in _FOUND]])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(work, ", ".join([f"doc_id {texts.schema['doc_id'].dataType.simpleString()}", *[f"{n} {k}" for n, k in _FOUND]]))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]", least: float = LEAST_LOG10) -> DataFrame:
    """The documents with all their columns, each secret replaced by ``mark``; chars_col follows the text. Null texts stay null.

    Rows are judged one by one, so rows that repeat stay and are cut alike; an empty table gives no rows; other columns pass as they are.
    """

    def cut(t: str) -> str:
        out, at = [], 0
        for a, _, b in spans_of(t, least):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t) if t else t for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    done = packed.mapInArrow(work, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    new: dict[str, Column] = {text_col: F.col("text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("text") == F.col("row")[text_col], F.col("row")[chars_col]).otherwise(F.length("text").cast(docs.schema[chars_col].dataType))
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
