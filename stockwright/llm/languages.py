"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters, of letters only with one space between words, are hashed into a fixed number of features. Document
frequencies are counted over all training documents. Weights are learned by follow-the-regularised-leader with an elastic net, which
leaves most of them zero, on a bounded sample of the training documents; a temperature is then fitted on the rest of that sample.
A feature's value is its share of the text's n-grams times its inverse document frequency, so that a text's scores are sums over its
n-grams, whatever its length, and are made in bounded steps over the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.common import WS, let_go, mixed, table

#: Hashed features, and the longest n-gram.
FEATURES, LONGEST = 1 << 16, 3
#: Training documents that the weights and the temperature are fitted on: about so many in all, the same number of each language.
SAMPLE = 6000
#: Of the sample, one in so many documents is for the temperature, whole and as a piece of so many words: short texts shall be calibrated too.
HELD_BACK, PIECE = 5, 3
UNKNOWN = "und"
#: Learning rate and its offset, the two penalties, passes over the sample, and what feature values are multiplied by.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.1, 1.0, 0.02, 0.1, 4, 10.0
#: Characters that one vectorised step works on.
STEP = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _slices(text: str) -> Iterator[str]:
    """A long text in slices of up to STEP characters, cut at spaces where there are any."""
    at = 0
    while at < len(text):
        end = at + STEP
        if end < len(text):
            space = text.rfind(" ", at + STEP // 2, end)
            end = space if space > 0 else end
        yield text[at:end]
        at = end


def _spelled(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of the texts with one space between words and around each text, and where each text begins."""
    lowered = [f" {t.lower()} " for t in texts]
    points = _points("".join(lowered))
    starts = np.cumsum([0, *map(len, lowered)])
    points = np.where(_letters()[points], points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[starts[:-1]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], before[starts]


def _grams(points: np.ndarray, starts: np.ndarray, features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, the features of all n-grams that lie in one text, and where each text's begin."""
    code = points.astype(np.uint64) + np.uint64(1)
    acc, sizes = code, np.diff(starts)
    for n in range(1, LONGEST + 1):
        if n > 1:
            acc = acc[:-1] * np.uint64(0x200003) + code[n - 1 :] if len(acc) else acc
        inside = np.ones(len(acc), bool)
        for k in range(1, n):  # the last n - 1 places of a text begin none
            ends = starts[1:] - k
            inside[ends[(ends >= starts[:-1]) & (ends < len(acc))]] = False
        yield (mixed(acc[inside] + np.uint64(n << 56)) % np.uint64(features)).astype(np.int32), np.cumsum([0, *np.maximum(sizes - n + 1, 0)])


def _by_text(texts: list[str], features: int) -> Iterator[np.ndarray]:
    """The features of each text, one for each n-gram; texts are short enough for one step."""
    parts = list(_grams(*_spelled(texts), features))
    for i in range(len(texts)):
        yield np.concatenate([f[s[i] : s[i + 1]] for f, s in parts])


def _steps(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) in steps; a text longer than a step comes in slices, each a step of its own."""
    at, some, size = 0, [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > STEP:
            yield at, some
            some, size = [], 0
        if len(t) > STEP:
            for s in _slices(t):
                yield i, [s]
        else:
            at = at if some else i
            some.append(t)
            size += len(t)
    if some:
        yield at, some


def counted(text: str, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text and how often each occurs."""
    total = None
    for _, some in _steps([text]):
        f = next(_by_text(some, features))
        if total is None and len(text) <= STEP:
            return np.unique(f, return_counts=True)
        total = np.bincount(f, minlength=features) + (0 if total is None else total)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


def document_frequencies(docs: DataFrame, text_col: str = "text", features: int = FEATURES) -> np.ndarray:
    """In how many documents each feature occurs, over all rows; as many numbers as features come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(features, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found[counted(t or "", features)[0]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], names=["feature", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(features)
    out[rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Weights by feature and language, the inverse document frequencies already in them; intercepts; temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of each text and its calibrated probability; without a letter, or with nothing learned, unknown."""
        k = len(self.languages)
        sums, sizes = np.zeros((len(texts), k)), np.zeros(len(texts))
        for at, some in _steps(texts):
            for f, starts in _grams(*_spelled(some), len(self.weights)):
                # sums of each text's rows by differences of running sums, in double precision
                upto = np.concatenate([np.zeros((1, k)), np.cumsum(self.weights[f], axis=0, dtype=np.float64)])
                sums[at : at + len(some)] += upto[starts[1:]] - upto[starts[:-1]]
                sizes[at : at + len(some)] += np.diff(starts)
        scores = (SCALE * sums / np.maximum(sizes, 1)[:, None] + self.intercepts) / self.temperature
        best = scores.argmax(axis=1) if k else np.zeros(len(texts), int)
        shares = np.exp(scores - scores.max(axis=1, keepdims=True)) if k else scores
        return [(self.languages[b], float(s[b] / s.sum())) if k and _has_letter(t) else (UNKNOWN, 0.0) for t, b, s in zip(texts, best.tolist(), shares, strict=True)]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def leader_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, k: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (features + 1, k), the last row the intercepts, of the regularised leader after some passes over rows (features, values, class).

    A coordinate whose gradients sum to no more than l1 stays zero; its learning rate falls with its own gradients.
    """
    z, n = np.zeros((features + 1, k)), np.zeros((features + 1, k))

    def leader(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            f, x, y = rows[r]
            f, x = np.append(f, features), np.append(x, 1.0)
            w = leader(f)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - s * w
            n[f] += g * g
    return leader(np.arange(features + 1))


def fitted_temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least cross entropy of scores (rows, classes), by golden section over its logarithm."""
    if len(scores) == 0:
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / math.exp(log_t)
        top = s.max(axis=1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(s)), classes]))

    low, high, ratio = math.log(0.02), math.log(50.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _sampled(docs: DataFrame, sample: int, features: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, int, int]]]:
    """The languages, and (features, counts, class, draw) of about ``sample`` documents, as many of each language, drawn by a hash of their texts.

    A text of which there are many copies is drawn once, so that the sample stays bounded.
    """
    sizes = sorted((r.lang, r["count"]) for r in docs.groupBy("lang").count().collect())
    languages = [lang for lang, _ in sizes]
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("draw")
    each = sample / max(1, len(sizes))
    below = F.lit(0).cast("long")
    for lang, n in sizes:
        below = F.when(F.col("lang") == lang, F.lit(round(min(1.0, each / n) * (1 << 30)))).otherwise(below)
    some_words = F.split(F.btrim("text", F.lit(WS)), r"[\x20\x09-\x0D]+")
    rows = docs.select("text", "lang", draw, F.xxhash64("text").alias("hash")).where(F.col("draw") < below).dropDuplicates(["hash", "lang"])

    piece = F.array_join(F.slice(some_words, (F.col("draw") % F.size(some_words) + 1).cast("int"), PIECE), " ")
    back = F.col("draw") % HELD_BACK == 0
    rows = rows.unionByName(rows.where(back).withColumn("text", piece).where(r"text rlike '\\p{L}'")).select("text", "lang", "draw")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                f, n = zip(*[counted(t or "", features) for t in some.column("text").to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), pa.array([x.astype(np.int32) for x in n], pa.list_(pa.int32())), some.column("lang"), some.column("draw")], names=["f", "n", "lang", "draw"])

    got = rows.mapInArrow(work, "f array<int>, n array<int>, lang string, draw long").toArrow()
    place = {lang: i for i, lang in enumerate(languages)}
    out = []
    for batch in got.to_batches():
        f, n = batch.column("f"), batch.column("n")
        out += [(f[i].values.to_numpy(), n[i].values.to_numpy(), place[batch.column("lang")[i].as_py()], batch.column("draw")[i].as_py()) for i in range(batch.num_rows)]
    return languages, sorted(out, key=lambda r: (r[3], r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, features: int = FEATURES) -> LanguageModel:
    """A model of the languages of docs; null languages and texts without a letter teach nothing.

    Every row counts for the document frequencies; weights and temperature are fitted on about ``sample`` rows. Equal texts are drawn
    once a language. Without rows the model knows no language. The order of rows doesn't matter.
    """
    learned = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages, rows = _sampled(learned, sample, features)
    if not languages:
        return LanguageModel((), np.zeros((features, 0), np.float32), np.zeros(0), 1.0)
    seen = document_frequencies(learned, "text", features)
    n_docs = learned.count()
    idf = np.log((1 + n_docs) / (1 + seen)) + 1
    made = [(f, SCALE * idf[f] * n / n.sum(), y, d) for f, n, y, d in rows]
    back = [r for r in made if r[3] % HELD_BACK == 0]
    w = leader_weights([r[:3] for r in made if r[3] % HELD_BACK], features, len(languages))
    scores = np.array([x @ w[f] + w[-1] for f, x, _, _ in back]).reshape(len(back), len(languages))
    t = fitted_temperature(scores, np.array([r[2] for r in back], int))
    return LanguageModel(tuple(languages), (w[:-1] * idf[:, None]).astype(np.float32), w[-1], t)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, columns of ``keep``, lang_pred, score) of every document: the likeliest learned language and its probability.

    Null texts and those without a letter are ``und`` with a score of 0, as is all if nothing was learned. Other columns are dropped,
    rows that repeat are predicted alike, null ids pass, an empty table gives no rows. The model, of 4 bytes for each feature and
    language, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                got = shared.value.predict([t or "" for t in some.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*some.schema.names[:-1], "lang_pred", "score"])
        let_go()

    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in keep.items()], F.col(text_col).alias("_text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(work, f"{kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by their CRC; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(~held_out())), keep={"held_out": held_out()})
