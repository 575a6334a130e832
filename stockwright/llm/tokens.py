"""Token counts of texts for a word-end BPE vocabulary.

Whole-token shortcut: the vocabulary strings that encode alone as one token are proved once, when the file is read; a
pre-token among them counts as one, and only the rest is merged.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.bpe import Memory, merged
from stockwright.llm.common import table

LIMIT = 2048
SLICE = 1 << 20
#: What str.split() takes for white space, but the tokenizer doesn't.
_ODD = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of all bytes: a byte that Latin-1 prints stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}


class WordCounter:
    """Counts tokens as the tokenizers library does for a file of this kind; other kinds are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        m = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or (first["type"], first["behavior"], first["invert"], second["type"]) != ("Split", "Removed", True, "ByteLevel") or m["type"] != "BPE" or m["ignore_merges"] or second["add_prefix_space"]:
            raise ValueError("this kind of tokenizer file is not supported")
        self.end = m["end_of_word_suffix"]
        self.vocab, self.ranks = set(m["vocab"]), {}
        for k, pair in enumerate(m["merges"]):
            self.ranks[tuple(pair if isinstance(pair, list) else pair.split(" "))] = k
        self.pattern = regex.compile(first["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.letters = byte_letters()
        # the proof: these strings, merged like any other, end as one token
        self.whole = {w[: -len(self.end)] for w in self.vocab if w.endswith(self.end) and len(self.merge(w[: -len(self.end)])) == 1}
        self.known, self.known_words = Memory(lambda spelled: len(self.merge(spelled))), Memory(self.word)

    def merge(self, spelled: str) -> list[str]:
        return merged([*spelled[:-1], spelled[-1] + self.end], lambda a, b: self.ranks.get((a, b))) if spelled else []

    def pre_token(self, text: str) -> int:
        spelled = "".join([self.letters[b] for b in text.encode()])
        return 1 if spelled in self.whole else self.known[spelled]

    def word(self, word: str) -> int:
        """Tokens of a run without white space: special strings count as one each."""
        parts = self.special.split(word) if "<|" in word else [word]
        n = len(parts) - 1
        for p in parts:
            if not p.isascii():
                p = unicodedata.normalize("NFC", p).replace("Σ", "σ")  # lower case letter by letter: no final sigma
            n += sum(map(self.pre_token, self.pattern.findall(p.lower())))
        return n

    def count(self, text: str) -> int:
        n = at = 0
        while at < len(text):
            to = at + SLICE
            while to < len(text) and not text[to].isspace():
                to += 1
            some = text[at:to]
            known = self.known_words
            n += sum([known[w] for w in (_SPACE.split(some) if _ODD.search(some) else some.split())])
            at = to
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    Null texts are empty: no bytes and no tokens. Extra columns are dropped, repeated rows repeat, null ids pass, an empty
    table gives no rows; special strings inside texts count as one token.
    """
    path = path or default_vocabulary()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = [c.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    texts = docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(work, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
