"""SentencePiece BPE encoding and decoding.

A text is cut where no piece of the vocabulary can reach across (proved when the model is read); each cut part is encoded
by backtracking over the pieces that an Aho-Corasick automaton finds, and its result is remembered within bounds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.bpe import REMEMBER, Memory, merged
from stockwright.llm.common import let_go, table

SPACE = "▁"
#: Code points of a text that are encoded in one go.
SLICE = 1 << 20
#: Entries of a young half of what a worker remembers where no other stages share it; REMEMBER drops parts that soon come again.
PARTS = 2 * REMEMBER
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_NORMAL, _USER, _BYTE = 1, 4, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """A merge-type SentencePiece model with byte fallback and identity normalisation; others are refused."""

    def __init__(self, path: str, remember: int = REMEMBER):
        import struct

        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.score: dict[str, float] = {}
        dummy, squeeze, rules = True, True, b""
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                text, kind, score = piece[1].decode(), piece.get(3, _NORMAL), struct.unpack("<f", piece.get(2, bytes(4)))[0]
                if kind == _NORMAL:
                    self.ids[text], self.score[text] = len(self.pieces), score
                elif kind == _BYTE:
                    self.byte_ids[int(text[1:-1], 16)] = len(self.pieces)
                elif kind == _USER:
                    raise ValueError("user-defined pieces are not supported")
                self.pieces.append(text)
            elif field == 3:
                spec = dict(_fields(value))
                dummy, squeeze, rules = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if rules or squeeze or not dummy or len(self.byte_ids) != 256:
            raise ValueError("only identity normalisation with a space before the text and byte fallback is supported")
        # proof of the cuts: no piece has a space after another character, none holds one of these controls
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces reach across spaces")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        # only pieces that encode as themselves can occur in a result; of each the next shorter one that it starts with
        own = {p for p in self.ids if len(p) > 1 and merged(list(p), self.rank) == [p]}
        self.shorter = {p: next(p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in own) for p in own}
        self.most = max(map(len, own), default=1)
        self.finder = ahocorasick.Automaton()
        for p in own:
            self.finder.add_word(p, p)
        self.finder.make_automaton()
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        #: whether two pieces stay apart when their text is merged anew
        self.compatible = Memory(lambda ab: merged([*ab[0], *ab[1]], self.rank) == [*ab], remember)
        self.known = Memory(self.part, remember)

    def rank(self, a: str, b: str) -> float | None:
        s = self.score.get(a + b)
        return None if s is None else -s

    def split(self, part: str) -> list[str]:
        """Pieces of a part: at each place the longest piece that stays apart from the one before, else one step back."""
        if SPACE * 2 in part:  # runs of spaces merge at equal rank, for which pairs alone don't decide
            return merged(list(part), self.rank)
        n, find, most, shorter, compatible = len(part), self.finder.iter_long, self.most, self.shorter, self.compatible
        failed = bytearray(n // 8 + 1)
        taken: list[str] = []
        at = 0
        while at < n:
            last, piece = next(find(part, at, min(n, at + most)), (0, ""))
            if not piece or last + 1 - len(piece) != at:
                piece = part[at]
            while True:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1 and (not taken or compatible[taken[-1], piece]):
                    taken.append(piece)
                    at = to
                    break
                piece = shorter.get(piece)
                while piece is None:
                    failed[at >> 3] |= 1 << (at & 7)
                    if not taken:  # ranks that tie may leave no cut into pairs that stay apart
                        return merged(list(part), self.rank)
                    before = taken.pop()
                    at -= len(before)
                    piece = shorter.get(before)
        return taken

    def encode_part(self, part: str) -> list[int]:
        pieces = self.split(part)
        if None not in (ids := [self.ids.get(p) for p in pieces]):
            return ids
        ids = []
        for piece in pieces:
            k = self.ids.get(piece)
            ids += [k] if k is not None else [self.byte_ids[b] for b in piece.encode()]
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids, without taking off the space before the text."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(self.pieces[i])
        out.append(run.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def part(self, part: str) -> tuple[str, int, str]:
        """(ids with commas, their number, decoded text) of a part."""
        ids = self.encode_part(part)
        return ",".join(map(str, ids)), len(ids), self.decode_ids(ids)

    def slices(self, text: str) -> Iterator[list[tuple[str, int, str]]]:
        """The parts of a text, in bounded lists."""
        at, n, lead = 0, len(text), SPACE
        while at < n:
            to = at + SLICE
            while to < n and not (text[to] in (" ", SPACE) and text[to - 1] not in (" ", SPACE)):
                to += 1
            known = self.known
            yield [known[p] for p in self.cut.findall(lead + text[at:to].replace(" ", SPACE))]
            at, lead = to, ""

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of a text and what they decode to."""
        parts = [x for some in self.slices(text) for x in some]
        ids = np.array(",".join([x[0] for x in parts]).split(","), np.int32) if parts else np.zeros(0, np.int32)
        return ids, "".join([x[2] for x in parts]).removeprefix(" ")

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        ids, back, count, first = hashlib.sha256(), hashlib.sha256(), 0, True
        for some in self.slices(text):
            decoded = "".join([x[2] for x in some])
            ids.update((("" if first else ",") + ",".join([x[0] for x in some])).encode())
            back.update((decoded.removeprefix(" ") if first else decoded).encode())
            count, first = count + sum([x[1] for x in some]), False
        return count, ids.hexdigest(), back.hexdigest()


@lru_cache(maxsize=2)
def model(path: str, remember: int = REMEMBER) -> PieceModel:
    """A worker's model, with memories of so many entries; reading it takes about a second."""
    return PieceModel(path, remember)


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _rows(texts: DataFrame, path: str, schema: str, row, forget: bool = False) -> DataFrame:  # noqa: ANN001
    """texts with the columns of schema, made of each text by ``row``. forget: a task remembers a quarter as much and leaves nothing
    remembered in its worker, where other stages follow in the same workers.
    """
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, REMEMBER // 2 if forget else PARTS)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # few rows at a time, as ids take more room than text
                some = batch.slice(at, 256)
                at += some.num_rows
                out = list(zip(*[row(m, t or "") for t in some.column("text").to_pylist()], strict=True))
                rest = [some.column(i) for i in range(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, *[pa.array(x, _ARROW[k]) for x, k in zip(out, kinds, strict=True)]], names=[*some.schema.names[:-1], *names])
        if forget:
            m.known.forget()
            m.compatible.forget()
            let_go()

    kept = [f for f in texts.schema.fields if f.name != "text"]
    return texts.select(*[f.name for f in kept], "text").mapInArrow(work, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], schema]))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every document. Null texts are empty: no ids, and decode to an empty text.

    Extra columns are dropped, repeated rows repeat, null ids pass, an empty table gives no rows.
    """

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _rows(texts, path or default_model(), "ids array<int>, decoded string", lambda m, t: m.encode(t), forget=True)


def encoding_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, without keeping ids or texts; as encode_documents."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _rows(texts, path or default_model(), SCHEMA, lambda m, t: m.digest(t))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(table(spark, sf_dir, "documents"))
