"""Fill-in-middle: texts are cut at two unit ranks and rearranged as ropes, and rebuilt from what was made of them.

A unit is a run of white space with the word that follows it, or white space at the end of the text. A rope is a balanced
tree of slices of a text; each node caches how many units and code points lie below it, so that a cut at a rank goes down
one path, opens one slice and shares all others with both halves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80
#: Code points of a leaf, before it is drawn out to the end of a unit.
LEAF = 2048
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_SPACE, _WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]")


@dataclass(frozen=True, slots=True)
class Rope:
    """A node: a leaf has a text, others have two children. None stands for the empty rope."""

    units: int
    points: int
    height: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += (node.right, node.left)


def leaf(text: str) -> Rope | None:
    """Units of a leaf are its words, and one more if it ends in white space."""
    if not text:
        return None
    tail = _SPACE.match(text, len(text) - 1) is not None
    return Rope(len(text.encode().split()) + tail, len(text), 0, text)  # bytes are split at just the six characters


def node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.points + b.points, 1 + max(a.height, b.height), "", a, b)


def concat(a: Rope | None, b: Rope | None) -> Rope | None:
    """The two in a row, heights kept within one of each other as in an AVL tree."""
    if a is None or b is None:
        return a or b
    if abs(a.height - b.height) <= 1:
        return node(a, b)
    if a.height > b.height:
        right = concat(a.right, b)
        if right.height <= a.left.height + 1:
            return node(a.left, right)
        if right.left.height <= right.right.height:
            return node(node(a.left, right.left), right.right)
        return node(node(a.left, right.left.left), node(right.left.right, right.right))
    left = concat(a, b.left)
    if left.height <= b.right.height + 1:
        return node(left, b.right)
    if left.right.height <= left.left.height:
        return node(left.left, node(left.right, b.right))
    return node(node(left.left, left.right.left), node(left.right.right, b.right))


def build(text: str, size: int = LEAF) -> Rope | None:
    """The rope of a text, cut into leaves at ends of units."""
    leaves, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            # on to a word, if only white space came, and then to its end
            word = _WORD.search(text, end - 1)
            space = _SPACE.search(text, word.start()) if word else None
            end = space.start() if space else len(text)
        leaves.append(leaf(text[at:end]))
        at = end

    def over(i: int, k: int) -> Rope:
        return leaves[i] if k - i == 1 else node(over(i, (i + k) // 2), over((i + k) // 2, k))

    return over(0, len(leaves)) if leaves else None


def split(rope: Rope | None, rank: int, by: str = "units") -> tuple[Rope | None, Rope | None]:
    """What lies before and from a rank on, in units or in code points (``by``)."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if rope.left is None:
        at = rank if by == "points" else next(islice(UNIT.finditer(rope.text), rank - 1, None)).end()
        return leaf(rope.text[:at]), leaf(rope.text[at:])
    here = getattr(rope.left, by)
    if rank < here:
        a, b = split(rope.left, rank, by)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - here, by)
    return concat(rope.left, a), b


def text_of(rope: Rope | None) -> str:
    return "" if rope is None else "".join(rope.leaves())


def rearranged(rope: Rope | None, first: int, second: int, form: str) -> tuple[Rope | None, int, int]:
    """The rope with its parts in the order of ``form`` behind their sentinels, and the code points of prefix and middle."""
    head, suffix = split(rope, second)
    prefix, middle = split(head, first)
    parts = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    out = None
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        out = concat(out, concat(leaf(mark), parts[mark]))
    points = lambda r: 0 if r is None else r.points
    return out, points(prefix), points(middle)


def restored(output: str, form: str) -> str:
    """The text that an output was made of. A sentinel stands in it once, as none is in the text."""
    if form == "plain":
        return output
    rest, parts = build(output), {}
    for mark in sorted((PREFIX, SUFFIX, MIDDLE), key=output.index, reverse=True):
        rest, part = split(rest, output.index(mark), "points")
        parts[mark] = split(part, len(mark), "points")[1]
    return text_of(concat(concat(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def _drawn(seed: int, id_col: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's id; a null id is drawn for as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document: n units, of which two drawn ranks bound the middle.

    Of 100 documents ``rate`` are rearranged, and of 100 of those ``spm_rate`` with the suffix first; the rest are plain, as are
    empty texts and those that hold a sentinel. Null texts are empty. What is drawn depends on the id only, so rows that repeat an id
    are cut alike; null ids are drawn for as empty ones. Extra columns are dropped, an empty table gives no rows.
    """
    h = _drawn(seed, F.col(id_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("doc_id"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"), text.alias("text"))

    def made(text: str, form: str, h1: int, h2: int) -> tuple[int, int | None, int | None, str]:
        rope = build(text)
        n = 0 if rope is None else rope.units
        if form == "plain":
            return n, None, None, text
        cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
        out, before, inside = rearranged(rope, *cuts, form)
        return n, before, inside, text_of(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _few(batch):
                cells = [some.column(c).to_pylist() for c in ("text", "form", "h1", "h2")]
                n, before, inside, out = zip(*[made(*c) for c in zip(*cells, strict=True)], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(n, pa.int64()), some.column("form"), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(out, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _few(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def restore(made: DataFrame) -> DataFrame:
    """The rows of fill_in_middle (others with form and output alike) with ``restored``, the text rebuilt from the two alone.

    Null outputs stay null; an output without its sentinels is an error, as it was made by something else.
    """
    names = [f.name for f in made.schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _few(batch):
                back = [None if o is None else restored(o, f) for o, f in zip(some.column("output").to_pylist(), some.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(back, pa.string())], names=[*names, "restored"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(work, f"{kind}, restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
