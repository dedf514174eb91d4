"""Operator 13: fill-in-the-middle order of texts, by ropes that are split at units and put together again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a leaf, at most.
LEAF = 64
_UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
UNITS, LEAVES = re.compile(_UNIT), re.compile(f"(?:{_UNIT}){{1,{LEAF}}}+")


class Rope(NamedTuple):
    """A leaf (``text``) or two subtrees; either knows its units, its code points and its height."""

    units: int
    points: int
    height: int
    text: str | None
    left: Rope | None
    right: Rope | None

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.text is not None:
                out.append(node.text)
            else:
                stack += [node.right, node.left]
        return "".join(out)


def leaf(text: str, units: int) -> Rope:
    return Rope(units, len(text), 0, text, None, None)


EMPTY = leaf("", 0)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.points + b.points, max(a.height, b.height) + 1, None, a, b)


def join(a: Rope, b: Rope) -> Rope:
    """Both texts in one balanced tree: the shorter one is hung in along the taller one's edge."""
    if not a.points or not b.points:
        return a if a.points else b
    if abs(a.height - b.height) <= 1:
        return _node(a, b)
    if a.height > b.height:
        right = join(a.right, b)
        if right.height > a.left.height + 1:  # rotate
            if right.left.height > right.right.height:
                return _node(_node(a.left, right.left.left), _node(right.left.right, right.right))
            return _node(_node(a.left, right.left), right.right)
        return _node(a.left, right)
    left = join(a, b.left)
    if left.height > b.right.height + 1:
        if left.right.height > left.left.height:
            return _node(_node(left.left, left.right.left), _node(left.right.right, b.right))
        return _node(left.left, _node(left.right, b.right))
    return _node(left, b.right)


def rope(text: str) -> Rope:
    """A balanced rope over leaves of up to ``LEAF`` units."""
    leaves = [leaf(p, len(p.encode().split()) + (p[-1:] in " \t\n\v\f\r")) for p in LEAVES.findall(text)]
    while len(leaves) > 1:
        leaves = [_node(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def split(tree: Rope, at: int, by: str = "units") -> tuple[Rope, Rope]:
    """The tree in two: ``at`` units (or code points, by "points") and the rest."""
    if at <= 0:
        return EMPTY, tree
    if at >= getattr(tree, by):
        return tree, EMPTY
    if tree.text is not None:
        ends = [m.end() for m in UNITS.finditer(tree.text)]
        if by == "units":
            return leaf(tree.text[: ends[at - 1]], at), leaf(tree.text[ends[at - 1] :], tree.units - at)
        whole = sum(e <= at for e in ends)
        through = at not in ends  # a unit that is cut counts on both sides
        return leaf(tree.text[:at], whole + through), leaf(tree.text[at:], tree.units - whole)
    if at < getattr(tree.left, by):
        a, b = split(tree.left, at, by)
        return a, join(b, tree.right)
    a, b = split(tree.right, at - getattr(tree.left, by), by)
    return join(tree.left, a), b


@dataclass(frozen=True)
class Choice:
    """How often texts are rearranged, and how often the suffix then comes first, in hundredths; ``seed`` draws."""

    seed: str = "42"
    rate: int = 50
    suffix_first: int = 80


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearranged(doc_id: int | None, text: str, choice: Choice) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output)."""
    tree = rope(text)
    n, (h1, h2, h3, h4) = tree.units, draws(doc_id, choice.seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= choice.rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(tree, first)
    middle, suffix = split(rest, second - first)
    p, s, m = (join(leaf(mark, 0), part) for mark, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    spm = h4 % 100 < choice.suffix_first
    out = join(join(s, p) if spm else join(p, s), m)
    return n, "spm" if spm else "psm", prefix.points, middle.points, str(out)


def restored(output: str, form: str | None) -> str:
    """The text that was rearranged: the output's tree is split at its marks, which no text holds, and put in order."""
    if form not in ("psm", "spm"):
        return output
    second, third = output.index(PREFIX if form == "spm" else SUFFIX, 1), output.index(MIDDLE, 1)
    rest, middle = split(rope(output), third, "points")
    first, last = split(rest, second, "points")
    a, b, m = (split(part, len(PREFIX), "points")[1] for part in (first, last, middle))
    return str(join(join(b, m), a) if form == "spm" else join(join(a, m), b))


def transform(docs: DataFrame, choice: Choice = Choice(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text cut at two of its units and rearranged, or plain.

    Nothing is shuffled; a text's draws come from its id alone. Null texts are empty, empty texts are plain. A null id
    draws as the empty string; repeated rows each give a row. Other columns aren't read. No rows give no rows.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [rearranged(i, t or "", choice) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = [(n, pa.int64()), (form, pa.string()), (prefix, pa.int64()), (middle, pa.int64()), (out, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` with the text that each output came from. A null output stays null; a null form is plain."""
    small_batches(rows.sparkSession)
    at, how = rows.columns.index(output_col), rows.columns.index(form_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else restored(t, f) for t, f in zip(batch.column(at).to_pylist(), batch.column(how).to_pylist(), strict=True)]
            yield batch.append_column(name, pa.array(texts, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, f"{fields}, `{name}` string")
