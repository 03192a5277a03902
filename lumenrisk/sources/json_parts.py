"""One large JSON document as rows of its elements, read in splits by many tasks.

Spark's text source cuts the file behind closing braces, so it splits and prunes as for lines, in any store. A split
doesn't know whether it starts inside a string, nor how deep. A first pass therefore walks each split from both
states (outside and inside a string) and keeps a row of figures; the driver chains these rows, one small row a split,
and a second pass walks each split from the state that is then known. Elements that cross split edges come as
fragments and are joined by the split that they began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import scratch

#: A whole string, or a mark: a quote here opens a string that the piece doesn't close.
MARK = re.compile(r'"(?:[^"\\]++|\\.)*+"|["\[\]{}]', re.S)
REST = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)

_FIGURES = "file string, start long, inside boolean, end_inside boolean, depth int, low int, levels array<int>, names array<string>"
_PARTS = "name string, key string, began int, part int, at long, whole boolean, text string"


@dataclass
class Walk:
    """Where a walk over pieces stands: inside a string or not, and the depth, from the split's start or absolute."""

    inside: bool
    depth: int = 0
    low: int = 0
    opened: dict[int, str | None] = field(default_factory=dict)

    def steps(self, piece: str) -> Iterator[tuple[int, str, str | None]]:
        """(position, mark, name) of each bracket outside strings; the name is that of the value that it opens.

        ``depth`` is changed before a step of an opening bracket, and of a closing one, is given.
        """
        at, last = 0, (0, 0)
        if self.inside:
            m = REST.match(piece)
            if not m:
                return
            self.inside, at = False, m.end()
        for m in MARK.finditer(piece, at):
            a, b = m.span()
            mark = piece[a]
            if mark == '"':
                if b == a + 1:
                    self.inside = True
                    return
                last = a, b
            elif mark in "[{":
                named = last[1] and piece[last[1] : a].strip() == ":"
                name = piece[last[0] + 1 : last[1] - 1] if named else None
                if self.depth <= 1:  # the top level's depth, if the split starts at it or deeper
                    self.opened[self.depth] = name if mark == "[" else None
                self.depth += 1
                yield a, mark, name
            else:
                self.depth -= 1
                self.low = min(self.low, self.depth)
                yield a, mark, None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start of the split, value): texts up to the next closing brace, which is left out, in order."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for b in batches:
        yield from (((f, s), v + "}") for f, s, v in zip(*[c.to_pylist() for c in b.columns], strict=True))


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows a split: what a walk from outside and from inside a string comes to."""
    found: dict[tuple[str, int], tuple[Walk, Walk]] = {}
    for split, piece in _splits(batches):
        for w in found.setdefault(split, (Walk(False), Walk(True))):
            for _ in w.steps(piece):
                pass
    rows = [(f, s, bool(i), w.inside, w.depth, w.low, list(w.opened), list(w.opened.values())) for (f, s), both in found.items() for i, w in enumerate(both)]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = [c.split()[0] for c in _FIGURES.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


@dataclass(frozen=True)
class Start:
    """What a split starts with: its number, the state, the array it is in, and the split its open element began in."""

    number: int
    inside: bool
    depth: int
    name: str | None
    began: int


def _starts(spark: SparkSession, path: str, level: int) -> dict[tuple[str, int], Start]:
    """The start of each split, chained from the figures in the order of the files and their bytes."""
    figures: dict[tuple[str, int], dict] = {}
    for r in _pieces(spark, path).mapInArrow(_figures, _FIGURES).collect():  # two small rows a split
        figures.setdefault((r.file, r.start), {})[r.inside] = r
    out, file = {}, None
    for number, split in enumerate(sorted(figures)):
        if split[0] != file:
            file, inside, depth, name, began = split[0], False, 0, None, number
        out[split] = Start(number, inside, depth, name, began)
        r = figures[split][inside]
        if depth + min(r.low, 0) <= level:
            began = number
        opened = dict(zip(r.levels, r.names, strict=True))
        name = opened.get(1 - depth, name)
        inside, depth = r.end_inside, depth + r.depth
    return out


def _cut(starts: dict[tuple[str, int], Start], names: frozenset[str] | None, level: int):
    """A function of batches that gives whole elements, and the parts of those that cross the split's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, walk, begun, out, size = None, None, None, [], 0
        held: list[str] = []
        name = key = None
        at = began = 0

        def part(whole: bool) -> tuple:
            return name, key, began, starts[split].number, at if begun else None, whole, "".join(held)

        for this, piece in _splits(batches):
            if this != split:
                if held:
                    out.append(part(False))
                s, split, held, key, at = starts[this], this, [], None, 0
                walk, name, began = Walk(s.inside, s.depth), s.name, s.began
                # begun: the open element began in this split (True), in an earlier one (False), or there is none
                begun = False if s.depth > level and (names is None or name in names) else None
            cut = 0
            for a, mark, opened in walk.steps(piece):
                if mark in "[{":
                    if walk.depth == 2 and level == 2:
                        name = opened if mark == "[" else None
                    elif walk.depth == level + 1 and mark == "{" and begun is None and (names is None or name in names):
                        begun, cut, key, began, at = True, a, opened, starts[split].number, at + 1
                elif begun is not None and walk.depth == level:
                    held.append(piece[cut : a + 1])
                    out.append(part(begun))
                    held, begun, key = [], None, None
            if begun is not None:
                held.append(piece[cut:])
            size += len(piece)
            if size >= 1 << 24 and out:
                yield _batch(out)
                out, size = [], 0
        if held:
            out.append(part(False))
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _elements(spark: SparkSession, path: str, names: frozenset[str] | None, level: int) -> DataFrame:
    staged = scratch(spark, "elements")  # each array, and the parts at edges, are read out of it; the document is walked once
    _pieces(spark, path).mapInArrow(_cut(_starts(spark, path, level), names, level), _PARTS).write.parquet(staged)
    parts = spark.read.schema(_PARTS).parquet(staged)
    order = lambda began, at: F.shiftleft(began.cast("long"), 33) + at
    whole = parts.where("whole").select("name", "key", order(F.col("began"), F.col("at")).alias("ord"), "text")
    edges = parts.where("NOT whole").groupBy("began").agg(  # an element with no first part is no object
        F.max("name").alias("name"), F.max("key").alias("key"), F.max("at").alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    return whole.union(edges.where("at IS NOT NULL").select("name", "key", order(F.col("began"), F.col("at")).alias("ord"), "text"))


def array_elements(spark: SparkSession, path: str, arrays: dict[str, str]) -> dict[str, DataFrame]:
    """(ord, fields) of the objects in each of the named top-level arrays of a document: ``arrays`` maps the arrays to
    their fields' schema. ``ord`` grows along the document.

    The texts of other arrays are left where they are read. An array that is missing, null or empty has no rows;
    elements that are no objects give none; an element that doesn't fit the schema has nulls. Keys are compared as they
    are written; one with a closing brace in it names no array. An element's text must fit in memory. Several files
    are several documents.
    """
    found = _elements(spark, path, frozenset(arrays), 2)
    return {n: found.where(F.col("name") == n).select("ord", F.from_json("text", s).alias("v")).select("ord", "v.*") for n, s in arrays.items()}


def map_entries(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(ord, key, fields) of the objects that a document of the form {key: object, ...} holds; values of another form
    give no row, and a key with a closing brace in it is null."""
    found = _elements(spark, path, None, 1)
    return found.select("ord", "key", F.from_json("text", value).alias("v")).select("ord", "key", "v.*")
