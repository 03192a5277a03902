"""Conversation structure repair by a rank-convergence parallel Viterbi.

The roles of a repaired conversation read ``(s?(ua)+)?``: an automaton of four states. Backward costs (the least cost
to finish from a row in a state) are a min-plus recursion over the rows, so a long conversation is a chain of chunks.
Each chunk starts at its right end from a speculative cost vector; fix-up passes hand every chunk its right
neighbour's result and rerun it until the new vectors differ from the old ones only by a constant, from where on the
old ones hold. Costs matter only up to that constant; the constants are added up along the chunks. The stitched
backward costs then drive the trace of the least audit from the left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from .common import staged, unstaged

#: A chunk ends after so many different rows, or so many characters of text.
CHUNK_ROWS, CHUNK_CHARS = 2048, 1 << 22
#: Bytes of repaired text that travel as one row.
PIECE = 1 << 20

# The automaton: nothing yet, after s, after u, after a. What a kept role leads to, what a new one leads to.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEW = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
NAMES = {"u": "user", "a": "assistant"}
#: Least costs to finish after the last row: accepted states, or the insertions that lead there.
END = (0, 6, 3, 0)
#: What a chunk starts from while its right neighbour is not known.
SPECULATIVE = (0, 0, 0, 0)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): the damaged rows; nulls of the key, role and text count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    return rows.where(kind != 0).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(blank(role_col)).alias("role"), text.alias("text"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies")
    )


def _runs(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with their number, and whether their role and text stand in an earlier turn.

    Both are aggregates, combined before they are dealt out; the join's keys are unique on both sides.
    """
    key = lambda *more: F.struct("conv_id", "role", F.sha2("text", 256).alias("digest"), *more)
    order = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    runs = rows.groupBy(key(order.alias("at")).alias("key")).agg(F.any_value("conv_id").alias("conv_id"), F.any_value("turn").alias("turn"), F.any_value("role").alias("role"), F.any_value("text").alias("text"), F.sum("copies").alias("copies"))
    first = rows.groupBy(key().alias("said")).agg(F.min(order).alias("at")).select(F.struct("said.conv_id", "said.role", "said.digest", "at").alias("key"), F.lit(True).alias("first"))
    return runs.join(first, "key", "left").select("conv_id", "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))


# ---- the recursion, one row at a time: a row is (initial of its role, truncated, must go)


@lru_cache(1 << 16)
def step(initial: str, truncated: bool, gone: bool, right: tuple) -> tuple[tuple, int]:
    """The vector left of a row from the normalised one right of it, normalised, and the constant taken off."""
    v = [_own(initial, truncated, gone, s, right) for s in range(4)]
    v[2] = min(v[2], INSERT + v[3])
    for s in (0, 1, 3):
        v[s] = min(v[s], INSERT + v[2])
    v[2] = min(v[2], INSERT + v[3])
    least = min(v)
    return tuple(x - least for x in v), least


def _own(initial: str, truncated: bool, gone: bool, s: int, right: tuple) -> int:
    """The least cost from state ``s`` if the row itself is edited next."""
    best = DELETE + right[s]
    if not gone:
        more = TRUNCATED if truncated else 0
        best = min(best, REROLE + more + right[NEW[s][1]])
        if initial in KEEPS[s]:
            best = min(best, KEEP + more + right[KEEPS[s][initial]])
    return best


@lru_cache(1 << 16)
def trace(initial: str, truncated: bool, gone: bool, right: tuple, s: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits at a row from state ``s``: insertions, then the row's own edit; and the state after."""
    left, off = step(initial, truncated, gone, right)
    left, edits = [x + off for x in left], ""
    while True:
        more = TRUNCATED if truncated else 0
        if left[s] == DELETE + right[s]:
            return edits + "D", s
        if left[s] == INSERT + left[NEW[s][1]]:
            edits, s = edits + "I", NEW[s][1]
        elif not gone and initial in KEEPS[s] and left[s] == KEEP + more + right[KEEPS[s][initial]]:
            return edits + "K", KEEPS[s][initial]
        else:
            return edits + "R", NEW[s][1]


def backward(rows: list[tuple[str, bool, bool]], right: tuple) -> tuple[tuple, int]:
    """Left vector of a chunk, normalised, and its constant without the forced deletions that ``rows`` leaves out."""
    total = 0
    for r in reversed(rows):
        right, off = step(*r, right)
        total += off
    return right, total


def refit(rows: list[tuple[str, bool, bool]], old: tuple, new: tuple, left: tuple, total: int) -> tuple[tuple, int]:
    """Left vector and constant under ``new`` where those under ``old`` are known: stops where both differ by a constant."""
    gap = 0
    for r in reversed(rows):
        if old == new:
            return left, total + gap
        old, a = step(*r, old)
        new, b = step(*r, new)
        gap += b - a
    return new, total + gap


def forward(rows: list[tuple[str, bool, bool]], right: tuple, s: int) -> tuple[list[str], int]:
    """Edits of each row from state ``s`` on, and the state after the last."""
    vectors = [right]
    for r in reversed(rows[1:]):
        vectors.append(step(*r, vectors[-1])[0])
    out = []
    for r, v in zip(rows, reversed(vectors[: len(rows)]), strict=True):
        edits, s = trace(*r, v, s)
        out.append(edits)
    return out, s


def closing(s: int) -> str:
    """Insertions after the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[s]


# ---- chunks


_SPACE = " \t\n\v\f\r"


def judged(role: str, text: str, first: bool) -> tuple[str, bool, bool, int]:
    """(initial, truncated, must go, fault) of a run's first row; fault 1 blank, 2 duplicate, 3 truncated, 0 none."""
    bare = text.rstrip(_SPACE)
    fault = 1 if not bare else 2 if not first else 3 if bare[-1] not in ".!?" else 0
    return role[:1], fault == 3, fault in (1, 2), fault


class Chunk:
    """Consecutive runs of one conversation. Rows that must go leave states as they are, so only their number counts."""

    def __init__(self) -> None:
        self.runs: list[tuple[str, str, int, bool]] = []  # role, text, copies, first
        self.turns: list[int | None] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        self.runs.append((role, text, copies, first))
        self.turns.append(turn)
        self.chars += len(text)

    def full(self, rows: int) -> bool:
        return len(self.runs) >= rows or self.chars >= CHUNK_CHARS

    def judge(self) -> list[tuple[str, bool, bool, int]]:
        return [judged(role, text, first) for role, text, _, first in self.runs]

    def summary(self) -> dict:
        """Counts that add up along the chunks, and what a seam needs: outer initials and turns."""
        faults = self.judge()
        n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "forced": 0}
        before = None
        for (initial, _, gone, fault), (_, _, copies, _) in zip(faults, self.runs, strict=True):
            n["blank"] += copies if fault == 1 else 0
            n["duplicate"] += 0 if fault == 1 else copies if fault == 2 else copies - 1
            n["truncated"] += fault == 3
            n["forced"] += copies if gone else copies - 1
            n["illegal"] += (before is not None and before + initial not in ("su", "ua", "au")) + copies - 1  # no role follows itself
            before = initial
        turns = [t for t in self.turns if t is not None]
        n |= {"turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None}
        return n | {"head": faults[0][0], "tail": before}

    def codes(self) -> list[tuple[str, bool, bool]]:
        """The rows that the recursion sees: none that must go."""
        return [r[:3] for r in self.judge() if not r[2]]

    def edited(self, edits: list[str], s: int) -> tuple[str, list[str]]:
        """The audit and the repaired rows of the chunk under the edits of ``codes()``, from state ``s``.

        Among equal costs the audit with D first is least, so forced deletions come before insertions.
        """
        audit, lines, own = [], [], iter(edits)
        for (initial, _, gone, _), (role, text, copies, _) in zip(self.judge(), self.runs, strict=True):
            if gone:
                audit.append("D" * copies)
                continue
            done = next(own)
            for e in done:
                if e == "D":
                    continue
                to, after = NEW[s]
                if e == "I":
                    lines.append(f"{NAMES[to]}:")
                elif e == "R":
                    lines.append(f"{NAMES[to]}:{text}")
                else:
                    lines.append(f"{role}:{text}")
                    after = KEEPS[s][initial]
                s = after
            audit.append(done + "D" * (copies - 1))
        return "".join(audit), lines


def finish(s: int) -> tuple[str, list[str]]:
    """The insertions after the last row, and their lines."""
    lines = []
    for _ in closing(s):
        to, s = NEW[s]
        lines.append(f"{NAMES[to]}:")
    return "I" * len(lines), lines


class Merged:
    """Sums over the chunks of a conversation in order, with what happens at their seams."""

    def __init__(self) -> None:
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "cost"), 0)
        self.low = self.high = self.tail = None

    def add(self, c: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            self.n[k] += c[k]
        self.n["cost"] += c["total"] + DELETE * c["forced"]
        if self.tail is not None:
            self.n["illegal"] += self.tail + c["head"] not in ("su", "ua", "au")
        if c["low"] is not None:
            self.n["turns"] -= self.high == c["low"]
            self.low, self.high = c["low"] if self.low is None else self.low, c["high"]
        self.tail = c["tail"]

    def row(self) -> dict:
        n = self.n
        gaps = 0 if self.low is None else self.high - self.low + 1 - n["turns"]
        return {"gaps": gaps} | {k: n[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_SEAM = ("blank", "duplicate", "truncated", "illegal", "forced", "turns", "low", "high")
_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()
_VECTOR = T.ArrayType(T.IntegerType())


def _schema(conv: T.DataType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *[T.StructField(n, t) for n, t in fields]])


def _batches(rows: Iterator[dict], schema: T.StructType, most: int = 512, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += sum(len(v) for v in r.values() if isinstance(v, (str, bytes, list)))
        if len(held) >= most or weight >= size:
            yield from pa.Table.from_pylist(held, schema=arrow).to_batches()
            held, weight = [], 0
    if held:
        yield from pa.Table.from_pylist(held, schema=arrow).to_batches()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            yield from b.slice(at, 1024).to_pylist()


def _chunks(rows: Iterator[dict], most: int) -> Iterator[tuple[object, Chunk, bool, bool]]:
    """(conversation, chunk, first of the task's chunks of it, last of them) of sorted rows."""
    held, of, head = None, None, True
    for r in rows:
        new = held is None or r["conv_id"] != of
        if held is not None and (new or held.full(most)):
            yield of, held, head, new
            head, held = new, None
        if held is None:
            held, of = Chunk(), r["conv_id"]
        held.add(r["turn"], r["role"], r["text"], r["copies"], r["first"])
    if held is not None:
        yield of, held, head, True


def _digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def repair(rows: DataFrame, ids: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conv_id of
    ``ids``, else of ``rows`` (conv_id, turn, role, text, copies: as ``damage`` gives them).

    Rows are sorted into ranges of conversation, turn, role and text, so no task holds a hot conversation whole: its
    chunks are stitched as the module says; a conversation that ends within its task in one chunk is its own stitch.
    Rows of a turn are ordered by role and text; equal ones stand together and travel as one with their number. Null
    turns come first; a null conv_id is a conversation of its own; empty texts are blank; an empty table gives an empty
    result; other columns don't take part. Very long texts are read whole. Only the digest of a stitched conversation
    reads its text in one task, in pieces, as SHA-256 can't be split.
    """
    conv = rows.schema["conv_id"].dataType
    runs = staged(_runs(rows), "turns")
    order = ("conv_id", "turn", "role", "text")
    placed = runs.repartitionByRange(*order).sortWithinPartitions(*order)
    whole = _schema(conv, *[(c, _L) for c in _COUNTS], ("audit", _S), ("repaired_sha256", _S))
    packed = (("roles", T.ArrayType(_S)), ("texts", T.ArrayType(_S)), ("counts", T.ArrayType(_L)), ("firsts", T.ArrayType(_B)), ("codes", _S))
    seam = (("part", T.IntegerType()), ("seq", T.IntegerType()), *[(c, _L) for c in _SEAM], ("head", _S), ("tail", _S), *packed, ("left", _VECTOR), ("total", _L))
    both = T.StructType([*whole.fields, *[T.StructField(n, t) for n, t in seam if n not in whole.fieldNames()]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks with vectors from a speculative start; conversations inside a task in one chunk are done."""
        part = TaskContext.get().partitionId()

        def out() -> Iterator[dict]:
            held = None  # the outermost conversations of a task may go on in other tasks
            for seq, (of, chunk, head, last) in enumerate(_chunks(_rows(batches), chunk_rows)):
                if held is not None:
                    yield one(*held)
                held = (seq, of, chunk, head and last and seq > 0)
            if held is not None:
                yield one(*held[:3], False)

        def one(seq: int, of: object, chunk: Chunk, alone: bool) -> dict:
            codes = chunk.codes()
            left, total = backward(codes, END if alone else SPECULATIVE)
            n = chunk.summary() | {"total": total + left[0] if alone else total}
            if alone:
                edits, s = forward(codes, END, 0)
                audit, lines = chunk.edited(edits, 0)
                more, ends = finish(s)
                merged = Merged()
                merged.add(n)
                return {"conv_id": of} | merged.row() | {"audit": audit + more, "repaired_sha256": _digest(lines + ends)}
            roles, texts, copies, firsts = map(list, zip(*chunk.runs, strict=True))
            n |= {"roles": roles, "texts": texts, "firsts": firsts, "codes": _pack(codes)}
            return {"conv_id": of, "part": part, "seq": seq, "left": list(left) if codes else None} | {k: n[k] for k in (*_SEAM, "head", "tail", "total")} | {k: n[k] for k in ("roles", "texts", "firsts", "codes")} | {"counts": copies}

        return _batches(out(), both)

    cuts = staged(placed.mapInArrow(cut, both), "chunks")
    done = cuts.where(F.col("audit").isNotNull()).select(*whole.fieldNames())
    open_ = cuts.where(F.col("audit").isNull())
    stitched = _stitch(open_, conv, whole)
    found = done.unionByName(stitched)
    return _with_all((rows if ids is None else ids).select("conv_id").distinct(), found)


def _pack(codes: list[tuple[str, bool, bool]]) -> str:
    """A row's initial, in upper case marks of their own where it is cut off: two characters a row."""
    return "".join((i if i in ("s", "u", "a") else "-") + ("t" if t else ".") for i, t, _ in codes)


def _unpack(codes: str) -> list[tuple[str, bool, bool]]:
    return [(codes[i], codes[i + 1] == "t", False) for i in range(0, len(codes), 2)]


def _with_all(ids: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each of ``ids``; those without a row get zeros, no audit and the digest of nothing."""
    joined = ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    zeros = [F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return joined.select("i.conv_id", *zeros, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.lit(_digest([]))).alias("repaired_sha256"))


def _next_left() -> Column:
    """The left vector of the next chunk of the conversation; chunks of forced deletions alone pass it through."""
    along = Window.partitionBy("conv_id").orderBy(F.desc("part"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last("left", ignorenulls=True).over(along), F.array(*[F.lit(x) for x in END]))


def _stitch(cuts: DataFrame, conv: T.DataType, whole: T.StructType) -> DataFrame:
    """The conversations of several chunks, or whose ends their task could not see."""
    slim = cuts.select("conv_id", "part", "seq", "codes", "left", "total", F.array(*[F.lit(x) for x in SPECULATIVE]).alias("right"))
    vector = _schema(conv, ("part", T.IntegerType()), ("seq", T.IntegerType()), ("codes", _S), ("left", _VECTOR), ("total", _L), ("right", _VECTOR), ("changed", _B))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[dict]:
            for r in _rows(batches):
                old, new = tuple(r["right"]), tuple(r.pop("next"))
                r["changed"] = False
                if r["left"] is not None and old != new:
                    left, total = refit(_unpack(r["codes"]), old, new, tuple(r["left"]), r["total"])
                    r["changed"] = list(left) != r["left"]
                    r["left"], r["total"] = list(left), total
                r["right"] = list(new)
                yield r

        return _batches(out(), vector)

    own = []
    while True:  # a pass for each chunk that a difference crosses without converging; most need one or two
        slim = staged(slim.withColumn("next", _next_left()).mapInArrow(again, vector), "vectors")
        own.append(slim)
        if len(own) > 1:
            unstaged(own.pop(0))
        if slim.where("changed").isEmpty():
            break
        slim = slim.drop("changed")

    exits = T.StructType([f for f in vector if f.name not in ("codes", "changed")] + [T.StructField("exits", _VECTOR)])
    entered = T.StructType([f for f in exits if f.name != "exits"] + [T.StructField("entry", T.IntegerType()), T.StructField("last", _B)])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state after a chunk for each state before it."""
        out = ({k: r[k] for k in ("conv_id", "part", "seq", "left", "total", "right")} | {"exits": [forward(_unpack(r["codes"]), tuple(r["right"]), s)[1] for s in range(4)]} for r in _rows(batches))
        return _batches(out, exits)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before each chunk, along the conversation; its first chunk takes the cost of the start's state."""

        def out() -> Iterator[dict]:
            held, s = None, 0
            for r in _rows(batches):
                new = held is None or held["conv_id"] != r["conv_id"]
                if held is not None:
                    yield held | {"last": new}
                if new:
                    s = 0
                    r["total"] += r["left"][0] if r["left"] is not None else r["right"][0]
                to = r.pop("exits")[s]
                held = r | {"entry": s}
                s = to
            if held is not None:
                yield held | {"last": True}

        return _batches(out(), entered)

    along = ("conv_id", "part", "seq")
    known = slim.mapInArrow(ends, exits).repartition("conv_id").sortWithinPartitions(*along).mapInArrow(enter, entered)
    wide = cuts.select("part", "seq", *_SEAM, "head", "tail", "roles", "texts", "counts", "firsts", "codes").join(known.drop("left"), ["part", "seq"])
    piece = _schema(conv, ("part", T.IntegerType()), ("seq", T.IntegerType()), ("piece", T.IntegerType()), ("audit", _S), ("text", T.BinaryType()), *[(c, _L) for c in _SEAM], ("head", _S), ("tail", _S), ("total", _L))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Audit and repaired text of a chunk, in pieces of bounded size."""

        def out() -> Iterator[dict]:
            for r in _rows(batches):
                chunk = Chunk()
                for role, text, copies, first in zip(r["roles"], r["texts"], r["counts"], r["firsts"], strict=True):
                    chunk.add(None, role, text, copies, first)
                edits, s = forward(_unpack(r["codes"]), tuple(r["right"]), r["entry"])
                audit, lines = chunk.edited(edits, r["entry"])
                if r["last"]:
                    more, ends = finish(s)
                    audit, lines = audit + more, lines + ends
                text = "".join(f"{line}\n" for line in lines).encode("utf-8", "surrogatepass")
                at = {k: r[k] for k in ("conv_id", "part", "seq")}
                yield at | {"piece": 0, "audit": audit, "text": text[:PIECE]} | {k: r[k] for k in (*_SEAM, "head", "tail", "total")}
                for n in range(PIECE, len(text), PIECE):
                    yield at | {"piece": n // PIECE, "text": text[n : n + PIECE]}

        return _batches(out(), piece)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's row from its pieces in order; the text goes through the digest and is not kept."""

        def out() -> Iterator[dict]:
            of, n = None, None
            for r in _rows(batches):
                if n is None or r["conv_id"] != of:
                    if n is not None:
                        yield row(of, n, audit, digest)
                    of, n, audit, digest, tail = r["conv_id"], Merged(), [], hashlib.sha256(), b""
                if r["piece"] == 0:
                    n.add(r)
                    audit.append(r["audit"])
                if r["text"]:  # each line ends with a newline, but the last line's is not part of the digest
                    digest.update(tail + r["text"][:-1])
                    tail = r["text"][-1:]
            if n is not None:
                yield row(of, n, audit, digest)

        def row(of: object, n: Merged, audit: list[str], digest) -> dict:
            return {"conv_id": of} | n.row() | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        return _batches(out(), whole)

    return wide.mapInArrow(write, piece).repartition("conv_id").sortWithinPartitions(*along, "piece").mapInArrow(merge, whole)


def damaged_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conv_id before the damage."""
    return repair(damage(conversations), conversations)
