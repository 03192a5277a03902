"""Object mentions of captions with character offsets, and their token spans under any tokenizer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.bytepairs import BytePairs

WORD = re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?")
PARTS = re.compile(f"({WORD.pattern})")
TOKEN = re.compile(r"\w+|[^\w\s]")

Encode = Callable[[str], list]


def mentions_of(text: str, vocabulary: dict[str, str], heads: frozenset[str] | None = None) -> list[tuple[str, int, int]]:
    """(object, start, end) of each mention, in order: a known pair of words first, else a known word.

    Only words that begin an entry (``heads``) are looked at one by one; offsets are running sums of the lengths of
    words and gaps.
    """
    heads = heads_of(vocabulary) if heads is None else heads
    parts = PARTS.split(text)
    words = [w.lower() for w in parts[1::2]]
    hits = [i for i, w in enumerate(words) if w in heads]
    ends = list(accumulate(map(len, parts))) if hits else []
    out, free = [], 0
    for i in hits:
        if i < free:
            continue
        pair = vocabulary.get(f"{words[i]} {words[i + 1]}") if i + 1 < len(words) else None
        one = vocabulary.get(words[i]) if pair is None else None
        if pair is not None or one is not None:
            out.append((pair or one, ends[2 * i], ends[2 * (i + (pair is not None)) + 1]))
        free = i + 2 if pair is not None else i + 1
    return out


def heads_of(vocabulary: dict[str, str]) -> frozenset[str]:
    return frozenset(k.split(" ", 1)[0] for k in vocabulary)


def token_counter(text: str, encode: Encode | None) -> Callable[[int, int], int]:
    """Number of tokens of any piece of a text. The default tokenizer's tokens are found once for all prefixes."""
    if encode is not None:
        return lambda a, b: len(encode(text[a:b]))
    starts = [m.start() for m in TOKEN.finditer(text)]
    return lambda a, b: bisect_left(starts, b) if a == 0 else len(TOKEN.findall(text[a:b]))


def token_spans(text: str, encode: Encode | BytePairs | None) -> Callable[[int, int], tuple[int, int]]:
    """(first token, number of tokens) of a piece of a text. A tokenizer with offsets encodes the text once; any other
    one encodes the text before a piece, and the piece."""
    if isinstance(encode, BytePairs):
        return encode.encode(text).span
    count = token_counter(text, encode)
    return lambda a, b: (count(0, a), count(a, b))


def _per_text(rows: DataFrame, keep: list[str], fields: dict[str, T.DataType], kernel: Callable[..., list[tuple]], more: list[str]) -> DataFrame:
    """One row for each tuple that ``kernel`` gives for a text and the ``more`` columns of its row."""
    slim = rows.select(*keep, F.coalesce("text", F.lit("")).alias("__text"), *[F.col(c).alias(f"__{c}") for c in more])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in slim.schema][: len(keep)], *[T.StructField(n, t) for n, t in fields.items()]])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, at = [], []
            for i, args in enumerate(zip(*[c.to_pylist() for c in b.columns[len(keep) :]], strict=True)):
                found = kernel(*args)
                got += found
                at += [i] * len(found)
            kept = [c.take(pa.array(at, pa.int64())).cast(arrow.field(i).type) for i, c in enumerate(b.columns[: len(keep)])]
            new = [pa.array([g[i] for g in got], arrow.field(len(keep) + i).type) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return slim.mapInArrow(run, schema)


def mentions(docs: DataFrame, vocabulary: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """(id, mention_index, object, surface, start, end) of every mention; offsets are characters of the text itself."""
    fields = {"mention_index": T.IntegerType(), "object": T.StringType(), "surface": T.StringType(), "start": T.IntegerType(), "end": T.IntegerType()}
    heads = heads_of(vocabulary)
    return _per_text(docs, [id_col], fields, lambda t: [(k, o, t[a:b], a, b) for k, (o, a, b) in enumerate(mentions_of(t, vocabulary, heads))], [])


def caption_spans(docs: DataFrame, vocabulary: dict[str, str], truth: str, id_col: str = "doc_id", encode: Encode | BytePairs | None = None, n_ids: str | None = None) -> DataFrame:
    """(id, mention_index, word, surface, start, end, first, n_tokens, label) of every mention, in the order of its first
    token; ``truth`` is a column of the objects that are there, label 1 marks others.

    ``encode`` is a tokenizer with offsets, or any text-to-ids function; mentions without tokens, or whose last token lies behind the
    response's ``n_ids`` tokens (the text's own number where no column is named), are left out.
    """
    kinds = {"mention_index": T.IntegerType(), "word": T.StringType(), "surface": T.StringType(), "start": T.IntegerType(), "end": T.IntegerType(), "first": T.IntegerType(), "n_tokens": T.IntegerType(), "label": T.IntegerType()}
    heads = heads_of(vocabulary)

    def kernel(text: str, there: list | None, limit: int | None = None) -> list[tuple]:
        span, known, out = token_spans(text, encode), set(there or ()), []
        last = limit if limit is not None else sum(span(0, len(text)))
        for k, (o, a, b) in enumerate(mentions_of(text, vocabulary, heads)):
            first, n = span(a, b)
            if n and first + n <= last:
                out.append((k, o, text[a:b], a, b, first, n, int(o not in known)))
        return sorted(out, key=lambda s: (s[5], s[0]))

    return _per_text(docs, [id_col], kinds, kernel, [truth, *([n_ids] if n_ids else [])])


def labelling(docs: DataFrame, spans: DataFrame, truth: str, id_col: str = "doc_id") -> DataFrame:
    """One row an image: its spans sorted by first token, the hallucinated words, chair_i (share of its mentions) and
    chair_s (1 if there is one), and the objects that are there."""
    span = F.struct("first", "mention_index", "word", "surface", "n_tokens", "label")
    by = spans.groupBy(id_col).agg(F.array_sort(F.collect_list(span)).alias("object_token_spans"))
    none = F.array().cast(by.schema["object_token_spans"].dataType)
    out = docs.select(id_col, F.col("text").alias("generated_text"), F.col(truth).alias("ground_truth_objects")).join(by, id_col, "left")
    out = out.withColumn("object_token_spans", F.coalesce("object_token_spans", none))
    bad: Column = F.filter("object_token_spans", lambda s: s["label"] == 1)
    share = F.coalesce(F.try_divide(F.size(bad).cast("double"), F.size("object_token_spans").cast("double")), F.lit(0.0))
    return out.select("*", F.transform(bad, lambda s: s["word"]).alias("hallucinated_words"), share.alias("chair_i"), (F.size(bad) > 0).cast("int").alias("chair_s"))
