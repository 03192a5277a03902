"""Stupid-backoff scores, computed relationally.

Documents are dealt to chunks of bounded size by a hash. A chunk explodes its texts into n-grams and asks for the
count of each distinct one; requests are dealt by the n-gram's hash, and each hash slot, the count table's
partition, sums what all chunks hold and answers every request. The answers are joined to the chunk's exploded
n-grams, scored and summed by document. A frequent n-gram costs its slot one row a chunk, however often it occurs.
This is the shuffle join of exploded n-grams with their counts, in which each chunk's rows for a slot travel packed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .decontam import mix64

#: Bytes of text in a chunk, and distinct n-grams that a slot answers, about.
CHUNK_BYTES, SLOT_GRAMS = 8 << 20, 1 << 20
ALPHA, LEAST = 0.4, 2
_NONE = np.uint64(0x5851F42D4C957F2D)  # the n-gram of no words, whose count is the number of words


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of each word with the one before it."""
    words = text.encode("utf-8", "surrogatepass").split()
    one = mix64(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    return one, mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] + np.uint64(1))


def _chunk_grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram hashes of the texts, unigrams then bigrams of each text, and each text's number of words."""
    parts, n = [], []
    for t in texts:
        one, two = _hashed(t)
        parts += [one, two]
        n.append(len(one))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(n, np.int64)


def _planes(a: np.ndarray) -> bytes:
    """The bytes of 64-bit numbers by place: sorted keys and small counts then compress well in the shuffle."""
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(b: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind)[:, 0]


def _requests(slot_bits: int):
    def run(chunk: pa.Table) -> pa.Table:
        keys, n = _chunk_grams(chunk.column("text").to_pylist())
        keys, counts = np.unique(keys, return_counts=True)
        at = int(np.searchsorted(keys, _NONE))
        keys, counts = np.insert(keys, at, _NONE), np.insert(counts, at, n.sum())
        slot = (keys >> np.uint64(64 - slot_bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        end = np.append(cut[1:], len(slot))
        pieces = list(zip(cut.tolist(), end.tolist(), strict=True))
        return pa.table({
            "slot": slot[cut],
            "chunk": np.full(len(cut), chunk.column("chunk")[0].as_py(), np.int64),
            "keys": pa.array([_planes(keys[a:b]) for a, b in pieces], pa.binary()),
            "counts": pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in pieces], pa.binary()),
        })

    return run


def _answers(slot: pa.Table) -> pa.Table:
    """Total counts, for each request in its own order."""
    each = [_whole(k, np.uint64) for k in slot.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, np.int32) for c in slot.column("counts").to_pylist()])
    keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
    total = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)[inverse]
    ends = np.cumsum([len(k) for k in each])
    return pa.table({"slot": slot.column("slot"), "chunk": slot.column("chunk"), "totals": pa.array([_planes(t) for t in np.split(total, ends[:-1])], pa.binary())})


def _scores(alpha: float, least: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers.column("slot").to_numpy(), kind="stable")
        totals = answers.column("totals").to_pylist()
        total = np.concatenate([_whole(totals[i], np.int64) for i in order]) if totals else np.empty(0, np.int64)
        grams, n = _chunk_grams(docs.column("text").to_pylist())
        keys, inverse = np.unique(grams, return_inverse=True)
        at = int(np.searchsorted(keys, _NONE))
        if len(total) != len(keys) + 1:
            raise ValueError("a chunk was dealt anew between its request and its answer")
        words, total = total[at], np.delete(total, at)
        count = total[inverse].astype(float)
        score, backed, start = [], [], 0
        for m in n.tolist():
            one, two = count[start : start + m], count[start + m : start + 2 * m - 1] if m else count[:0]
            seen = two >= least
            s = math.log(one[0] / words) if m else 0.0
            s += float(np.where(seen, np.log(two) - np.log(one[:-1]), math.log(alpha) + np.log(one[1:] / words)).sum()) if m > 1 else 0.0
            score.append(s)
            backed.append(int((~seen).sum()))
            start += max(2 * m - 1, 0)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": n, "n_backoff": pa.array(backed, pa.int64()), "log_score": pa.array(score, pa.float64())})

    return run


def _dealt(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) for every row, and the bytes of all texts.

    The chunk is a hash of id and text, so a task that runs again deals alike in whatever order its rows come. Rows that
    repeat id and text until they fill more than a chunk are counted, and dealt in pieces of at most a chunk.
    """
    key, weight = F.xxhash64("doc_id", "text"), F.octet_length("text") + F.lit(16)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = rows.groupBy(key.alias("__key")).agg(F.count("*").alias("n"), F.sum(weight.cast("long")).alias("bytes"))
    often = (F.col("n") > 1) & (F.col("bytes") > chunk_bytes)
    total = each.agg(F.coalesce(F.sum(F.col("bytes") - 16 * F.col("n")), F.lit(0)).alias("size"), F.count_if(often).alias("often")).first()
    chunks = max(1, -(-total.size // chunk_bytes))
    chunk = lambda piece: F.pmod(F.xxhash64("doc_id", "text", piece), F.lit(chunks)).alias("chunk")
    if not total.often:
        return rows.select(chunk(F.lit(0).cast("long")), "doc_id", "text"), total.size
    hot = staged(each.where(often).select("__key"), "lm-often")  # fewer keys than chunks
    keyed = rows.withColumn("__key", key)
    many = keyed.join(hot, "__key", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    many = many.withColumn("most", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(chunk_bytes) / weight)))
    pieces = many.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("most"))))).repartition("doc_id", "text", "piece")
    own = F.least(F.col("most"), F.col("n") - F.col("piece") * F.col("most")).cast("int")
    spread = pieces.select(chunk(F.col("piece")), "doc_id", "text", F.explode(F.array_repeat(F.lit(0), own))).select("chunk", "doc_id", "text")
    return keyed.join(hot, "__key", "left_anti").select(chunk(F.lit(0).cast("long")), "doc_id", "text").unionByName(spread), total.size


def lm_scores(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES, slot_grams: int = SLOT_GRAMS) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score, word_score) for every row of ``docs``, under bigram counts of them all.

    A word after another scores c(ab) / c(a) if c(ab) is ``least`` or more, else ``alpha`` c(b) / N; a first word
    c(b) / N. log_score sums the logarithms, word_score is its mean. Null and blank texts have no words, log_score
    0 and a null word_score; repeated rows count and repeat, and any number of them leaves chunks small; an empty table gives an empty result; very long texts are read whole; other columns
    don't take part. n-grams are told apart by 64-bit hashes: among a trillion of them some 30,000 share one, and a
    shared count changes a score by less than rounding.
    """
    dealt, size = _dealt(docs, chunk_bytes)
    slot_bits = min(max(1, math.ceil(math.log2(max(2, size / 4 / slot_grams)))), 40)
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    requests = dealt.groupBy("chunk").applyInArrow(_requests(slot_bits), "slot long, chunk long, keys binary, counts binary")
    answers = requests.groupBy("slot").applyInArrow(_answers, "slot long, chunk long, totals binary")
    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(alpha, least), f"doc_id {doc_id}, n_words long, n_backoff long, log_score double")
    return scored.withColumn("word_score", F.try_divide("log_score", "n_words"))
