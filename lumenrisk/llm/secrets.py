"""Secret scan: fixed pattern kinds, and dictionary-primed zstandard novelty for what the patterns miss.

A candidate is a mixed string near a sensitive word, before or behind it or grown together with it. It is compressed
with a dictionary made of common identifiers, of the words that the corpus itself uses most around sensitive places,
and of the text around it; the bytes it adds, against its length, say how much of it neither explains. Incompressible ones are reported as kind
``novel``. What the patterns find is measured in the same way and keeps its place whatever the measure.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, per_document

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that make a neighbourhood sensitive, how far on or back a candidate may lie, and the text that primes it.
CONTEXT = re.compile(r"passphrase|passw|pwd|secret|token|api.?key|access.?key|private.?key|authori[sz]|bearer|credential|signature", re.I | re.A)
REACH, BACK, AROUND = 64, 32, 512
#: Characters of a candidate; those under ``LONG`` need a digit and a letter, longer ones two kinds of characters.
CANDIDATE, SHORT, LONG = re.compile(r"[A-Za-z0-9+/_=~.!#@$%^&*-]{12,}"), 12, 16
#: Marks around a candidate that are not part of it; an address of mail, which is no secret.
_OUTER, MAIL = "+/_=~.!#@$%^&*-", re.compile(r"[A-Za-z0-9+_.-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Parts of names (letters of one case, or a capital and small ones) that are counted, the documents that must have one, how many are taken.
PART, LEAST_DOCS, TAKEN = re.compile(r"[A-Z]?[a-z]{3,20}|[A-Z]{4,20}"), 5, 500
#: Names that code uses around secrets; strings made of them are no secrets.
IDENTIFIERS = (
    "access_key access_token account administrator algorithm api_key application argument attribute authenticate "
    "authorization backend base64 bearer boolean buffer callback certificate character checksum class client_id "
    "client_secret cluster collection column command component config configuration connection constant container "
    "content context controller cookie credential database default definition description destination development "
    "dictionary directory document element encoding encryption endpoint environment example exception expression "
    "false field filename filesystem format framework frontend function generator github handler hash_algorithm "
    "header host http https identifier implementation import index instance integer interface iterator javascript "
    "json key_id keyword language length library localhost location manager message metadata method middleware "
    "module namespace network none notification null number object operation option org output package parameter "
    "passphrase password path permission placeholder platform plugin private_key process production project "
    "property protocol provider public_key python query reference refresh_token registry repository request "
    "resource response return root_password router runtime schema script secret_key security sequence server "
    "service session session_token settings signature source staging standard statement static status storage "
    "string structure subscription system template terminal test_token timestamp token true type undefined unicode "
    "update username utility validate value variable version www.example.com xxxxxxxxxxxxxxxx 0000000000000000 "
    "0123456789 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ your_api_key_here changeme"
)
#: The window holds identifiers, neighbourhood and a long candidate; small tables, as both are small.
_PARAMS = zstandard.ZstdCompressionParameters.from_level(19, window_log=17, hash_log=13, chain_log=14, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)


def _packed(raw: bytes, primer: str) -> int:
    known = zstandard.ZstdCompressionDict(primer.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(dict_data=known, compression_params=_PARAMS).compress(raw))


#: What stands before a candidate in its frame: known text, so that a block with matches is begun already and a match
#: inside the candidate costs no more than itself.
_ANCHOR = IDENTIFIERS[:96].encode()


def novelty(candidate: str, around: str) -> float:
    """Bytes that the candidate adds to its primed frame, over its own bytes. ``around``: the corpus's words and the
    neighbourhood."""
    raw, primer = candidate.encode("utf-8", "surrogatepass"), f"{IDENTIFIERS} {around}"
    return (_packed(_ANCHOR + raw, primer) - _packed(_ANCHOR, primer)) / max(len(raw), 1)


def _novelty_at(text: str, a: int, b: int, words: str) -> float:
    return novelty(text[a:b], words + text[max(0, a - AROUND) : a] + text[b : b + AROUND])


def parts_near(text: str) -> set[str]:
    """Parts of names around the sensitive words of a text, each once; linear in the text."""
    out, until = set(), 0
    for m in CONTEXT.finditer(text):
        a, b = max(until, m.start() - AROUND), m.end() + AROUND
        if a < b:
            out.update(p[0] for p in PART.finditer(text, a, min(b, len(text))))
            until = b
    return out


def corpus_words(docs: DataFrame) -> str:
    """The ``TAKEN`` parts of names that most documents have around sensitive words, the most frequent one last.

    They are counted over all documents, as an aggregate by part. Parts are plain words, so a secret that many copies
    of a document repeat can't enter and explain itself.
    """
    each = per_document(docs, lambda ts: {"parts": [sorted(parts_near(t)) for t in ts]}, [field("parts", T.ArrayType(T.StringType()))], keep=())
    counts = each.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS)
    return "".join(f"{r.part} " for r in reversed(counts.orderBy(F.desc("n"), "part").limit(TAKEN).collect()))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Mixed strings in sensitive places, each once; a sensitive word inside a string cuts it. Linear in the text."""
    context = [m.span() for m in CONTEXT.finditer(text)]
    if not context:
        return
    at = 0
    for m in CANDIDATE.finditer(text):
        while at < len(context) and context[at][1] + REACH <= m.start():
            at += 1
        if at == len(context):
            return
        if context[at][0] - BACK >= m.end():
            continue
        start, inside = m.start(), at
        while inside < len(context) and context[inside][0] < m.end():
            if context[inside][0] >= start:
                yield from _mixed(text, start, context[inside][0])
            start, inside = max(start, context[inside][1]), inside + 1
        yield from _mixed(text, start, m.end())


def _mixed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    own = text[a:b]
    a, b = a + len(own) - len(own.lstrip(_OUTER)), b - (len(own) - len(own.rstrip(_OUTER))) if own.strip(_OUTER) else a
    if b - a < SHORT or MAIL.fullmatch(text, a, b):
        return
    own = text[a:b]
    digit, lower, upper = (any(f(c) for c in own) for f in (str.isdigit, str.islower, str.isupper))
    if digit and (lower or upper) or b - a >= LONG and lower and upper:
        yield a, b


def novel_spans(text: str, taken: Sequence[tuple[int, int, str]], threshold: float, words: str = "") -> list[tuple[int, int, str, float]]:
    """Incompressible candidates near a sensitive word that overlap no given span."""
    found = []
    ends, starts, until = [], [], 0
    for a, b, _ in sorted(taken):  # disjoint unions of the given spans
        if starts and a <= until:
            ends[-1] = until = max(until, b)
        else:
            starts.append(a)
            ends.append(until := b)
    for a, b in candidates(text):
        i = bisect_left(ends, a + 1)
        if i < len(starts) and starts[i] < b:
            continue
        new = _novelty_at(text, a, b, words)
        if new >= threshold:
            found.append((a, b, "novel", new))
    return found


def spans_of(text: str, threshold: float, words: str = "") -> list[tuple[int, int, str, float]]:
    """All spans with their novelty, by start and then by kind as listed."""
    base = base_spans(text)
    every = [(a, b, k, _novelty_at(text, a, b, words)) for a, b, k in base] + novel_spans(text, base, threshold, words)
    return sorted(every, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end, novelty) in code points, ends exclusive.

    Every row gives a row, with an empty array for null, empty or clean texts; repeated rows repeat; spans that begin
    at one place stand in the order of their kinds; words of equal frequency are ordered by code point; very long texts are read whole, in time that grows with their
    length; an empty table gives an empty result; other columns don't take part, whatever their names.
    """
    words = corpus_words(docs)
    one = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("novelty", T.DoubleType())])

    def kernel(texts: list[str]) -> dict:
        return {"spans": [[{"kind": k, "start": a, "end": b, "novelty": new} for a, b, k, new in spans_of(t, threshold, words)] for t in texts]}

    return per_document(docs, kernel, [field("spans", T.ArrayType(one))])


def redact(docs: DataFrame, threshold: float = 0.9, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's span replaced by ``mark``; n_chars, if there, follows. Other rows are untouched.

    Of overlapping spans the union is replaced. A null text stays null, an empty one empty; repeated rows repeat; an
    empty table gives an empty result; other columns stay as they are, whatever their names.
    """

    words = corpus_words(docs)

    def clean(t: str) -> str:
        out, at = [], 0
        for a, b, *_ in spans_of(t, threshold, words):
            if b > at:
                out += [t[at:a], mark] if a >= at else []
                at = b
        return "".join([*out, t[at:]])

    others = [c for c in docs.columns if c != "text"]
    cleaned = per_document(docs, lambda ts: {"__clean": [clean(t) for t in ts]}, [field("__clean", T.StringType())], keep=[*others, F.col("text").isNull().alias("__null")])
    text = F.when(F.col("__null"), None).otherwise(F.col("__clean"))
    change = {"text": text} | ({"n_chars": F.when(F.col("__null"), F.col("n_chars")).otherwise(F.length("__clean").cast("long"))} if "n_chars" in docs.columns else {})
    return cleaned.withColumns(change).select(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    """The digest columns of a scan: counts by kind, sha256 of the base spans, all spans and their novelty as text."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = text(F.filter("spans", lambda s: s["kind"] != "novel"))
    new = F.array_join(F.transform("spans", lambda s: F.format_number(s["novelty"], 3)), ",")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), n("novel").alias("n_novel"), new.alias("novelty"))
