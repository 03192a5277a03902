"""The source divergence audit against plain counting, and the pointer sort against sorted()."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenrisk.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    rows = [tuple(x or "" for x in r[1:4]) for r in rows]
    docs, count, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall(text.translate(LOWER))
        docs.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(w for la, w in docs if la == lang and docs[la, w] >= least)

        def p(names, kept=kept, lang=lang):
            n = {w: sum(count[lang, s, w] for s in names) for w in kept}
            return {w: 1 + 1_000_000_000 * (n[w] + 5) // (sum(n.values()) + 5 * len(kept)) for w in kept}

        q, each = p(sources), {s: p([s]) for s in sources}
        for s in sources:
            pairs = [("pair", o, sum(abs(each[s][w] - each[o][w]) for w in kept)) for o in sources if o != s]
            terms = [("term", w, each[s][w] - q[w]) for w in kept if count[lang, s, w] and each[s][w] > q[w]]
            for part, most in ((pairs, None), (terms, top)):
                for rank, (name, item, value) in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1):
                    out.append((lang, s, name, item, value, rank))
    return sorted(out)


def found(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


WORDS = ["Alpha", "beta", "GAMMA-delta", "übergroß", "Ünder", "extraordinarily", "extraordinarilyx", "extraordinary", "x", "中文字", "a1b2", "\x00nul", "é", "it's"]


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS, rng.integers(0, 12))), ["en", "de", None, "fr"][rng.choice(4, p=[0.6, 0.2, 0.1, 0.1])], ["s1", "s2", "ß", None][rng.choice(4, p=[0.5, 0.2, 0.2, 0.1])], "t", 7) for i in range(n)]


@pytest.mark.parametrize("least,top", [(1, 50), (8, 3)])
def test_audit_against_plain_counting(spark, least, top):
    rows = rows_of(1, 200)
    rows += rows[:30] + [(500, None, "xx", "only", "t", 7), (501, "  12 ", "yy", "a", "t", 7), (502, "", "yy", "b", "t", 7), (503, "long " * 40000 + "Alpha", "en", "s1", "t", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(divergence.divergence(df.repartition(3), least, top)) == plain(rows, least, top)
    assert found(divergence.divergence(df.coalesce(1), least, top)) == plain(rows, least, top)


def test_empty_table(spark):
    assert found(divergence.divergence(spark.createDataFrame([], SCHEMA))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAZé中 .", max_size=40), max_size=30))
def test_pointer_sort(texts):
    body = pa.array(["skipped", *texts], pa.large_string()).slice(1)
    group = np.arange(len(texts)) % 3
    if not texts:
        return
    words, of, n, docs = divergence.shard_counts(body, group)
    count, each = Counter(), Counter()
    for t, g in zip(texts, group.tolist(), strict=True):
        own = [w.encode() for w in TERM.findall(t.translate(LOWER))]
        count.update((w, g) for w in own)
        each.update((w, g) for w in set(own))
    assert {(w, g): (a, b) for w, g, a, b in zip(words.to_pylist(), of.tolist(), n.tolist(), docs.tolist(), strict=True)} == {k: (count[k], each[k]) for k in count}
    assert words.to_pylist() == sorted(words.to_pylist())


def test_large_slices_are_split_in_three():
    """More pointers than plain sorting takes, a third of them one word, others equal in their first eight and sixteen bytes."""
    rng = np.random.default_rng(2)
    names = [b"the", b"thereabouts", b"thereaboutsandfurtheron", b"thereaboutsandfurtherin", *[f"w{i}".encode() for i in range(500)]]
    picks = [names[0] if rng.random() < 0.33 else names[rng.integers(len(names))] for _ in range(90000)]
    data = np.frombuffer(b" ".join(picks), np.uint8)
    data = np.frombuffer(bytes(data).translate(bytes.maketrans(b"0123456789", b"abcdefghij")), np.uint8)
    start, length, _ = divergence.word_pointers(data, np.array([0, len(data)]))
    order, first = divergence.multikey_quicksort(data, start, length)
    raw = data.tobytes()
    words = [raw[s : s + n] for s, n in zip(start[order].tolist(), length[order].tolist(), strict=True)]
    assert words == sorted(words)
    assert first.tolist() == [i == 0 or words[i] != words[i - 1] for i in range(len(words))]
    same = [a < b for a, b, w, v in zip(order, order[1:], words, words[1:], strict=False) if w == v]
    assert all(same)
