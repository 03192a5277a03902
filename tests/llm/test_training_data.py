"""Operators against brute-force versions on small tables, with null, empty, repeated and clashing input."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrisk.llm import common, decontam, langid, licenses, lm_scores, mixing, quality_fm, quality_rules, secrets, simhash_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(20)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t) if t else 0) for i, t, la, s in rows], SCHEMA)


def odd_rows():
    long = text(1, 30000)
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, text(4), "en", None), (4, text(4), "en", None), (5, text(4), "fr", "b"), (None, text(6), "en", "b"), (7, long, "en", "b"), (8, "one", "en", "c"), (9, "é ü ß", "de", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (7, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def every(df):
    return [r.asDict() for r in df.collect()]


ALL = {
    "secrets": lambda d, x: secrets.report(secrets.scan(d)),
    "leaks": lambda d, x: decontam.leaks(d, x.select(F.col("doc_id").alias("item_id"), F.lit("a b c d e f g").alias("text"))),
    "rules": lambda d, x: quality_rules.quality_rules(d, x),
    "simhash": lambda d, x: simhash_dedup.near_duplicates(d),
    "fm": lambda d, x: quality_fm.classify(d, x),
    "toxicity": lambda d, x: toxicity.classify(d, x),
    "licenses": lambda d, x: licenses.licenses(d),
    "lm": lambda d, x: lm_scores.lm_scores(d),
    "mixing": lambda d, x: mixing.mix(d),
    "langid": lambda d, x: langid.identify(d),
}


@pytest.mark.parametrize("name", ALL)
def test_odd_input(spark, odd, labels, name):
    """One row for each input row (leaks: for each match); empty tables and clashing column names work."""
    op = ALL[name]
    assert len(every(op(odd, labels))) == (0 if name == "leaks" else len(odd_rows()))
    assert every(op(odd.where("false"), labels)) == []
    clash = odd
    for c in ("score", "size", "fp", "spans", "label", "x", "target", "component_id", "root", "kept", "h", "chunk", "count", "w"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert len(every(op(clash, labels.where("false")))) == (0 if name == "leaks" else len(odd_rows()))


def test_secrets(spark):
    key = "Zk8QpL2vXw9TbR4mYc7N"
    hexes = "0123456789abcdef01234567"
    t = f"é Token = 'abc' password:hunter2x AKIA{'B' * 16} {hexes} bearer {key} and access_key_example_configuration"
    got = every(secrets.report(secrets.scan(table(spark, [(1, t, "en", "a"), (2, "ſecret = abcdefgh toKen=abcdefg", "en", "a")]))))[0:2]
    a, b = sorted(got, key=lambda r: r["doc_id"])
    assert (a["n_assign"], a["n_access"], a["n_hex"], a["n_novel"]) == (1, 1, 1, 1)
    base = []
    for kind, pattern, least, group in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t, re.I | re.A if kind == "assign" else 0) if len(m[group]) >= least]
    want = ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(base))
    assert a["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert f"novel:{t.index(key)}:{t.index(key) + len(key)}" in a["spans"]
    assert b["n_assign"] == 1  # the long s is no s
    cleaned = every(secrets.redact(table(spark, [(1, t, "en", "a"), (2, None, "en", "a")])))
    assert "hunter2x" not in cleaned[0]["text"] and key not in cleaned[0]["text"] and cleaned[0]["n_chars"] == len(cleaned[0]["text"]) and cleaned[1]["text"] is None


SECRET = "Zk8QpL2vXw9TbR4mYc7N"


@pytest.mark.parametrize(
    ("around", "n"),
    [
        ("bearer {}", 1),  # behind the word
        ("{} is the secret", 1),  # before it
        ("my_api_key-{}", 1),  # grown together with it
        ("token " + "x " * 40 + "{}", 0),  # too far away
        ("the parcel {}", 0),  # no sensitive word
        ("credential {0} and again {0}", 0),  # its own copy explains it
        ("token of configuration-management and AdministratorDirectory {:.0}", 0),  # names
        ("bearer a1b2c3d4e5f6 {:.0}", 1),  # a short one with digits
    ],
)
def test_only_novelty_finds(around, n):
    t = around.format(SECRET)
    assert secrets.base_spans(t) == []
    got = secrets.novel_spans(t, [], 0.9)
    assert len(got) == n and all(t[a:b] in (SECRET, "a1b2c3d4e5f6") for a, b, *_ in got)


def test_secret_scan_measures_once():
    """Long runs take time in proportion; a place near several sensitive words is measured once."""
    t = ("token secret " + SECRET + " key bearer ") * 3000
    calls = []
    own, secrets.novelty = secrets.novelty, lambda c, around: calls.append(c) or 1.0
    try:
        assert len(secrets.novel_spans(t, [], 0.9)) == 3000 == len(calls)
        run = "".join("token" if i % 100 == 0 else "aB3"[i % 3] for i in range(60000))
        assert sum(map(len, (run[a:b] for a, b in secrets.candidates(run)))) <= len(run)
    finally:
        secrets.novelty = own


def test_novelty_of_known_names():
    assert secrets.novelty("access_key_configuration", "") < 0.7 < secrets.novelty("Zk8QpL2vXw9TbR4mYc7N", "")


def test_decontamination(spark):
    items = [(1, text(11, 40)), (2, text(12, 25)), (3, "too short"), (4, None), (5, "")]
    near = items[0][1].split()
    near[39] = "other"
    far = [w if i % 4 else "zzz" for i, w in enumerate(items[0][1].split())]
    docs = [(1, text(20) + " " + items[0][1].upper() + " " + text(21), "en", "a"), (2, text(22) + " " + " ".join(near), "en", "a"), (3, " ".join(far), "en", "a"), (4, text(23), "en", "a"), (5, f"it is too short\n{items[1][1]}", "en", "a"), (6, None, "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 20, 50):  # one index, then several blocks
        got = {(r["doc_id"], r["item_id"]): r for r in every(decontam.leaks(table(spark, docs), bench, index_chars=chars))}
        assert set(got) == {(1, 1), (2, 1), (5, 2), (5, 3)}
        assert got[1, 1]["start_word"] == 60 and got[1, 1]["similarity"] == 1 and got[1, 1]["hamming"] == 0
        assert 0.8 <= got[2, 1]["similarity"] < 1
        assert {r["doc_id"] for r in every(decontam.without_leaks(table(spark, docs), bench, index_chars=chars))} == {3, 4, 6}


def plain_similarity(items, j, words, k=5):
    """Weighted Jaccard from counters: shingles weigh log(1 + items / items with it), those the item lacks as if of one item."""
    cut = lambda w: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    own = Counter(tuple(items[j][i : i + min(k, len(items[j]))]) for i in range(max(1, len(items[j]) - k + 1)))
    df = Counter(s for it in items for s in cut(it))
    other = Counter(tuple(words[i : i + min(k, len(items[j]))]) for i in range(max(1, len(words) - k + 1)))
    w = lambda s: math.log1p(len(items) / df[s]) if s in own else math.log1p(len(items))
    both = sum(w(s) * min(n, other[s]) for s, n in own.items())
    return both / (sum(w(s) * n for s, n in own.items()) + sum(w(s) * n for s, n in other.items()) - both)


def search_of(items, radius=18):
    df = Counter(s for it in items for s in {" ".join(it[i : i + 5]) for i in range(max(1, len(it) - 4))})
    return decontam.Search(decontam.Index(list(range(len(items))), [" ".join(it) for it in items], {s: n for s, n in df.items() if n > 1}, len(items)), 0.8, radius)


@pytest.mark.parametrize("radius", [0, 3, 15, 18, 19])
def test_tables_return_every_fingerprint_in_the_radius(radius):
    rng = np.random.default_rng(radius)
    search = search_of([text(i, 12).split() for i in range(40)], radius)
    far = search.prints[rng.integers(0, 40, 3000)]
    for _ in range(20):
        far = np.where(rng.random(3000) < 0.8, far ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)), far)
    w, i, d = search.near(far)
    want = {(a, b) for a, f in enumerate(far.tolist()) for b, p in enumerate(search.prints.tolist()) if (f ^ p).bit_count() <= radius}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want and len(w) == len(want) and (d <= radius).all()


def test_decontamination_against_all_windows():
    """The search finds what plain comparison of all windows finds, by similarity and radius."""
    rng = np.random.default_rng(5)
    items = [text(100 + i, 14 + i).split() for i in range(12)]
    items[3][:8] = items[4][:8]
    search = search_of(items)
    for trial in range(20):
        words = text(300 + trial, 80).split()
        own = list(items[int(rng.integers(12))])
        if trial % 2:
            own[int(rng.integers(len(own)))] = "edit"
        words[30:30] = own
        want = {}
        for j, it in enumerate(items):
            for at in range(len(words) - len(it) + 1):
                w = words[at : at + len(it)]
                prints = [decontam.fingerprints(h, len(h)).view(np.uint64)[0, 0] for h in (decontam.shingle_hashes(decontam.word_hashes([y.encode() for y in x]), 5) for x in (w, it))]
                s = plain_similarity(items, j, w)
                if s >= 0.8 - 1e-9 and int(prints[0] ^ prints[1]).bit_count() <= 18:
                    want[j] = max(want.get(j, 0), s)
        assert {m[0]: m[4] for m in search.matches(" ".join(words))} == pytest.approx(want)


def test_decontamination_of_truncated_items(spark):
    """Documents shorter than an item are held against the exact similarity, without the radius."""
    items = [text(700 + i, 20 + 4 * i).split() for i in range(10)]
    docs = {(i, cut, end): it[cut:] if end else it[: len(it) - cut] for i, it in enumerate(items) for cut in range(1, 14) for end in (0, 1)}
    search = search_of(items)
    found = 0
    for words in docs.values():
        want = {j: s for j in range(10) if len(words) < len(items[j]) and (s := plain_similarity(items, j, words)) >= 0.8 - 1e-9}
        assert {m[0]: m[4] for m in search.matches(" ".join(words)) if len(words) < len(items[m[0]])} == pytest.approx(want)
        found += len(want)
    assert 60 < found < len(docs)
    bench = spark.createDataFrame([(f"q{i}", " ".join(it)) for i, it in enumerate(items)], "item_id string, text string")
    rows = table(spark, [(1, " ".join(items[5][:-1]), "en", "a"), (2, " ".join(items[5][:9]), "en", "a")])
    for chars in (1 << 20, 300):  # weights and results are the same in blocks
        got = every(decontam.leaks(rows, bench, index_chars=chars))
        assert [(r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in got] == [(1, "q5", 0, 39)]
        assert got[0]["similarity"] == pytest.approx(plain_similarity(items, 5, items[5][:-1]))


def test_rule_statistics():
    rng = np.random.default_rng(2)
    for _ in range(30):
        words = [str(rng.integers(3)) for _ in range(int(rng.integers(0, 60)))]
        wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)}
        assert quality_rules.repeated_words([w.encode() for w in words]) == len(covered)
    counts, _ = quality_rules.statistics("a# b\u00a0c\n \na# b\u00a0c\n\nx <é>")  # a no-break space is part of a word
    assert counts == (6, 14, 4, 1, 0)


def test_isolation_forest():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, quality_rules.FEATURES)), rng.normal(8, 1, (10, quality_rules.FEATURES))])
    s = quality_rules.Forest(x).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.97)
    cut = quality_rules.threshold(s, np.arange(510) < 500)
    assert (s[:500] > cut).mean() <= 0.006


@pytest.mark.parametrize("leaves", [100_000, 20])
def test_simhash_components(spark, leaves):
    """Fingerprints and components as from plain comparison of all pairs, also where trie nodes are split in Spark."""
    rows = [(i, text(i % 120, 300), "en", "a") for i in range(150)]
    rows += [(200 + i, " ".join(w if k != i else "zz" for k, w in enumerate(text(3, 300).split())), "en", "a") for i in range(40)]
    rows += [(300, "", "en", "a"), (301, None, "en", "a"), (302, "A b", "en", "a"), (303, "a B", "en", "a")]
    got = every(simhash_dedup.near_duplicates(table(spark, rows), max_leaves=leaves))
    import xxhash

    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h) and h)

    fp = {i: plain(t) for i, t, *_ in rows}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got} == fp
    ids, root = sorted(fp), {i: i for i in fp}
    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == root
    kept = {r["doc_id"] for r in every(simhash_dedup.keep_one(table(spark, rows)))}
    assert kept == set(root.values())


@pytest.mark.parametrize("leaves", [100_000, 8])
def test_trie_join_finds_every_link(spark, leaves):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {int(x) for x in rng.integers(0, 1 << 63, 200)}
    for _ in range(300):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {(r.src & (1 << 64) - 1, r.dst & (1 << 64) - 1) for r in simhash_dedup.links(df, 2, leaves).collect()}

    def groups(edges):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return {frozenset(g) for g in out.values()}

    ordered = sorted(fps)
    assert groups(got) == groups((a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 2)


def test_keep_one_of_two_groups_of_one_id(spark):
    """An id that names texts of two groups keeps one row of each."""
    rows = [(1, text(1), "en", "a"), (1, text(2), "en", "a"), (2, text(1), "en", "a"), (3, text(2), "en", "a"), (1, text(2), "en", "b")]
    got = every(simhash_dedup.keep_one(table(spark, rows)))
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, text(1)), (1, text(2))])


def test_frequent_keys_are_joined_apart(spark):
    rows = spark.createDataFrame([(i, 0 if i % 2 else i) for i in range(4000)], "doc_id long, fp long")
    distinct = rows.groupBy("fp").agg(F.count("*").alias("rows"))
    hot = simhash_dedup.frequent(distinct, "fp")
    assert [r.fp for r in hot.collect()] == [0]
    got = common.join_known(rows, distinct, "fp", hot)
    assert got.count() == 4000 and got.where("fp = 0 AND rows = 2001").count() == 2001


def test_labelled_rows_that_repeat_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"t{i % 50}") for i in range(500)] + [(2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None)], "doc_id long, quality int")
    rows = common.labelled(docs, labels, "quality", 10, 1, -9)
    got = common.collected(rows, 20)
    assert len(got) == 20 and got == common.collected(rows.repartition(7), 20) and got == sorted(set(got))
    assert {(r.doc_id, r.label) for r in common.collected(rows, 100)} == {(1, 1), (2, 1)}


def test_keep_one_of_repeated_and_nameless(spark):
    rows = [(1, text(1), "en", "a"), (1, text(1), "en", "a"), (2, text(1), "en", "a"), (None, text(1), "en", "a"), (None, text(2), "en", "a"), (None, text(2), "en", "a"), (3, text(3), "en", "a")]
    got = every(simhash_dedup.keep_one(table(spark, rows)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", text(1)), ("None", text(2)), ("3", text(3))])


def test_factorisation_machine():
    """Linear-time margins equal the sum over all pairs; the machine learns an interaction."""
    rng = np.random.default_rng(0)
    d = quality_fm.WORDS + quality_fm.STATS + quality_fm.EXTRA
    x = (rng.random((3, d)) * (rng.random((3, d)) < 0.02)).astype(np.float32)
    m = quality_fm.Machine(np.zeros(d - quality_fm.WORDS), np.ones(d - quality_fm.WORDS), 0.1, rng.normal(size=d), rng.normal(size=(d, 4)))
    for row, got in zip(x, m.margin(x), strict=True):
        at = np.flatnonzero(row)
        pairs = sum((m.v[i] @ m.v[j]) * row[i] * row[j] for n, i in enumerate(at) for j in at[n + 1 :])
        assert got == pytest.approx(0.1 + row @ m.w + pairs, rel=1e-4, abs=1e-4)


def test_held_out_quality_and_toxicity(spark):
    rows = [(i, " ".join([text(i, 40), "trash moron" if i % 5 == 0 else "", "$$$ ### " * 10 if i % 3 == 0 else ""]), "en", "a") for i in range(400)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    q = {r["doc_id"]: r["predicted"] for r in every(quality_fm.classify(docs, labels))}
    assert np.mean([q[i] == (i % 3 != 0) for i in q]) > 0.97
    t = {r["doc_id"]: r["predicted"] for r in every(toxicity.classify(docs, labels))}
    assert np.mean([t[i] == (i % 5 == 0) for i in t]) > 0.97


def test_toxic_copies_are_over_the_whole_text():
    """Texts that share a long word are no copies; edited ones are, and the first stays."""
    own = [toxicity.terms_of(text(800 + i, 60).replace(" ", "x ") + " everywhere another because") for i in range(60)]
    edits = [toxicity.terms_of(" ".join([*sorted(s)[3:], "changed"])) for s in own]
    assert toxicity.copies([toxicity.signature(s) for s in own]) == []
    assert toxicity.copies([toxicity.signature(s) for s in own + edits]) == list(range(60, 120))
    assert toxicity.copies([toxicity.signature({"short"})] * 3) == []


def toxic_table(spark, n=300):
    rows = [(i, " ".join([text(i, 40), f"vileword{i % 2} idiot" if i % 5 == 0 else ""]), "en", "a") for i in range(n)]
    rows += [(n + i, " ".join([text(3, 40), f"edit{i} vileword0"]), "en", "a") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0 or i >= n)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    return rows, labels


def test_toxicity_is_repeatable(spark):
    """Layouts and numbers of partitions give the same scores to the last bit."""
    rows, labels = toxic_table(spark)
    got = []
    for order, parts in ((rows, 1), (rows[::-1], 3), (rows[1::2] + rows[::2], 7)):
        found = toxicity.classify(table(spark, order).repartition(parts), labels.repartition(parts))
        got.append({r["doc_id"]: (r["score"], r["predicted"]) for r in every(found)})
    assert got[0] == got[1] == got[2]
    assert np.mean([p == (i % 5 == 0 or i >= 300) for i, (_, p) in got[0].items()]) > 0.95


def test_scores_do_not_depend_on_the_batch(spark):
    """The quality scores of three layouts agree to the last bit; so do both classifiers' scores row by row."""
    rows = [(i, " ".join([text(i, 20 + i % 50), "$$$ ### " * (i % 7)]), "en", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 7 < 4), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = []
    for order, parts in ((rows, 1), (rows[::-1], 3), (rows[1::2] + rows[::2], 7)):
        found = quality_fm.classify(table(spark, order).repartition(parts), labels.repartition(parts))
        got.append({r["doc_id"]: (r["score"], r["predicted"]) for r in every(found)})
    assert got[0] == got[1] == got[2]
    rng = np.random.default_rng(5)
    d = quality_fm.WORDS + quality_fm.STATS + quality_fm.EXTRA
    x = (rng.random((200, d)) * (rng.random((200, d)) < 0.1)).astype(np.float32)
    m = quality_fm.Machine(np.zeros(d - quality_fm.WORDS), np.ones(d - quality_fm.WORDS), 0.1, rng.normal(size=d), rng.normal(size=(d, 8)))
    assert m.score(x).tolist() == [m.score(r[None])[0] for r in x]
    c = toxicity.Classifier({w: i for i, w in enumerate(WORDS)}, 0, rng.normal(size=len(WORDS) + 3), -1.0)
    words = [" ".join(rng.choice(WORDS, 9)) for _ in range(50)]
    for t in words:
        f = c.features(t).astype(float)
        assert c.score(t) == pytest.approx(1 / (1 + math.exp(1.0 - f @ c.w)), rel=1e-12)


def plain_label_model(votes, prior, rounds):
    """EM with loops: the table of log P(vote | class), and the posteriors under it with each voter's weight."""
    n, m = len(votes), len(votes[0])
    p = [0.98 if v.count(1) > v.count(-1) - sum(all(r[j] == -1 for r in votes) for j in range(m)) else 0.02 for v in votes]
    for _ in range(rounds):
        log, within = {}, [[0.0] * m for _ in range(m)]
        for c in (0, 1):
            w = [x if c else 1 - x for x in p]
            for j in range(m):
                counts = [sum(wi for wi, v in zip(w, votes, strict=True) if v[j] == k) + 0.5 for k in (-1, 0, 1)]
                for k, x in zip((-1, 0, 1), counts, strict=True):
                    log[j, c, k] = math.log(x / sum(counts))
            mean = [sum(wi * v[j] for wi, v in zip(w, votes, strict=True)) / sum(w) for j in range(m)]
            for a in range(m):
                for b in range(m):
                    within[a][b] += sum(wi * (v[a] - mean[a]) * (v[b] - mean[b]) for wi, v in zip(w, votes, strict=True)) / n
        sd = [math.sqrt(within[j][j]) + 0.05 for j in range(m)]
        weight = []
        for a in range(m):
            each = [1.0 if a == b else abs(within[a][b] / (sd[a] * sd[b])) for b in range(m)]
            weight.append(1 / sum(x for x in each if x > 0.2))
        p = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(weight[j] * (log[j, 1, v[j]] - log[j, 0, v[j]]) for j in range(m))
            p.append(1 / (1 + math.exp(-odds)))
    return log, weight, p


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_label_model_against_loops(rounds):
    rng = np.random.default_rng(3)
    y = rng.random(60) < 0.4
    votes = np.stack([np.where(rng.random(60) < a, np.where(rng.random(60) < b, 1, -1) * np.where(y, 1, -1), 0) for a, b in ((0.9, 0.9), (0.8, 0.8), (0.7, 0.9), (0.9, 0.6))], axis=1)
    model = toxicity.label_model(votes, 0.4, rounds)
    log, weight, p = plain_label_model(votes.tolist(), 0.4, rounds)
    for (j, c, k), x in log.items():
        assert model.table[j, c, k + 1] == pytest.approx(x)
    assert model.weight == pytest.approx(weight) and model.posterior(votes) == pytest.approx(p)


def test_named_voters():
    graded = toxicity.grades(["vile", "nasty", "mean", "bad", "poor", "low"])
    votes = dict(zip(toxicity.VOTERS, toxicity.votes_of("You are a real idiot, vile and mean!!! STOP!!", graded), strict=True))
    assert votes == {"insult": 1, "two insults": 0, "strong term": 1, "medium term": 1, "weak term": 0, "two terms": 1, "addressed insult": 1, "few shouts": 1, "exclamations": 1, "no term": 0, "no shout": 0}
    assert toxicity.votes_of("", graded) == [0] * 9 + [-1, 0] and toxicity.votes_of("fine words", graded)[-2:] == [-1, -1]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.9, y, ~y).astype(int) * 2 - 1
    fair = np.where(rng.random(4000) < 0.75, y, ~y).astype(int) * 2 - 1
    own = [np.where(rng.random(4000) < a, y, ~y).astype(int) * 2 - 1 for a in (0.85, 0.85, 0.8)]
    votes = np.stack([good, fair, fair, *own], axis=1)
    model = toxicity.label_model(votes, 0.3)
    assert model.weight[1] < model.weight[0] and model.weight[2] < model.weight[0]  # the twin voters share a say
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85


def test_licenses(spark):
    t = "Some words. Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nReleased under the MIT License!  All rights reserved."
    got = every(licenses.licenses(table(spark, [(1, t, "en", "a"), (2, "no license here", "en", "a")])))
    assert got[0]["sentence_ids"] == ["apache-ref", "apache-use", "apache-copy", "mit-ref", "reserved"]
    assert got[0]["licenses"] == ["Apache-2.0", "MIT", "all-rights-reserved"] and got[1]["licenses"] == []


MIT_FILE = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_FILE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_HEADER = """#!/bin/sh
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

echo hello
"""


def test_licence_files_as_they_stand(spark):
    """Wrapped sentences, comment marks, tags, and notices on lines of their own."""
    texts = [MIT_FILE, BSD_FILE, BSD_FILE.split("3. ")[0], APACHE_HEADER, "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "intro\nReleased under the MIT License\nmore words", "words without any notice"]
    got = [r["licenses"] for r in sorted(every(licenses.licenses(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))), key=lambda r: r["doc_id"])]
    assert got[0] == ["MIT"] and got[1] == ["BSD-3-Clause"] and got[2] == ["BSD-2-Clause"] and got[3] == ["Apache-2.0", "all-rights-reserved"][:1]
    assert got[4] == ["GPL-2.0-or-later"] and got[5] == ["MIT"] and got[6] == []


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_lm_scores(spark, chunk):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(0, 40)))), "en", "a") for i in range(40)] + odd_rows()
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    uni, bi = Counter(w for d in words for w in d), Counter(p for d in words for p in zip(d, d[1:], strict=False))
    n = sum(uni.values())
    want = []
    for (i, *_), d in zip(rows, words, strict=True):
        s = math.log(uni[d[0]] / n) if d else 0.0
        for a, b in zip(d, d[1:], strict=False):
            s += math.log(bi[a, b] / uni[a]) if bi[a, b] >= 2 else math.log(0.4 * uni[b] / n)
        want.append((str(i), len(d), round(s, 6)))
    got = [(str(r["doc_id"]), r["n_words"], round(r["log_score"], 6)) for r in every(lm_scores.lm_scores(table(spark, rows), chunk_bytes=chunk, slot_grams=64))]
    assert sorted(got) == sorted(want)


def test_mixing(spark):
    rng = np.random.default_rng(0)
    names = ["s%d" % i for i in range(7)] + [None]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), "en", names[int(rng.integers(8)) if i % 3 else 0]) for i in range(900)]
    got = every(mixing.mix(table(spark, rows)))
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full, total = {}, set(), sum(size.values())
    while True:
        left = total - sum(3 * size[s] for s in full)
        level = left / sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and level * weight[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    target = {s: 3 * size[s] if s in full else level * weight[s] for s in order}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    again = every(mixing.mix(table(spark, rows[::-1])))
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    full_rows = every(mixing.mix_rows(table(spark, rows)))
    assert sorted((r["doc_id"], r["copies"] * r["size"]) for r in full_rows) == sorted((r["doc_id"], r["taken"]) for r in got)


@pytest.mark.parametrize("ids", ["null", "same", "own"])
def test_mixing_without_distinct_ids(spark, ids):
    """Rows without id, or of one id, or that repeat one text, still meet each source's target."""
    rng = np.random.default_rng(1)
    rows = [({"null": None, "same": 7, "own": i}[ids], " ".join([f"w{i}"] * int(rng.integers(1, 30))), "en", "abc"[i % 3]) for i in range(300)]
    rows += [({"null": None, "same": 7, "own": 1000}[ids], "again and again", "en", "c")] * 700
    got = every(mixing.mix(table(spark, rows)))
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in "abc")
    again = every(mixing.mix(table(spark, rows[::-1]).repartition(5)))
    assert Counter((r["source"], r["size"], r["taken"]) for r in again) == Counter((r["source"], r["size"], r["taken"]) for r in got)
    whole = every(mixing.mix_rows(table(spark, rows)))
    assert Counter((r["source"], r["size"], r["taken"]) for r in whole) == Counter((r["source"], r["size"], r["taken"]) for r in got)


CLASHES = ("score", "passes", "source_size", "until", "gs", "target", "h", "found", "item_id", "spans", "label", "node", "fp", "key", "root", "rows", "m", "text_", "left", "base")


@pytest.mark.parametrize("name", ["good", "one", "wide", "leaks", "redact", "mix"])
def test_filters_keep_clashing_columns(spark, labels, name):
    from lumenrisk.llm import simhash_similar

    docs = table(spark, [(i, text(i), "en", "ab"[i % 2]) for i in range(1, 30)])
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("clash"))
    bench = spark.createDataFrame([(1, text(500), "clash")], "item_id long, text string, found string")
    out = {
        "good": lambda: quality_fm.keep_good(docs, labels),
        "one": lambda: simhash_dedup.keep_one(docs),
        "wide": lambda: simhash_similar.keep_one(docs),
        "leaks": lambda: decontam.without_leaks(docs, bench),
        "redact": lambda: secrets.redact(docs),
        "mix": lambda: mixing.mix_rows(docs),
    }[name]()
    got = every(out)
    kept = [c for c in CLASHES if name != "mix" or c != "target"]
    assert len(got) > 0 and all(r[c] == "clash" for r in got for c in kept)
    assert name == "mix" or out.columns == docs.columns


def test_rows_without_lang_are_not_learned(spark):
    """Also where another row of the same id has a lang."""
    rows = [(i, "aaa aab aac", "xx", "s") for i in range(40)] + [(100 + i, "bbb bbc bbd", "yy", "s") for i in range(40)]
    odd_ones = [(i, "bbb bbc bbd bbe bbf " * 30, None, "s") for i in range(40)]
    plain, more = langid.fit(table(spark, rows)), langid.fit(table(spark, rows + odd_ones))
    assert plain.langs == more.langs and (plain.keys == more.keys).all() and (plain.rank == more.rank).all()


def test_language_id(spark):
    en, de = "the cat and the dog are with the other", "der hund und die katze sind mit dem anderen"
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.permutation((en if i % 2 else de).split())), "en" if i % 2 else "de", "a") for i in range(60)] + [(100, None, "en", "a"), (101, "12 34", None, "a")]
    got = {r["doc_id"]: r for r in every(langid.identify(table(spark, rows)))}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0


def test_language_distance():
    """The vectorised distance equals the plain one."""
    profile = {g: r for r, g in enumerate(["t", "h", " t", "th", "e ", "he"])}
    letters = langid.letters("The heat, the THE")
    text_ = "".join(" " if c == 0 else chr(c) for c in letters)
    assert text_ == " the heat the the "
    grams = [c for c in text_ if c != " "] + [text_[i : i + 2] for i in range(len(text_) - 1)] + [text_[i : i + 3] for i in range(len(text_) - 2) if text_[i + 1] != " "]
    alphabet = np.array(sorted({ord(c) for c in text_ if c != " "} | {ord(c) for g in profile for c in g if c != " "}), np.uint32)
    base, code = len(alphabet) + 3, {chr(c): i + 2 for i, c in enumerate(alphabet)} | {" ": 0}

    def key(g):
        c = [code[x] for x in g] + [-1] * (3 - len(g))
        return c[0] * base * base + (c[1] + 1) * base + c[2] + 1

    keys = np.array(sorted(key(g) for g in profile))
    rank = np.full((1, len(keys)), 10)
    for g, r in profile.items():
        rank[0, np.searchsorted(keys, key(g))] = r
    lang, score = langid.Profiles(["xx"], alphabet, keys, rank, 10).predict("The heat, the THE")
    counts = Counter(grams)
    mine = sorted(counts, key=lambda g: (-counts[g], key(g)))[: langid.RANKS]
    far = sum(abs(profile[g] - i) if g in profile else 10 for i, g in enumerate(mine))
    assert lang == "xx" and score == pytest.approx(1 - far / (10 * len(mine)))
