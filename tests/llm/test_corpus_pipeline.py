"""Groups of similar documents and the whole pipeline against plain comparison of all pairs."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenrisk.llm import mixing, quality_fm, secrets, simhash_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS) + str(rng.integers(20)) for _ in range(n))


def edited(t, seed, n):
    """``t`` with ``n`` of its words replaced."""
    rng, w = np.random.default_rng(seed), t.split()
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"edit{seed}x{k}"
    return " ".join(w)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else 0) for i, t, s in rows], SCHEMA)


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_shingles(t, k=5):
    w = plain_words(t)
    return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def plain_groups(texts):
    """Smallest id of each id's group, by exact similarity of all pairs."""
    sets = {i: set(plain_shingles(t)) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            same = not sets[a] and not sets[b]
            if a < b and root[a] != root[b] and (same or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root


def near_rows():
    rows = [(i, text(i, 300), "a") for i in range(60)]
    rows += [(100 + i, edited(text(i, 300), i, 1 + i % 12), "b") for i in range(60)]  # similarity 0.97 to 0.68
    rows += [(200 + i, text(i % 3, 300).upper(), "b") for i in range(12)]
    return rows + [(300, "", "a"), (301, None, "a"), (302, " \n", "b"), (303, "A b", "a"), (304, "a  B", "a"), (305, "a c", "a")]


def test_groups_as_from_all_pairs(spark):
    rows = near_rows()
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_documents(table(spark, rows)).collect()}
    want = plain_groups({i: t for i, t, _ in rows})
    assert got == want and 60 < len(set(want.values())) < 100
    assert sorted(r.doc_id for r in simhash_similar.keep_one(table(spark, rows)).collect()) == sorted(set(want.values()))


def test_large_group_of_near_copies(spark):
    """Nodes of many leaves are compared by pivots, hubs in blocks; the group stays whole and strangers stay out."""
    rows = [(i, edited(text(1, 300), i, 1 + i % 3), "a") for i in range(700)] + [(1000 + i, text(500 + i, 300), "a") for i in range(20)]
    got = Counter(r.component_id for r in simhash_similar.similar_documents(table(spark, rows)).collect())
    assert got == {0: 700} | {1000 + i: 1 for i in range(20)}


def test_repeated_nameless_and_clashing_rows(spark):
    rows = [(1, text(1), "a"), (1, text(1), "a"), (2, text(1), "a"), (None, text(1), "a"), (None, text(2), "a"), (None, text(2), "a"), (3, text(3), "a")]
    docs = table(spark, rows).selectExpr("*", "'clash' AS node", "'clash' AS root", "'clash' AS fp", "'clash' AS component_id", "'clash' AS shingles")
    got = simhash_similar.keep_one(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", text(1)), ("None", text(2)), ("3", text(3))])
    assert got[0].node == "clash" and simhash_similar.keep_one(docs.where("false")).collect() == []


def test_strongest_forest():
    """As many links as a spanning forest has, of the least total distance."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 40, 300), rng.integers(40, 80, 300)
    d = rng.permutation(300)
    a, b, e = simhash_similar.strongest(x, y, d)
    root, want = list(range(80)), []
    for k in np.argsort(d):
        if root[x[k]] != root[y[k]]:
            root = [root[x[k]] if r == root[y[k]] else r for r in root]
            want.append(int(d[k]))
    assert sorted(e.tolist()) == sorted(want) and len(a) == len(b) == len(want)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: good and bad documents, near copies, benchmark passages, secrets, empty texts."""
    items = [(i, text(9000 + i, 40)) for i in range(3)]
    rows = [(i, text(i, 120), "ab"[i % 2]) for i in range(160)]
    rows += [(200 + i, edited(text(i, 120), i, 1 + i % 2), "b") for i in range(30)]
    rows += [(300 + i, " ".join([text(700 + i, 60), items[i % 3][1].upper(), text(800 + i, 60)]), "a") for i in range(9)]
    rows += [(400 + i, text(900 + i, 100) + f" password = hunter{i}secret", "c") for i in range(9)]
    rows += [(500 + i, text(1000 + i, 30) + " $$$ ### %%% " * 20, "a") for i in range(80)]
    rows += [(600, "", "a"), (601, None, None)]
    path = tmp_path_factory.mktemp("tables")
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int(i < 500), 0) for i, *_ in rows if i < 600]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, items


def test_pipeline_against_plain_stages(spark, folder):
    path, rows, items = folder
    texts = {i: t for i, t, _ in rows}
    docs, labels = table(spark, rows), spark.read.parquet(f"{path}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality_fm.classify(docs, labels).collect()}
    assert all(scores[i] >= 0.3 for i in range(160)) and not any(scores[i] >= 0.3 for i in range(500, 580))
    left = {i: t for i, t in texts.items() if scores[i] >= 0.3}
    left = {i: left[i] for i in set(plain_groups(left).values())}
    marks = [" ".join(plain_words(t)) for _, t in items]
    left = {i: t for i, t in left.items() if not any(m in " ".join(plain_words(t)) for m in marks)}
    assert not any(200 <= i < 400 for i in left) and all(i in left for i in range(160))
    hidden = {i: re.sub(r"password = \w+", "[SECRET]", t) if t else t for i, t in left.items()}
    got = corpus_pipeline.run(spark, path).collect()
    mixed = {r.doc_id: r.copies for r in mixing.mix(table(spark, [(i, hidden[i], s) for i, _, s in rows if i in hidden])).collect() if r.copies > 0}
    assert Counter(r.doc_id for r in got) == Counter(list(mixed)) and {r.doc_id: r.copies for r in got} == mixed
    assert {r.doc_id: r.text for r in got} == {i: hidden[i] for i in mixed}
    assert not any(re.search("hunter[0-9]", r.text or "") for r in got)


def test_stages_return_the_documents_columns(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema == docs.schema
    assert secrets.redact(docs).count() == docs.count()


@pytest.mark.parametrize("leaves", [5, 40])
def test_split_nodes_lose_nothing(spark, leaves):
    """Nodes taken further down in Spark give the same groups."""
    rows = near_rows() + [(2000 + i, edited(text(5, 300), i, 1 + i % 3), "a") for i in range(200)]
    docs = table(spark, rows)
    want = {r.doc_id: r.component_id for r in simhash_similar.similar_documents(docs).collect()}
    assert {r.doc_id: r.component_id for r in simhash_similar.similar_documents(docs, max_leaves=leaves).collect()} == want


def test_texts_of_few_words_are_linked_exactly(spark):
    """Up to 13 shingles, all links that plain comparison finds, however coarse their fingerprints."""
    rng, texts = np.random.default_rng(4), {}
    for g in range(60):
        base = text(5000 + g, int(rng.integers(5, 18))).split()
        for v in range(5):
            w = list(base)
            for _ in range(v % 3):
                kind = int(rng.integers(3))
                at = int(rng.integers(len(w))) if kind else int(rng.integers(2)) * len(w)
                w[at:at] = ["new"] if kind == 0 else []
                if kind == 1 and len(w) > 5:
                    del w[0 if at % 2 else -1]
                if kind == 2:
                    w[0 if at % 2 else -1] = f"edit{v}"
            texts[10 * g + v] = " ".join(w[:17])
    rows = [(i, t, "a") for i, t in texts.items()]
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_documents(table(spark, rows)).collect()}
    want = plain_groups(texts)
    assert got == want and 60 < len(set(want.values())) < 240


def reachable_groups(texts, size=3):
    """Groups by all pairs that are similar and whose fingerprints are near in a section of ``size`` bytes and as a whole."""
    ids = sorted(texts)
    sets = [simhash_similar.shingle_set(texts[i])[1] for i in ids]
    fp = np.stack([np.frombuffer(simhash_similar.wide_fingerprint(h, 16 * size), np.uint8) for h in sets])
    bits = np.bitwise_count(fp[:, None] ^ fp[None, :]).astype(int)
    near = (bits.reshape(len(ids), len(ids), 16, size).sum(-1) < size).any(-1) & (bits.sum(-1) <= simhash_similar._expected_bits(0.8, simhash_similar.SPREAD, 128 * size))
    root = {i: i for i in ids}
    for a, b in np.argwhere(near).tolist():
        both = len(np.intersect1d(sets[a], sets[b]))
        x, y = sorted((root[ids[a]], root[ids[b]]))
        if x != y and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            root = {k: x if v == y else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("many", [12, 90])
def test_groups_whose_pairs_straddle_the_similarity(spark, many):
    """Where links of the forest fail the exact check, the other near pairs of their parts are checked."""
    texts = {1000 * g + i: edited(text(900 + g, 120), 1000 * g + i, 1 + i % 3) for g in range(120 // many + 3) for i in range(many)}
    docs = table(spark, [(i, t, "a") for i, t in texts.items()])
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_documents(docs).collect()}
    assert got == reachable_groups(texts)


@pytest.mark.parametrize("size,leaves", [(4, 1 << 20), (5, 40), (6, 1 << 20)])
def test_wider_sections_find_what_they_reach(spark, size, leaves):
    texts = {1000 * g + i: edited(text(700 + g, 150), 1000 * g + i, 1 + i % 3) for g in range(6) for i in range(15)}
    docs = table(spark, [(i, t, "a") for i, t in texts.items()])
    got = {r.doc_id: r.component_id for r in simhash_similar.similar_documents(docs, section=size, max_leaves=leaves).collect()}
    assert got == reachable_groups(texts, size)


def test_sections_grow_with_the_texts_at_the_same_recall():
    assert [simhash_similar.section_bytes(n) for n in (0, 256_410, 3_000_000, 10_000_000, 500_000_000, 5 * 10**9, 10**12)] == [3, 3, 3, 4, 5, 6, 6]
    rng, found = np.random.default_rng(8), {s: [0, 0] for s in (3, 4, 5, 6)}
    for _ in range(400):  # sets of a similarity of 0.80 to 0.84
        n = int(rng.integers(40, 400))
        both = round(n * rng.uniform(0.80, 0.84))
        h = rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)
        a, b = h[: both + (n - both) // 2], np.concatenate((h[:both], h[both + (n - both) // 2 :]))
        for size, count in found.items():
            x, y = (np.frombuffer(simhash_similar.wide_fingerprint(v, 16 * size), np.uint8) for v in (a, b))
            bits = np.bitwise_count(x ^ y).astype(int)
            count[0] += (bits.reshape(16, size).sum(1) < size).any() and bits.sum() <= simhash_similar._expected_bits(0.8, simhash_similar.SPREAD, 128 * size)
            count[1] += 1
    recalls = {s: k / n for s, (k, n) in found.items()}
    print(recalls)
    assert min(recalls.values()) > 0.98
