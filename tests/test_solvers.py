"""Network simplex, Adam and byte pairs against plain versions."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrisk.functions.bytepairs import BytePairs
from lumenrisk.operators import captions as C
from lumenrisk.operators import kernels as K
from lumenrisk.operators import learn as L
from lumenrisk.operators import network as N


@pytest.mark.parametrize("n,m", [(2, 3), (5, 5), (17, 9), (40, 40), (64, 64)])
def test_both_solvers_agree(n, m):
    rng = np.random.default_rng(n)
    for kind in range(4):
        cost = rng.random((n, m)) if kind % 2 else rng.integers(0, 4, (n, m)).astype(float)
        a, b = (rng.random(n), rng.random(m)) if kind < 2 else (np.ones(n), np.ones(m))  # equal masses: degenerate
        assert K.transport(a, b, cost, "emd") == pytest.approx(K.transport(a, b, cost, "linprog"), abs=1e-9)
    sparse = np.where(rng.random(n) < 0.6, 0.0, 1.0) + np.eye(n)[0]
    assert K.transport(sparse, np.ones(m), cost, "emd") == pytest.approx(K.transport(sparse, np.ones(m), cost, "linprog"), abs=1e-9)


def plain_network(x, y, net, batch, hidden, rate, passes, alpha, seed, n):
    """Adam with one loop over units and no layers of its own: two matrices and two vectors."""
    width = x.shape[1]
    cut = np.cumsum([width * hidden, hidden, hidden, 1])
    w1, b1, w2, b2 = np.split(net.w.copy(), cut[:-1])
    w1, order = w1.reshape(width, hidden), np.random.default_rng(seed + 1)
    p = [w1, b1, w2, b2]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(passes):
        for k in order.permutation(n):
            own = batch == k
            if not own.any():
                continue
            h = np.maximum(x[own] @ p[0] + p[1], 0)
            e = 1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[own]
            back = np.outer(e, p[2]) * (h > 0)
            g = [(x[own].T @ back + alpha * p[0]) / own.sum(), back.mean(0), (h.T @ e + alpha * p[2]) / own.sum(), np.array([e.mean()])]
            step += 1
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8 / math.sqrt(1 - 0.999**step))
    return np.concatenate([q.ravel() for q in p])


def test_adam_step_for_step(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y, strict=True)], "x array<double>, label int").repartition(3)
    dealt = {tuple(r.x): r.batch for r in N.batches_of(rows, 3).collect()}
    batch = np.array([dealt[tuple(r.tolist())] for r in x])
    got = N.fit(rows, 3, (4,), 0.05, max_iter=3, batch_size=30, alpha=0.01)
    want = plain_network(x, y, N.blank(3, (4,), 42), batch, 4, 0.05, 3, 0.01, 42, 3)
    assert got.w == pytest.approx(want, abs=1e-9)
    assert len(got.losses) == 3 and got.losses[-1] < got.losses[0]
    slow = N.fit(rows, 3, (4,), 0.0005, max_iter=1, batch_size=30)
    assert 0 < np.abs(slow.w - N.blank(3, (4,), 42).w).max() < 0.002  # the rate is in force


def test_adam_in_runs_and_in_tasks(spark, monkeypatch):
    """Many mini-batches are few Spark jobs; runs of any size, summed gradients and repeated rows give the plain weights."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 3)), 2, axis=0)
    y = np.tile([0, 1, 1, 1], 30)
    rows = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y, strict=True)], "x array<double>, label int").repartition(3)
    dealt = {tuple(r.x): r.batch for r in N.batches_of(rows, 20).collect()}
    batch = np.array([dealt[tuple(r.tolist())] for r in x])
    want = plain_network(x, y, N.blank(3, (4,), 42), batch, 4, 0.05, 2, 0.01, 42, 20)
    fit = lambda: N.fit(rows, 3, (4,), 0.05, max_iter=2, batch_size=6, alpha=0.01)
    spark.sparkContext.setJobGroup("adam", "runs")
    got = fit()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("adam"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got.w == pytest.approx(want, abs=1e-9) and jobs < 20  # one job a step would be 40
    monkeypatch.setattr(N, "RUN_BYTES", 8 * 5 * 6 * 3)  # three mini-batches a run
    assert (fit().w == got.w).all()
    monkeypatch.setattr(N, "RUN_BYTES", 0)
    assert fit().w == pytest.approx(want, abs=1e-9)


def test_network_gradient_against_differences():
    rng = np.random.default_rng(2)
    net, x, y = N.blank(3, (5, 4), 7), rng.normal(size=(11, 3)), rng.integers(0, 2, 11)
    g, loss = net.gradient(x, y)
    for i in rng.permutation(len(net.w))[:25]:
        w = net.w.copy()
        w[i] += 1e-6
        assert (N.Network(net.sizes, w).gradient(x, y)[1] - loss) / 1e-6 == pytest.approx(g[i], abs=1e-3)


def test_network_learns_in_the_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    rows = spark.createDataFrame([(r.tolist(), int(r[0] > r[1])) for r in x], "x array<double>, label int").withColumn("features", F.lit(0))
    net, best, f1 = L.grid_search("mlp", {"hidden_layer_sizes": [(8,)], "learning_rate_init": [0.1], "max_iter": 8, "batch_size": 60}, rows, rows)
    assert f1 > 0.9 and isinstance(net, N.Network) and best["learning_rate_init"] == 0.1


def plain_merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [len(p) for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def some_ranks():
    made = [bytes([b]) for b in range(256)]
    made += [b"ca", b"cat", b" cat", b" c", b"at", b"do", b"dog", b" dog", b"aa", b"aaaa", "é".encode(), "né".encode(), b"the", b"th", b"he", b"ab", b"ba"]
    return {t: i for i, t in enumerate(made)}


def test_byte_pairs_against_plain_merging():
    ranks, rng = some_ranks(), np.random.default_rng(4)
    bpe = BytePairs(ranks)
    for _ in range(300):
        piece = "".join(rng.choice(list("cathedog né ab"), rng.integers(1, 40))).encode()
        assert bpe.sizes(piece) == plain_merges(piece, ranks)
    assert sum(bpe.sizes(b"a" * 200_001)) == 200_001  # one long piece
    with pytest.raises(ValueError, match="have no rank"):
        BytePairs({b"a": 0})


def test_byte_pairs_offsets_and_a_public_vocabulary():
    bpe = BytePairs(some_ranks())
    t = bpe.encode("the cat né 猫 dog")
    assert [("the cat né 猫 dog"[a:b]) for a, b in zip(t.starts, t.ends, strict=True)][:2] == ["the", " cat"]
    assert t.span(4, 7) == (1, 1) and t.span(0, 3) == (0, 1) and t.span(3, 3)[1] == 0
    path = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
    if not path.exists():
        pytest.skip("no public vocabulary here")
    tiktoken = pytest.importorskip("tiktoken")
    own = BytePairs.from_file(str(path))
    known = tiktoken.Encoding("own", pat_str=own.pattern.pattern, mergeable_ranks=own.ranks, special_tokens={})
    for text in ("It's a cat, isn't it?  Two\n\n dogs -- 12345 über naïve 中文字 🐈 done", " ".join(f"word{i} and" for i in range(500)), "", "\n \t"):
        got = own.encode(text)
        assert got.ids == known.encode_ordinary(text)
        assert all(a < b for a, b in zip(got.starts, got.ends, strict=True))


def test_caption_spans_under_byte_pairs(spark):
    bpe = BytePairs(some_ranks())
    docs = spark.createDataFrame([(1, "the cat né dog", ["cat"]), (2, "dogs", []), (3, None, None)], "doc_id long, text string, objects array<string>")
    got = [tuple(r) for r in C.caption_spans(docs, {"cat": "cat", "dog": "dog"}, "objects", encode=bpe).select("doc_id", "word", "first", "n_tokens", "label").orderBy("first").collect()]
    at = bpe.encode("the cat né dog")
    assert got == [(1, "cat", 1, 1, 0), (1, "dog", at.span(11, 14)[0], 1, 1)]
