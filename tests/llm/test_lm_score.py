import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnflow.llm import lm_score as L
from tarnflow.llm.common import read_table

from .conftest import with_clashes


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def expected(rows):
    c = Counter(w for i, t in rows if not is_held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    norm = n + 0.5 * (v + 1)
    return [(i, is_held_out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / norm) for w in tokens(t))) for i, t in rows]


def compare(df, rows):
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect()), key=key)
    want = sorted(expected(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want))


def test_base_is_exact_and_the_model_is_better(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    out = L.score(docs).cache()
    compare(out, [(r.doc_id, r.text) for r in docs.collect()])
    r = out.where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r.s > r.b
    assert out.where("score > 0").count() == 0


def test_words_by_join_alone(spark, odd):
    compare(L.score(with_clashes(odd), max_frequent=0), [(r.doc_id, r.text) for r in odd.collect()])


def test_empty_table_and_no_training_rows(spark, none):
    assert L.score(none).count() == 0
    i = next(k for k in range(100) if is_held_out(k))
    compare(L.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")), [(i, "a b")])


def test_passes_over_segments_give_the_same_scores(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("doc_id < 60")
    one = {r.doc_id: r.score for r in L.score(docs).collect()}
    many = {r.doc_id: r.score for r in L.score(docs, max_filter_bytes=1 << 14).collect()}
    # Word filters are smaller too, so more false positives: close, not equal.
    assert one.keys() == many.keys() and np.corrcoef([one[k] for k in one], [many[k] for k in one])[0, 1] > 0.99


def filters(counts, bits=10):
    keys = np.array(sorted(counts), dtype=np.uint64)
    n = np.array([counts[int(k)] for k in keys])
    slices = L.slice_of(keys, 4)
    return L.Filters.join(4, {s: L.build_filter(keys[slices == s], n[slices == s], 1 << 40, bits) for s in range(4)})


def test_filter_never_misses_and_rarely_adds():
    rng = np.random.default_rng(2)
    counts = {int(k): int(c) for k, c in zip(rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.zipf(1.5, 3000).clip(max=10**6))}
    f = filters(counts)
    keys = np.array(list(counts), dtype=np.uint64)
    levels, exact = f.levels(keys), L.levels_of(np.array(list(counts.values())))
    assert (levels >= exact).all() and (levels > exact).mean() < 0.03
    assert (f.levels(rng.integers(0, 2**63, 20000, dtype=np.uint64)) > 0).mean() < 0.02


def test_levels_are_exact_for_small_counts_and_close_above():
    n = np.arange(1, 100000)
    value = L._VALUES[L.levels_of(n)]
    assert (value[:6] == n[:6]).all() and (np.abs(value / n - 1) < L.LEVEL_BASE - 1).all()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_are_windows_that_end_at_each_token(n):
    t, _ = L._tokens([b"a b", b"", b"a b"])
    g = L._ngrams(t, n)
    assert len(g) == len(t) - 1 == 7
    assert (g[4] == g[0]) and (g[5] == g[1])  # "a" after an end, "a b"
    assert len(set(g.tolist())) < 7


def test_blobs_round_trip():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    s = L.slice_of(h, 7)
    blobs = {}
    for at, b in [*L._pack(s, h, np.full(len(h), 2)), *L._pack(s, h, np.full(len(h), 3))]:
        blobs.setdefault(at, []).append(b)
    for at, parts in blobs.items():
        keys, n = L._unpack(parts)
        assert (keys == np.sort(h[s == at])).all() and (n == 5).all()


def scores(df):
    return sorted((r.doc_id, r.n_known, r.base_score, r.score) for r in df.collect())


def test_scores_are_equal_in_one_pass_and_in_many(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("doc_id < 60")
    one, many = scores(L.score(docs)), scores(L.score(docs, max_filter_bytes=1 << 14))
    assert len(one) == len(many) and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12) for a, b in zip(one, many))


def test_trigrams_are_counted_in_all_segments(spark, sf_dir):
    """A trigram's slice is mostly in another segment than its bigram's."""
    docs = read_table(spark, sf_dir, "documents").where("doc_id < 60")
    one, many = scores(L.score(docs, order=3)), scores(L.score(docs, order=3, max_filter_bytes=1 << 14))
    assert len(one) == len(many) and all(a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12) for a, b in zip(one, many))


def dirichlet(rows, order, mu=L.MU):
    """log10 probabilities from exact counts: (id, tokens) -> score."""
    learn = [tokens(t) for i, t in rows if not is_held_out(i)]
    counts = [Counter() for _ in range(order + 1)]
    for w in learn:
        row = [b" "] * order + w
        for k in range(order, len(row)):
            for n in range(1, order + 1):
                counts[n][tuple(row[k - n + 1 : k + 1])] += 1
    total = sum(counts[1].values())
    norm = total + 0.5 * (len(counts[1]) + 1)
    out = []
    for i, t in rows:
        row, s = [b" "] * order + tokens(t), 0.0
        for k in range(order, len(row)):
            p = (counts[1][(row[k],)] + 0.5) / norm
            for n in range(2, order + 1):
                context = counts[n - 1][tuple(row[k - n + 1 : k])]
                if context:
                    p = (counts[n][tuple(row[k - n + 1 : k + 1])] + mu * p) / (context + mu)
            s += math.log10(p)
        out.append((i, s))
    return sorted(out)


def test_score_is_the_dirichlet_model_within_filter_error(spark, sf_dir):
    """Against exact counts. A level's value is off by less than LEVEL_BASE, so a
    token's log10 probability by less than log10(1.25), but for the rare false
    positives; over a document errors mostly cancel out."""
    docs = read_table(spark, sf_dir, "documents")
    want = dirichlet([(r.doc_id, r.text) for r in docs.collect()], 2)
    got = sorted((r.doc_id, r.score) for r in L.score(docs).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    off = np.array([abs(a - b) / max(1.0, abs(b)) for (_, a), (_, b) in zip(got, want)])
    n = np.array([len(tokens(t)) for _, t in sorted((r.doc_id, r.text) for r in docs.collect())])
    each = np.array([abs(a - b) for (_, a), (_, b) in zip(got, want)]) / n
    assert off.mean() < 0.005 and each.max() < math.log10(L.LEVEL_BASE)


def test_keys_are_whole_hashes(spark):
    """Two hashes of one slice that are equal in their low 40 bits differ."""
    a, b = np.array([(5 << 40) | 12345], np.uint64), np.array([(6 << 40) | 12345], np.uint64)
    assert L.slice_of(a, 256) == L.slice_of(b, 256)
    ((_, blob),) = L._pack(L.slice_of(np.concatenate([a, b]), 256), np.concatenate([a, b]), np.array([1, 2]))
    keys, counts = L._unpack([blob])
    assert keys.tolist() == sorted([int(a[0]), int(b[0])]) and sorted(counts.tolist()) == [1, 2]
    f = L.Filters.join(256, {0: L.build_filter(a, np.array([3]), 1 << 30)})
    assert f.levels(a)[0] == 3 and f.levels(b)[0] == 0


def test_segments_are_within_their_bound(spark, sf_dir, monkeypatch):
    docs = read_table(spark, sf_dir, "documents").where("doc_id < 60")
    model, slices = L.train(docs)
    sizes = {r.slice: sum(map(len, r.filters)) for r in model.collect()}
    for bins in (L.MAX_BINS, 7):
        monkeypatch.setattr(L, "MAX_BINS", bins)
        found = L.filter_segments(model, slices, 2, 1 << 14)
        assert len(found) > 1 and all(lo <= hi for lo, hi in found) and all(a[1] < b[0] for a, b in zip(found, found[1:]))
        inside = [[s for s in sizes if lo <= s <= hi] for lo, hi in found]
        assert sum(map(len, inside)) == len(sizes) and all(sum(sizes[s] for s in x) <= 1 << 14 for x in inside)
