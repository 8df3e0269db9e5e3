import random
from collections import defaultdict

import numpy as np
import pytest

from tarnflow.llm import components as C
from tarnflow.llm import jaccard_join as J
from tarnflow.llm.common import read_table, shingles_of
from tarnflow.llm.components import components

from .conftest import with_clashes


def brute(rows, similarity=0.8):
    """(class, links, copies) of every row, over all pairs of rows."""
    sets = [set(shingles_of((t or "").encode()).tolist()) for _, t in rows]
    inverted = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    near = [set() for _ in rows]
    for k, s in enumerate(sets):
        for j in {j for x in s for j in inverted[x]}:
            common = len(s & sets[j])
            if j != k and common >= similarity * (len(s) + len(sets[j]) - common) - 1e-9:
                near[k].add(j)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, js in enumerate(near):
        for j in js:
            root[find(k)] = find(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    least = lambda ks: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
    return [
        (rows[k][0], least(groups[find(k)]) if sets[k] else rows[k][0], len(near[k]), sum(sets[j] == sets[k] for j in near[k])) for k in range(len(rows))
    ]


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect()), key=str)


def one_a_class(rows):
    """(id, text) of the row with the least id of each class, of one of them
    where several have it, and of all rows without words."""
    found, kept = brute(rows), {}
    for (i, t), (_, c, _, _) in zip(rows, found):
        words = len(shingles_of((t or "").encode()))
        key = ("class", c, None if c is not None else frozenset(shingles_of(t.encode()).tolist())) if words else ("row", len(kept))
        if key not in kept or (i is not None and (kept[key][0] is None or i < kept[key][0])):
            kept[key] = (i, t)
    return [(str(i), t) for i, t in kept.values()]


def family(rng, base, n, edits):
    words, out = base.split(), []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def sample():
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [text(rng.randint(1, 120)) for _ in range(150)]
    for size, edits in ((40, 3), (25, 6), (3, 1), (2, 2)):
        texts += family(rng, text(150), size, edits)
    passage = text(60)
    texts += [f"{passage} {text(rng.randint(5, 60))}" for _ in range(40)]
    texts += [texts[3]] * 20 + ["A b, c D e.", "a B c d E", "a b c d"]
    rng.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("bucket", [400, 8])
def test_equals_all_pairs(spark, monkeypatch, bucket):
    """With small buckets the large ones are split and compared in blocks."""
    monkeypatch.setattr(J, "BUCKET", bucket)
    rows = sample()
    assert got(J.join(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=str)


def test_documents_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    assert got(J.join(docs)) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_one_of_each_class_stays(spark):
    rows = sample()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    out = J.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c, _, _ in brute(rows) if i == c)


def test_odd_rows_and_empty_table(spark, odd, none):
    assert J.join(none).count() == 0 and J.deduplicate(none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(J.join(with_clashes(odd))) == sorted(brute(rows), key=str)
    clashing = with_clashes(odd)
    kept = J.deduplicate(clashing)
    assert kept.columns == clashing.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted(one_a_class(rows))


def test_ids_that_have_several_texts_or_none(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(1, base), (1, base + " x"), (2, base + " y"), (None, base + " z"), (None, base + " z"), (3, "else entirely different words here now")]
    assert got(J.join(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute(rows), key=str)


def test_rows_follow_the_size_of_a_group(spark, monkeypatch):
    """Twice the near copies: at most twice the rows of buckets and of blocks,
    and no more than one row a level-1 bucket for each class."""
    monkeypatch.setattr(J, "BUCKET", 100)
    rng, made = random.Random(3), []
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    copies = family(rng, base, 1600, 4)
    for n in (400, 800, 1600):
        docs = spark.createDataFrame(list(enumerate(copies[:n])), "doc_id long, text string")
        classes = J.sets(docs).dropDuplicates(["key"]).cache()
        leaves = J._buckets(classes).cache()
        tasks = J._tasks(leaves, classes.select("key", "n", "sketch"))
        made.append((classes.count(), leaves.count(), tasks.count()))
    assert all(leaves <= 2 * J.RUNS * classes and tasks == leaves for classes, leaves, tasks in made)
    assert all(b[k] <= 2.1 * a[k] for a, b in zip(made, made[1:]) for k in (1, 2))


def test_a_passage_that_many_share_is_split(spark, monkeypatch):
    """Documents that are alike in one passage only go down the tree; the result
    is that of all pairs, in blocks of few classes too."""
    monkeypatch.setattr(J, "BUCKET", 20)
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = text(40)
    texts = [f"{passage} {text(100)}" for _ in range(150)] + family(rng, text(120), 90, 3)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = J.sets(docs).dropDuplicates(["key"])
    assert {len(J.SLOTS[r.slot]) for r in J._buckets(classes).select("slot").distinct().collect()} > {1}
    assert got(J.join(docs)) == sorted(brute(rows), key=str)


def test_links_by_matrix_equal_links_by_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    dense = J.links_of(sets, i, j, 0.5)
    pairs = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.5 for a, b in zip(i, j)])
    assert (dense == pairs).all() and (J.links_of(sets, i[:10], j[:10], 0.5) == pairs[:10]).all()


def test_tree_fits_a_mask_and_meets_the_target():
    assert len(J.SLOTS) <= 63 and all(len(s) == 1 for s, p in zip(J.SLOTS, J.PARENTS) if p < 0)
    assert len({s for s, p in zip(J.SLOTS, J.PARENTS) if p < 0}) == 2 * J.RUNS
    for s, p in zip(J.SLOTS, J.PARENTS):
        assert p < 0 or s[: len(J.SLOTS[p])] == J.SLOTS[p]
    rng, met = random.Random(2), 0
    for t in range(300):
        shared = [rng.getrandbits(60) for _ in range(80)]
        a, b = (np.unique(np.array(shared + [rng.getrandbits(60) for _ in range(10)], dtype=np.uint64)) for _ in range(2))
        x, y = J.sketch(a), J.sketch(b)
        deepest = [k for k in range(len(J.SLOTS)) if k not in J.PARENTS]
        met += any((x[list(J.SLOTS[k])] == y[list(J.SLOTS[k])]).all() for k in deepest)
    assert met >= 297


@pytest.mark.parametrize("hot", [10_000, 2])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT_DEGREE", hot)
    edges = [(f"n{k}", f"n{k + 1}") for k in range(40) if k % 10 != 9] + [("z", "n5"), ("q", "q"), (None, "n1")]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {f"n{k}": min(f"n{j}" for j in range(k // 10 * 10, k // 10 * 10 + 10)) for k in range(40)} | {"z": "n0"}
    assert out == want
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
