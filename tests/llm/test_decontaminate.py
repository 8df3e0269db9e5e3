import hashlib
import random
import re

import pytest

from tarnflow.llm import decontaminate as D

from .conftest import with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add("" if item is None else str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def sample():
    rng = random.Random(4)
    vocab = ["a", "B", "c", "é", "É", "d1", "x-y"]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(draw(rng.choice([0, 1, 2, 5, 13, 14, 30])))) for k in range(12)] + [(12, None), (None, "c c c c"), (3, "a. B! c")]
    docs = []
    for k in range(150):
        w = draw(rng.randint(0, 60))
        if rng.random() < 0.5:
            v = rng.choice(items)[1] or ""
            at = rng.randint(0, len(w))
            w[at:at] = v.split()
        docs.append((k, rng.choice([" ", "\n", ", "]).join(w)))
    return [*docs, (None, None), (7, ""), (7, "...")], items


@pytest.mark.parametrize("most", [10**6, 40])
def test_equals_brute_force_in_one_pass_or_more(spark, monkeypatch, most):
    docs, items = sample()
    monkeypatch.setattr(D.load_indexes, "__defaults__", (13, most))
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.report(df, bench).collect())
    assert got == sorted((str(i), *brute(t, items)) for i, t in docs)
    assert len(list(D.load_indexes(bench))) == (1 if most > 40 else len(list(D.load_indexes(bench)))) and (most > 40 or len(list(D.load_indexes(bench))) > 1)


def test_drop_and_cut(spark):
    item = " ".join(f"w{k}" for k in range(20))
    clean = " ".join(f"c{k}" for k in range(400))
    rows = [(1, f"Intro: {item}, and more."), (2, clean), (3, f"{clean} -- {item.upper()}! {clean}"), (4, None), (5, "")]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == [2, 3, 4, 5]
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, bench, "cut").collect()}
    assert cut == {1: "Intro: , and more.", 2: clean, 3: f"{clean} -- ! {clean}", 4: None, 5: ""}
    assert D.decontaminate(docs, bench).columns == docs.columns
    with pytest.raises(ValueError):
        D.decontaminate(docs, bench, "hide")


def test_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.report(none, bench).count() == 0
    rows = D.report(odd, bench).collect()
    assert len(rows) == 10 and not any(r.contaminated for r in rows) and {r.n_items for r in rows} == {0}


def test_repeats_in_a_text_are_marked_throughout():
    index = D.BenchmarkIndex.build([("i", b" ".join([b"z"] * 13))])
    s = D.scan([b"q " + b"z " * 30 + b"q"], index)
    assert D._hits(s).tolist() == [30] and s.n_words.tolist() == [32]
