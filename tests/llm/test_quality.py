import numpy as np

from tarnflow.llm import quality
from tarnflow.llm.common import read_table

from .conftest import DOC, with_clashes


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    fit, test = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [r for r in quality.report(docs, fit).collect() if r.doc_id in test]
    right = np.mean([r.kept == (test[r.doc_id] == 1) for r in rows])
    clean = np.mean([r.kept for r in rows if test[r.doc_id] == 1])
    assert right > 0.97 and clean > 0.98


def test_sparse_sites_are_drawn_to_their_parents(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.2)] * 400 + [("big", "one", 0.0)] + [("poor", "x", 0.1)] * 300 + [("fair", "y", 0.6)] * 300 + [("new", "z", 0.0)]
    scored = spark.createDataFrame([(h, p, float(np.log(max(q, 1e-3) / (1 - max(q, 1e-3))))) for h, p, q in rows], "h string, p string, _logit double")
    got = {(r._host, r._path): r for r in quality.sites(scored, "h", "p").collect()}
    assert abs(got["+big", "+a"].path_rate - 0.9) < 0.05 and abs(got["+poor", "+x"].path_rate - 0.1) < 0.05
    mean = np.mean([max(q, 1e-3) for *_, q in rows])
    assert 0.05 < got["+big", "+one"].path_rate < got["+big", "+one"].host_rate
    assert 0.02 < got["+new", "+z"].host_rate < mean


def plain_rates(rows):
    """{(host, path): (host rate, path rate)} of (host, path, logit) by sums."""
    p = {k: [] for k in {(h, x) for h, x, _ in rows}}
    for h, x, z in rows:
        p[h, x].append(1 / (1 + np.exp(-z)))
    every = np.concatenate(list(p.values()))
    mean = every.mean()
    within = max((sum((np.array(v) ** 2).sum() - np.sum(v) ** 2 / len(v) for v in p.values())) / len(every), 1e-6)

    def kappa(groups):
        if len(groups) < 2:
            return 1e6
        n, rate, parent = (np.array(x, float) for x in zip(*groups))
        between = ((n * (rate - parent) ** 2).sum() - (len(n) - 1) * within) / max(n.sum() - (n**2).sum() / n.sum(), 1e-9)
        return min(1e6, max(1.0, within / max(between, 1e-9)))

    hosts = {h: np.concatenate([v for (g, _), v in p.items() if g == h]) for h, _ in p}
    k = kappa([(len(v), v.mean(), mean) for v in hosts.values()])
    host_rate = {h: (v.sum() + k * mean) / (len(v) + k) for h, v in hosts.items()}
    k = kappa([(len(v), np.mean(v), hosts[h].mean()) for (h, _), v in p.items()])
    return {(h, x): (host_rate[h], (np.sum(v) + k * host_rate[h]) / (len(v) + k)) for (h, x), v in p.items()}


def test_rates_equal_plain_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{rng.integers(4)}", f"p{rng.integers(3)}", float(rng.normal())) for _ in range(500)]
    got = {(r._host, r._path): (r.host_rate, r.path_rate) for r in quality.sites(spark.createDataFrame(rows, "h string, p string, _logit double"), "h", "p").collect()}
    for (h, x), want in plain_rates(rows).items():
        assert np.allclose(got["+" + h, "+" + x], want, atol=1e-9)


def test_whole_report_against_plain_sums(spark, sf_dir):
    """Posterior and verdict of every document, from the classifier's logits, the
    rates by sums and Bayes' rule on odds."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model, rows = quality.fit(docs, labels), docs.collect()
    logits = model.logits(np.array([quality.features((r.text or "").encode()) for r in rows]))
    rates = plain_rates([(r.source, r.lang, z) for r, z in zip(rows, logits)])
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == len(rows)
    for r, z in zip(rows, logits):
        host, path = rates[r.source, r.lang]
        odds = np.exp(z) * (1 - model.prior) / model.prior * path / (1 - path)
        g = got[r.doc_id]
        assert np.allclose([g.p_doc, g.host_rate, g.path_rate, g.posterior], [1 / (1 + np.exp(-z)), host, path, odds / (1 + odds)], atol=1e-6)
        assert g.kept == (g.posterior >= 0.5)


def test_rows_of_a_labelled_id_count_once(spark):
    """A third of all rows with one labelled id is one row of the fit."""
    docs = spark.createDataFrame([(1, f"text {k} of the one id", "en", "s") for k in range(50)] + [(2, "### !!! $$$", "en", "s"), (3, "a good text here", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    one = docs.groupBy("doc_id", "lang", "source").agg({"text": "min"}).withColumnRenamed("min(text)", "text")
    a, b = quality.fit(docs, labels), quality.fit(one, labels)
    assert a.prior == b.prior == 3 / 5 and np.allclose(a.weights, b.weights)


def test_salted_join_equals_broadcast(spark, sf_dir, monkeypatch):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    key = lambda: {(r.doc_id, r.kept, round(r.posterior, 9)) for r in quality.report(docs, labels).collect()}
    want = key()
    monkeypatch.setattr(quality, "MAX_SITES", 0)
    assert key() == want


def test_select_keeps_what_report_keeps(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    kept = {r.doc_id for r in quality.report(docs, labels).where("kept").collect()}
    out = quality.select(with_clashes(docs), labels)
    assert out.columns == with_clashes(docs).columns and {r.doc_id for r in out.select("doc_id").collect()} == kept


def test_odd_rows_and_no_labels(spark, odd, none, sf_dir):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.report(none, nothing).count() == 0 and quality.select(none, nothing).count() == 0
    assert quality.select(odd, nothing).count() == 10
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, None, 0), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.report(with_clashes(odd), labels).collect()
    assert len(rows) == 10 and all(0 <= r.posterior <= 1 for r in rows)


def test_unsafe_texts_have_finite_features():
    for t in (b"", b" ", b"\n\n", b"a", b"\xff\xfe", b"#" * 1000, "漢字".encode()):
        f = quality.features(t)
        assert len(f) == len(quality.FEATURES) and np.isfinite(f).all()
    assert DOC
