import random
import re
import time

import numpy as np
import pytest

from tarnflow.llm import boosting, pii
from tarnflow.llm.common import read_table

from .conftest import with_clashes

#: The base patterns as they are stated.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {
        "email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, t) if keep[k](m[0])] for k, p in PATTERNS.items()}


def test_base_spans_equal_the_stated_patterns():
    rng = random.Random(5)
    seeds = ["4111 1111 1111 1111", "a.b@c.d", "1.2.3.4", "+1 (23) 45-678", "256.1.1.1", "@", "0001.2.3.004", "+"]
    for _ in range(8000):
        t = "".join(rng.choice(seeds) if rng.random() < 0.2 else rng.choice("aZ0912.@-+ ()%é\n٣") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == brute(t), t


@pytest.fixture(scope="module")
def selector():
    return pii.Selector()


def test_held_out_candidates_are_told_apart(selector):
    x, y, kinds = pii.training_sample(2000, seed=77)
    chosen = selector.trees.probabilities(x) >= selector.thresholds[kinds]
    for k in range(len(pii.KINDS)):
        own = kinds == k
        assert y[own & chosen].mean() > 0.95 and chosen[own & (y > 0)].mean() > 0.9


def test_calibration_is_close(selector):
    x, y, _ = pii.training_sample(3000, seed=78)
    p = selector.trees.probabilities(x)
    assert abs(p.mean() - y.mean()) < 0.05 and np.mean((p - y) ** 2) < 0.05


def test_added_spans_stand_beside_base_ones(selector):
    t = "write to jane dot at none, or jane.roe [at] example [dot] com; call (212) 555-0187; on 2024-01-02 we paid 17.50 for version 1.2.3.4567"
    ((base, spans),) = selector.spans([t])
    found = {(pii.KINDS[k], t[a:b]) for k, a, b in spans}
    assert not any(base.values())
    assert ("email", "jane.roe [at] example [dot] com") in found and ("phone", "(212) 555-0187") in found
    assert not any("2024" in s or "17.50" in s for _, s in found)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = boosting.BoostedTrees.fit(x[:1500], y[:1500])
    assert ((m.probabilities(x[1500:]) > 0.5) == (y[1500:] > 0)).mean() > 0.93


def test_report_and_redaction(spark, odd, none):
    assert pii.report(none).count() == 0 and pii.redact(none).count() == 0
    rows = pii.report(odd).collect()
    assert len(rows) == 10 and all(r.spans == "" and r.n_email == 0 for r in rows)
    docs = with_clashes(spark.createDataFrame([(1, "mail a.b@c.org now", "en", "s", 18), (2, None, "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    (r,) = pii.report(docs).where("doc_id = 1").collect()
    assert r.spans == "email:5:14" and r.n_email == 1 and len(r.base_sha256) == 64
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[1].text == "mail <EMAIL> now" and out[1].n_chars == 16 and out[2].text is None and out[2].n_chars == 3
    assert pii.redact(docs).columns == docs.columns


def test_overlapping_spans_are_cut_once():
    assert pii.cut("abcdefgh", [(0, 1, 4), (3, 2, 6), (1, 7, 8)]) == "a<EMAIL>g<IP>"


AT = ["@", " @ ", " at ", " AT ", "[at]", " [at] ", "(at)", " (at) ", "{AT}", " < @ > ", "\nat\n", " (at)\n"]
DOT = [".", " dot ", " DOT ", "[dot]", " [dot] ", "(.)", " (dot) ", "\ndot\n"]


@pytest.mark.parametrize("at", AT)
def test_no_gate_stops_the_email_generator(at):
    for dot in DOT:
        t = f"so jane.roe{at}example{dot}com came"
        (m,) = pii._MAYBE["email"][0].finditer(t)
        assert (0, *m.span()) in pii.candidates(t) and t[m.start() : m.end()].startswith("jane.roe"), t


def test_every_positive_template_gives_a_candidate(monkeypatch):
    """No labelled value of the sample is lost, positive or not."""
    seen, plain = [], pii.candidates
    monkeypatch.setattr(pii, "candidates", lambda t: seen.append((t, plain(t))) or seen[-1][1])
    pii.training_sample(1000, seed=5)
    assert all(c for t, c in seen if re.search(r"\(at\) |\[at\]| at \w+ dot ", t))
    assert sum(" (at) " in t for t, _ in seen) > 10


def test_bracketed_addresses_are_found(selector):
    for t in ("write to jane.roe (at) example.com today", "contact jane.roe [at] example.com today", "mail jane.roe\n[at] example\n[dot] com"):
        ((_, spans),) = selector.spans([t])
        assert [pii.KINDS[k] for k, _, _ in spans] == ["email"], t


def test_a_text_of_many_spans_takes_time_in_proportion(selector):
    took = []
    for n in (8000, 16000):
        t = " ".join(f"a{k}@b.org +1 (212) 555-{k % 10000:04d} or jane{k} [at] c [dot] net" for k in range(n))
        start = time.process_time()
        ((base, spans),) = selector.spans([t])
        took.append(time.process_time() - start)
        assert len(base["email"]) == n and len(spans) > 2 * n
    assert took[1] < 3 * took[0]


def slow_spans(selector, t):
    """All spans of a text by the stated rule: base ones, then the likeliest
    candidate above its threshold that overlaps nothing chosen before."""
    out = [(k, a, b) for k, kind in enumerate(pii.KINDS) for a, b in brute(t)[kind]]
    own = [c for c in pii.candidates(t) if not any(c[1] < b and c[2] > a for _, a, b in out)]
    scored = []
    for c in own:
        p = selector.trees.probabilities(np.array([pii.describe(t, *c)]))[0]
        if p >= selector.thresholds[c[0]]:
            scored.append((-p, c))
    for _, c in sorted(scored):
        if not any(c[1] < b and c[2] > a for _, a, b in out):
            out.append(c)
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_whole_report_against_brute_force(spark, selector, sf_dir):
    rng = random.Random(3)
    seeds = ["4111 1111 1111 1111", "a.b@c.d", "1.2.3.4", "+1 (23) 45-678", "jane [at] x [dot] org", "(212) 555-0187", "card 4111-1111-1111-1111", "256.1.1.1", "10.[.]1", "é", "call 0301 234 5678", "2024-01-02"]
    rows = [(k, " ".join(rng.choice(seeds) if rng.random() < 0.4 else rng.choice(["word", "mail", "ip", "of", "to"]) for _ in range(40))) for k in range(120)]
    rows += [(500, None), (500, ""), (None, "mail a.b@c.d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    want = sorted(((r.doc_id, slow_spans(selector, r.text or "")) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.spans) for r in pii.report(with_clashes(docs)).collect()), key=str) == want
