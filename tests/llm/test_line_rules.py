from collections import Counter

import duckdb

from tarnflow.llm import line_rules as R
from tarnflow.llm.sql import ORACLE_SQL

from .conftest import with_clashes


def test_measures():
    t = "a b c d e\nx a b c d e\n\n \na b c d e\n# é|".encode()
    assert R.measures(t) == (18, 19, 2, 1, 15)
    assert R.measures(b"") == (0, 0, 0, 0, 0) and R.repeat_words([b"a"] * 5) == 0 and R.repeat_words([b"a"] * 6) == 6


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def host_sample():
    good = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(6)]
    docs = []
    for k in range(8):
        docs.append((k, "\n".join(["Accept all Cookies!"] + [f"{g} {k}" for g in good]), "big"))
    docs.append((8, "accept ALL cookies\naccept all cookies.\nAccept, all: cookies\nfour words of own", "big"))
    docs.append((9, "Accept all Cookies!\n" + "\n".join(good), "small"))
    return docs + [(10, None, None), (11, "", "big"), (11, "same words here in ten or so, all of them new ones", "big")]


def test_lines_above_the_limit_of_a_host_go(spark):
    df = with_clashes(spark.createDataFrame(host_sample(), "doc_id long, text string, source string"))
    got = {(r.doc_id, r.n_words): r for r in R.report(df, max_docs=4).collect()}
    words = {(i, len((t or "").split())) for i, t, _ in host_sample()}
    assert got.keys() == words and len(words) == 13
    for (i, n), r in got.items():
        if i < 8:  # the shared first line of three words goes
            assert r.n_left == n - 3 and r.kept
    (eight,), (nine,), (ten,) = ([r for (i, _), r in got.items() if i == k] for k in (8, 9, 10))
    assert eight.n_left == 4 and not eight.kept and not eight.base_failed
    assert nine.n_left == nine.n_words and nine.kept and ten.base_failed
    assert got[11, 0].base_failed and got[11, 12].kept
    counts = {(r._host, r.n_docs) for r in R.line_counts(df).collect()}
    assert ("+big", 9) in counts and ("+small", 1) in counts


def test_stripped_texts(spark):
    df = spark.createDataFrame(host_sample(), "doc_id long, text string, source string")
    out = {(r.doc_id, len(r.text or "")): r.text for r in R.strip_lines(df, max_docs=4).collect()}
    texts = Counter(k for k, _ in out)
    assert texts[11] == 2 and out[10, 0] is None and out[8, 17] == "four words of own"
    assert all("Cookies" not in (t or "") for (k, _), t in out.items() if k < 8)


def test_equals_sql_with_boilerplate(spark, monkeypatch):
    rows = host_sample() + [(20, "one line of ten words, that many rows of one document have", "big")] * 6
    rows += [(None, "a line of documents that have no id, each is one", "big")] * 5
    got = rows_of(R.report(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=4))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    sql = ORACLE_SQL["op8_line_rules"].replace("count(DISTINCT doc) > 100", "count(DISTINCT doc) > 4")
    assert got == sorted(c.sql(sql).fetchall(), key=str)


def test_rows_of_one_document_count_once(spark, monkeypatch):
    text = "the very same line of more than ten words in all the rows"
    df = spark.createDataFrame([(1, text, "h")] * 6 + [(None, text, "n")] * 6, "doc_id long, text string, source string")
    for most in (R.MAX_REPEATED, 0):
        monkeypatch.setattr(R, "MAX_REPEATED", most)
        assert {(r._host, r.n_docs) for r in R.line_counts(df).collect()} == {("+h", 1), ("+n", 6)}
        kept = [(r.doc_id, r.kept) for r in R.report(df, max_docs=4).collect()]
        assert kept.count((1, True)) == 6 and kept.count((None, False)) == 6


def test_odd_rows_and_empty_table(spark, odd, none):
    assert R.report(none).count() == 0 and R.strip_lines(none).count() == 0
    rows = R.report(with_clashes(odd)).collect()
    assert len(rows) == 10 and sum(r.kept for r in rows) == 0
