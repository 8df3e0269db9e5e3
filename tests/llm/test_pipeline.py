"""Every stage against a brute-force version on its own input."""

import corpus_pipeline
import duckdb
import public_tokenizers
from tokenizers import Tokenizer

from tarnflow.llm import common, pii, quality, tokens
from tarnflow.llm.sql import ORACLE_SQL

from .test_jaccard_join import brute as near
from .conftest import with_clashes
from .test_packing import check as check_packing


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages(spark, sf_dir, tmp_path):
    docs = common.read_table(spark, sf_dir, "documents")
    columns, inputs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([r for r in docs.collect()])
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert (docs.columns == columns) == (k < 4)
    final = docs.collect()

    labels = {r.doc_id: r.quality for r in common.read_table(spark, sf_dir, "labels").collect()}
    kept = set(ids(inputs[1]))
    known = [(r.doc_id in kept) == (labels[r.doc_id] == 1) for r in inputs[0] if r.doc_id in labels]
    assert sum(known) / len(known) > 0.97
    full = quality.report(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))
    assert ids(inputs[1]) == ids(full.where("kept").collect())

    classes = near([(r.doc_id, r.text) for r in inputs[1]])
    assert ids(inputs[2]) == sorted(i for i, c, _, _ in classes if i == c)

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/1/*.parquet')")
    duck.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{sf_dir}/benchmark.parquet')")
    clean = duck.sql(f"SELECT doc_id FROM ({ORACLE_SQL['op5_decontaminate']}) WHERE NOT contaminated").fetchall()
    assert ids(inputs[3]) == sorted(r[0] for r in clean)
    assert {r.doc_id: r.text for r in inputs[3]}.items() <= {r.doc_id: r.text for r in inputs[0]}.items()

    texts = [r.text for r in sorted(inputs[3])]
    spans = pii.Selector().spans(texts)
    assert [r.text for r in sorted(inputs[4])] == [pii.cut(t, s) for t, (_, s) in zip(texts, spans)]
    assert all(r.n_chars == len(r.text) for r in inputs[4])
    assert not any(pii._emails(r.text) for r in inputs[4])

    n, least = check_packing(final, [(r.doc_id, r.text) for r in inputs[4]], Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER)))
    assert n <= least + 1

    run = corpus_pipeline.run(spark, sf_dir)
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(run.collect()) == key(final)


def test_empty_documents(spark, tmp_path, none, sf_dir):
    docs = none
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert docs.count() == 0


def test_odd_rows_through_every_stage(spark, tmp_path, odd, sf_dir):
    """Nulls, empty and long texts, repeats and clashing columns, on every stage
    by itself: rows that no operator has a reason to drop stay."""
    docs = with_clashes(odd)
    want = {"ngram_jaccard_join": 8, "benchmark_decontamination": 10, "pii": 10}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            continue
        assert out.columns == docs.columns
        rows = out.select("doc_id", "text", "key").collect()
        assert len(rows) == want.get(name, len(rows)) and all(r.key == "key" for r in rows)


def test_run_frees_what_stages_stored(spark, sf_dir):
    before = common.scratch_tables()
    one = corpus_pipeline.run(spark, sf_dir)
    left = [p for p in common.scratch_tables() if p not in before]
    two = corpus_pipeline.run(spark, sf_dir)  # a second run leaves the first readable
    assert len(left) <= 2 and one.count() == two.count()
