import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from dutymark.llm.decontaminate import find_copies
from dutymark.llm.pii import entities, redacted
from dutymark.llm.quality_rules import fit_forest, judge
from tests.llm.cases import awkward_docs, no_docs
from tests.llm.test_jaccard import brute


def test_run_equals_brute_force(spark, sf_dir):
    docs, labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {r["doc_id"] for r in judge(docs, fit_forest(docs, labels)).filter("kept").collect()}
    rows = {i: r for i, r in rows.items() if i in kept}
    rows = {i: rows[i] for i, head, _ in brute([(i, r["text"]) for i, r in rows.items()]) if i == head}
    copies = {r["doc_id"] for r in find_copies(docs, bench).collect()}
    texts = {i: redacted(r["text"], entities(r["text"])) for i, r in rows.items() if i not in copies}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [(i, t, rows[i]["lang"], rows[i]["source"], len(t)) for i, t in texts.items()])
    want = sorted(con.sql(entry.oracle_sql()["op5_mixing"]).fetchall())
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "mix_key"]
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("make", [awkward_docs, no_docs])
def test_stages_take_awkward_rows(spark, sf_dir, make):
    docs = make(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == make(spark).columns
    docs.collect()


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
