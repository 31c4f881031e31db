"""The pipeline against a brute-force version of its stages, and on odd rows."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from docmill.llm import bpe, pii
from tests.llm.conftest import SF
from tests.llm.test_set_operators import naive_fingerprint, naive_groups
from tests.llm.test_text_operators import VOCABULARY, naive_hits


def brute(rows, items):
    """ids and texts that are left of (id, text) rows with unique ids."""
    kept = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    groups = naive_groups([naive_fingerprint(t) for _, t in kept], [i for i, _ in kept])
    kept = [(i, t) for (i, t), g in zip(kept, groups) if g[3] == i]
    hits = naive_hits({t for _, t in kept}, items)
    return {i: pii.masked(t) for i, t in kept if not hits[t][4]}


def test_pipeline(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == want.keys() and 0 < len(got) < len(rows)
    v = bpe.vocabulary(VOCABULARY)
    for i, t in want.items():
        assert got[i]["token_ids"] == v.encode(t) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark):
    copy = "some words that are said twice here"
    rows = [(1, copy, "en"), (1, copy, "en"), (1, "quite another text under this id", "en"), (2, copy, "en"), (None, None, None), (None, "hello there you", "en"), (3, "", None), (4, "12 34", "en"), (5, "x y z", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA)
    ids = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in df.collect())
    told = corpus_pipeline.identify_language(spark, docs, SF)
    assert told.columns == docs.columns and len(ids(told)) == 6
    assert ids(corpus_pipeline.drop_near_duplicates(spark, told, SF)) == [(-1, "hello there you"), (1, "quite another text under this id"), (1, copy), (5, "x y z")]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name != "encode":
            assert stage(spark, docs, SF).columns == docs.columns


def test_documents_of_no_known_language_are_kept(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in corpus_pipeline.identify_language(spark, docs, SF).collect()] == [(1, "some text", None)]


def test_stages_give_every_other_column_back(spark, docs, rows):
    """Clashing, dotted, repeated: extra columns come through each stage bit for bit, with the row they came with."""
    extra = {"score": "double", "group": "string", "fp": "long", "n_words": "long", "a.b": "string", "lang_pred": "string", "__id": "int", "__rank": "int", "contaminated": "boolean", "text.x": "string", "map": "map<string,int>", "salt": "int", "component_id": "string"}
    made = [(i, t, lang, "s", -1, k / 7, f"g{k}", k, -k, f"dot{k}", "xx", k, -k, k % 2 == 0, f"t{k}", {"k": k}, k, f"c{k}") for k, (i, t, lang) in enumerate(rows)]
    names = [f"`{n}` {t}" for n, t in extra.items()]
    given = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(names))
    whole = {r["fp"]: r for r in given.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.columns == given.columns and [f.dataType for f in out.schema] == [f.dataType for f in given.schema], name
        got = out.collect()
        assert got, name
        decided = {"language_id": {"lang"}, "pii": {"text", "n_chars"}}.get(name, set())
        for r in got:
            before = whole[r["fp"]].asDict()
            assert {k: v for k, v in r.asDict().items() if k not in decided} == {k: v for k, v in before.items() if k not in decided}, name
    assert corpus_pipeline.encode(spark, given, SF).count() == len(rows)


def test_the_row_kept_of_equal_ones_does_not_depend_on_order(spark):
    made = [(1, "the same words as ever", "en", "s", 0, x) for x in ("b", "a", "c")]
    for order in (made, made[::-1]):
        docs = spark.createDataFrame(order, SCHEMA + ", mark string").repartition(2)
        assert [r["mark"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()] == ["a"]


@pytest.mark.parametrize("few", [0, 1000])
def test_only_a_few_ids_are_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(corpus_pipeline, "FEW", few, raising=False)
    made = [(i // 2, f"text {i // 4} of a few words and {i // 4} again", "en", "s", 0) for i in range(40)]
    alone = [(100 + i, t, *rest) for i, (_, t, *rest) in enumerate(made)]
    for rows in (made, alone):  # ids that rows share, and ids of one row
        got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SF)
        assert ("BroadcastExchange" in got._jdf.queryExecution().executedPlan().toString()) == bool(few)
        want = {least for *_, least in naive_groups([naive_fingerprint(r[1]) for r in rows], [r[0] for r in rows])}
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
