"""The pipeline, stage by stage against plain versions, and its tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from brute import best_fit, near_groups, quality as plain_quality, without_passages

import corpus_pipeline
from lectern.llm import langid, quality
from lectern.sources import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    out, docs, folder = [], table(spark, SF, "documents"), tmp_path_factory.mktemp("stages")
    before = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after = docs.toPandas()
        out.append((name, before, after))
        before = after
    return {name: (a, b) for name, a, b in out}


def test_columns_stay(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert list(stages) == ["quality", "language", "near_duplicates", "passages", "packing"]
    assert all(b.columns.tolist() == columns for name, (_, b) in stages.items() if name != "packing")


def test_quality_stage(stages):
    before, after = stages["quality"]
    keep = [plain_quality(t, quality.COVERAGE_LIMITS, quality.LINE_COVERAGE_LIMIT, quality.SYMBOL_LIMIT)["kept"] for t in before["text"]]
    assert sorted(after["doc_id"]) == sorted(before["doc_id"][keep]) and 0 < len(after) < len(before)


def test_language_stage(spark, stages):
    before, after = stages["language"]
    docs = spark.createDataFrame(before)
    found = {r.doc_id: r for r in langid.predict(docs, langid.learn_profiles(langid._training(docs))).collect()}
    assert sorted(after["doc_id"]) == sorted(k for k, r in found.items() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE)
    assert len(after) >= 0.95 * len(before)


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    before = before.sort_values("doc_id").reset_index(drop=True)
    label, _ = near_groups(before["text"].tolist())
    assert sorted(after["doc_id"]) == sorted({int(before["doc_id"][k]) for k in label}) and len(after) < len(before)


def test_passage_stage(stages):
    before, after = stages["passages"]
    left = {k: b.decode("utf-8", "ignore") for k, (b, _, _) in zip(before["doc_id"], without_passages(before["text"], 200), strict=True)}
    assert dict(zip(after["doc_id"], after["text"], strict=True)) == {k: t for k, t in left.items() if t}
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_packing_stage(stages):
    before, after = stages["packing"]
    assert set(after["doc_id"]) == set(before["doc_id"])
    for _, g in after.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(np.append(0, g["length"].to_numpy()))[:-1]).all()
    assert after["sequence_id"].nunique() == best_fit(after["length"].tolist(), 4096)


def test_run_and_empty_table(spark, stages, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"][1])
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stages_take_nulls_repeats_and_clashing_columns(spark, docs_of):
    from brute import EDGES

    body = "\n".join(f"line {k} has some words of its own and a few of all others" for k in range(30))
    other = " ".join(f"word{k % 97} and{k % 31}" for k in range(400))
    texts = [*EDGES, body, body, body + " more", other, other, None, ""]
    ids = [None, None, *range(len(texts) - 4), 7, 7]
    docs = docs_of(texts, ["en" if t else None for t in texts], ids).withColumns({"_nj_doc": F.lit("own"), "_dd_doc": F.lit(5), "stays": F.lit(False)})
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert out.count() <= (1 << 20)
            if name != "packing":
                assert out.columns == docs.columns
                assert rows.isEmpty() or {r["_nj_doc"] for r in out.collect()} <= {"own"}
    kept = [r.text for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF).collect()]
    assert sum(bool(t) and t.startswith("line 0 ") for t in kept) == 1 and sum(t == other for t in kept) == 1
    assert sum(not t for t in kept) == 1 or sum(not t for t in kept) == len({i for i, t in zip(ids, texts, strict=True) if not t})
