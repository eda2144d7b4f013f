import pytest

import corpus_pipeline
from docframe.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import database, plain

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score", "op2_top_k": "query_id rank vec_id score", "op3_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op4_mixing": "doc_id size source_size target taken", "op5_license_scan": "doc_id license dice licenses", "op6_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op7_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op9_toxicity": "doc_id held_out score predicted", "op10_near_duplicates": "doc_id n_shingles component_id kept", "op11_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_quality": "doc_id held_out score predicted", "op13_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert plain(QUERIES[name](spark, FOLDER).toPandas()) == plain(database(FOLDER).execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_table(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    if name not in ("op2_top_k", "op13_filter_audit"):
        assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER))
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept and kept <= ids, name
        assert docs.where("n_chars <> length(text)").count() == 0
        ids = kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {x for r in mixed.select("doc_ids").collect() for x in r.doc_ids} <= ids and mixed.count() > 0


@pytest.mark.parametrize("rows", [0, 1, 40])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    """An empty table, one row, and nulls, blanks and repeated rows: the mix is of clean texts, with every one of the source that weighs most."""
    texts = [None, "", " \n"] + [f"clean text number {i} " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    given = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    given = (given + given[3:10] + [(None, "no id, but a text of its own", None, "a", 28)])[-rows:] if rows else []
    for name, df in {
        "documents": spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": spark.createDataFrame([(1, "a passage of the benchmark that nobody has")], "item_id long, text string"),
        "labels": spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int"),
    }.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = {i: source for i, t, _, source, _ in given if t and t.strip()}
    taken = {x for r in mixed for x in r.doc_ids}
    assert taken <= set(wanted) and {i for i, source in wanted.items() if source is None} <= taken and bool(mixed) == bool(wanted)
