import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

import oracle  # noqa: E402

from nearfield.llm import queries  # noqa: E402

QUERIES, SQL = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "op1_tokeniser_fertility": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_crf_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_nnpu_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_string_tiling": ["doc_id", "contaminated"],
    "op9_line_dedup": ["doc_id", "n_lines"],
}


@pytest.mark.skipif(not oracle.there, reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    oracle.same(QUERIES[name](spark, oracle.SF_DIR), SQL[name])


@pytest.mark.skipif(not oracle.there, reason="no tables")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_whole_table(spark, name):
    found = QUERIES[name](spark, oracle.SF_DIR)
    assert set(COLUMNS[name]) <= set(found.columns)
    assert found.count() == spark.read.parquet(f"{oracle.SF_DIR}/documents.parquet").count()


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
