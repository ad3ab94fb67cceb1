import pytest

from hushlake.plans.queries import QUERIES

LONG = "The report is long enough that its first words are not all of it. "


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, LONG + "\nBest regards,\nMartin\nPS: more."), (2, LONG), (3, "")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def test_signoff_names_reads_whole_texts(spark, sf):
    got = sorted((r.doc_id, r.entity_type, r.original) for r in QUERIES["signoff_names"](spark, sf).collect())
    assert got == [(1, "PERSON", "Dupont"), (1, "PERSON", "Martin"), (2, "PERSON", "Dupont"), (3, "PERSON", "Dupont")]


def test_unknown_tokens_stay_before_whole_texts(spark, sf):
    got = {r.doc_id: r.restored for r in QUERIES["restore_unknown_tokens"](spark, sf).collect()}
    assert got == {r.doc_id: "[x [EMAIL_ADDRESS_00000000]] " + r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
