"""What the operators leave to the driver's process."""

import glob
import os

from hushlake.llm import common, langid


def test_the_driver_fits_no_model(spark, monkeypatch):
    rows = [(k, lang, text) for k in range(40) for lang, text in (("en", f"the house by the river {k}"), ("fr", f"une maison pres du fleuve {k}"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = langid.train(df)
    driver = os.getpid()

    def elsewhere(rows, langs):
        from hushlake.llm.langid import fit_vectors

        assert os.getpid() != driver
        return fit_vectors(rows, langs)

    monkeypatch.setattr(langid, "fit_vectors", elsewhere)
    got = langid.train(df)
    assert got.languages == want.languages == ["en", "fr"] and got.threshold == want.threshold
    assert (got.logits == want.logits).all() and got.predict("the house by the river")[0] == "en"


def test_a_stored_table_has_no_marker_and_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/a b%20c")
    with common.scratch(spark):
        df = common.stored(spark.createDataFrame([(1, "x"), (None, None), (1, "x")], "a long, t string"))
        assert sorted(map(str, df.collect())) == ["Row(a=1, t='x')", "Row(a=1, t='x')", "Row(a=None, t=None)"]
        names = {os.path.basename(p) for p in glob.glob(f"{tmp_path}/*/*/*")}
        assert names and all(n.startswith("part-") for n in names)
    assert not glob.glob(f"{tmp_path}/*/*")


def test_folders_are_made_ahead(spark, tmp_path):
    common._folders(spark, f"file://{tmp_path}/t")
    assert os.path.isdir(tmp_path / "t/_temporary/0")


def test_freed_memory_goes_back(spark):
    assert "native heap" in common.trimmed(spark)
