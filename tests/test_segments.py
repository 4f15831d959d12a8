"""Segments by language hold all rows."""

from lodeseek.plans import catalog


def test_rows_without_a_language_are_kept(spark, folder):
    rows = [(1, "the one", "en", "src1", 300), (2, "the two", None, "src1", 300), (3, "three", "de", "src2", 300), (4, "four", "fr", "src3", 300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    assert sorted(r.doc_id for r in catalog.QUERIES["segment_union"](spark, folder).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in catalog.QUERIES["add_field"](spark, folder).collect()) == [1, 2, 3, 4]
