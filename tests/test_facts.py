"""Known facts of the domain on literal rows."""

import pytest
from pyspark.sql import functions as F

from dutymark.functions import codes, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("__x")).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("1905", "19050000"), ("190531", "19053100"), ("19053100", "19053100"), ("", ""), (None, ""), ("1905310", "01905310"), ("1905.31.00", "19053100")])
def test_canonical_codes(spark, raw, want):
    assert one(spark, codes.canonicalize_hsn(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "kind", "shown"), [("9971", "SAC", "9971"), ("190190", "HSN", "19019000"), ("997111", "SAC", "997111")])
def test_services_are_not_filled(spark, raw, kind, shown):
    assert one(spark, codes.code_type(F.lit(raw))) == kind and one(spark, codes.display_code(F.lit(raw))) == shown


@pytest.mark.parametrize(("rate", "ok"), [(0.0, True), (0.1, True), (0.25, True), (1.5, True), (3.0, True), (5.0, True), (12.0, True), (18.0, True), (28.0, True), (15.0, False), (4.0, False), (20.0, False)])
def test_slabs(spark, rate, ok):
    assert one(spark, codes.is_valid_slab(F.lit(rate))) is ok


def test_effective_tax(spark):
    tax = lambda *v: one(spark, codes.effective_tax(*[F.lit(x).cast("double") if not isinstance(x, str) else F.lit(x) for x in v]))
    assert tax(28.0, 12.0, "igst_only", None) == 40.0 and tax(18.0, None, "combined", 40.0) == 18.0 and tax(None, None, "unknown", 5.0) == 5.0


def test_texts(spark):
    assert one(spark, text.expand_words(F.lit("BTRM CLNR"))) == "bathroom cleaner"
    assert one(spark, text.tokenize(F.lit("TATA Tea 500 gm premium pack"))) == ["tea"]
    assert abs(one(spark, text.trgm_similarity(F.lit("HORLICKS WOMENS"), F.lit("HORLICKS"))) - 0.5625) < 1e-9
    assert one(spark, text.normalize_name(F.lit("THE SHP BTL 2X200 ML"))) == "SHAMPOO BOTTLE ML"
    assert one(spark, text.detect_language(F.lit("मसाला"))) == "hi" and one(spark, text.detect_language(F.lit("vellam podi"))) == "ml-roman"
    assert one(spark, text.normalize_term(F.lit("café crème"))) == "CAFE CREME"


def test_terms_of_all_lines(spark, tmp_path):
    from dutymark.queries import scalars  # noqa: F401
    from dutymark.registry import QUERIES

    spark.createDataFrame([(1, "first line\nsecond, line\nCafé"), (2, "one\ntwo")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["term"] for r in QUERIES["t18_normalize_term"](spark, str(tmp_path)).collect()} == {1: "FIRST LINE SECOND LINE CAFE", 2: "ONE TWO"}


def test_the_best_scope_wins_over_any_number_of_more_similar_rows(spark):
    from dutymark.operators.similarity import match_curated

    goods = [(i, f"steel anvil blue {chr(97 + i // 26)}{chr(97 + i % 26)}", "chapter") for i in range(80)] + [(80, "steel anvil blue", "chapter"), (99, "steel anvil blue with a long tail", "exact")]
    out = match_curated(spark.createDataFrame([(1, "steel anvil blue"), (2, "steel anvil blue")], "query_id long, text string"), spark.createDataFrame(goods, "id long, description string, scope string"))
    assert sorted((r["query_id"], r["id"]) for r in out.collect()) == [(1, 99), (2, 99)]
