"""Readers and writers of the tariff domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutymark.functions import codes, text
from dutymark.operators.lookups import first_per

C = F.col
BATCH = "Category_L2 string, Description string, HSN_Ref string, GST_Ref string"
ALIAS = "language_code string, original_term string, normalized_term string, english_term string, hsn_code string, category string, notes string, priority int, is_active boolean, source string"


def read_product_batches(spark: SparkSession, path: str) -> DataFrame:
    """Brand files (JSON arrays); the brand is the file name; rows without text or code and files that start with _ are left out."""
    rows = spark.read.schema(BATCH).option("multiLine", True).option("pathGlobFilter", "[!_]*.json").json(path).select("*", "_metadata.file_name")
    brand = F.replace(F.regexp_replace("file_name", r"\.json$", ""), F.lit("_"), F.lit(" "))
    out = rows.select(brand.alias("brand"), C("Description").alias("description"), codes.digits(C("HSN_Ref")).alias("raw_hsn_code"), codes.canonicalize_hsn(C("HSN_Ref")).alias("hsn_code"), codes.parse_rate(C("GST_Ref")).alias("gst_rate"), codes.clean_category(C("Category_L2")).alias("category"))
    return out.filter("trim(coalesce(description, '')) <> '' and hsn_code <> ''")


def longest_descriptions(df: DataFrame) -> DataFrame:
    """The row with the longest description of each raw code, the first on a tie (ord)."""
    return first_per(df.filter("raw_hsn_code <> ''"), "raw_hsn_code", F.desc(F.length(F.coalesce("description", F.lit("")))), "ord")


def read_tariff_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tariff CSV with a header; lines that start with # are comments."""
    rows = spark.read.schema("hsn_code string, description string, gst_rate string").option("comment", "#").option("header", True).csv(path).withColumn("ord", F.monotonically_increasing_id())
    return longest_descriptions(rows.select(codes.digits(C("hsn_code")).alias("raw_hsn_code"), codes.canonicalize_hsn(C("hsn_code")).alias("hsn_code"), "description", codes.parse_rate(C("gst_rate")).alias("gst_rate"), "ord"))


def resolve_columns(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns by candidate names (case and punctuation aside), else by position."""
    plain = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    by_name = {plain(c): c for c in reversed(df.columns)}
    picked = []
    for position, (name, candidates) in enumerate(wanted.items()):
        found = next((by_name[plain(c)] for c in (name, *candidates) if plain(c) in by_name), None)
        column = found or (df.columns[position] if position < len(df.columns) else None)
        picked.append((F.lit(None).cast("string") if column is None else C(f"`{column}`")).alias(name))
    return df.select(*picked)


def load_verified(df: DataFrame, order: str) -> DataFrame:
    """Sheet rows (description, hsn, rate): empty ones left out, the first row per UPPER(description) wins."""
    kept = df.filter("trim(coalesce(description, '')) <> ''").withColumn("key", F.upper(F.trim("description")))
    return first_per(kept, "key", order).withColumn("hsn_code", codes.clean_hsn(C("hsn"))).withColumn("no_size", text.strip_sizes(C("description")))


def read_alias_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Alias corpus as JSON arrays, or as objects with an array `entries`."""
    flat = spark.read.schema(f"{ALIAS}, entries array<struct<{', '.join(x.replace(' ', ':', 1) for x in ALIAS.split(', '))}>>").option("multiLine", True).json(path)
    own = flat.filter("entries is null").drop("entries")
    return own.unionByName(flat.filter("entries is not null").select(F.explode("entries").alias("e")).select("e.*"))


def load_pending(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Pending rows under alternative keys (product_name or name, hsn_code or hsn) whose name is not there yet."""
    pick = lambda *names: F.coalesce(*[C(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    rows = df.select(F.trim(pick("product_name", "name")).alias("product_name"), codes.clean_hsn(pick("hsn_code", "hsn")).alias("hsn_code")).filter("product_name <> ''")
    one = rows.groupBy("product_name").agg(F.min("hsn_code").alias("hsn_code"))
    return one.join(existing.select("product_name").distinct(), "product_name", "left_anti").withColumn("status", F.lit("pending"))


def schedule_prefix_rates(df: DataFrame) -> DataFrame:
    """(prefix, rate): every run of 2 to 8 digits of the chapter cell; NIL and EXEMPT are 0; the last row (ord) wins."""
    listed = df.select(F.explode(F.regexp_extract_all("cell", F.lit(r"\b(\d{2,8})\b"), F.lit(1))).alias("prefix"), codes.parse_rate(C("rate_text"), nil=True).alias("rate"), "ord")
    return listed.filter("rate is not null").groupBy("prefix").agg(F.max_by("rate", "ord").alias("rate"))


def master_report(df: DataFrame) -> DataFrame:
    """Report rows: Yes or No, blanks for nulls."""
    blank = lambda c: F.coalesce(C(c).cast("string"), F.lit(""))
    return df.select(F.substring("hsn_code", 1, 2).alias("chapter"), "hsn_code", blank("description").alias("description"), F.coalesce(codes.rate_label(C("gst_rate")), F.lit("")).alias("gst_rate"), F.when(codes.cess_flag(C("hsn_code")), "Yes").otherwise("No").alias("cess"))


def export_master(df: DataFrame, path: str, kind: str = "csv") -> None:
    """The report ordered by chapter, code and text, as CSV or JSON."""
    rows = master_report(df).orderBy("chapter", "hsn_code", "description")
    rows.write.option("header", True).csv(path) if kind == "csv" else rows.write.json(path)


def bulk_report(results: DataFrame) -> DataFrame:
    return results.select("row_id", "query", F.when(C("hsn_code") != "", F.lpad("hsn_code", 8, "0")).alias("hsn_code"), F.concat(C("confidence").cast("string"), F.lit("%")).alias("confidence"), F.when(C("hsn_code").isNull(), "Not found").when(C("review"), "Needs review").otherwise("Matched").alias("status"))


def audit_events(df: DataFrame) -> DataFrame:
    """Events with the key as a digest."""
    return df.withColumn("api_key_hash", F.substring(F.sha2(C("api_key").cast("string").cast("binary"), 256), 1, 16)).drop("api_key")


def append_events(df: DataFrame, path: str) -> None:
    audit_events(df).write.mode("append").parquet(path)


def intake(df: DataFrame, column: str, key: str) -> DataFrame:
    """(row_id, text, failed): empty cells stay as failed rows; row_id comes from the input."""
    t = F.trim(F.coalesce(C(column), F.lit("")))
    return df.select(C(key).alias("row_id"), t.alias("text"), (t == "").alias("failed"))


def prediction_rows(results: DataFrame, run: str) -> DataFrame:
    """Rows to append: the id is a digest of run and text, so that a repeated run gives the same ids."""
    return results.select(F.sha2(F.concat_ws("|", F.lit(run), C("row_id").cast("string"), C("query")).cast("binary"), 256).alias("request_id"), C("query").alias("input_text"), C("hsn_code").alias("predicted_hsn"), "confidence", (C("confidence") < 70).alias("needs_review"))
