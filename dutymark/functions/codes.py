"""Tariff codes and rates as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dutymark.functions.fixed import CESS_CHAPTERS, CHAPTER_RATES, PLACEHOLDERS, SLABS


def digits(c: Column) -> Column:
    """Digits of a code; null becomes ''."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def canonicalize_hsn(c: Column) -> Column:
    """Eight digits: cut longer codes, fill chapters, headings and subheadings on the right, odd lengths on the left."""
    d = digits(c)
    n = F.length(d)
    return F.when(n == 0, "").when(n >= 8, F.substring(d, 1, 8)).when(n.isin(2, 4, 6), F.rpad(d, 8, "0")).otherwise(F.lpad(d, 8, "0"))


def clean_hsn(c: Column) -> Column:
    """Loader form: filled on the left, never cut, null without digits."""
    d = digits(c)
    return F.when(F.length(d) == 0, None).when(F.length(d) < 8, F.lpad(d, 8, "0")).otherwise(d)


def is_service(c: Column) -> Column:
    return digits(c).rlike("^99[0-9]{2}([0-9]{2})?$")


def code_type(c: Column, kind: Column | None = None) -> Column:
    """SAC or HSN; an explicit kind wins."""
    by_code = F.when(is_service(c), "SAC").otherwise("HSN")
    return by_code if kind is None else F.when(F.upper(kind).isin("SAC", "HSN"), F.upper(kind)).otherwise(by_code)


def display_code(c: Column, kind: Column | None = None) -> Column:
    """Services keep 4 or 6 digits, goods are filled to 8."""
    d = digits(c)
    return F.when(code_type(c, kind) == "SAC", F.substring(d, 1, 6)).when(F.length(d) < 8, F.rpad(d, 8, "0")).otherwise(d)


def hierarchy(c: Column) -> Column:
    """struct(chapter, heading, subheading), null where the code is too short."""
    d = digits(c)
    part = lambda n: F.when(F.length(d) >= n, F.substring(d, 1, n))
    return F.struct(part(2).alias("chapter"), part(4).alias("heading"), part(6).alias("subheading"))


def parse_rate(c: Column, nil: bool = False) -> Column:
    """First number of a text; nil=True reads NIL, EXEMPT, NA and - as 0."""
    number = F.regexp_extract(c.cast("string"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.upper(F.trim(c.cast("string"))).isin("NIL", "EXEMPT", "NA", "-"), 0.0).otherwise(number) if nil else number


def rate_label(c: Column) -> Column:
    """18.0 -> 18%, 0.25 -> 0.25%."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), r"\.$", "")
    return F.when(c.isNull(), None).otherwise(F.concat(text, F.lit("%")))


def _slabs() -> Column:
    return F.array(*[F.lit(s) for s in SLABS])


def is_valid_slab(c: Column) -> Column:
    return F.coalesce(F.exists(_slabs(), lambda s: F.abs(c - s) < 0.01), F.lit(False))


def closest_slab(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array_min(F.transform(_slabs(), lambda s: F.struct(F.abs(s - c).alias("d"), s.alias("s"))))["s"])


def cess_flag(c: Column) -> Column:
    return F.substring(digits(c), 1, 2).isin(*CESS_CHAPTERS)


def chapter_rate(c: Column) -> Column:
    """Default rate of a code's chapter, null outside 01 to 99."""
    rates = F.array(*[F.lit(float(r)) for r in CHAPTER_RATES])
    chapter = F.substring(digits(c), 1, 2).try_cast("int")
    return F.when((chapter >= 1) & (F.length(digits(c)) >= 2), F.get(rates, chapter - 1))


def effective_tax(rate: Column, cess: Column, semantics: Column, history: Column) -> Column:
    """igst_only adds cess; combined is the rate itself; else the larger current history rate."""
    return (
        F.when(rate.isNull(), history)
        .when((semantics == "igst_only") & (F.coalesce(cess, F.lit(0.0)) != 0), F.round(rate + cess, 4))
        .when(semantics == "combined", rate)
        .otherwise(F.greatest(rate, F.coalesce(history, rate)))
    )


def is_valid_code(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("^([0-9]{2}|[0-9]{4}|[0-9]{6}|[0-9]{8})$")


def is_unclassified(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("", *PLACEHOLDERS)


def is_placeholder(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("00$")


def full_description(own: Column, parent: Column, official: Column) -> Column:
    """Official text, else parent and own joined unless own holds parent already."""
    head = F.rtrim(F.regexp_replace(F.coalesce(parent, F.lit("")), "[: -]+$", ""))
    joined = F.when((head == "") | (F.instr(F.lower(own), F.lower(head)) > 0), own).otherwise(F.concat(head, F.lit(" — "), own))
    return F.coalesce(F.nullif(F.trim(official), F.lit("")), joined)


def clean_category(c: Column) -> Column:
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("Other_Unclassified"))


def to_decimal_rate(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast("decimal(5,2)")
