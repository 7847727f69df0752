"""Watch lists of any table: which columns hold codes and names, codes in one form, and codes sought by name where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What columns of codes and of names are called, in lower case.
CODES, NAMES = ("code", "股票代码", "代码", "stock_code", "symbol"), ("name", "股票名称", "名称", "stock_name")


def code(text: Column) -> Column:
    """A code in one form: 600519 of 600519.SH and SH600519, 00700 of 700.HK and HK700, tickers of one to five letters as they are; null for others."""
    up = F.upper(F.trim(text))
    part = lambda pattern: F.nullif(F.regexp_extract(up, pattern, 1), F.lit(""))
    hong_kong = F.coalesce(part(r"^([0-9]{1,5})\.HK$"), part(r"^HK([0-9]{1,5})$"))
    plain = F.coalesce(part(r"^([0-9]{5,6})$"), part(r"^([A-Z]{1,5}(?:\.(?:US|[A-Z]))?)$"))
    return F.coalesce(plain, part(r"^([0-9]{6})\.(?:SH|SZ|SS|BJ)$"), part(r"^(?:SH|SZ|SS|BJ)([0-9]{6})$"), F.lpad(hong_kong, 5, "0"))


def columns_of(rows: DataFrame) -> tuple[str | None, str | None]:
    """The columns of codes and of names by what they are called, the last of several; where none is, the first two columns."""
    at, named = None, None
    for c in rows.columns:
        at = c if c.strip().lower() in CODES else at
        named = c if c.strip().lower() in NAMES else named
    if at is None and named is None:
        return (rows.columns[0] if rows.columns else None), (rows.columns[1] if len(rows.columns) > 1 else None)
    return at, named


def watch_list(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(code, name) of each row that has either: a valid code as it is; else what a name, or a code that is none, is known by in
    known (name, code), whose names are unique. A name that looks like a code is one where there is no other."""
    at, named = columns_of(rows)
    text = lambda c: F.lit(None).cast("string") if c is None else F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    said = rows.select(text(at).alias("_code"), text(named).alias("_name")).filter("_code IS NOT NULL OR _name IS NOT NULL")
    swap = F.col("_code").isNull() & code(F.col("_name")).isNotNull()
    said = said.select(F.when(swap, F.col("_name")).otherwise(F.col("_code")).alias("_code"), F.when(~swap, F.col("_name")).alias("_name"))
    valid = code(F.col("_code"))
    sought = F.when(valid.isNull(), F.coalesce("_name", "_code"))
    found = said.withColumn("_valid", valid).withColumn("_sought", sought)
    names = known.select(F.col("name").alias("_sought"), F.col("code").alias("_known"))
    return found.join(names, "_sought", "left").select(F.coalesce("_valid", "_known").alias("code"), F.coalesce("_name", F.when(F.col("_valid").isNull(), F.col("_code"))).alias("name"))
