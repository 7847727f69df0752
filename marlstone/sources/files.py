"""Sources of other forms: trade files, markdown, raw files and their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names that brokers give a field.
ALIASES = {
    "symbol": ("symbol", "code", "ticker", "证券代码"),
    "trade_date": ("trade_date", "date", "成交日期"),
    "side": ("side", "action", "买卖方向"),
    "quantity": ("quantity", "qty", "成交数量"),
    "price": ("price", "成交价格"),
}
FEES = ("fee", "commission", "手续费", "佣金")
TAXES = ("tax", "stamp_duty", "印花税")
BUYS, SELLS = ("buy", "b", "买入"), ("sell", "s", "卖出")


def trades_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Trades (symbol, trade_date, side, quantity, price, fee, tax) of CSV files with any broker's column names.

    All is read as text; rows without a day, a symbol, a known side, or with a quantity or price that isn't above 0 go.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    known = {c.strip().lower(): c for c in raw.columns}

    def pick(names: tuple[str, ...]) -> Column:
        held = [F.nullif(F.trim(F.col(f"`{known[n]}`")), F.lit("")) for n in names if n in known]
        return F.coalesce(*held) if held else F.lit(None).cast("string")

    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    total = lambda names: sum((F.coalesce(number(F.col(f"`{known[n]}`")), F.lit(0.0)) for n in names if n in known), F.lit(0.0))
    day = F.coalesce(*(F.try_to_timestamp(pick(ALIASES["trade_date"]), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")))
    said = F.lower(pick(ALIASES["side"]))
    side = F.when(said.isin(*BUYS), "buy").when(said.isin(*SELLS), "sell")
    parsed = raw.select(pick(ALIASES["symbol"]).alias("symbol"), day.alias("trade_date"), side.alias("side"), number(pick(ALIASES["quantity"])).alias("quantity"), number(pick(ALIASES["price"])).alias("price"), total(FEES).alias("fee"), total(TAXES).alias("tax"))
    return parsed.filter("symbol IS NOT NULL AND trade_date IS NOT NULL AND side IS NOT NULL AND quantity > 0 AND price > 0")


def front_matter(text: Column) -> Column:
    """map of `name: value` lines between --- lines at the start of a text; null where there are none."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, "\r?\n"), lambda line: line.rlike("^[A-Za-z_][A-Za-z0-9_-]*:"))
    pair = lambda line: F.struct(F.regexp_extract(line, "^([^:]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(line, "^[^:]+:", "")), "^\"|\"$", "").alias("value"))
    return F.when(block != "", F.map_from_entries(F.transform(lines, pair)))


def plain_markdown(text: Column) -> Column:
    """The text of markdown: no front matter, code fences, marks of headings and lists, or addresses of links."""
    out = F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    out = F.regexp_replace(out, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(#{1,6}|[-*+]|[0-9]+\.|>)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[*_`]+", ""), r"\s+", " "))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, meta, text) of markdown files: the title is that of the front matter, else the first heading, else the file's name."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    meta = front_matter(F.col("raw"))
    heading = F.nullif(F.trim(F.regexp_extract("raw", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return raw.select("path", F.coalesce(F.try_element_at(meta, F.lit("title")), heading, F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)).alias("title"), meta.alias("meta"), plain_markdown(F.col("raw")).alias("text"))


def headings(text: Column) -> Column:
    """array<struct<line, level, title>> of ATX headings outside of code fences, by their lines in the whole text.

    What stands between fences is blanked and keeps its line ends; a fence that isn't closed goes on to the end.
    """
    parts = F.split(text, "(?m)^[ \\t]*```")
    lines = F.split(F.array_join(F.transform(parts, lambda part, k: F.when(k % 2 == 1, F.regexp_replace(part, "[^\n]+", "")).otherwise(part)), ""), "\n")
    made = F.transform(lines, lambda line, k: F.struct((k + 1).alias("line"), F.length(F.regexp_extract(line, "^(#{1,6})\\s", 1)).alias("level"), F.trim(F.regexp_replace(line, "^#{1,6}\\s+|\\s*#*\\s*$", "")).alias("title")))
    return F.filter(made, lambda h: h["level"] > 0)


def manifest(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(path, kind, bytes, lines, sha256) of the files of a folder, at any depth."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    lines = F.when(F.length("content") == 0, 0).otherwise(F.size(F.split(F.decode("content", "UTF-8"), "\n")))
    return raw.select("path", kind.alias("kind"), F.col("length").alias("bytes"), lines.alias("lines"), F.sha2("content", 256).alias("sha256")).filter(F.col("kind").isin(*extensions))


def source_kind(source: Column) -> Column:
    """url, repo, md, txt or other, by how a source is written."""
    low = F.lower(F.trim(source))
    return F.when(low.rlike(r"^(https?://github\.com/[^/]+/[^/]+/?$|git@)|\.git/?$"), "repo").when(low.rlike("^https?://"), "url").when(low.rlike(r"\.(md|markdown)$"), "md").when(low.rlike(r"\.(txt|text|srt|vtt)$"), "txt").otherwise("other")
