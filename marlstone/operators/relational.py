"""Keyed choices, upserts, merges, lookups and checks that the library's jobs share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import graphs


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in the order, by a map-side aggregate of whole rows; null orders come first."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_r")).select("_r.*")


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key; ties by the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def last_n(rows: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


def failover(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source that has a key; sources must not repeat keys themselves."""
    tagged = reduce(DataFrame.unionByName, (s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)))
    return first_by(tagged, keys, "_source").withColumnRenamed("_source", "source")


def supplement(primary: DataFrame, secondary: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """primary with its null columns filled from secondary."""
    other = secondary.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    filled = [F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in primary.columns]
    return primary.join(other, keys, "left").select(*filled)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """old with rows of new put in their places; of new rows with one key the last counts. A column `state` tells which."""
    last = latest(new, keys, *order)
    kept = old.join(last.select(*keys), keys, "left_anti").withColumn("state", F.lit("kept"))
    known = old.select(*keys, F.lit(True).alias("_known")).distinct()
    put = last.join(known, keys, "left").withColumn("state", F.when(F.col("_known"), "updated").otherwise("inserted")).drop("_known")
    return kept.unionByName(put.select(kept.columns))


def filled(old: DataFrame, new: DataFrame, key: str, order: str, fixed: list[str], fields: list[str]) -> DataFrame:
    """(key, fixed, fields, state) of old rows (one a key) with new ones put in: a field takes the last value that isn't null or empty, a fixed one stays as it was first.

    Values are picked by partial aggregates in the order of `order`, so a hot key's rows are never gathered; equal places are settled by the value.
    """
    kind = dict(new.dtypes)
    there = lambda c: F.col(c).isNotNull() & (F.trim(c) != "" if kind[c] == "string" else F.lit(True))
    place = lambda c: F.struct(F.col(order), F.col(c))
    picked = new.groupBy(key).agg(*(F.min_by(c, place(c)).alias(c) for c in fixed), *(F.max_by(c, F.when(there(c), place(c))).alias(c) for c in fields))
    before = old.select(key, *(F.col(c).alias(f"_{c}") for c in [*fixed, *fields]), F.lit(True).alias("_known"))
    joined = picked.withColumn("_new", F.lit(True)).join(before, key, "full")
    state = F.when(F.col("_new").isNull(), "kept").when(F.col("_known"), "updated").otherwise("inserted")
    return joined.select(key, *(F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fixed), *(F.coalesce(c, f"_{c}").alias(c) for c in fields), state.alias("state"))


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): first-seen, unchanged, changed or gone, by a content hash on each side."""
    a, b = old.select(key, F.col(content).alias("_old")), new.select(key, F.col(content).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "first-seen").when(F.col("_new").isNull(), "gone").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, kind.alias("change"))


def unique_names(rows: DataFrame, name: str, code: str) -> DataFrame:
    """(name, code) of names that one code has alone."""
    return rows.groupBy(name).agg(F.min(code).alias(code), F.max(code).alias("_last")).filter(F.col(code) == F.col("_last")).drop("_last")


def resolve(links: DataFrame, pages: DataFrame, link: str, target: str, slug: str) -> DataFrame:
    """links with `found` and `status`: a page with that target, else the page with that slug; ambiguous if several, else missing."""
    exact = pages.select(F.col(target).alias(link), F.col(target).alias("_exact")).distinct()
    short = pages.groupBy(F.col(slug).alias(link)).agg(F.count_distinct(target).alias("_n"), F.min(target).alias("_one"))
    joined = links.join(exact, link, "left").join(short, link, "left")
    status = F.when(F.col("_exact").isNotNull() | (F.col("_n") == 1), "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return joined.withColumn("status", status).withColumn("found", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_one")))).drop("_exact", "_n", "_one")


def freshness(items: DataFrame, day: str, today: Column, days: int) -> DataFrame:
    """items with `kept` and the reason why not: unknown, old or future (a day ahead is allowed)."""
    reason = F.when(F.col(day).isNull(), "unknown").when(F.col(day) < F.date_sub(today, days - 1), "old").when(F.col(day) > F.date_add(today, 1), "future").otherwise("kept")
    return items.withColumn("reason", reason).withColumn("kept", F.col("reason") == "kept")


def canonical_redirects(rows: DataFrame, redirects: DataFrame, key: str, hops: int | None = None) -> DataFrame:
    """rows with `canonical`: redirects (a, b) followed from the key to the end, or for at most `hops`, ending before a place already seen.

    With `hops` each is a join; without, pointers double in length, so that a chain of n takes log n rounds.
    """
    if hops is None:
        found = graphs.canonical(redirects).withColumnRenamed("a", "_from").withColumnRenamed("canonical", "_to")
        return rows.join(found, rows[key] == found["_from"], "left").withColumn("canonical", F.coalesce("_to", key)).drop("_from", "_to")
    out = rows.withColumn("_seen", F.array(key)).withColumn("canonical", F.col(key))
    for _ in range(hops):
        step = redirects.select(F.col("a").alias("canonical"), F.col("b").alias("_next"))
        fresh = F.col("_next").isNotNull() & ~F.array_contains("_seen", F.col("_next"))
        out = out.join(step, "canonical", "left").withColumn("_go", F.coalesce(fresh, F.lit(False)))
        out = out.withColumn("_seen", F.when(F.col("_go"), F.array_append("_seen", F.col("_next"))).otherwise(F.col("_seen"))).withColumn("canonical", F.when(F.col("_go"), F.col("_next")).otherwise(F.col("canonical"))).drop("_next", "_go")
    return out.drop("_seen")


def quiet(at: Column, start: int, end: int) -> Column:
    """Whether a time's minute of the day lies in quiet hours, which may run past midnight."""
    minute = F.hour(at) * 60 + F.minute(at)
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def days_ago(text: Column, today: Column) -> Column:
    """The day of `N hours/days/weeks/months/years ago`; a month is 30 days, a year 365. Null for other texts."""
    n = F.regexp_extract(text, r"(?i)^\s*([0-9]+)\s+(hour|day|week|month|year)s?\s+ago\s*$", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*[0-9]+\s+(hour|day|week|month|year)", 1))
    length = F.when(unit == "hour", F.floor(n / 24).cast("int")).when(unit == "day", n).when(unit == "week", n * 7).when(unit == "month", n * 30).when(unit == "year", n * 365)
    return F.date_sub(today, length)


def trade_hash(*columns: Column) -> Column:
    """SHA-256 of a trade's fields, numbers with eight digits."""
    return F.sha2(F.concat_ws("|", *columns), 256)


def match_score(name: Column, query: str) -> Column:
    """How well a name meets a typed text: equal 100, at its start 80, within 60, else 0."""
    low, asked = F.lower(name), query.lower()
    return F.when(low == asked, 100).when(low.startswith(asked), 80).when(F.contains(low, F.lit(asked)), 60).otherwise(0)


def unique_slugs(rows: DataFrame, slug: str, key: str) -> DataFrame:
    """rows with `unique_slug`: the second of a slug gets -2, and so on, in the order of the key."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(key))
    return rows.withColumn("_n", n).withColumn("unique_slug", F.when(F.col("_n") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.col("_n").cast("string")))).drop("_n")
