"""Benchmark decontamination by templates, with DataFrame functions only.

A text becomes a template: words in lower case, and typed placeholders for numbers, for units after
a number, and for names (capitalised words within a sentence). Windows of the template are hashed and
joined with those of the benchmark. An item is found in a text where enough of its windows are, and
where its slots are filled consistently: each value of the item by one value of the text. Both are asked
of each occurrence, which is told by its alignment (place in the text less place in the item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.arrays import let
from marlstone.llm.shared import materialize

#: Words of a window, the share of an item's windows that a text must hold, and the most windows that are broadcast.
WIDTH, COVERAGE, BROADCAST = 8, 0.5, 200_000
#: Tasks that a window's texts are dealt to where the benchmark isn't broadcast.
SALTS = 16

#: Units that may follow a number.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "mg", "g", "kg", "t", "lb", "lbs", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "km/h", "mph", "percent", "dollar", "dollars", "euro", "euros", "cents", "usd", "eur", "kb", "mb", "gb", "tb", "hz", "w", "kw", "v",
)

_TOKENS = r"[\p{L}\p{M}]+|\d+(?:[.,]\d+)*|[.!?\n]"


def template(text: Column, names: bool = True) -> Column:
    """struct<words, slots>: the template of a text, and what each placeholder stands for; slots are null where there is none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKENS), F.lit(0))

    def number(x: Column) -> Column:
        return (x >= "0") & (x < ":")

    def mark(x: Column) -> Column:
        return x.isin(".", "!", "?", "\n")

    def words(tokens: Column) -> Column:
        def word(x: Column, k: Column) -> Column:
            before = F.get(tokens, k - 1)
            kind = F.when((x >= "a") & (x < "{") & ~F.coalesce(number(before), F.lit(False)), F.lower(x))  # most words: the rest needn't be tried
            kind = kind.when(mark(x), None).when(number(x), "#number").when(number(before) & F.lower(x).isin(*UNITS), "#unit")
            if names:
                kind = kind.when(x.rlike(r"^\p{Lu}[\p{Ll}\p{M}]+$") & ~F.coalesce(mark(before), F.lit(True)), "#name")
            return kind.otherwise(F.lower(x))

        return F.transform(tokens, word)

    def parts(tokens: Column, made: Column) -> Column:
        slots = F.transform(F.filter(F.arrays_zip(made.alias("w"), tokens.alias("t")), lambda z: z["w"].isNotNull()), lambda z: F.when(z["w"].startswith("#"), F.lower(z["t"])))
        return F.struct(F.filter(made, lambda w: w.isNotNull()).alias("words"), F.when(F.exists(made, lambda w: w.startswith("#")), slots).alias("slots"))

    return let(found, lambda tokens: let(words(tokens), lambda made: parts(tokens, made)))


def windows(made: Column, width: int = WIDTH, whole: bool = False) -> Column:
    """array<struct<place, key, width, slots>> of a template's windows; none where it has fewer words, or with `whole` one of all its words."""

    def cut(words: Column, slots: Column, n: Column) -> Column:
        def window(k: Column) -> Column:
            own = F.when(slots.isNotNull(), F.filter(F.slice(slots, k, n), lambda s: s.isNotNull()))
            return F.struct(k.alias("place"), F.xxhash64(F.slice(words, k, n)).alias("key"), n.alias("width"), own.alias("slots"))

        return F.when((n > 0) & (F.size(words) >= n), F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), window))

    return let(made, lambda t: let(t["words"], lambda words: let(t["slots"], lambda slots: cut(words, slots, F.least(F.lit(width), F.size(words)) if whole else F.lit(width)))))


def _exploded(rows: DataFrame, id_columns: list[str], cut: Column) -> DataFrame:
    found = rows.select(*id_columns, F.explode(cut).alias("w"))
    return found.select(*id_columns, "w.place", "w.key", "w.width", F.coalesce("w.slots", F.array().cast("array<string>")).alias("slots"))


def _occurrences(hits: DataFrame) -> DataFrame:
    """hits once for each group they may belong to: the document, their exact alignment, and bands of alignments.

    Bands overlap by half, so that words put in or left out don't part an occurrence; one is WIDTH wide, one as wide as the item, which
    is less than two copies are apart. Alignments are those of one text, where several have the same id.
    """
    shift = F.col("place") - F.col("item_place")
    own = lambda scale, band: F.struct(F.lit(scale).alias("scale"), F.col("part").alias("part"), band.cast("long").alias("band"))
    wide = F.ceil(F.col("windows") / 2)
    bands = [own(k, F.floor(shift / step) + over) for k, step in ((2, F.lit(WIDTH // 2)), (3, wide)) for over in (0, 1)]
    document = F.struct(F.lit(0).alias("scale"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("band"))
    return hits.withColumn("group", F.explode(F.array(document, own(1, shift), *bands)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, windows, found, coverage, verbatim): a row for each document and each item that it holds.

    windows are the item's, found the most of them that an occurrence which passes has; verbatim tells that the slots of enough of them
    are unchanged. An occurrence is all of a document, or what has about the same alignment. An item counts both as it is and without
    its names' capitals, so that a text in lower case is found too. An item of fewer words than a window is one window of its own
    length, sought among windows of that length with and without names; one of placeholders alone only with its own values. Null and
    empty texts hold nothing. Rows of one id count as one document, repeated rows as one. An empty table on either side gives no rows.
    A very long text is one row's windows, made in a task's memory. Ties don't arise: a pair is a row. Other columns are not looked at,
    whatever their names. The benchmark's windows are broadcast only up to BROADCAST of them, each item's counted; beyond that
    the windows of texts are shuffled to them.
    """
    items = benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text"))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumn("part", F.xxhash64("text"))
    both = [_exploded(items, ["item_id"], windows(template(F.col("text"), names), width, True)) for names in (True, False)]
    sought = both[0].union(both[1]).distinct()
    total = sought.groupBy("item_id").agg(F.countDistinct("place").alias("windows"))
    sought = materialize(sought.join(total, "item_id").select("item_id", "windows", "key", "width", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")), "sought")
    few = sought.limit(BROADCAST + 1).count() <= BROADCAST
    short = sorted(r.width for r in sought.select("width").distinct().collect() if r.width < width)
    cut = windows(template(F.col("text")), width)
    if short:  # the texts' templates are cut again only for lengths that items have
        more = [let(template(F.col("text"), names), lambda t: F.flatten(F.array_compact(F.array(*(windows(t, n) for n in short))))) for names in (True, False)]
        cut = F.flatten(F.array_compact(F.array(cut, *more)))
    held = _exploded(texts, ["doc_id", "part"], cut)
    if few:
        hits = held.join(F.broadcast(sought), ["key", "width"])
    else:  # a window that very many texts hold is dealt to SALTS tasks, and the benchmark's windows to each
        salted = sought.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part", "place"), F.lit(SALTS)).cast("int")).join(salted, ["key", "width", "salt"]).drop("salt")
    bare = (F.col("width") < width) & (F.size("item_slots") == F.col("width"))
    hits = hits.filter(~bare | (F.col("slots") == F.col("item_slots")))
    unchanged = F.when(F.col("slots") == F.col("item_slots"), F.col("item_place"))
    pairs = F.array_distinct(F.flatten(F.collect_set(F.when(F.size("slots") > 0, F.arrays_zip("item_slots", "slots")))))
    decided = _occurrences(hits).groupBy("doc_id", "item_id", "windows", "group").agg(F.size(F.collect_set("item_place")).cast("long").alias("found"), F.size(F.collect_set(unchanged)).alias("same"), pairs.alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.col("pairs.item_slots")))
    least = coverage * F.col("windows")
    passed = decided.filter((F.col("found") >= least) & (consistent | (F.col("same") >= least)))
    return passed.groupBy("doc_id", "item_id", "windows").agg(F.max("found").alias("found"), F.max(F.col("same") >= least).alias("verbatim")).select(
        "doc_id", "item_id", "windows", "found", (F.col("found") / F.col("windows")).alias("coverage"), "verbatim"
    )
