"""Chunks of markdown: sections under their headings, and spans of whole blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.arrays import let, running

HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
_LINE_END = r"\r\n|\n|\r"


def _paths(lines: Column) -> Column:
    """array<struct<line, path>> of the headings: a heading of level n stands under the last headings of at most n - 1 levels."""
    told = F.transform(lines, lambda s, k: F.struct((k + 1).alias("line"), F.length(F.regexp_extract(s, HEADING, 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_extract(s, HEADING, 2), "^#+|#+$", "")).alias("title")))

    def step(path: Column, h: Column) -> tuple[Column, Column]:
        below = F.concat(F.slice(path, F.lit(1), F.least(h["level"] - 1, F.size(path))), F.array(h["title"]))
        return below, F.struct(h["line"].alias("line"), below.alias("path"))

    return let(F.filter(told, lambda h: h["level"] > 0), lambda heads: running(heads, F.array().cast("array<string>"), step, "struct<line:int,path:array<string>>"))


def heading_chunks(docs: DataFrame, id_column: str, text_column: str, max_lines: int = 80, separator: str = " > ") -> DataFrame:
    """(id, start_line, end_line, heading_path, sha256, text): a section under a heading, in stretches of max_lines (2 at least).

    Lines before the first heading have an empty path; stretches of blank lines, and null or empty texts, give none. Each
    row is cut by itself, so nothing is shuffled; the fold goes over a text's headings only.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), rf"({_LINE_END})\z", "")
    lined = docs.select(id_column, F.split(text, _LINE_END).alias("lines")).withColumn("heads", _paths(F.col("lines")))
    first = F.array(F.struct(F.lit(1).alias("line"), F.array().cast("array<string>").alias("path")))
    sections = F.when(F.coalesce(F.get("heads", F.lit(0))["line"], F.lit(0)) == 1, F.col("heads")).otherwise(F.concat(first, "heads"))
    cut = lined.select(id_column, "lines", sections.alias("sections"))

    def stretches(section: Column, k: Column) -> Column:
        end = F.coalesce(F.get("sections", k + 1)["line"] - 1, F.size("lines"))

        def stretch(start: Column) -> Column:
            n = F.least(F.lit(max_lines), end - start + 1)
            body = F.regexp_replace(F.array_join(F.slice("lines", start, n), "\n"), r"^\s+|\s+$", "")
            return F.struct(start.alias("start_line"), (start + n - 1).alias("end_line"), F.array_join(section["path"], separator).alias("heading_path"), F.sha2(body, 256).alias("sha256"), body.alias("text"))

        return F.transform(F.sequence(section["line"], end, F.lit(max_lines)), stretch)

    made = F.filter(F.flatten(F.transform("sections", stretches)), lambda c: c["text"] != "")
    return cut.select(id_column, F.explode(made).alias("c")).select(id_column, "c.*")


_SPAN = "struct<start:int,end:int,kind:string,first:int,last:int>"


def _left(line: Column) -> Column:
    """How many blanks a line begins with."""
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def _blocks(lines: Column) -> Column:
    """array<struct<start, end>> of what blank lines part, in code points; lines between fences stay together. A null after the lines closes the last block."""

    def step(s: Column, line: Column) -> tuple[Column, Column]:
        bare = F.regexp_replace(line, r"^\s+|\s+$", "")
        said = F.coalesce(bare != "", F.lit(False))
        within = line.isNotNull() & (said | s["fenced"])
        start = F.when(within, F.coalesce(s["start"], s["at"] + _left(line)))
        end = F.when(said, s["at"] + F.length(F.regexp_replace(line, r"\s+$", ""))).otherwise(s["end"])
        fence = F.coalesce(bare.startswith("```") | bare.startswith("~~~"), F.lit(False))
        state = F.struct(start.alias("start"), end.alias("end"), (s["at"] + F.coalesce(F.length(line), F.lit(0)) + 1).alias("at"), (s["fenced"] != fence).alias("fenced"))
        return state, F.when(~within & s["start"].isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end")))

    none = F.lit(None).cast("int")
    zero = F.struct(none.alias("start"), none.alias("end"), F.lit(0).alias("at"), F.lit(False).alias("fenced"))
    return F.array_compact(running(F.array_append(lines, F.lit(None).cast("string")), zero, step, "struct<start:int,end:int>"))


def _spans(text: Column, found: Column, size: int, overlap: int) -> Column:
    """Blocks joined while they span at most `size`; a longer block is cut in windows. A null after the blocks closes the last span."""

    def windows(block: Column, n: Column) -> Column:
        starts = F.filter(F.sequence(block["start"], block["end"] - 1, F.lit(size - overlap)), lambda at: (at == block["start"]) | (at - (size - overlap) + size < block["end"]))

        def cut(at: Column) -> Column:
            piece = F.substr(text, at + 1, F.least(F.lit(size), block["end"] - at))
            return let(piece, lambda x: let(F.regexp_replace(x, r"^\s+|\s+$", ""), lambda bare: F.when(bare != "", _one(at + _left(x), at + _left(x) + F.length(bare), "window", n, n))))

        return F.array_compact(F.transform(starts, cut))

    def step(g: Column, block: Column) -> tuple[Column, Column]:
        n = g["n"] + 1
        wide = F.coalesce(block["end"] - block["start"] > size, F.lit(False))
        flush = g["start"].isNotNull() & (block.isNull() | wide | F.coalesce(block["end"] - g["start"] > size, F.lit(False)))
        held = F.when(flush, F.array(_one(g["start"], g["end"], "blocks", g["first"], g["last"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))
        out = F.when(wide, F.concat(held, windows(block, n))).otherwise(held)
        goes_on = g["start"].isNotNull() & ~flush
        start, first = F.when(goes_on, g["start"]).otherwise(block["start"]), F.when(goes_on, g["first"]).otherwise(n)
        state = F.struct(F.when(~wide, start).alias("start"), block["end"].alias("end"), first.alias("first"), n.alias("last"), n.alias("n"))
        return state, out

    none = F.lit(None).cast("int")
    zero = F.struct(none.alias("start"), none.alias("end"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("n"))
    return F.flatten(running(F.array_append(found, F.lit(None).cast("struct<start:int,end:int>")), zero, step, f"array<{_SPAN}>"))


def _one(start: Column, end: Column, kind: str, first: Column, last: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"))


def parent_spans(text: Column, size: int = 1800, overlap: int = 64) -> Column:
    """array<struct<start, end, kind, first, last>> of a text's spans, in code points from 0, with the numbers of their blocks.

    A null, empty or blank text has none. Spans are filled greedily by folds over a text's lines and blocks, within its row.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    return let(F.coalesce(text, F.lit("")), lambda t: let(_blocks(F.split(t, "\n")), lambda found: _spans(t, found, size, overlap)))
