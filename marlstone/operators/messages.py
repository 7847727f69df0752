"""Messages cut into chunks that a channel takes: at separators where there are some, by force where not, with page marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.arrays import let, running
from marlstone.functions.text import effective_length

#: What parts a message, the coarsest first: where it is cut, what of that opens the next section, and what is put between sections.
SEPARATORS = (("\n---\n", "", "\n---\n"), ("\n# ", "# ", "\n"), ("\n## ", "## ", "\n"), ("\n### ", "### ", "\n"), ("\n**", "**", "\n"), ("\n", "", "\n"))
#: What ends a chunk that was cut by force, how a page's number is put, what room it takes in bytes and in words, and the least budgets.
SUFFIX, MARK, MARK_BYTES, MARK_WORDS, LEAST_BYTES, LEAST_WORDS = "\n\n...(本段内容过长已截断)", "\n\n📄 {}/{}", 16, 13, 40, 10

_ITEM = "struct<text:string,tail:string,size:int,most:int,budget:int,run:string>"


def _item(text: Column, tail: Column, size: Column, most: Column, budget: Column, run: Column) -> Column:
    """A stretch of a message: its text and what is put after it, its size with that, what a chunk of its run may hold, what it may hold itself, and its run."""
    return F.struct(text.alias("text"), tail.alias("tail"), size.cast("int").alias("size"), most.cast("int").alias("most"), budget.cast("int").alias("budget"), run.alias("run"))


class _Measure:
    """How a text's size is counted: in bytes, or in words as a channel counts characters."""

    def __init__(self, words: bool, special: int = 2) -> None:
        self.words, self.special = words, special
        self.suffix = len(SUFFIX) if words else len(SUFFIX.encode())

    def text(self, text: Column) -> Column:
        return effective_length(text, self.special) if self.words else F.octet_length(text)

    def char(self, char: Column) -> Column:
        return F.when(F.octet_length(char) == 4, self.special).otherwise(1) if self.words else F.octet_length(char)

    def fits(self, full: Column, own: Column, room: Column) -> Column:
        """A character of several bytes is left to the next piece where it would end exactly at the limit."""
        return (full <= room) if self.words else (full < room) | ((full == room) & (own == 1))


def _parted(item: Column, measure: _Measure, mark: tuple[str, str, str], level: int) -> Column:
    """An item's sections, where it is too long and holds the separator; else the item itself. A section that is too long for a chunk gets a run of its own."""
    needle, opens, between = mark
    width = len(between)

    def section(text: Column, k: Column, n: Column) -> Column:
        said = F.when(k > 0, F.concat(F.lit(opens), text)).otherwise(text)
        whole, left = measure.text(said) + width, item["budget"] - width
        most = item["budget"] if measure.words else left
        run = F.concat(item["run"], F.lit(f"/{level}"))
        return _item(said, F.when(k == n - 1, item["tail"]).otherwise(F.lit(between)), whole, most, left, F.when(whole > most, F.concat(run, F.lit("."), k.cast("string"))).otherwise(run))

    parts = let(F.split(item["text"], "\\Q" + needle + "\\E"), lambda s: F.transform(s, lambda t, k: section(t, k, F.size(s))))
    return F.when((measure.text(item["text"]) > item["budget"]) & F.contains(item["text"], F.lit(needle)), parts).otherwise(F.array(item))


def _forced(item: Column, measure: _Measure) -> Column:
    """The pieces of an item that is still too long, each as long as the budget allows and ended by SUFFIX, but for the last; blanks at the end get no piece."""
    text, long = item["text"], item["budget"] > measure.suffix
    room, end = F.when(long, item["budget"] - measure.suffix).otherwise(F.greatest(F.lit(1), item["budget"])), F.when(long, SUFFIX).otherwise("")

    def step(state: Column, char: Column) -> tuple[Column, Column]:
        own = measure.char(char)
        stays = measure.fits(state["used"] + own, own, room) | (state["used"] == 0)
        after = F.struct((F.when(stays, state["used"]).otherwise(0) + own).cast("int").alias("used"), F.when(stays, state["n"]).otherwise(state["n"] + 1).cast("int").alias("n"))
        return after, after["n"]

    def cut(numbers: Column) -> Column:
        starts = F.filter(F.transform(numbers, lambda n, k: F.when((k == 0) | (n != F.get(numbers, k - 1)), k)), lambda k: k.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, k: F.substr(text, at + 1, F.coalesce(F.get(s, k + 1), F.length(text)) - at)))

    # characters of one byte each: all pieces but the last are as long as each other
    plain = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / room).cast("int")), lambda k: F.substr(text, k * room + 1, room))
    mixed = let(running(F.split(text, ""), F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), step, "int"), cut)
    pieces = F.when(F.octet_length(text) == F.length(text), plain).otherwise(mixed)
    kept = let(pieces, lambda c: F.slice(c, 1, F.array_max(F.transform(c, lambda p, k: F.when((k == 0) | ~p.rlike(r"(?U)^\s*$"), k + 1).otherwise(1)))))

    def made(c: Column) -> Column:
        last = lambda k: k == F.size(c) - 1
        return F.transform(c, lambda p, k: _item(F.when(last(k), p).otherwise(F.concat(p, end)), F.when(last(k), item["tail"]).otherwise(""), F.lit(0), F.lit(0), F.lit(0), F.concat(item["run"], F.lit("!"), k.cast("string"))))

    return F.when(measure.text(text) > item["budget"], let(kept, made)).otherwise(F.array(item))


def _packed(items: Column) -> Column:
    """Items in a row as chunks: what is of one run goes together as long as it fits."""

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        stays = (state["run"] == x["run"]) & (state["used"] + x["size"] <= x["most"])
        after = F.struct(x["run"].alias("run"), (F.when(stays, state["used"]).otherwise(0) + x["size"]).cast("int").alias("used"), F.when(stays, state["n"]).otherwise(state["n"] + 1).cast("int").alias("n"))
        return after, F.struct(after["n"].alias("n"), F.concat(x["text"], x["tail"]).alias("text"))

    zero = F.struct(F.lit("").alias("run"), F.lit(0).alias("used"), F.lit(-1).alias("n"))

    def joined(held: Column) -> Column:
        starts = F.filter(F.transform(held, lambda x, k: F.when((k == 0) | (x["n"] != F.get(held, k - 1)["n"]), k)), lambda k: k.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda at, k: F.array_join(F.transform(F.slice(held, at + 1, F.coalesce(F.get(s, k + 1), F.size(held)) - at), lambda x: x["text"]), "")))

    return let(running(items, zero, step, "struct<n:int,text:string>"), joined)


def _chunks(text: Column, budget: int, least: int, measure: _Measure, mark: int) -> Column:
    if budget - mark < least:
        raise ValueError(f"a chunk takes {least} at least, and {mark} for its mark: {budget} are too few")
    whole = F.coalesce(text, F.lit(""))
    items = F.array(_item(whole, F.lit(""), measure.text(whole), F.lit(budget - mark), F.lit(budget - mark), F.lit("0")))

    def at(level: int) -> Callable[[Column], Column]:
        return lambda held: F.flatten(F.transform(held, lambda x: _parted(x, measure, SEPARATORS[level], level)))

    for level in range(len(SEPARATORS)):
        items = let(items, at(level))
    items = let(items, lambda held: F.flatten(F.transform(held, lambda x: _forced(x, measure))))
    some = let(let(items, _packed), lambda c: let(F.filter(c, lambda x: x != ""), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("")))))
    numbered = let(some, lambda c: F.transform(c, lambda t, k: F.concat(t, F.format_string(MARK.replace("{}", "%d"), k + 1, F.size(c)))))
    return numbered if mark else some


def chunks_by_bytes(text: Column, budget: int, marked: bool = False) -> Column:
    """array<string>: a message in chunks of so many bytes at most, cut at the coarsest separators that do; marked ones end with their number and how many there are.

    Chunks joined give the message, but for what a forced cut adds (SUFFIX) and blanks that it ends with. A chunk is within its budget. A null
    message is an empty one, which is one empty chunk. An empty section at the end gives no chunk of its own.
    """
    return _chunks(text, budget, LEAST_BYTES, _Measure(False), MARK_BYTES if marked else 0)


def chunks_by_words(text: Column, budget: int, special: int = 2, marked: bool = False) -> Column:
    """array<string>: a message in chunks of so many characters at most, of which those beyond the basic plane count `special`; else as chunks_by_bytes."""
    return _chunks(text, budget, LEAST_WORDS, _Measure(True, special), MARK_WORDS if marked else 0)
