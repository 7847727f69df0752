"""JSON that a model wrote carelessly, mended as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.arrays import let, running

#: Strings (an end may be missing), strings in single quotes, comments, marks, and bare words up to the next mark or line.
_PIECES = r"""(?s)"(?:[^"\\]|\\.)*+(?:"|\\?$)|(?<=[\s{\[,:])'(?:[^'\\\n]|\\.)*+'(?=\s*[,:}\]])|//[^\n]*|/\*.*?(?:\*/|$)|[{}\[\],:]|[^\s{}\[\],:"][^{}\[\],:"\n]*"""
#: A well-formed object of so many levels at a text's beginning, which mending would leave as it is but for spaces; no part is tried twice.
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_LEVELS = 4


def _sound(levels: int) -> str:
    value = _STRING + r"|-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|true|false|null"
    for level in range(levels):
        each = r"(?:,[ \n]*+(?![}}\]])|(?=[}}\]]))"
        object_ = rf"\{{[ \n]*+(?:{_STRING}[ \n]*+:[ \n]*+(?:{value})[ \n]*+{each})*+\}}".replace("}}", "}")
        value = object_ if level == levels - 1 else rf"{value}|{object_}|\[[ \n]*+(?:(?:{value})[ \n]*+{each})*+\]".replace("}}", "}")
    return f"^({value})"


_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
#: Fields in which a service wraps what a model wrote.
WRAPPED = ("$.text", "$.answer", "$.response", "$.generated_text", "$.choices[0].text", "$.choices[0].message.content")


def _controls(inner: Column) -> Column:
    for mark, escaped in (("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
        inner = F.replace(inner, F.lit(mark), F.lit(escaped))
    return F.regexp_replace(inner, r"[\x00-\x1f]", "")


def _piece(piece: Column) -> Column:
    """struct<kind, key, value>: a mark is its own kind, `x` a scalar as a key and as a value, `#` a comment."""
    first = F.substring(piece, 1, 1)
    closed = F.regexp_like(piece, F.lit(r'(?s)^"(?:[^"\\]|\\.)*+"$'))
    double = F.concat(_controls(F.when(closed, piece).otherwise(F.regexp_replace(piece, r'(?s)^("(?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u])*+)\\(?:u[0-9a-fA-F]{0,3})?$', "$1"))), F.when(closed, "").otherwise('"'))
    single = F.regexp_replace(F.regexp_replace(F.regexp_replace(piece, "^'|'$", ""), r"\\'", "'"), r'(?<!\\)"', r'\\"')
    bare = F.trim(F.regexp_replace(piece, r"\s*(?s:/\*.*|//.*)$", ""))
    word = F.when(bare.isin("True", "False"), F.lower(bare)).when(bare == "None", "null").when(bare.isin("true", "false", "null") | bare.rlike(_NUMBER), bare)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(bare, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    kind = F.when(first.isin("{", "}", "[", "]", ",", ":"), first).when(F.startswith(piece, F.lit("//")) | F.startswith(piece, F.lit("/*")), "#").otherwise("x")
    text = F.when(first == '"', double).when((first == "'") & F.endswith(piece, F.lit("'")) & (F.length(piece) > 1), F.concat(F.lit('"'), _controls(single), F.lit('"')))
    return F.struct(kind.alias("kind"), F.coalesce(text, quoted).alias("key"), F.coalesce(text, word, quoted).alias("value"))


def _step(state: Column, item: Column) -> tuple[Column, Column]:
    """One piece: `open` holds the brackets that are open, `at` what comes next (a key k, its colon c, its value v, an item a, nothing more e), `some` whether a comma must lead."""
    kind, open_, at, some = item["kind"], state["open"], state["at"], state["some"]
    live = (at != "e") & (kind != "#")
    opens, scalar, closes = kind.isin("{", "["), kind == "x", kind.isin("}", "]", "$")
    pending = F.when(at == "v", "null").when(at == "c", ":null").otherwise("")
    lead = F.when(at.isin("k", "a") & some, ",").otherwise("")
    opener = F.translate(kind, "}]", "{[")
    depth = F.when(kind == "$", 1).otherwise(F.length(open_) + 1 - F.instr(F.reverse(open_), opener))
    known = closes & ((kind == "$") | F.contains(open_, opener))
    left = F.substr(open_, F.lit(1), F.greatest(depth - 1, F.lit(0)))
    closers = F.translate(F.reverse(F.substr(open_, depth)), "{[", "}]")
    gap = (kind == ",") & at.isin("v", "c")
    key = scalar & (at == "k")
    out = (
        F.when(~live, "").when(opens, F.concat(lead, F.when(at == "k", '"":').when(at == "c", ":").otherwise(""), kind)).when(key, F.concat(lead, item["key"]))
        .when(scalar, F.concat(lead, F.when(at == "c", ":").otherwise(""), item["value"])).when(known, F.concat(pending, closers))
        .when(gap, pending).when((kind == ":") & (at == "c"), ":").otherwise("")
    )
    outer = F.when(left == "", "e").when(F.endswith(left, F.lit("{")), "k").otherwise("a")
    after = F.when(at.isin("c", "v"), "k").otherwise(at)
    then = F.when(~live, at).when(opens, F.when(kind == "{", "k").otherwise("a")).when(key, "c").when(scalar | gap, after).when(known, outer).when((kind == ":") & (at == "c"), "v").otherwise(at)
    stack = F.when(live & opens, F.concat(open_, kind)).when(live & known, left).otherwise(open_)
    more = F.when(~live, some).when(opens, F.lit(False)).when((scalar & ~key) | gap | known, F.lit(True)).otherwise(some)
    return F.struct(stack.alias("open"), then.alias("at"), more.alias("some")), out


def _begun(text: Column) -> Column:
    """A text from where its object begins; empty where it has none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*([{\[].*)$", 1)
    return F.when(fenced != "", fenced).when(F.regexp_like(text, F.lit(r"^\s*\[")), text).otherwise(F.regexp_extract(text, r"(?s)(\{.*)$", 1))


def mended(text: Column) -> Column:
    """The JSON object in a text, well-formed; null where the text has no opening brace.

    It begins after a code fence that a bracket follows, else at the first brace, and ends where that closes; an array is taken where the text begins with one. Comments go, single
    quotes and bare words are quoted, words of Python are put in JSON's; commas are set anew, so that none is missing, double or trailing; keys without a value get null, closing brackets
    that nothing opened go, and what stands open at the end, a string too, is closed. Bare words after the last bracket are what the model said besides. One pass over a text's pieces.
    """
    found = F.nullif(F.regexp_replace(_begun(text), r"(?s)([}\]])[^{}\[\],:\"]*$", "$1"), F.lit(""))
    end = F.array(F.struct(F.lit("$").alias("kind"), F.lit("").alias("key"), F.lit("").alias("value")))
    pieces = F.concat(F.transform(F.regexp_extract_all(found, F.lit(_PIECES), F.lit(0)), _piece), end)
    zero = F.struct(F.lit("").alias("open"), F.lit("v").alias("at"), F.lit(False).alias("some"))
    return F.when(found.isNotNull(), let(pieces, lambda all_: F.array_join(running(all_, zero, _step, "string"), "")))


def unwrapped(text: Column) -> Column:
    """`mended` of a text, or of what a service wrapped in one of its fields where that holds an object itself."""

    def inner(outer: Column) -> Column:
        held = F.filter(F.array(*(F.get_json_object(outer, path) for path in WRAPPED)), lambda x: F.contains(x, F.lit("{")))
        named = F.regexp_like(outer, F.lit('"(?:text|answer|response|generated_text|choices)"'))
        return F.coalesce(mended(F.when(named, F.get(held, F.lit(0)))), outer)

    return let(mended(text), inner)


def read_json(text: Column, schema: str) -> Column:
    """A value of the schema from what a model wrote; null where there is no object, fields that aren't there or of another kind are null.

    What is well-formed is taken as it stands, so that only the rest is mended piece by piece.
    """
    return F.from_json(F.coalesce(F.nullif(F.regexp_extract(_begun(text), _sound(_LEVELS), 1), F.lit("")), mended(text)), schema)
