"""Message chunks against a plain program of the same rule, and the reference cases of short and long messages."""

import random

import pytest

from pyspark.sql import functions as F

from marlstone.operators import messages as M


def plain(text, budget, words, special=2, mark=0):
    """The rule as a recursion over a text."""
    size = (lambda s: len(s) + (special - 1) * sum(ord(c) > 0xFFFF for c in s)) if words else (lambda s: len(s.encode()))
    suffix = len(M.SUFFIX) if words else len(M.SUFFIX.encode())

    def force(s, most):
        room, end = (most - suffix, M.SUFFIX) if most > suffix else (max(1, most), "")
        out = []
        while True:
            k, used = 0, 0
            while k < len(s) and (k == 0 or (used + size(s[k]) <= room if words else used + size(s[k]) < room or (used + size(s[k]) == room and size(s[k]) == 1))):
                used += size(s[k])
                k += 1
            piece, s = s[:k], s[k:]
            if not s.strip():
                return [*out, piece]
            out.append(piece + end)

    def cut(s, most):
        if size(s) <= most:
            return [s]
        for needle, opens, between in M.SEPARATORS:
            if needle in s:
                break
        else:
            return force(s, most)
        first, *rest = s.split(needle)
        parts, left = [first, *(opens + r for r in rest)], most - len(between)
        limit = most if words else left
        out, now = [], None
        for k, part in enumerate(parts):
            tail = "" if k == len(parts) - 1 else between
            if size(part) + len(between) > limit:
                got = cut(part, left)
                out, now = [*out, *got[:-1], got[-1] + tail], None
            elif now is not None and now + size(part) + len(between) <= limit:
                out[-1] += part + tail
                now += size(part) + len(between)
            else:
                out.append(part + tail)
                now = size(part) + len(between)
        return out

    got = [c for c in cut(text or "", budget - mark) if c] or [""]
    return [c + M.MARK.format(k + 1, len(got)) for k, c in enumerate(got)] if mark else got


def random_message(rng):
    bits = ["\n---\n", "\n# ", "\n## ", "\n### ", "\n**", "\n", " ", "word", "longer words stand here", "x" * 90, "é", "价格上涨了很多", "🎯", "🎯🎯 emoji", "   ", ""]
    return "".join(rng.choices(bits, k=rng.randrange(0, 40)))


def test_chunks_are_those_of_a_plain_program(spark):
    rng = random.Random(3)
    texts = [random_message(rng) for _ in range(120)] + ["", None, "x" * 5000, "价" * 3000, "a\n---\n", "\n---\n\n---\n", "y" * 60 + " " * 200, "\n".join(["line"] * 2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    t = F.col("text")
    found = rows.select("id", M.chunks_by_bytes(t, 40).alias("b40"), M.chunks_by_bytes(t, 150).alias("b150"), M.chunks_by_bytes(t, 120, marked=True).alias("m120"), M.chunks_by_words(t, 10).alias("w10"), M.chunks_by_words(t, 60, 3).alias("w60"), M.chunks_by_words(t, 80, marked=True).alias("m80")).collect()
    for r in found:
        text = texts[r.id]
        assert r.b40 == plain(text, 40, False) and r.b150 == plain(text, 150, False) and r.m120 == plain(text, 120, False, mark=16), text
        assert r.w10 == plain(text, 10, True) and r.w60 == plain(text, 60, True, 3) and r.m80 == plain(text, 80, True, mark=13), text
        assert all(len(c.encode()) <= 150 for c in r.b150) and all(len(c.encode()) <= 120 for c in r.m120)
        assert "".join(c.replace(M.SUFFIX, "") for c in r.b150).rstrip() == (text or "").rstrip()


def chunked(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_reference_cases(spark):
    words = lambda s, n, **more: chunked(spark, M.chunks_by_words(F.lit(s), n, **more))
    assert words("", 100) == [""] and words("Short message without separators.", 100) == ["Short message without separators."]
    assert words("Part A\n---\nPart B", 500) == ["Part A\n---\nPart B"]
    long = "A" * 50 + "\n---\n" + "B" * 50
    assert len(words(long, 60)) == 2 and "".join(words(long, 60)) == long
    assert M.SUFFIX in words("X" * 200, 50)[0]
    parts = words("A" * 80 + "\n---\n" + "B" * 80, 40)
    assert "".join(p.replace(M.SUFFIX, "") for p in parts) == "A" * 80 + "\n---\n" + "B" * 80 and all(len(p) <= 40 for p in parts)
    assert len(words("A" * 79 + "🎯", 80)) == 2 and "".join(p.replace(M.SUFFIX, "") for p in words("🎯ab", 10)) == "🎯ab"
    made = chunked(spark, M.chunks_by_bytes(F.lit("中文" * 100), 100, marked=True))
    assert all(c.endswith(f"📄 {k + 1}/{len(made)}") and len(c.encode()) <= 100 for k, c in enumerate(made))
    with pytest.raises(ValueError, match="10"):
        M.chunks_by_words(F.lit(""), 2)
    with pytest.raises(ValueError, match="40"):
        M.chunks_by_bytes(F.lit(""), 50, marked=True)
