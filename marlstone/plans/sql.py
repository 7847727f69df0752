"""Pieces of DuckDB SQL that several oracles share."""

from marlstone.functions.text import STOP_WORDS


def q(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


def tokens(text: str, least: int = 3, words: tuple[str, ...] = STOP_WORDS) -> str:
    stop = ", ".join(f"'{w}'" for w in words)
    plain = "regexp_extract_all(r, '[a-z0-9]+')"
    left = "trim(regexp_replace(r, '[a-z0-9]+', ' ', 'g'))"
    parts = f"CASE WHEN len({plain}) = 0 THEN [r] ELSE list_concat({plain}, CASE WHEN {left} <> '' AND length({left}) <> length(r) THEN [{left}] ELSE [] END) END"
    runs = f"string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+')"
    return f"list_filter(flatten(list_transform({runs}, lambda r: {parts})), lambda t: length(t) >= {least} AND t NOT IN ({stop}))"


BARS = """
bars AS (
    SELECT user_id AS code, CAST(ts AS DATE) AS day, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
           last(value ORDER BY ts, event_id) AS close, count(*) AS volume
    FROM events GROUP BY 1, 2
)"""
