"""DuckDB phrases for the checks, written apart from the Spark expressions."""

from __future__ import annotations

from evidentia import params as P


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: w <> '')"


def toks(x: str) -> str:
    stop = ", ".join(q(w) for w in P.STOP_WORDS)
    stem = (
        "CASE WHEN length(p) > 4 AND p LIKE '%s' AND p NOT LIKE '%ss' THEN [p, left(p, length(p) - 1)] "
        "WHEN length(p) > 5 AND p LIKE '%ing' THEN [p, left(p, length(p) - 3)] ELSE [p] END"
    )
    return (
        f"flatten(list_transform({words(x)}, lambda w: CASE WHEN regexp_full_match(w, '[a-z]{{2,3}}-[0-9]{{2,3}}') "
        "THEN [w, split_part(w, '-', 1), split_part(w, '-', 2), CAST(CAST(split_part(w, '-', 2) AS INT) AS VARCHAR)] "
        f"ELSE flatten(list_transform(list_filter(string_split(w, '-'), lambda p: length(p) >= 2 AND p NOT IN ({stop})), lambda p: {stem})) END))"
    )


def fnv(x: str) -> str:
    return (
        f"list_reduce(list_transform(string_split({x}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), "
        f"lambda h, c: (xor(h, c) * {P.FNV_PRIME}) & 4294967295, CAST({P.FNV_OFFSET} AS BIGINT))"
    )


def any_contains(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def case_map(x: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def excerpt(x: str, n: int) -> str:
    flat = (
        rf"trim(regexp_replace(array_to_string(list_filter(string_split_regex({x}, '\r?\n'), "
        r"lambda ln: NOT regexp_matches(ltrim(ln), '^[#\[]')), ' '), '\s+', ' ', 'g'))"
    )
    return f"CASE WHEN length({flat}) > {n} THEN left({flat}, {n}) || '…' ELSE {flat} END"
