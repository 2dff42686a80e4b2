"""Scalar building blocks as column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(*columns: Column | str) -> Column:
    """First column that is not null or blank, as text; empty if there is none."""
    return F.coalesce(*(F.when(F.trim(col(c).cast("string")) != "", col(c).cast("string")) for c in columns), F.lit(""))


def required_pieces(pattern: str) -> list[str]:
    """Lower-cased literals that every match of ``pattern`` holds, longest first; none if that can't be told from its top level."""
    pieces, run, i, depth = set(), "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        step = 2 if c == "\\" else 1
        if c == "[":  # a class, up to its bracket
            step = pattern.index("]", i + 2 + (pattern[i + 1] == "^")) + 1 - i
        literal = c == "\\" and not pattern[i + 1].isalnum() or c not in "\\[](){}|.^$*+?"
        if c == "|" and not depth:
            return []
        if depth or not literal:
            if c in "*?{" and not depth:
                run = run[:-1]  # the character before may be missing
            pieces.add(run)
            run = ""
            if c == "{" and not depth:
                step = pattern.index("}", i) + 1 - i
            depth += (c == "(") - (c == ")")
        else:
            run += pattern[i + step - 1]
        i += step
    return sorted({p.lower() for p in pieces | {run}} - {""}, key=lambda p: (-len(p), p))


def pattern_count(text: Column | str, patterns: list[str], low: Column | str | None = None) -> Column:
    """How often any of the patterns matches, without regard to case; null text counts as empty.

    A pattern is only run on texts that hold its literal pieces, which most texts don't. ``low``: a column with the
    lower-cased text, if there is one.
    """
    x = F.coalesce(col(text), F.lit(""))
    low = F.lower(x) if low is None else F.coalesce(col(low), F.lit(""))
    return reduce(lambda a, b: a + b, (_guarded(low, p, F.regexp_count(x, F.lit(f"(?i){p}")), F.lit(0)) for p in patterns))


def _guarded(low: Column, pattern: str, found: Column, none: Column) -> Column:
    held = [F.contains(low, F.lit(p)) for p in required_pieces(pattern)]
    return F.when(reduce(lambda a, b: a & b, held), found).otherwise(none) if held else found


def contains_any(text: Column | str, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col(text), F.lit(w)) for w in words))


def flag(condition: Column) -> Column:
    """1 if true, 0 if false or null."""
    return F.when(condition, 1).otherwise(0)


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def when_chain(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """First value whose condition holds; add ``otherwise`` as needed."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def case_map(value: Column | str, pairs: dict[str, str], otherwise: str | None = None) -> Column:
    out = when_chain((col(value) == k, F.lit(v)) for k, v in pairs.items())
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def glob_regex(glob: Column | str) -> Column:
    """Regular expression of a glob (`*`, `?`, `[..]`, `[!..]`), made once per row of the small glob table."""
    quoted = F.regexp_replace(col(glob), r"([.^$+(){}|\\])", r"\\$1")
    quoted = F.regexp_replace(quoted, r"\[!", "[^")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def text_cut(text: Column | str, n: int) -> Column:
    return F.substring(col(text), 1, n)


def head_tail(text: Column | str, limit: int = 800, head: int = 200, tail: int = 400) -> Column:
    """The text, or its head and tail around an ellipsis if it is longer than ``limit``."""
    t = col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, head), F.lit("..."), F.right(t, F.lit(tail)))).otherwise(t)


def fill_template(template: Column | str, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by values; names that are not given stay."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), col(template))


def token_estimate(text: Column | str) -> Column:
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4)


def json_part(text: Column | str) -> Column:
    """What stands from the first ``{`` to the last ``}`` of a reply, code fences removed."""
    bare = F.regexp_replace(col(text), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def features_text(names: list[str]) -> Column:
    """``k: v. k: v`` over columns, empty ones left out."""
    each = [F.when(F.trim(F.col(n).cast("string")) != "", F.concat(F.lit(f"{n}: "), F.col(n).cast("string"))) for n in names]
    return F.concat_ws(". ", *each)


def query_text(method: str = "method", path: str = "path", agent: str = "user_agent") -> Column:
    """The request as a retrieval query."""
    parts = [("HTTP Method: ", F.col(method)), ("Endpoint: ", F.col(path)), ("User Agent: ", F.substring(F.col(agent), 1, 80))]
    return F.concat_ws(" | ", *(F.when(c != "", F.concat(F.lit(label), c)) for label, c in parts))
