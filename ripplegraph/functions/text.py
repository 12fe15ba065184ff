"""Column functions on SQL and report text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_comments(sql: Column) -> Column:
    """SQL without comments, white space collapsed; for display, not for comparison."""
    plain = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


@dataclass(frozen=True)
class Dialect:
    """What a SQL dialect reads as one token."""

    backslash: bool = False  # a backslash in a literal takes the next sign along
    dollar: bool = False  # $$ literals, with or without a tag
    hash: bool = False  # comments from # to the end of the line
    triple: bool = False  # literals in three quotes
    nested: bool = False  # block comments inside block comments


#: Dialects by name.
DIALECTS = {
    "ansi": Dialect(),
    "bigquery": Dialect(backslash=True, hash=True, triple=True),
    "clickhouse": Dialect(backslash=True, dollar=True, nested=True),
    "databricks": Dialect(backslash=True),
    "duckdb": Dialect(dollar=True, nested=True),
    "hive": Dialect(backslash=True),
    "mysql": Dialect(backslash=True, hash=True),
    "postgres": Dialect(dollar=True, nested=True),
    "redshift": Dialect(backslash=True, dollar=True, nested=True),
    "snowflake": Dialect(backslash=True, dollar=True),
    "spark": Dialect(backslash=True),
    "sqlite": Dialect(),
    "trino": Dialect(),
    "tsql": Dialect(nested=True),
}
#: Where the dialect isn't known, what holds has to hold under each of these.
READINGS = (Dialect(), Dialect(backslash=True), Dialect(dollar=True), Dialect(backslash=True, dollar=True), Dialect(hash=True), Dialect(backslash=True, hash=True, triple=True))


def readings(dialect: str | None) -> tuple[Dialect, ...]:
    """The ways to read a text: one for a dialect that is known by name."""
    if dialect is None:
        return READINGS
    if dialect.lower() not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; one of {', '.join(DIALECTS)}, or None to ask for every reading")
    return (DIALECTS[dialect.lower()],)


@cache
def token_pattern(d: Dialect) -> str:
    """A pattern whose matches, one after the other, are the tokens of a text; the same for Java and for Python's regex.

    Repetitions are possessive, so a literal of any length is read in one pass without a stack.
    """
    quoted = lambda q: rf"{q}[^{q}\\]*+(?:(?:{q}{q}|\\[\s\S])[^{q}\\]*+)*+{q}" if d.backslash else rf"{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}"
    parts = []
    if d.triple:
        parts += ['"""[\\s\\S]*?"""', "'''[\\s\\S]*?'''"]
    if d.dollar:
        parts += [r"\$\$[\s\S]*?\$\$", r"\$([A-Za-z_]\w*+)\$[\s\S]*?\$\1\$", r"[eE]'[^'\\]*+(?:(?:''|\\[\s\S])[^'\\]*+)*+'"]
    parts += [quoted("'"), quoted('"'), r"`[^`]*+`", r"/\*(?:[^*]++|\*(?!/))*+\*/", r"--[^\n]*+"]
    if d.hash:
        parts.append(r"#[^\n]*+")
    parts += [r"(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?+\d++)?(?![\p{L}\p{M}\p{N}_])", r"[\p{L}\p{M}\p{N}_$@]++"]
    return "|".join([*parts, r"<=>|->>|<>|<=|>=|!=|\|\||::|->|=>|:=|\*\*", r"\S"])


def _tokens(sql: Column, d: Dialect) -> Column:
    return F.regexp_extract_all(sql, F.lit(token_pattern(d)), F.lit(0))


def _comment(t: Column, d: Dialect) -> Column:
    lone = t.startswith("--") | (t.startswith("/*") & (F.length(t) > 3))
    return lone | (t.startswith("#") & (F.length(t) > 1)) if d.hash else lone


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _code(tokens: Column, d: Dialect) -> Column:
    code = F.filter(tokens, lambda t: ~_comment(t, d))
    if d.hash:
        code = F.filter(code, lambda t: t != "#")  # an empty comment
    return F.transform(code, lambda t: F.when(t.rlike(r"^[\p{L}\p{N}_@.][^'\"`]*$"), F.lower(t)).otherwise(t))


def signature(sql: Column, dialect: Dialect = READINGS[0]) -> Column:
    """The tokens of a text, without comments and white space between tokens, names and keywords in lower case.

    What stands in a literal or a quoted name counts as it is, and a line comment ends where its line does.
    """
    return _code(_tokens(sql, dialect), dialect)


def _open(tokens: Column, d: Dialect) -> Column:
    """Whether a quote, a dollar or a block comment has no end, or comments nest where dialects differ."""
    stray = F.exists(tokens, lambda t: t.isin("'", '"', "`") | (t.contains("$$") & ~t.endswith("$$")))
    begun = F.array_join(F.filter(tokens, lambda t: ~_comment(t, d) & ~t.rlike("^['\"`$]")), "").contains("/*")
    return stray | begun | F.exists(tokens, lambda t: _comment(t, d) & t.startswith("/*") & F.substring(t, 3, 1 << 30).contains("/*"))


def _read(sql: Column, d: Dialect) -> Column:
    """struct<open, code> of a text, whose tokens are found once."""
    return let(_tokens(sql, d), lambda t: F.struct(_open(t, d).alias("open"), _code(t, d).alias("code")))


#: Where readings part: escapes, dollars, hashes, triple quotes, and an E before a literal.  A text without them is read alike by all.
_MARKS = r"""[\\$#]|'''|\"\"\"|(?<![\p{L}\p{M}\p{N}_@])[eE]'"""


def _each(texts: list[Column], dialect: str | None, f: Callable[[Dialect], Column]) -> Column:
    """array of ``f`` for each reading that can differ on these texts: the first alone if none has a mark."""
    known = readings(dialect)
    every = F.array(*map(f, known))
    if len(known) == 1:
        return every
    marked = reduce(lambda a, b: a | b, [x.rlike(_MARKS) for x in texts])
    return F.when(~marked, F.array(f(known[0]))).otherwise(every)


#: An expression can neither begin nor end with these.
_JOINING = ("+", "/", "%", "=", "<", ">", "<=", ">=", "<>", "!=", "||", "::", ".", ",", "and", "or", "like", "in", "when", "then", "else", "between")


def _broken(tokens: Column) -> Column:
    count = lambda sign: F.size(tokens) - F.size(F.array_remove(tokens, sign))
    ends = F.when(F.size(tokens) > 0, F.element_at(tokens, -1).isin(*_JOINING, "-", "*", "not", "case", "as", "(") & ~((F.size(tokens) > 1) & F.element_at(tokens, -1).isin("*") & F.try_element_at(tokens, F.lit(-2)).isin(".", ",", "select"))).otherwise(False)
    starts = F.when(F.size(tokens) > 0, F.element_at(tokens, 1).isin(*(x for x in _JOINING if x not in ("+", ".")), ")", "as")).otherwise(False)
    return (count("(") != count(")")) | (count("[") != count("]")) | (ends & (F.size(tokens) > 1)) | starts


def unreadable(sql: Column, dialect: str | None = "ansi") -> Column:
    """Whether no reading of a text can be trusted: a quote, comment or bracket without its partner, or an operator without an operand."""
    poor = lambda x, d: let(_read(x, d), lambda r: r["open"] | let(r["code"], _broken))
    return let(sql, lambda x: F.exists(_each([x], dialect, lambda d: poor(x, d)), lambda found: found))


def _pairs(base: Column, head: Column, dialect: str | None, *more: Callable[[Column, Column], Column]) -> Column:
    """array<struct<equal, m0, ...>> by reading: whether two texts are the same code (null if one is open), and what ``more`` says of what was read."""

    def read(d: Dialect) -> Column:
        both = F.struct(_read(base, d).alias("b"), _read(head, d).alias("h"))
        equal = lambda p: F.when(~p["b"]["open"] & ~p["h"]["open"], p["b"]["code"] == p["h"]["code"])
        return let(both, lambda p: F.struct(equal(p).alias("equal"), *(m(p["b"], p["h"]).alias(f"m{i}") for i, m in enumerate(more))))

    return _each([base, head], dialect, read)


def _same(pairs: Column) -> Column:
    every, none = F.forall(pairs, lambda p: F.coalesce(p["equal"], F.lit(False))), F.forall(pairs, lambda p: F.coalesce(~p["equal"], F.lit(False)))
    return F.when(every, True).when(none, False)


def same_code(base: Column, head: Column, dialect: str | None = None) -> Column:
    """Whether nothing but layout, comments and the case of names differs: true, false, or null where that can't be told.

    Equal texts are the same.  Others are the same, or differ, only if every possible reading says so and finds the ends of all
    literals and comments.
    """
    return let(F.struct(base.alias("b"), head.alias("h")), lambda x: F.when(x["b"] == x["h"], True).otherwise(let(_pairs(x["b"], x["h"], dialect), _same)))


def compared(base: Column, head: Column, dialect: str | None = None) -> Column:
    """``same_code``, but null also for different texts of which one is empty, or unreadable in some reading."""
    poor = lambda r: r["open"] | let(r["code"], _broken)
    bare = lambda b, h: (F.size(b["code"]) == 0) | (F.size(h["code"]) == 0)
    # empty is what the first reading finds empty
    empty = lambda p, x: p[0]["m1"] if dialect is None else (F.size(signature(x["b"])) == 0) | (F.size(signature(x["h"])) == 0)
    told = lambda p, x: let(_same(p), lambda same: F.when(same | ~(empty(p, x) | F.exists(p, lambda r: r["m0"])), same))
    pairs = lambda x: _pairs(x["b"], x["h"], dialect, lambda b, h: poor(b) | poor(h), bare)
    return let(F.struct(base.alias("b"), head.alias("h")), lambda x: F.when(x["b"] == x["h"], True).otherwise(let(pairs(x), lambda p: told(p, x))))


PRAGMA = "line int, verb string, column string, scope string, reason string, problem string"
_VERBS = ("change", "break")


@cache
def _python(d: Dialect):
    return regex.compile(token_pattern(d) + r"|\n")


@cache
def _directive(marker: str):
    return regex.compile(rf"^(?:--|/\*|#)[\s*]*{regex.escape(marker)}:allow(?:-(?P<verb>\w+)|\((?P<call>\w+)\))(?P<args>.*)", regex.IGNORECASE | regex.DOTALL)


def scan(sql: str, dialect: str | None, marker: str) -> list[dict]:
    """The override directives in the comments of one text; see ``pragmas``."""
    code, found, line = [], [], 1
    for m in _python(readings(dialect)[0]).finditer(sql):
        t = m[0]
        if t.startswith(("--", "/*")) and len(t) > 1 or t.startswith("#") and readings(dialect)[0].hash:
            if d := _directive(marker).match(t):
                found.append((line, len(code), d))
        elif t != "\n":
            code.append(t)
        line += t.count("\n")
    low = [t.lower() for t in code]
    first = low.index("select") if "select" in low else None
    out = []
    for line, at, d in found:
        verb, args = (d["verb"] or d["call"]).lower(), d["args"]
        reason = regex.search(r"""\breason\s*=\s*(?:"([^"]*)"|'([^']*)')""", args)
        why = (reason[1] or reason[2] or "").strip() if reason else ""
        rest = args[: reason.start()] + " " + args[reason.end() :] if reason else args
        named = regex.search(r"""\bcolumn\s*=\s*["`]?(\w+)""", rest)
        problem = "unknown verb" if verb not in _VERBS else None if why else "no reason"
        whole = not named and first is not None and at <= first
        column = named[1].lower() if named else None if whole else _projected(code[at:])
        out.append({"line": line, "verb": verb, "column": column, "scope": "model" if whole else "column", "reason": why or None, "problem": problem})
    return out


def _projected(code: list[str]) -> str | None:
    """The name of the output column that begins at a token: the last name before its comma; None if it ends with no name."""
    depth, last = 0, None
    for t in code:
        depth += (t == "(") - (t == ")")
        if depth < 0 or depth == 0 and (t in (",", ";") or t.lower() in ("from", "where", "union")):
            break
        last = t
    if last and last[0] in "\"`" and len(last) > 2:
        return last[1:-1].lower()
    return last.lower() if last and regex.fullmatch(r"[\p{L}_][\p{L}\p{M}\p{N}_$]*", last) and last.lower() not in ("end", "select") else None


def pragmas(sql: Column, dialect: str | None = None, marker: str = "ripple") -> Column:
    """array<struct<line, verb, column, scope, reason, problem>>: override directives in a text's comments.

    A directive is ``<marker>:allow-change`` or ``<marker>:allow(change)`` (or break), then reason="..." and column=... in any
    order and case.  Without a column it is for the whole model if it stands before the first SELECT, else for
    the output column that follows, null if that has no name.  With a ``problem`` (unknown verb, no reason) it allows nothing.
    What stands in a literal is no directive.  Texts without the marker aren't handed to Python's worker at all.
    """

    @F.pandas_udf(f"array<struct<{PRAGMA.replace(' ', ':').replace(',:', ',')}>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else scan(t, dialect, marker))

    return F.coalesce(found(F.when(F.lower(sql).contains(f"{marker.lower()}:allow"), sql)), F.array())


def interpolate(template: str, tokens: dict[str, Column]) -> Column:
    """A template with each ``{name}`` of ``tokens`` replaced; other braces stay as they are."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), tokens.items(), F.lit(template))


def relation_key(name: Column) -> Column:
    """A relation's name without quotes and in lower case."""
    return F.lower(F.regexp_replace(F.trim(name), r'["`\[\]]', ""))
