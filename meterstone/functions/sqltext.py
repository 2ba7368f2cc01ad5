"""References in SQL text: a tokenizer and a small automaton, both of native expressions. No grammar is parsed.

One regular expression cuts a statement into tokens from left to right, so quotes inside comments and comment marks inside
quotes mean nothing. Comments are dropped and literals blanked. A fold over the tokens then keeps one character per open
parenthesis: whether it belongs to a function, and whether a list of tables goes on in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r'(?:"[^"]*+(?:""[^"]*+)*+"|`[^`]*+`|[\p{L}_][\p{L}\p{N}_$]*+)'
_TOKEN = "|".join(
    [
        r"[eE]'[^'\\]*+(?:(?:\\[\s\S]|'')[^'\\]*+)*+'",
        r"'[^']*+(?:''[^']*+)*+'",
        r"\$\$[\s\S]*?\$\$",
        r"--[^\r\n]*+",
        r"/\*[\s\S]*?\*/",
        rf"{_PART}(?:\s*+\.\s*+{_PART})*+",
        r"[0-9][\p{L}\p{N}_.]*+",
        r"\S",
    ]
)

#: Words that begin a readable statement.
_STATEMENTS = ("select", "with", "from", "insert", "update", "delete", "merge", "create", "explain", "table", "values", "(")
#: Words after which a parenthesis is no function's.
_PLAIN = (
    "as", "in", "exists", "any", "all", "some", "on", "and", "or", "not", "where", "select", "distinct", "from", "join", "using", "over", "by", "when",
    "then", "else", "case", "values", "filter", "having", "union", "except", "intersect", "group", "within", "lateral", "with", "recursive", "materialized",
    "between", "like", "ilike", "is", "set", "returning", "qualify", "limit", "offset", "into", "table", "only", "end",
)
#: Words that end a list of tables.
_CLOSING = (
    "where", "group", "having", "order", "limit", "offset", "fetch", "qualify", "window", "union", "except", "intersect", "returning", "set", "values", "sample",
)
#: Further words that are no columns.
_OTHER = ("left", "right", "full", "inner", "outer", "cross", "natural", "asof", "asc", "desc", "nulls", "first", "last", "partition", "rows", "range", "true", "false", "null")
_WORDS = tuple(dict.fromkeys((*_PLAIN, *_CLOSING, *_OTHER, *_STATEMENTS[:-1])))


def tokens(sql: Column) -> Column:
    """Tokens in lower case without comments; each literal is an empty one."""
    found = F.regexp_extract_all(sql, F.lit(f"({_TOKEN})"), F.lit(1))
    kept = F.filter(found, lambda t: ~t.rlike(r"^(--|/\*[\s\S])"))
    return F.transform(kept, lambda t: F.when(t.rlike(r"^([eE]?'[\s\S]*'|\$\$[\s\S]*)$"), "''").otherwise(F.lower(t)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _among(t: Column, words: tuple[str, ...]) -> Column:
    return t.isin(*words)


def _named(token: Column) -> Column:
    return token.rlike(r'^[\p{L}_"`]') & ~_among(token, _WORDS)


def _plain_name(token: Column) -> Column:
    """Without quotes and spaces around the dots, at most schema and table."""
    parts = F.regexp_extract_all(token, F.lit(f"({_PART})"), F.lit(1))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r'^["`]|["`]$', ""))
    return F.array_join(F.slice(bare, F.greatest(F.size(bare) - 1, F.lit(1)), 2), ".")


# What the next token may be: anything, a table, or a name that WITH defines.
_ANY, _TABLE, _WITH = "", "t", "w"
# A parenthesis is open, a function's, a list of tables goes on in it, or a list of WITH does.
_OPEN, _CALL, _LIST, _DEFS = "o", "f", "l", "d"
#: More were closed than opened.
_BROKEN = "!"
_STATE = "struct<levels:string,wanted:string,tables:array<string>,defined:array<string>,columns:array<string>>"


def _facts(ts: Column, t: Column, i: Column) -> Column:
    """A token with all that the fold asks of it and its neighbours, found once."""
    before, after = F.coalesce(F.get(ts, i - 1), F.lit("")), F.coalesce(F.get(ts, i + 1), F.lit(""))
    follows = _named(before)
    starts = (t == "join") | (t == "into") | (t == "table") | ((t == "using") & (after != "(")) | ((t == "update") & (before == ""))
    return F.struct(
        t.alias("t"),
        _named(t).alias("name"),
        follows.alias("follows"),
        # An alias without AS stands behind a name, a closing parenthesis, a literal or a number.
        (follows | before.rlike("""[)'"`0-9]$""") | _among(before, ("end", "as"))).alias("alias"),
        (after == "(").alias("called"),
        _among(before, ("into", "table")).alias("target"),
        ((t == "from") & (before != "distinct")).alias("begins"),
        starts.alias("starts"),
        ((t == "with") & ~_among(after, ("ordinality", "time", "ties", "no", "local"))).alias("defines"),
        _among(t, ("select", *_CLOSING)).alias("ends"),
        _among(t, ("lateral", "only")).alias("skipped"),
    )


def _step(s: Column, x: Column) -> Column:
    t, wanted = x["t"], s["wanted"]
    level, outer = F.right(s["levels"], F.lit(1)), F.left(s["levels"], F.length(s["levels"]) - 1)
    at = lambda kind: F.concat(outer, F.lit(kind))
    opened = F.when(wanted == _TABLE, _LIST).when(x["follows"] & (level != _DEFS), _CALL).otherwise(_OPEN)
    tables_follow = (x["begins"] | x["starts"]) & (level != _CALL) | (t == ",") & (level == _LIST)
    levels = (
        F.when(s["levels"] == _BROKEN, _BROKEN)
        .when(t == "(", F.concat(s["levels"], opened))
        .when(t == ")", F.when(outer != "", outer).otherwise(_BROKEN))
        .when(tables_follow, at(_LIST))
        .when(x["defines"], at(_DEFS))
        .when(x["ends"], at(_OPEN))
        .otherwise(s["levels"])
    )
    next_wanted = (
        F.when((x["skipped"] | (t == "(")) & (wanted == _TABLE), _TABLE)
        .when(tables_follow, _TABLE)
        .when(x["defines"] | (t == "recursive") | (t == ",") & (level == _DEFS), _WITH)
        .otherwise(_ANY)
    )
    is_table = x["name"] & (wanted == _TABLE) & (~x["called"] | x["target"])
    is_defined = x["name"] & (wanted == _WITH)
    is_column = x["name"] & (wanted == _ANY) & (level != _DEFS) & ~x["called"] & ~x["alias"]
    grown = lambda list_, holds: F.when(holds, F.array_append(list_, t)).otherwise(list_)
    return F.struct(
        levels.alias("levels"), next_wanted.alias("wanted"), grown(s["tables"], is_table).alias("tables"),
        grown(s["defined"], is_defined).alias("defined"), grown(s["columns"], is_column).alias("columns"),
    ).cast(_STATE)


def references(sql: Column) -> Column:
    """struct(readable, tables, columns) of a statement.

    ``tables`` stand where a statement reads or writes a table, by schema and name as far as given, without names that the
    statement itself defines; ``columns`` by their own name. A text that begins like no statement, or whose parentheses or
    quotes don't close, is not readable.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(_OPEN).alias("levels"), F.lit(_ANY).alias("wanted"), none.alias("tables"), none.alias("defined"), none.alias("columns")).cast(_STATE)

    def finish(s: Column) -> Column:
        defined = F.transform(s["defined"], _plain_name)
        tables = F.array_except(F.transform(s["tables"], _plain_name), defined)
        columns = F.array_distinct(F.transform(s["columns"], lambda c: F.substring_index(_plain_name(c), ".", -1)))
        closed = (F.length(s["levels"]) == 1) & (s["levels"] != _BROKEN)
        return F.struct(closed.alias("closed"), tables.alias("tables"), columns.alias("columns"))

    def read(ts: Column) -> Column:
        folded = F.aggregate(F.transform(ts, lambda t, i: _facts(ts, t, i)), start, _step, finish)
        begins = F.coalesce(_among(F.get(ts, F.lit(0)), _STATEMENTS), F.lit(False))
        # What is left of quotes and comments that don't close.
        torn = F.exists(ts, lambda t: _among(t, ("'", '"', "`"))) | F.contains(F.array_join(ts, " "), F.lit("/ *"))
        return bound(folded, lambda f: F.struct((begins & f["closed"] & ~torn).alias("readable"), f["tables"].alias("tables"), f["columns"].alias("columns")))

    return bound(tokens(sql), read)
