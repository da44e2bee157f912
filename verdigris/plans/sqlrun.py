"""Files of SQL statements, split where a semicolon really ends one, with named parameters."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.versioned import registered

#: What versioned tables add to SQL: a version of a registered table, its changes, its history.
_NAME = r"([\w`]+(?:\.[\w`]+)*)"
_AFTER = "where group having order sort cluster distribute limit offset window lateral join inner left right full cross natural semi anti on using union except minus intersect pivot unpivot tablesample".split()
#: A name of the statement's own after a table: with AS, or a word that can't begin anything else.
_ALIAS = rf"(?P<alias>\s+as\b|\s+(?!(?:{'|'.join(_AFTER)})\b)[\w`]+)?"
_VERSION = re.compile(rf"{_NAME}\s+(?:FOR\s+)?VERSION\s+AS\s+OF\s+(\d+){_ALIAS}", re.IGNORECASE)
_CHANGES = re.compile(rf"\btable_changes\(\s*'([^']+)'\s*,\s*(\d+)\s*(?:,\s*(\d+)\s*)?\){_ALIAS}", re.IGNORECASE)
_HISTORY = re.compile(rf"DESCRIBE\s+HISTORY\s+{_NAME}(?:\s+LIMIT\s+(\d+))?", re.IGNORECASE)

#: What hides a semicolon: quoted text with doubled or escaped quotes, quoted names, comments.
_TOKEN = re.compile(
    r"""(?P<text>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<end>;)|(?P<plain>[^;'"`/-]+|.)""",
    re.DOTALL,
)


def statements(text: str) -> Iterator[str]:
    """The statements without their comments; quoted text stays as it is."""
    parts: list[str] = []
    for token in _TOKEN.finditer(text):
        if token.lastgroup == "end":
            if statement := "".join(parts).strip():
                yield statement
            parts = []
        else:
            parts.append(" " if token.lastgroup == "comment" else token[0])
    if statement := "".join(parts).strip():
        yield statement


def run_statement(spark: SparkSession, statement: str, args: dict | None = None) -> DataFrame:
    """One statement. `DESCRIBE HISTORY t`, `t VERSION AS OF n` and `table_changes('t', first, last)` speak of views that
    a versioned table has registered; inside a statement they are looked for outside of quoted text only. Where the statement gives
    them no other name, they have the table's: `s.t VERSION AS OF 0 WHERE t.id > 0`."""
    if told := _HISTORY.fullmatch(statement):
        found = registered(spark, told[1]).history()
        return found.limit(int(told[2])) if told[2] else found

    def named(df: DataFrame, m: re.Match) -> str:
        view = f"_verdigris_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        return f"{view}{m['alias']}" if m["alias"] else f"{view} AS {m[1].split('.')[-1]}"

    def changes(m: re.Match) -> str:
        return named(registered(spark, m[1]).changes(int(m[2]), int(m[3]) if m[3] else None), m)

    def version(m: re.Match) -> str:
        return named(registered(spark, m[1]).as_of(int(m[2])), m)

    quoted = [m.span() for m in _TOKEN.finditer(statement) if m.lastgroup == "text" and m[0][0] != "`"]
    plain = lambda m: not any(a <= m.start() < b for a, b in quoted)
    for pattern, make in ((_CHANGES, changes), (_VERSION, version)):
        if pattern is _VERSION:
            quoted = [m.span() for m in _TOKEN.finditer(statement) if m.lastgroup == "text" and m[0][0] != "`"]
        statement = pattern.sub(lambda m, make=make: make(m) if plain(m) else m[0], statement)
    return spark.sql(statement, args=args) if args else spark.sql(statement)


def run_sql(spark: SparkSession, text: str, args: dict | None = None, verbose: bool = False) -> DataFrame | None:
    """Run all statements; the last one's result, None if there is none. `:name` in a statement takes its
    value from args."""
    result = None
    for statement in statements(text):
        used = {k: v for k, v in (args or {}).items() if re.search(rf":{re.escape(k)}\b", statement)}
        result = run_statement(spark, statement, used)
        if verbose:
            result.show(truncate=False)
    return result


def run_sql_file(spark: SparkSession, path: str, args: dict | None = None, verbose: bool = False) -> DataFrame | None:
    rows = spark.read.text(path, wholetext=True).collect()
    return run_sql(spark, "\n".join(r[0] for r in rows), args, verbose)
