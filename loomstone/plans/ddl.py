"""CREATE TABLE statements: names, engine clauses, and the table specification they stand for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

#: The engine family that is understood, and the prefix of its replicated forms.
FAMILY, REPLICATED = "MergeTree", "Replicated"

_QUOTES = "'\"`"
_TYPES = {
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "bool": T.BooleanType(),
}


def _skip_quoted(text: str, at: int) -> int:
    """The place after the quoted run that begins at `at`; doubled quotes and backslashes are part of it."""
    quote = text[at]
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
            continue
        if text[at] == quote:
            if text[at + 1 : at + 2] == quote:
                at += 2
                continue
            return at + 1
        at += 1
    raise ValueError("a quote isn't closed")


def _plain(text: str):
    """Places outside quotes and comments."""
    at = 0
    while at < len(text):
        if text[at] in _QUOTES:
            at = _skip_quoted(text, at)
        elif text.startswith("--", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at)
            at = len(text) if end < 0 else end + 2
        else:
            yield at
            at += 1


def find_keyword(text: str, word: str, start: int = 0) -> int:
    """Where a keyword stands outside quotes, comments and parentheses, as a whole word; -1 if nowhere."""
    depth = 0
    for at in _plain(text):
        depth += (text[at] == "(") - (text[at] == ")")
        if at >= start and not depth and text[at : at + len(word)].lower() == word.lower():
            before, after = text[at - 1 : at], text[at + len(word) : at + len(word) + 1]
            if not re.match(r"\w", before or " ") and not re.match(r"\w", after or " "):
                return at
    return -1


def split_arguments(text: str) -> list[str]:
    """Arguments between commas that stand in no quote and no parentheses, trimmed."""
    depth, cuts = 0, [-1]
    for at in _plain(text):
        if text[at] in "([{":
            depth += 1
        elif text[at] in ")]}":
            depth -= 1
            if depth < 0:
                raise ValueError("a parenthesis is closed that wasn't opened")
        elif text[at] == "," and not depth:
            cuts.append(at)
    if depth:
        raise ValueError("a parenthesis isn't closed")
    out = [text[a + 1 : b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)])]
    return [] if out == [""] else out


def _closing(text: str, start: int) -> int:
    depth = 0
    for at in _plain(text):
        if at >= start:
            depth += (text[at] == "(") - (text[at] == ")")
            if not depth:
                return at
    raise ValueError("a parenthesis isn't closed")


def _engine(text: str) -> tuple[int, int, str, str | None]:
    """Begin and end of what follows ENGINE =, the engine's name, and its arguments."""
    at = find_keyword(text, "ENGINE")
    found = re.compile(r"ENGINE\s*=\s*(\w+)", re.I).match(text, at) if at >= 0 else None
    if not found:
        raise ValueError("the statement has no ENGINE clause")
    end = found.end()
    after = re.compile(r"\s*\(").match(text, end)
    if not after:
        return found.start(1), end, found[1], None
    close = _closing(text, after.end() - 1)
    return found.start(1), close + 1, found[1], text[after.end() : close]


def normalized_engine(name: str, arguments: str | None) -> str:
    """The engine without replication: its path and replica go, other arguments stay."""
    if not name.endswith(FAMILY):
        raise ValueError(f"engine {name} isn't of the {FAMILY} family")
    if not name.startswith(REPLICATED):
        return name if arguments is None else f"{name}({arguments})"
    own = split_arguments(arguments or "")
    if len(own) < 2:
        raise ValueError(f"{name} needs a path and a replica")
    base = name[len(REPLICATED) :]
    return f"{base}({', '.join(own[2:])})" if own[2:] else base


def normalized(statement: str) -> str:
    """The statement with its engine normalised, trimmed and without a last semicolon; nothing else changes."""
    text = statement.strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    begin, end, name, arguments = _engine(text)
    return text[:begin] + normalized_engine(name, arguments) + text[end:]


def _identifier(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] in ("`", '"'):
        end = _skip_quoted(text, at)
        quote = text[at]
        return text[at + 1 : end - 1].replace(quote * 2, quote), end
    found = re.compile(r"\w+").match(text, at)
    if not found:
        raise ValueError("a name is missing")
    return found[0], found.end()


def _name(text: str) -> tuple[int, int, str, str]:
    found = re.compile(r"\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?", re.I).match(text)
    if not found:
        raise ValueError("this isn't a CREATE TABLE statement")
    first, end = _identifier(text, found.end())
    dot = re.compile(r"\s*\.\s*").match(text, end)
    if not dot:
        return found.end(), end, "", first
    second, end = _identifier(text, dot.end())
    return found.end(), end, first, second


def table_name(statement: str) -> tuple[str, str]:
    """Database (empty if not given) and table."""
    return _name(statement)[2:]


def destination(statement: str) -> tuple[str, str]:
    """table_name of a statement that must name its database."""
    database, table = table_name(statement)
    if not database:
        raise ValueError("the destination must name its database")
    return database, table


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def retargeted(statement: str, database: str, table: str) -> str:
    """The statement for another table."""
    begin, end, _, _ = _name(statement)
    return statement[:begin] + f"{quoted(database)}.{quoted(table)}" + statement[end:]


@dataclass(frozen=True)
class TableSpec:
    """A destination: name, columns in order, partition expression, sort key, codec, engine."""

    database: str
    table: str
    schema: T.StructType
    partition_by: str | None = None
    sort_by: tuple[str, ...] = ()
    codec: str = "zstd"
    level: int = 5
    engine: str = FAMILY
    settings: dict = field(default_factory=dict, hash=False)

    @classmethod
    def from_ddl(cls, statement: str) -> "TableSpec":
        """The specification of a CREATE TABLE statement; types that Spark lacks become those that hold their values."""
        text = normalized(statement)
        database, table = destination(text)
        _, end, _, _ = _name(text)
        begin = text.index("(", end)
        columns = []
        for line in split_arguments(text[begin + 1 : _closing(text, begin)]):
            name, at = _identifier(line, 0)
            columns.append(T.StructField(name, spark_type(line[at:].strip())))
        _, _, name, arguments = _engine(text)
        partition = _clause(text, "PARTITION BY")
        order = _clause(text, "ORDER BY")
        keys = tuple(split_arguments(order[1:-1] if order.startswith("(") and order.endswith(")") else order)) if order else ()
        return cls(database, table, T.StructType(columns), _expression(partition) if partition else None, keys, engine=normalized_engine(name, arguments))

    def retargeted(self, database: str, table: str) -> "TableSpec":
        return replace(self, database=database, table=table)


def spark_type(text: str) -> T.DataType:
    """The Spark type of a column's type; codecs and defaults after it are left aside."""
    nullable = re.match(r"(?:Nullable|LowCardinality)\((.*)\)", text, re.I | re.S)
    if nullable:
        return spark_type(nullable[1])
    found = re.match(r"Decimal\((\d+)\s*,\s*(\d+)\)", text, re.I)
    if found:
        return T.DecimalType(int(found[1]), int(found[2]))
    found = re.match(r"Array\((.*)\)", text, re.I | re.S)
    if found:
        return T.ArrayType(spark_type(found[1]))
    name = re.match(r"\w*", text)[0].lower()
    if name not in _TYPES:
        raise ValueError(f"type {text} isn't known")
    return _TYPES[name]


def _clause(text: str, words: str) -> str:
    at = find_keyword(text, words.split()[0], _engine(text)[1])
    while at >= 0:
        found = re.compile(r"\s+".join(words.split()) + r"\s+", re.I).match(text, at)
        if found:
            ends = [e for e in (find_keyword(text, w, found.end()) for w in ("PARTITION", "ORDER", "PRIMARY", "SAMPLE", "TTL", "SETTINGS", "COMMENT")) if e >= 0]
            return text[found.end() : min(ends, default=len(text))].strip()
        at = find_keyword(text, words.split()[0], at + 1)
    return ""


def _expression(text: str) -> str:
    """A partition expression in Spark SQL: toYYYYMM is the one function that has another name there."""
    return re.sub(r"toYYYYMM\(([^()]*)\)", r"cast(year(\1) * 100 + month(\1) as bigint)", text, flags=re.I)


def columns_of(source) -> list[tuple[str, str, int]]:
    """A DataFrame's columns: name, type and place, counted from one."""
    return [(f.name, f.dataType.simpleString(), k) for k, f in enumerate(source.schema.fields, 1)]


def literal(value: str) -> str:
    """A string literal: quotes are doubled, backslashes stay."""
    return "'" + value.replace("'", "''") + "'"
