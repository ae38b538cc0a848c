"""Key templates [P11-P15, T16]: text with {{.Name}} and {{.Field "column"}} actions, compiled to a Column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The key patterns that are used where none is configured.
DEFAULT_STREAM_KEY = "{{.Prefix}}:{{.Schema}}:{{.Table}}"
DEFAULT_DOCUMENT_KEY = '{{.Prefix}}:{{.Schema}}:{{.Table}}:{{.Field "id"}}'
KEY_SEPARATOR = "\x1f"
_ACTION = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)
_FIELD = re.compile(r'\(?\s*\.Field\s+(?:"((?:[^"\\]|\\.)*)"|`([^`]*)`)\s*\)?')


def field(name: str, new: str = "new_data", old: str = "old_data") -> Column:
    """The new value if its column is there, else the old one, else ''; SQL NULL is the text null."""
    look = lambda m: (F.coalesce(F.map_contains_key(F.col(m), name), F.lit(False)), F.coalesce(F.element_at(F.col(m), F.lit(name)), F.lit("null")))
    (in_new, of_new), (in_old, of_old) = look(new), look(old)
    return F.when(in_new, of_new).when(in_old, of_old).otherwise(F.lit(""))


def template(pattern: str, prefix: str = "", columns: dict[str, Column] | None = None) -> Column:
    """Compile a pattern. The prefix is itself a pattern, evaluated first and without a prefix of its own."""
    names = {"Schema": F.col("schema"), "Table": F.col("table"), "Operation": F.col("op"), "ID": F.col("event_id")} | (columns or {})
    if "Prefix" not in names:
        names["Prefix"] = template(prefix, columns=(columns or {}) | {"Prefix": F.lit("")}) if prefix else F.lit("")
    parts: list[Column] = []
    at = 0
    for m in _ACTION.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        action = m.group(1)
        if f := _FIELD.fullmatch(action):
            parts.append(field(f.group(1) if f.group(1) is not None else f.group(2)))
        elif action.startswith(".") and action[1:] in names:
            parts.append(names[action[1:]].cast("string"))
        else:
            raise ValueError(f"unknown action in key pattern: {{{{{action}}}}}")
    if "{{" in pattern[at:]:
        raise ValueError(f"unclosed action in key pattern: {pattern!r}")
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts) if parts else F.lit("")


def sanitize(subject: Column) -> Column:
    """A message subject without wildcards and white space."""
    return F.translate(subject, "*> \t\n\r", "______")


def canonical_key(data: Column, columns: list[str]) -> Column:
    """Key values joined by the unit separator; null if a column is missing. SQL NULL is the text null."""
    present = reduce(lambda a, b: a & b, (F.coalesce(F.map_contains_key(data, c), F.lit(False)) for c in columns))
    return F.when(present, F.concat_ws(KEY_SEPARATOR, *(F.coalesce(F.element_at(data, F.lit(c)), F.lit("null")) for c in columns)))
