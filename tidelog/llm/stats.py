"""Statistics of a whole text, the inputs of the quality classifier and of the learned rules.

Counts are exact. Nothing but the text is read: no label, language, source or id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as tx

COUNTS = ("n_words", "n_bytes", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_runs")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_SYMBOL = _table(tx.SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(bytes(range(48, 58)))
_MARK = _table(b"!?:;\"'()[]{}=+_/\\@~^`")
_LETTER = (~tx.IS_SPACE).astype(np.uint8)
_LETTER[0x80:0xC0] = 0  # continuation bytes: a code point counts once


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(tx.SPACES)]
    return len(lines) - len(set(lines))


def compute(texts: list[bytes]) -> dict[str, np.ndarray]:
    w = tx.split(texts)
    n, doc = len(texts), w.doc
    h = w.hashes()
    salt = tx.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    repeated = np.zeros(len(h), bool)
    g, first = w.windows(3, h)
    if len(g):
        _, inverse, times = np.unique(tx.mix(g ^ salt[doc[first]]), return_inverse=True, return_counts=True)
        twice = first[times[inverse] > 1]
        for i in range(3):
            repeated[twice + i] = True
    count = lambda mask: np.bincount(doc[mask], minlength=n).astype(np.int64)
    distinct = np.zeros(n, np.int64)
    if len(h):
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=n).astype(np.int64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return {
        "n_words": w.count.astype(np.int64),
        "n_bytes": w.size,
        "word_chars": w.per_text(_LETTER[w.buf]),
        "n_symbols": w.per_text(_SYMBOL[w.buf]),
        "n_dup_lines": np.fromiter(map(dup_lines, texts), np.int64, n),
        "n_repeat_words": count(repeated),
        "n_lines": w.per_text(w.buf == 10) + 1,
        "n_upper": w.per_text(_UPPER[w.buf]),
        "n_digits": w.per_text(_DIGIT[w.buf]),
        "n_marks": w.per_text(_MARK[w.buf]),
        "n_distinct": distinct,
        "n_runs": count(again),
    }


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and one long column for each of COUNTS; `text` is dropped unless kept."""
    fields = [docs.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} long" for c in COUNTS])
    columns = [*dict.fromkeys([*keep, "text"])]
    run = tx.per_text(dict.fromkeys(COUNTS, pa.int64()), compute, keep)
    return shared.in_arrow(docs.select(*columns), run, schema)


#: Ratios, each defined for empty texts (0).
RATIOS = {
    "log_words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "run_share": ("n_runs", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def ratio_columns() -> dict[str, Column]:
    """The ratios as Spark columns over COUNTS."""
    out = {}
    for name, (a, b) in RATIOS.items():
        out[name] = F.log1p(F.col(a).cast("double")) if b is None else F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out


def with_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns(ratio_columns())
