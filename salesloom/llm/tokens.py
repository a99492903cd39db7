"""Operator 10: token counts by section, from one encoding of the whole document.

A document is encoded once; every token keeps the characters it stands for, and
the sections of the document (lines, or spans or fields given by a column) meet
these token spans in an interval join: both are ordered, so each section is two
binary searches. A token that crosses a boundary belongs to one section by an
explicit rule: to that of its `first`, `middle` or `last` character, or in
`share` to each in proportion to its characters. A character cut in two by
tokens counts for both.

Defined results: a null text is empty; an empty text has no tokens and, in lines,
one empty section; sections may overlap or leave gaps (each is counted on its
own); null sections give no rows; bounds beyond the text are cut to it; repeated
rows are counted each; an empty table gives an empty table; extra columns are
not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.llm.bpe import Vocabulary, encoder

RULES = ("first", "middle", "last", "share")
SECTION = "array<struct<section:string,start:bigint,end:bigint>>"


def fields_as_sections(frame: DataFrame, fields: list[str], apart: str = "\n") -> tuple[Column, Column]:
    """The whole text of some columns, and the sections they make of it; each separator goes to the field before."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    whole = F.concat_ws(apart, *texts)
    sections, at = [], F.lit(0).cast("long")
    for k, (name, text) in enumerate(zip(fields, texts)):
        end = at + F.length(text) + (len(apart) if k + 1 < len(fields) else 0)
        sections.append(F.struct(F.lit(name).alias("section"), at.alias("start"), end.alias("end")))
        at = end
    return whole, F.array(*sections).cast(SECTION)


def line_bounds(text: str) -> list[int]:
    """Character offsets of the lines of a text; a line holds its own line end."""
    lines = text.split("\n")
    sizes = [len(line) + 1 for line in lines]
    sizes[-1] -= 1
    return [0, *np.cumsum(sizes).tolist()]


def token_characters(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character of each token."""
    ends = np.cumsum(sizes[ids])
    character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return character[ends - sizes[ids]], character[ends - 1]


def counted(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [start, end)."""
    if rule == "share":
        sums = np.concatenate([[0], np.cumsum(last - first + 1)])  # characters of the tokens so far
        return _shares(first, last, sums, ends) - _shares(first, last, sums, starts)
    at = {"first": first, "middle": (first + last) // 2, "last": last}[rule]
    return np.searchsorted(at, ends) - np.searchsorted(at, starts)


def _shares(first: np.ndarray, last: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tokens before a character, a token counted by the part of its characters that is before it."""
    whole = np.searchsorted(last, at)  # tokens that end before `at`
    out = whole.astype(float)
    reach = np.searchsorted(first, at)  # tokens that begin before `at`
    for k in np.flatnonzero(reach > whole):  # split characters may put several tokens across one place
        cut = slice(whole[k], reach[k])
        out[k] += float(np.sum((at[k] - first[cut]) / (last[cut] - first[cut] + 1)))
    return out


def token_counts(
    docs: DataFrame,
    vocabulary: Vocabulary,
    sections: str | None = None,
    rule: str = "first",
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows (key, section, start, end, n_tokens, n_crossing, doc_tokens), one per section of each document.

    `sections` names a column of type array<struct<section, start, end>> with
    character offsets; without it the lines are the sections. `n_crossing` counts
    the tokens with characters on both sides of the section's start or end.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = docs.select(key, text, *([F.col(sections).cast(SECTION).alias("given sections")] if sections else []))
    count = T.DoubleType() if rule == "share" else T.LongType()
    fields = [T.StructField(key, given.schema[key].dataType), T.StructField("section", T.StringType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "end")]
    fields += [T.StructField("n_tokens", count), T.StructField("n_crossing", T.LongType()), T.StructField("doc_tokens", T.LongType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = batch.column(2).to_pylist() if sections else [None] * len(texts)
            of, names, rows = [], [], []
            for k, (t, span) in enumerate(zip(texts, spans)):
                t = t or ""
                if sections:
                    span = [x for x in span or () if x and x["start"] is not None and x["end"] is not None]
                    starts, ends = (np.clip(np.array([x[n] for x in span], np.int64), 0, len(t)) for n in ("start", "end"))
                    ends = np.maximum(starts, ends)
                    names += [x["section"] for x in span]
                else:
                    bounds = np.array(line_bounds(t), np.int64)
                    starts, ends = bounds[:-1], bounds[1:]
                    names += map(str, range(len(starts)))
                ids = tool.ids_of(t)
                first, last = token_characters(t, ids, tool.sizes) if len(ids) else (np.zeros(0, np.int64),) * 2
                cross = sum((np.searchsorted(first, at) - np.searchsorted(last, at) for at in (starts, ends)), np.zeros(len(starts), np.int64))
                rows.append((starts, ends, counted(first, last, starts, ends, rule), cross, np.full(len(starts), len(ids))))
                of += [k] * len(starts)
            if of:
                joined = [np.concatenate(x) for x in zip(*rows)]
                keys = batch.column(0).take(pa.array(of, pa.int64()))
                kinds = [pa.int64(), pa.int64(), pa.float64() if rule == "share" else pa.int64(), pa.int64(), pa.int64()]
                columns = [keys, pa.array(names, pa.string()), *(pa.array(x, kind) for x, kind in zip(joined, kinds))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return given.mapInArrow(run, schema)
