"""Rows that fail to parse: a minimum-cost error parse of delimited records.

Each record is read by a dynamic program over its characters whose states are the four of RFC 4180 (start of a
cell, inside an unquoted cell, inside a quoted cell, behind a closing quote) times the number of cells so far.
Reading a character as the format wants costs nothing; inserting or deleting a quote or a delimiter costs one edit.
Quote edits weigh more than any number of delimiter edits, so the cheapest parse states the reason by itself:

* a parse with quote edits      -> ``quoting`` (no reading without them exists)
* else one with delimiter edits -> ``columns`` (well-formed, other cell count than the header)
* else, a cell of wrong type    -> ``value``
* else the row is valid and loads.

The format is deterministic, so a parse without edits is unique and is found by one pattern match; the program runs
for the records without such a parse, many at a time as numpy arrays. It steps over quotes, delimiters and whole runs of
other characters, so that its work grows with the number of these and not with the length of the texts.

Cases: a null text counts as an empty one; a record whose file has no header fails with ``columns``; rows without
file or row number are no data rows; rows delivered twice come out once; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramoflow.operators.scale import sized_join

_CELL = r'(?:"(?:[^"]|"")*+"|[^",]*+)'
_WELL_FORMED = re.compile(rf"{_CELL}(?:,{_CELL})*+", re.S)
_SPLIT = re.compile(r'(?:"((?:[^"]|"")*+)"|([^",]*+))(?:,|\Z)', re.S)
_TOKEN = re.compile(r'[^",]+|[",]')
_LINE_END = re.compile(r"(?:\r\n|\n|\r)\Z")

# Costs: quote edits come before delimiter edits.
_QUOTE, _DELIM, _NEVER = 1 << 31, 1, 1 << 61
_S, _U, _Q, _E = range(4)
_OPS = {1: "delete quote", 2: "insert quote", 3: "delete delimiter", 4: "insert delimiter"}
#: Cells of the program's table held at a time.
_TABLE_CELLS = 24_000_000


def clean_record(text: str | None) -> str:
    """Without byte order mark and line end."""
    text = (text or "").removeprefix("﻿")
    return _LINE_END.sub("", text, count=1)


def split_well_formed(text: str) -> list[str] | None:
    """The cells of a well-formed record, else None."""
    if '"' not in text:
        return text.split(",")
    if not _WELL_FORMED.fullmatch(text):
        return None
    cells, at, end = [], 0, len(text)
    while True:
        m = _SPLIT.match(text, at)
        quoted = m.group(1)
        cells.append(m.group(2) if quoted is None else quoted.replace('""', '"'))
        at = m.end()
        if at == end and text[at - 1 : at] != ",":
            return cells
        if at == end:
            cells.append("")
            return cells
        if at == m.start():
            return cells


def repair(texts: list[str], widths: list[int]) -> list[tuple[int, int, list[str], list[str]]]:
    """Cheapest parse of each text into exactly its width of cells: quote edits, delimiter edits, cells, edits."""
    out: list = [None] * len(texts)
    tokens = [_TOKEN.findall(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: len(tokens[i]))
    at = 0
    while at < len(order):
        take = 1
        while at + take < len(order):
            i = order[at + take]
            if (take + 1) * (len(tokens[i]) + 1) * 4 * (max(widths[j] for j in order[at : at + take + 1]) + 1) > _TABLE_CELLS:
                break
            take += 1
        chunk = order[at : at + take]
        for i, res in zip(chunk, _repair_chunk([tokens[i] for i in chunk], [widths[i] for i in chunk]), strict=True):
            out[i] = res
        at += take
    return out


def _relax(cost: np.ndarray, back: np.ndarray, upcoming: np.ndarray) -> None:
    """Insertions before the upcoming character (3: end). cost: [record, state, cells]; back: the edit and state that led here.

    A delimiter put between a quote and text mends the quoting, so it weighs as much as a quote."""
    after_quote = np.where((upcoming == 0) | (upcoming == 1), _QUOTE, _DELIM)
    before_quote = np.where(upcoming == 1, _QUOTE, _DELIM)
    extra = np.array([np.full(len(cost), _DELIM), before_quote, after_quote]).T
    _relax_quotes(cost, back)
    for k in range(1, cost.shape[2]):  # one more cell
        src = cost[:, [_S, _U, _E], k - 1] + extra
        which = src.argmin(1)
        least = src[np.arange(len(src)), which]
        better = least < cost[:, _S, k]
        cost[:, _S, k] = np.where(better, least, cost[:, _S, k])
        back[:, _S, k] = np.where(better, 128 + 8 * 4 + np.array([_S, _U, _E])[which], back[:, _S, k])
    _relax_quotes(cost, back)


def _relax_quotes(cost: np.ndarray, back: np.ndarray) -> None:
    for src, dst in ((_S, _Q), (_Q, _E), (_E, _Q)):
        better = cost[:, src] + _QUOTE < cost[:, dst]
        cost[:, dst] = np.where(better, cost[:, src] + _QUOTE, cost[:, dst])
        back[:, dst] = np.where(better, 128 + 8 * 2 + src, back[:, dst])


def _repair_chunk(texts: list[list[str]], widths: list[int]) -> list[tuple[int, int, list[str], list[str]]]:
    """texts: quotes, delimiters and the runs of other characters between them. An edit within a run costs no less than the
    same edit at one of its ends, so that a run is one step, however long it is."""
    b, n, k = len(texts), max(map(len, texts)), max(max(widths), 1)
    chars = np.full((b, n + 1), 3, np.int8)  # 0 other, 1 quote, 2 delimiter, 3 end
    for i, t in enumerate(texts):
        chars[i, : len(t)] = [1 if x == '"' else 2 if x == "," else 0 for x in t]
    cost = np.full((b, 4, k), _NEVER, np.int64)
    cost[:, _S, 0] = 0
    # One byte for each way: low 3 bits the former state; edits in the next; 128 marks an insertion.
    ways = np.zeros((n + 1, b, 4, k), np.uint8)  # how the cost after consuming was reached
    eps = np.zeros((n + 1, b, 4, k), np.uint8)  # how insertions improved it
    _relax(cost, eps[0], chars[:, 0])
    lengths = np.array([len(t) for t in texts])
    final = np.full((b, 4, k), _NEVER, np.int64)
    final[lengths == 0] = cost[lengths == 0]
    for p in range(n):
        c = chars[:, p]
        new = np.full_like(cost, _NEVER)
        way = ways[p + 1]

        def go(src: int, dst: int, extra: int, edit: int, rows: np.ndarray, shift: int = 0, new=new, way=way, cost=cost) -> None:
            cand = cost[:, src] + extra
            if shift:
                cand = np.concatenate([np.full((b, 1), _NEVER, np.int64), cand[:, :-1]], 1)
            better = rows[:, None] & (cand < new[:, dst])
            new[:, dst] = np.where(better, cand, new[:, dst])
            way[:, dst] = np.where(better, 8 * edit + src, way[:, dst])

        quote, delim, other = c == 1, c == 2, c == 0
        if quote.any():
            go(_S, _Q, 0, 0, quote)
            go(_Q, _E, 0, 0, quote)
            go(_E, _Q, 0, 0, quote)
            for s in (_S, _U, _Q, _E):
                go(s, s, _QUOTE, 1, quote)
        if delim.any():
            for s in (_S, _U, _E):
                go(s, _S, 0, 5, delim, shift=1)  # 5: a delimiter read as such
                go(s, s, _DELIM, 3, delim)
            go(_Q, _Q, 0, 0, delim)
        if other.any():
            go(_S, _U, 0, 0, other)
            go(_U, _U, 0, 0, other)
            go(_Q, _Q, 0, 0, other)
        cost = np.minimum(new, _NEVER)
        _relax(cost, eps[p + 1], chars[:, p + 1])
        done = lengths == p + 1
        if done.any():
            final[done] = cost[done]
    out = []
    for i, t in enumerate(texts):
        cells_left = max(widths[i], 1) - 1
        state = min((_S, _U, _E), key=lambda s: final[i, s, cells_left])
        total = int(final[i, state, cells_left])
        out.append((total // _QUOTE, total % _QUOTE, *_walk_back(t, i, state, cells_left, ways, eps)))
    return out


def _walk_back(text: list[str], i: int, state: int, k: int, ways: np.ndarray, eps: np.ndarray) -> tuple[list[str], list[str]]:
    """Cells and edits of the cheapest parse, from its end to its start. Places of edits count characters."""
    cells: list[list[str]] = [[]]
    place = [0, *accumulate(map(len, text))]
    edits: list[str] = []
    p = len(text)
    while True:
        way = int(eps[p, i, state, k])
        if way & 128:
            edit, src = (way >> 3) & 7, way & 7
            edits.append(f"{_OPS[edit]} at {place[p]}")
            if edit == 4:
                cells.append([])
                k -= 1
            elif src == _E:  # an inserted quote that doubles the one before it
                cells[-1].append('"')
            state = src
            continue
        if p == 0:
            break
        way = int(ways[p, i, state, k])
        edit, src = way >> 3, way & 7
        p -= 1
        if edit == 5:
            cells.append([])
            k -= 1
        elif edit:
            edits.append(f"{_OPS[edit]} at {place[p]}")
        elif text[p] == '"':
            if src == _E:
                cells[-1].append('"')
        else:
            cells[-1].append(text[p])
        state = src
    return ["".join(reversed(c)) for c in reversed(cells)], list(reversed(edits))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = [clean_record(t) for t in pdf["raw_text"]]
        widths = [len(h) if h is not None else -1 for h in pdf["header"]]
        cells = [split_well_formed(t) for t in texts]
        quote, delim, edits = [0] * len(texts), [0] * len(texts), [[] for _ in texts]
        bad = [i for i, (c, w) in enumerate(zip(cells, widths, strict=True)) if c is None or len(c) != w]
        known = [i for i in bad if widths[i] >= 1]
        for i, (q, d, repaired, ops) in zip(known, repair([texts[i] for i in known], [widths[i] for i in known]), strict=True):
            quote[i], delim[i], cells[i], edits[i] = q, d, repaired, ops
        for i in bad:
            if widths[i] < 1:  # no header: the record can't be read as it says
                quote[i], delim[i], cells[i] = int(cells[i] is None), 1, cells[i] or []
        yield pd.DataFrame({"file_id": pdf["file_id"], "row_number": pdf["row_number"], "header": pdf["header"], "cells": cells, "quote_edits": quote, "delimiter_edits": delim, "edits": edits})


def file_headers(rows: DataFrame) -> DataFrame:
    """file_id and header (names in lower case without spaces and underscores) from the rows numbered 0."""
    raw = rows.filter("row_number = 0 AND file_id IS NOT NULL").groupBy("file_id").agg(F.min("raw_text").alias("raw_text"))

    @F.pandas_udf("array<string>")
    def names(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            t = clean_record(t)
            cells = split_well_formed(t)
            out.append([re.sub(r"[\s_]", "", c).lower() for c in (cells if cells is not None else t.split(","))])
        return pd.Series(out)

    return raw.select(F.col("file_id").cast("bigint"), names("raw_text").alias("header"))


def error_parse(rows: DataFrame) -> DataFrame:
    """rows: file_id, row_number, raw_text -> one row per data row: header, cells, quote_edits, delimiter_edits, edits, reason.

    ``reason`` is null for rows that load.
    """
    data = rows.filter("row_number >= 1 AND file_id IS NOT NULL").select(F.col("file_id").cast("bigint"), F.col("row_number").cast("bigint"), "raw_text").distinct()
    counted = rows.filter("row_number = 0").select("file_id").distinct()
    joined = sized_join(data, file_headers(rows), ["file_id"], "left", counted=counted)
    parsed = joined.select("file_id", "row_number", "raw_text", "header").mapInPandas(
        _parse,
        "file_id bigint, row_number bigint, header array<string>, cells array<string>, quote_edits int, delimiter_edits int, edits array<string>",
    )
    reason = F.when(F.col("quote_edits") > 0, "quoting").when(F.col("delimiter_edits") > 0, "columns").when(~_valid(), "value")
    return parsed.withColumn("reason", reason)


def cell(name: str) -> Column:
    """The trimmed cell under a header name; null where the file has no such column or the cell is blank."""
    at = F.array_position("header", name)
    return F.nullif(F.regexp_replace(F.when(at > 0, F.get("cells", (at - 1).cast("int"))), r"(?U)^[\s﻿]+|[\s﻿]+$", ""), F.lit(""))


def _valid() -> Column:
    number, added, released = cell("releaseid"), cell("dateadded"), cell("released")
    day = F.try_to_timestamp(F.substring(added, 1, 10), F.lit("yyyy-MM-dd"))
    return (
        cell("artist").isNotNull()
        & cell("title").isNotNull()
        & (number.isNull() | F.coalesce(number.rlike(r"\A[0-9]{1,12}\z"), F.lit(False)))
        & (added.isNull() | (added.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?\z") & day.isNotNull()))
        & (released.isNull() | released.rlike(r"\A(19[0-9]{2}|20[0-9]{2}|2100)"))
    )


def load_valid(rows: DataFrame) -> DataFrame:
    """The rows that load, typed: the known columns by name, the others kept in ``more``."""
    fixed = ["artist", "title", "releaseid", "dateadded", "released"]
    ok = error_parse(rows).filter("reason IS NULL")
    added = cell("dateadded")
    return ok.select(
        "file_id",
        "row_number",
        cell("artist").alias("artist"),
        cell("title").alias("title"),
        cell("releaseid").cast("bigint").alias("release_id"),
        F.coalesce(F.try_to_timestamp(added, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(added, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(added, F.lit("yyyy-MM-dd"))).alias("date_added"),
        F.substring(cell("released"), 1, 4).cast("int").alias("released"),
        F.expr(f"filter(arrays_zip(header, cells), x -> NOT array_contains(array({', '.join(map(repr, fixed))}), x.header))").alias("more"),
    )


def rejected(rows: DataFrame) -> DataFrame:
    """The rows that fail, with reason, the edits that would repair them and the repaired cells."""
    return error_parse(rows).filter("reason IS NOT NULL").select("file_id", "row_number", "reason", "edits", "cells")
