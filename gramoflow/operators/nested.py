"""Deeply nested records as flat, linked tables.

Typed lists are flattened inside the engine. Trees written as JSON text go through a structural index built for a
whole batch at once: bitmaps of quotes, brackets and delimiters over the bytes of all texts, nesting depth as a prefix
sum, spans of nodes from the two; no text is parsed value by value.

Cases: a null or empty list gives no rows; a null element keeps its position and gives no row; an element that is
not a node (a number, a text) is treated like null; a tree given as one object instead of a list is its only child; a
text that is null, no object or has unbalanced brackets gives no rows (``broken_trees`` lists it); repeated rows come
out once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COLON, _COMMA, _QUOTE, _SLASH = (ord(c) for c in '{}[]:,"\\')
#: Bytes of text indexed at a time.
BATCH_BYTES = 8_000_000


def flatten_list(rows: DataFrame, rec_id: str, items: Column, step: str, name: str) -> DataFrame:
    """rec_id, path, parent_path, name: one row per element of a list of structs, in its place."""
    flat = rows.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.posexplode(items).alias("pos", "item")).filter("item IS NOT NULL")
    return flat.select("rec_id", F.concat(F.lit(f"{step}/"), (F.col("pos") + 1).cast("string")).alias("path"), F.lit("").alias("parent_path"), F.col("item").getField(name).alias("name"))


def index_trees(texts: list[bytes]) -> tuple[list[list[tuple[str, str, str | None]]], list[bool]]:
    """For each JSON text its nodes below the root as (path, parent path, name), and whether it could be read."""
    out: list[list] = [[] for _ in texts]
    good = [True] * len(texts)
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < BATCH_BYTES:
            size += len(texts[end])
            end += 1
        for i, (nodes, ok) in enumerate(_index_batch(texts[at:end])):
            out[at + i], good[at + i] = nodes, ok
        at = end
    return out, good


def _index_batch(texts: list[bytes]) -> list[tuple[list, bool]]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds, starts = starts[1:], starts[:-1]
    # Quotes that are not escaped: a backslash run of even length stands before them.
    quotes = np.flatnonzero(data == _QUOTE)
    slashes = np.flatnonzero(data == _SLASH)
    if len(slashes):
        run_start = np.concatenate([[True], np.diff(slashes) > 1])
        first = slashes[np.maximum.accumulate(np.where(run_start, np.arange(len(slashes)), 0))]
        run_end = np.append(np.diff(slashes) > 1, True)
        odd = set((slashes[run_end][((slashes - first + 1)[run_end] % 2) == 1] + 1).tolist())
        quotes = quotes[[q not in odd for q in quotes.tolist()]] if odd else quotes
    # A text with an odd number of quotes is broken; its quotes are left out so that the others keep their parity.
    of_quote = np.searchsorted(starts, quotes, "right") - 1
    broken = np.bincount(of_quote, minlength=len(texts)) % 2 == 1
    keep = ~broken[of_quote]
    quotes = quotes[keep]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[quotes] ^= 1
    inside = np.cumsum(inside[:-1], dtype=np.int64) & 1  # 1 from an opening quote up to before its closing one
    tokens = np.flatnonzero(np.isin(data, (_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COLON, _COMMA)) & (inside == 0))
    kind = data[tokens]
    text_of = np.searchsorted(starts, tokens, "right") - 1
    opens, closes = (kind == _OPEN_OBJ) | (kind == _OPEN_ARR), (kind == _CLOSE_OBJ) | (kind == _CLOSE_ARR)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    # Depth within the own text: a broken text must not shift the next ones.
    before = np.concatenate([[0], depth])[np.searchsorted(tokens, starts)]
    depth = depth - before[text_of]
    last = np.searchsorted(tokens, bounds) - 1
    first_tok = np.searchsorted(tokens, starts)
    has = last >= first_tok
    broken |= ~has
    broken[has] |= depth[last[has]] != 0
    low = np.full(len(texts), 0)
    np.minimum.at(low, text_of, depth)
    broken |= low < 0
    broken[has] |= kind[first_tok[has]] != _OPEN_OBJ
    level = np.where(opens, depth - 1, depth)  # of the container the token stands in; for brackets, the one around them
    level = np.where(closes, depth, level)
    # The container each token stands in: the last opening bracket one level up.
    order = np.arange(len(tokens))
    parent = np.full(len(tokens), -1)
    comma_no = np.zeros(len(tokens), np.int64)
    for lv in range(1, int(level.max(initial=0)) + 1):
        mine = np.flatnonzero((level == lv) & ~closes)
        holders = np.flatnonzero(opens & (depth == lv))
        if not len(mine) or not len(holders):
            continue
        parent[mine] = holders[np.maximum(np.searchsorted(holders, mine) - 1, 0)]
        commas = (kind[mine] == _COMMA).astype(np.int64)
        run = np.cumsum(commas)
        head = np.concatenate([[True], parent[mine][1:] != parent[mine][:-1]])
        base = np.maximum.accumulate(np.where(head, run - commas, 0))
        comma_no[mine] = run - base
    # Key before each colon: the last quoted span before it.
    colon = order[kind == _COLON]
    q = np.searchsorted(quotes, tokens[colon])
    key_open, key_close = quotes[np.maximum(q - 2, 0)], quotes[np.maximum(q - 1, 0)]
    key_len = key_close - key_open - 1
    is_children = (key_len == 8) & _span_is(data, key_open + 1, b"children")
    is_name = (key_len == 4) & _span_is(data, key_open + 1, b"name")
    # Value of a "children" member: the token right behind its colon, if that opens something.
    kid_colon = colon[is_children]
    kid_value = kid_colon + 1
    fits = kid_value < len(tokens)
    kid_value = kid_value[fits]
    gap_free = opens[kid_value] & (parent[kid_value] == parent[kid_colon[fits]])
    holders = kid_value[gap_free]
    child_list = np.zeros(len(tokens), bool)
    child_list[holders[kind[holders] == _OPEN_ARR]] = True
    only_child = np.zeros(len(tokens), bool)
    only_child[holders[kind[holders] == _OPEN_OBJ]] = True
    objects = order[kind == _OPEN_OBJ]
    in_list = child_list[np.maximum(parent[objects], 0)] & (parent[objects] >= 0)
    nodes = objects[in_list | only_child[objects] | (level[objects] == 0)]
    # Names: the string value of the member "name" of a node, last one wins.
    name_at: dict[int, tuple[int, int]] = {}
    node_set = np.zeros(len(tokens), bool)
    node_set[nodes] = True
    name_colon = colon[is_name]
    name_colon = name_colon[node_set[np.maximum(parent[name_colon], 0)]]
    v = np.searchsorted(quotes, tokens[name_colon])
    nxt = tokens[np.minimum(name_colon + 1, len(tokens) - 1)]
    for c, i, stop in zip(name_colon.tolist(), v.tolist(), nxt.tolist(), strict=True):
        if i + 1 < len(quotes) and quotes[i] < stop:
            name_at[int(parent[c])] = (int(quotes[i]) + 1, int(quotes[i + 1]))
    raw = data.tobytes()
    out: list[tuple[list, bool]] = [([], not b) for b in broken.tolist()]
    paths: dict[int, str] = {}
    for tok, lv, up, txt in zip(nodes.tolist(), level[nodes].tolist(), parent[nodes].tolist(), text_of[nodes].tolist(), strict=True):
        if broken[txt]:
            continue
        if lv == 0:
            paths[tok] = ""
            continue
        if child_list[up]:
            owner, pos = int(parent[up]), int(comma_no[tok]) + 1
        else:
            owner, pos = up, 1
        if owner not in paths:
            continue
        above = paths[owner]
        path = paths[tok] = f"{above}/{pos}" if above else str(pos)
        span = name_at.get(tok)
        name = None
        if span is not None:
            piece = raw[span[0] : span[1]]
            name = json.loads(b'"' + piece + b'"', strict=False) if b"\\" in piece else piece.decode("utf-8", "replace")
        out[txt][0].append((path, above, name))
    return out


def _span_is(data: np.ndarray, at: np.ndarray, word: bytes) -> np.ndarray:
    ok = np.ones(len(at), bool)
    for i, b in enumerate(word):
        ok &= data[np.minimum(at + i, len(data) - 1)] == b
    return ok


def _explode_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, texts = pdf["rec_id"].tolist(), [(t or "").encode("utf-8", "replace") for t in pdf["tree"]]
        nodes, _ = index_trees(texts)
        rows = [(i, *n) for i, ns in zip(ids, nodes, strict=True) for n in ns]
        yield pd.DataFrame(rows, columns=["rec_id", "path", "parent_path", "name"])


def flatten_trees(rows: DataFrame, rec_id: str, tree: str) -> DataFrame:
    """rec_id, path, parent_path, name: every node below the root of the JSON trees ``{name, attrs, children, text}``."""
    picked = rows.filter(F.col(rec_id).isNotNull()).select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(tree).alias("tree")).distinct()
    return picked.mapInPandas(_explode_trees, "rec_id bigint, path string, parent_path string, name string")


def broken_trees(rows: DataFrame, rec_id: str, tree: str) -> DataFrame:
    """rec_id of the texts that are no whole tree."""

    @F.pandas_udf("boolean")
    def readable(texts: pd.Series) -> pd.Series:
        return pd.Series(index_trees([(t or "").encode("utf-8", "replace") for t in texts])[1])

    return rows.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.col(tree).alias("tree")).distinct().filter(~readable("tree")).select("rec_id")
