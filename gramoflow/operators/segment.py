"""Several values packed in one field: dictionary-guided segmentation.

An automaton over all known whole values that contain a delimiter (``Stereo/Mono``, ``Tin Music, Inc.``) finds them in
a field; a dynamic program then covers the field's slots at least cost. A known value costs nothing and may run over
delimiters, an unknown one costs 1 and may run over weak delimiters only, and every value costs a little so that one
known value wins against two. Delimiters are

* strong: comma, semicolon, bar, line break and tab anywhere; slash, plus and middle dot between spaces
* weak: slash, plus and middle dot without a space on each side; they separate known values only

A quote opens a quoted value at the start of a slot and only if a closing quote ends the slot; elsewhere quotes are
plain characters (12" records).

The dictionary is the fixed vocabulary of the field plus the clean names of other tables. It is broadcast in shards of
a fixed number of values: each shard's automaton looks for its values in all distinct texts, the hits of all shards meet
in the dynamic program, so the dictionary may grow without bound.

Cases: null, empty and blank fields hold no value; empty slots do not count; repeated values stay; outer spaces and
enclosing quotes go, doubled quotes inside quotes become single; rows delivered twice come out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramoflow.operators.scale import sized_join, stage

# The vocabulary of formats and their descriptions.
FORMAT_VALUES = (
    "Vinyl", "CD", "CDr", "Cassette", "File", "MiniDisc", "Reel-To-Reel", "8-Track Cartridge", "Shellac", "Flexi-disc", "Lathe Cut", "Acetate", "SACD", "DVD", "Box Set",
    "LP", "EP", "Single", "Maxi-Single", "Album", "Compilation", "Mixtape", "Promo", "Reissue", "Remastered", "Repress", "Limited Edition", "Numbered", "Club Edition",
    "White Label", "Test Pressing", "Gatefold", "Stereo", "Mono", "Stereo/Mono", "Mono/Stereo", "Quadraphonic", "33 1/3 RPM", "33 ⅓ RPM", "45 RPM", "78 RPM", "16 2/3 RPM", "180 g", "C60", "C90", '7"', '10"', '12"',
)

#: Known values in one automaton.
SHARD_VALUES = 100_000
#: Any of these may separate values.
ANY_DELIMITER = r"[,;|\n\r\t/+·]"

_DELIM = re.compile(r"[  ]*([,;|\n\r\t]|[/+·])[  ]*")
_STRONG = frozenset(",;|\n\r\t")
_SPACES = "  \t\r\n"
_UNKNOWN, _EACH, _WEAK_SPLIT = 1.0, 0.01, 0.5


def automaton(values: Iterable[str]) -> ahocorasick.Automaton:
    """Of the values in lower case."""
    a = ahocorasick.Automaton()
    for v in values:
        low = v.strip().lower()
        if low:
            a.add_word(low, len(low))
    if len(a):
        a.make_automaton()
    return a


def known_spans(text: str, known: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Where known values stand in the text, in its own characters: some of them are several in lower case."""
    low = text.lower()
    if not len(known):
        return []
    found = [(end + 1 - size, end + 1) for end, size in known.iter(low)]
    if len(low) != len(text):
        at = [i for i, c in enumerate(text) for _ in c.lower()]
        found = [(at[a], at[b - 1] + 1) for a, b in found if (a == 0 or at[a] != at[a - 1]) and (b == len(at) or at[b] != at[b - 1])]
    return found


def _slots(text: str) -> tuple[list[tuple[int, int, bool]], list[bool]]:
    """Slots (start, end, quoted) between delimiters outside quotes, and for each gap between two slots if it is strong."""
    slots, strong = [], []
    at, end = 0, len(text)
    while True:
        begin = at
        while begin < end and text[begin] in "  ":
            begin += 1
        if begin < end and text[begin] == '"':
            close = begin + 1
            while close < end:
                if text[close] == '"':
                    if close + 1 < end and text[close + 1] == '"':
                        close += 2
                        continue
                    break
                close += 1
            stop = close + 1
            while stop < end and text[stop] in "  ":
                stop += 1
            m = _DELIM.match(text, stop) if stop < end else None
            if close < end and (stop >= end or m):
                slots.append((begin, close + 1, True))
                if stop >= end:
                    return slots, strong
                strong.append(True)
                at = m.end()
                continue
        m = _DELIM.search(text, begin)
        if not m:
            slots.append((begin, end, False))
            return slots, strong
        slots.append((begin, m.start(), False))
        mark = m.group(1)
        strong.append(mark in _STRONG or (m.end() > m.end(1) and m.start() < m.start(1)))
        at = m.end()


def segment(text: str | None, spans: list[tuple[int, int]], known: frozenset[str] = frozenset()) -> list[str]:
    """The values of a field. spans: where known values with delimiters stand; known: other known values in lower case."""
    if text is None:
        return []
    slots, strong = _slots(text)
    n = len(slots)
    if n > 1 and (spans or not all(strong)):
        starts, ends = {s[0]: i for i, s in enumerate(slots)}, {s[1]: i for i, s in enumerate(slots)}
        covers: dict[int, list[int]] = {}
        for a, b in spans:
            i, j = starts.get(a), ends.get(b)
            if i is not None and j is not None and i < j and not any(slots[k][2] for k in range(i, j + 1)):
                covers.setdefault(j, []).append(i)
        best, via = [0.0] + [0.0] * n, [0] * (n + 1)
        run, run_from = 0.0, 0  # cheapest start of an unknown value in the current stretch of weak delimiters
        for j in range(n):
            a, b, quoted = slots[j]
            weak_before = j > 0 and not strong[j - 1]
            entry = best[j] + (_WEAK_SPLIT if weak_before else 0)
            if not weak_before or quoted or slots[j - 1][2] or entry < run:
                run, run_from = entry, j
            single = entry + (0 if quoted or text[a:b].strip(_SPACES).lower() in known else _UNKNOWN)
            cost, frm = run + _UNKNOWN, run_from
            if single <= cost:
                cost, frm = single, j
            for i in covers.get(j, ()):
                c = best[i] + (_WEAK_SPLIT if i > 0 and not strong[i - 1] else 0)
                if c <= cost:
                    cost, frm = c, i
            best[j + 1], via[j + 1] = cost + _EACH, frm
        parts, j = [], n
        while j > 0:
            i = via[j]
            parts.append((slots[i][0], slots[j - 1][1], slots[i][2] and j - i == 1))
            j = i
        parts.reverse()
    else:
        parts = slots
    out = []
    for a, b, quoted in parts:
        v = text[a:b].strip(_SPACES)
        if quoted:
            v = v[1:-1].replace('""', '"').strip(_SPACES)
        if v:
            out.append(v)
    return out


def has_delimiter(c: str):
    return F.col(c).rlike(ANY_DELIMITER)


def dictionary(*names: DataFrame) -> DataFrame:
    """v: the distinct clean names that contain a delimiter; each frame has one text column."""
    out = None
    for df in names:
        one = df.select(F.trim(F.col(f"`{df.columns[0]}`")).alias("v")).filter(has_delimiter("v")).distinct()
        out = one if out is None else out.unionByName(one).distinct()
    return out


def segment_fields(fields: DataFrame, names: DataFrame | None = None, vocabulary: Iterable[str] = FORMAT_VALUES, shard_values: int = SHARD_VALUES) -> DataFrame:
    """fields: keys and ``text`` -> keys and ``vals``, the values in order. Identical input rows give one output row.

    names: column ``v`` of known values with delimiters, of any size."""
    keys = [c for c in fields.columns if c != "text"]
    fields = fields.filter(F.col("text").isNotNull()).distinct()
    vocabulary = list(vocabulary)
    plain = frozenset(v.lower() for v in vocabulary)
    schema = fields.schema.simpleString()[7:-1]
    first = [] if names is None else [r.v for r in names.limit(shard_values + 1).collect()]
    if len(first) <= shard_values:
        values = vocabulary + first
        held = fields.sparkSession.sparkContext.broadcast([v for v in values if re.search(ANY_DELIMITER, v)])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = automaton(held.value)
            for pdf in batches:
                memo: dict[str, list[str]] = {}
                vals = []
                for t in pdf["text"]:
                    if t not in memo:
                        memo[t] = segment(t, known_spans(t, known), plain)
                    vals.append(memo[t])
                yield pdf.assign(vals=vals)

        return fields.mapInPandas(run, f"{schema}, vals array<string>").select(*keys, "vals")
    shards = -(-names.count() // shard_values)
    texts = stage(fields.select("text").distinct(), "texts")  # read once a shard
    hits = None
    for s in range(shards):
        part = [r.v for r in names.filter(F.pmod(F.xxhash64("v"), F.lit(shards)) == s).collect()]  # about shard_values
        held = fields.sparkSession.sparkContext.broadcast(part + (vocabulary if s == 0 else []))

        def look(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            known = automaton(v for v in held.value if re.search(ANY_DELIMITER, v))
            for pdf in batches:
                yield pd.DataFrame({"text": pdf["text"], "spans": [[x for ab in known_spans(t, known) for x in ab] for t in pdf["text"]]})

        found = texts.mapInPandas(look, "text string, spans array<int>").filter(F.size("spans") > 0)
        hits = found if hits is None else hits.unionByName(found)
    spans = hits.groupBy("text").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([segment(x, [] if y is None else list(zip(y[::2], y[1::2], strict=True)), plain) for x, y in zip(t, s, strict=True)])

    cut_texts = stage(texts.join(spans, "text", "left").select("text", cut("text", "spans").alias("vals")), "cut")
    return sized_join(fields, cut_texts, ["text"]).select(*keys, "vals")


def values(segmented: DataFrame, least: int = 1) -> DataFrame:
    """Keys, pos (from 1), val: one row per value of the fields that hold at least so many."""
    keys = [c for c in segmented.columns if c != "vals"]
    return segmented.filter(F.size("vals") >= least).select(*keys, F.posexplode("vals").alias("pos", "val")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))


_QUANTITY = re.compile(r"\s*\d{1,4}\s*[xX×*]\s*(?=\S)")


def without_quantity(value: str) -> str:
    """A carrier without the quantity written onto it: ``2 x Vinyl`` is ``Vinyl``."""
    return _QUANTITY.sub("", value, count=1)

