"""Evaluation passages inside training texts: an FM-index over each shard of the corpus.

Texts and passages become words (runs of letters and digits; markup, case, accents, spacing and invisible characters do
not count). A shard is a bounded run of words over the alphabet of the passages' words; all other words are one letter.
Each shard gets its suffix array, the Burrows-Wheeler transform in a wavelet matrix and every ``SAMPLE``-th suffix position.
All windows of ``least`` consecutive words of the passages are searched backward at once; occurrences are located by
walking to a sampled position and overlapping ones merge into spans to be removed.

The passages are broadcast in blocks of at most ``BLOCK_WORDS`` words; a longer test set is searched block by block.

Cases: null, empty and blank texts hold nothing; a passage of fewer words than ``least`` cannot leak by this measure; very
long texts fill a shard of their own; repeated rows come out once; an empty corpus or test set gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramoflow.operators.scale import spread

LEAST_WORDS = 13
#: Words of one shard's index.
SHARD_WORDS = 1_000_000
#: Distance of the sampled suffix positions.
SAMPLE = 16
#: Words of the passages searched at a time.
BLOCK_WORDS = 2_000_000

_TAG = re.compile(r"<!--.*?-->|</?([A-Za-z][A-Za-z0-9]*)[^<>]*>", re.S)
# Tags that stand inside words; all others part them.
_INLINE = frozenset("a b i u s em strong span font small big sub sup mark code tt wbr".split())
_WORD = re.compile(r"[^\W_]+")
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(lambda m: "" if (m.group(1) or "").lower() in _INLINE else " ", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", text).casefold().translate(_LETTERS)
    text = "".join(c for c in text if c.isascii() or not (unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Mn", "Me")))
    return _WORD.findall(text)


class Bits:
    """A packed bitmap with the number of ones before each of its 64-bit words."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
        held = np.packbits(bit, bitorder="little")
        packed[: len(held)] = held
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Ranks and symbols of a sequence of small integers: one packed bitmap for each bit of them."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        cur = seq
        for b in range(self.bits - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.first = np.searchsorted(_order_of(cur, self.bits), _reverse_bits(np.arange(sigma), self.bits))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        at = at.astype(np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            seen = self.levels[level].rank(at)
            at = np.where((symbol >> b) & 1 == 1, self.zeros[level] + seen, at - seen)
        return at - self.first[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before it."""
        at = at.astype(np.int64)
        symbol = np.zeros(len(at), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            bits = self.levels[level]
            one, seen = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << b
            at = np.where(one, self.zeros[level] + seen, at - seen)
        return symbol, at - self.first[symbol]


def _reverse_bits(x: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(x)
    for _ in range(bits):
        out = (out << 1) | (x & 1)
        x = x >> 1
    return out


def _order_of(seq: np.ndarray, bits: int) -> np.ndarray:
    return _reverse_bits(seq.astype(np.int64), bits)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the sequence ends with a letter smaller than all others."""
    n = len(seq)
    rank = seq.astype(np.int64)
    step = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search over a sequence of word numbers from 1; 0 ends it."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.tree = Wavelet(seq[sa - 1].astype(np.int64), sigma)
        sampled = sa % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), sa[sampled].astype(np.int32)  # by row

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and row behind the last of each pattern (rows of equal length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            alive = np.flatnonzero(lo < hi)
            if not len(alive):
                break
            c = patterns[alive, k]
            lo[alive], hi[alive] = self.starts[c] + self.tree.rank(c, lo[alive]), self.starts[c] + self.tree.rank(c, hi[alive])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled suffix."""
        out, at, steps = np.full(len(rows), -1), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            known = self.sampled.get(at[todo])
            out[todo[known]] = self.positions[self.sampled.rank(at[todo[known]])] + steps
            todo = todo[~known]
            symbol, before = self.tree.symbol_and_rank(at[todo])
            at[todo] = self.starts[symbol] + before
            steps += 1
        return out


class Phrases:
    """The distinct windows of the passages and the items and word positions they stand for."""

    def __init__(self, items: Iterable[tuple[int, str]], least: int) -> None:
        self.least = least
        self.numbers: dict[str, int] = {}
        seen: dict[tuple[int, ...], list[int]] = {}
        for item, passage in items:
            ws = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in words_of(passage)]  # 1: any other word
            for i in range(len(ws) - least + 1):
                seen.setdefault(tuple(ws[i : i + least]), []).append(item)
        self.patterns = np.array(list(seen), np.int64).reshape(-1, least)
        self.owners = [sorted(set(v)) for v in seen.values()]
        self.sigma = len(self.numbers) + 2

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers with runs of other words as one, and the word position of each."""
        get = self.numbers.get
        seq = np.fromiter((get(w, 1) for w in words), np.int64, len(words))
        keep = np.ones(len(seq), bool)
        keep[1:] = (seq[1:] != 1) | (seq[:-1] != 1)
        return seq[keep], np.flatnonzero(keep)


def leaks_in(docs: list[tuple[int, list[str]]], phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, word behind the last) of the merged occurrences in one shard."""
    seqs, places, owners = [], [], []
    for d, (_, words) in enumerate(docs):
        seq, place = phrases.encode(words)
        if len(seq) >= phrases.least:
            seqs += [seq, np.ones(1, np.int64)]  # documents are parted by an "other" word
            places += [place, np.zeros(1, np.int64)]
            owners.append(np.full(len(seq) + 1, d))
    if not seqs or not len(phrases.patterns):
        return []
    place, owner = np.concatenate(places), np.concatenate(owners)
    index = FMIndex(np.concatenate(seqs), phrases.sigma)
    lo, hi = index.search(phrases.patterns)
    found = np.flatnonzero(hi > lo)
    counts = (hi - lo)[found]
    which = np.repeat(found, counts)
    rows = np.repeat(lo[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = index.locate(rows)
    hits: dict[tuple[int, int], list[int]] = {}
    for p, pos in zip(which.tolist(), at.tolist(), strict=True):
        for item in phrases.owners[p]:
            hits.setdefault((int(owner[pos]), item), []).append(int(place[pos]))
    out = []
    for (d, item), starts in hits.items():
        begin = end = -1
        for s in sorted(starts):
            if s > end:
                if end >= 0:
                    out.append((docs[d][0], item, begin, end))
                begin = s
            end = s + phrases.least
        out.append((docs[d][0], item, begin, end))
    return out


def leaked_spans(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents: doc_id, text; items: item_id, passage -> doc_id, item_id, first_word, end_word of each leaked span."""
    spark = documents.sparkSession
    passages = items.filter("item_id IS NOT NULL AND passage IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "passage").distinct()
    size = passages.agg(F.coalesce(F.sum(F.size(F.split("passage", r"\s+"))), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_words))
    docs = spread(documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    out = None
    for b in range(blocks):
        part = passages.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([(r.item_id, r.passage) for r in part.collect()])  # about block_words words

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            phrases = Phrases(held.value, least)
            shard: list[tuple[int, list[str]]] = []
            size = 0
            for pdf in batches:
                for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                    words = words_of(text)
                    shard.append((doc, words))
                    size += len(words)
                    if size >= shard_words:
                        yield pd.DataFrame(leaks_in(shard, phrases), columns=["doc_id", "item_id", "first_word", "end_word"])
                        shard, size = [], 0
            yield pd.DataFrame(leaks_in(shard, phrases), columns=["doc_id", "item_id", "first_word", "end_word"])

        one = docs.mapInPandas(run, "doc_id bigint, item_id bigint, first_word int, end_word int")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def leaked_items(documents: DataFrame, items: DataFrame, **sizes) -> DataFrame:
    """doc_id, item_id: which documents give away which items."""
    return leaked_spans(documents, items, **sizes).select("doc_id", "item_id").distinct()
