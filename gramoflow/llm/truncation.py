"""Texts cut off by a field limit or in transit: a backward character n-gram model of where texts end.

The model reads a text backward from a position and compares how often texts of the corpus end behind these characters with
how often they go on. Contexts are the last 1, 2, 4 and 8 characters (digits are one character). A text that ends inside
or behind a word has a second chain, in which the letters of that word are a class (by the case of its first one) behind
the last 0, 1, 2, 4 and 8 characters before the word; it counts at every letter of a word, so that a rare name at a text's
end is not taken for a piece of a word only because it is rare.

* The probability of an end is smoothed from short to long contexts: each context's counts are joined by SMOOTHING
  observations spread as the shorter one says. The class chain comes first, then the character contexts that
  hold the whole last word. No context is too rare to count, and none decides alone.
* ``END`` counts are made of distinct endings only (the last ENDING characters), so that reposts of one text count once,
  and a text's own ending is taken out of its counts.
* What a cut leaves behind the last character (an open tag or entity, half a character, dots put in place of the rest)
  is set aside first, unless the dots belong to an ending that the corpus has.
* The log-odds of a language and source fall into two heaps; their threshold is the deepest valley below the heap of
  complete texts, where the language and the corpus count along with a weight of POOLED texts each, at any size of the group.

All documents are counted, in whole. Only counts of contexts that end some text are kept: a bitmap, sized by their number,
tells most others apart before the shuffle, and an exact join after it.

Cases: null and blank texts are not judged; a text of nothing but a cut's leavings is judged as it is; language and source may be null and form their own groups; a repeated row counts once as an ending; very long
texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramoflow.operators.scale import spread, stage

#: Characters of a context; of the one before a last word whose letters are a class.
EXACT, CLASSED = (1, 2, 4, 8), (0, 1, 2, 4, 8)
#: Observations that a shorter context weighs beside a longer one, and the share of positions that end a text without any.
SMOOTHING, PRIOR = 200.0, 1e-3
#: Texts with the same last characters count as one ending.
ENDING = 48
#: Characters of a text's end in which its last word and leavings are looked for.
TAILS = (300, 4_000, 1_000_000_000)
#: Dots are part of an ending that has them in this share of the places where the characters before them stand, after so many doubtful ones.
KNOWN_SHARE, KNOWN_DOUBT = 0.2, 10
#: Bits of the bitmap for each needed context, and the most of all (32 MB). A fuller bitmap lets more through to the exact join.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: A context of this share of the texts, and of so many, is joined by broadcast.
HOT_SHARE, LEAST_HOT = 1 / 1000, 300
#: Histogram of the log-odds: range (what lies beyond counts at its ends) and width of a bin.
RANGE, BIN = (-16.0, 6.0), 0.25
#: Texts of the language, and of the corpus, that count along with a group's own; share of texts that a valley may hold by
#: chance; bins that a valley is wide at least.
POOLED, CHANCE, WIDE = 300, 5e-4, 5
#: Threshold where nothing lies below the heap of complete texts.
USUAL = -5.0

_PAD = max(EXACT) + 1
_DOTS = re.compile(r" ?(?:\.{2,}|…)+")
_REST = re.compile(r"(?:&#?\w{0,8}|<[^<>]{0,40}|�|…|\s)+\Z")
_LETTER = re.compile(r"[^\W\d_]")
#: Places of a text's contexts: class chain, character chain, and the dots with the characters before them.
_AT_EXACT, _AT_DOTS, _PLACES = len(CLASSED), len(CLASSED) + len(EXACT), len(CLASSED) + len(EXACT) + 1

# Odd multipliers of the rolling hash (modulo 2 ** 64) and of the final mixing.
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_B, _IB = _U(_BASE), _U(pow(_BASE, -1, 1 << 64))
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_OTHER, _UPPER, _LOWER = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def _salt(n: int) -> np.uint64:
    return _mix(np.array([n + 1], _U))[0]


class Alphabet:
    """Hash and kind of each character, filled in as characters occur."""

    def __init__(self) -> None:
        self.values = _mix(np.arange(1, 0x110001, dtype=_U))
        self.kinds = np.zeros(0x110000, np.uint8)
        self.seen = np.zeros(0x110000, bool)
        self.values[0] = 0

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.seen[codes].all():
            for c in np.unique(codes[~self.seen[codes]]).tolist():
                self.seen[c] = True
                if (ch := chr(c)).isdigit():
                    self.values[c] = self.values[ord("0")]
                elif ch.isalpha() or unicodedata.combining(ch):
                    self.kinds[c] = _UPPER if ch.isupper() else _LOWER
        return self.values[codes], self.kinds[codes]


def plain(text: str) -> str:
    """Without spaces at the end; dots in a row are one character."""
    text = text.rstrip()
    return _DOTS.sub("…", text) if ".." in text or "…" in text else text


class Windows:
    """The characters of some texts with the hash of any window of them."""

    def __init__(self, texts: list[str], alphabet: Alphabet) -> None:
        pad = "\0" * _PAD
        self.codes = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([_PAD + len(t) for t in texts]) - 1  # last character of each text
        values, self.kinds = alphabet.of(self.codes)
        n = len(values)
        power, self.back = np.full(n + 1, _B), np.full(n + 1, _IB)
        power[0] = self.back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def hash(self, last: np.ndarray, k: int) -> np.ndarray:
        """Of the k characters up to each place."""
        first = last + 1 - k
        return _mix((self.sums[last + 1] - self.sums[first]) * self.back[first] ^ _salt(k))

    def classed(self, start: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
        """Of the k characters before each word with the class of the word."""
        kind = np.where(upper, _salt(101), _salt(102))
        return _mix(kind) if k == 0 else _mix(self.hash(start - 1, k) ^ kind)


def _tail(text: str) -> tuple[str, str]:
    """The text's end, and the same without a cut's leavings (empty if nothing else is there)."""
    whole = text.rstrip()
    for size in TAILS:  # what is looked for usually stands in the first, shortest tail
        tail = plain(whole[-size:])
        bare = _REST.sub("", tail)
        held = bare or tail
        word = _word(held)
        if len(whole) <= size or (bare and len(held) - word > _PAD):
            break
    first = max(0, len(held) - word - 4 * ENDING)
    return tail[first:], bare[first:]


def _word(text: str) -> int:
    """Letters of the word at the text's end."""
    n = 0
    while n < len(text) and (_LETTER.match(c := text[-1 - n]) or unicodedata.combining(c)):
        n += 1
    return n


def _contexts(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Of the end of each text: contexts by place (0 where there is none), and how many character contexts lie within its
    last word."""
    w = Windows(texts, alphabet)
    word = np.array([_word(t) for t in texts], np.int64)
    out = np.zeros((len(texts), _PLACES), np.int64)
    start = w.ends - word + 1
    inside = word > 0
    first = np.minimum(start, w.ends)
    upper = w.kinds[first] == _UPPER
    for i, k in enumerate(CLASSED):
        out[inside, i] = w.classed(start[inside], upper[inside], k).view(np.int64)
    for i, k in enumerate(EXACT):
        out[:, _AT_EXACT + i] = w.hash(w.ends, k).view(np.int64)
    dots = w.codes[w.ends] == ord("…")
    out[dots, _AT_DOTS] = w.hash(w.ends[dots], _PAD).view(np.int64)
    return out, (np.array(EXACT) <= word[:, None]).sum(1) * inside


def final_contexts(texts: list[str], alphabet: Alphabet) -> dict[str, list]:
    """Of each text: contexts as it is and without a cut's leavings (empty without leavings), how many of its character
    contexts are within a word, whether the leavings are dots only, and the key of its ending; no contexts if there is nothing."""
    if not texts:
        return {n: [] for n in ("full", "skip", "bare", "bare_skip", "dots", "ending")}
    ends = [_tail(t) for t in texts]
    full, skip = _contexts([t for t, _ in ends], alphabet)
    cut = [i for i, (t, b) in enumerate(ends) if b and b != t]
    bare: list[list[int]] = [[] for _ in texts]
    bare_skip = np.zeros(len(texts), np.int64)
    if cut:
        rows, s = _contexts([ends[i][1] for i in cut], alphabet)
        for i, row in zip(cut, rows.tolist(), strict=True):
            bare[i] = row
        bare_skip[cut] = s
    dots = [bool(b) and t != b and t[len(b) :].strip() == "…" for t, b in ends]
    tails = Windows(["\0" * (ENDING - len(t)) + t for t, _ in ends], alphabet)
    key = tails.hash(tails.ends, ENDING).view(np.int64)
    return {"full": [f if t else [] for f, (t, _) in zip(full.tolist(), ends, strict=True)], "skip": skip.tolist(), "bare": bare, "bare_skip": bare_skip.tolist(), "dots": dots, "ending": key.tolist()}


def interior(texts: list[str], alphabet: Alphabet, needed=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the contexts at which these texts go on, with their counts. needed tells of an array of hashes which may be
    wanted; a longer context is wanted only if the shorter one is."""
    texts = [p for t in texts if (p := plain(t))]
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = Windows(texts, alphabet)
    final = np.zeros(len(w.codes), bool)
    final[w.ends] = True
    hashes, counts = [], []

    def keep(h: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        hit = needed(h) if needed is not None else np.ones(len(h), bool)
        codes, distinct = pd.factorize(h[hit])
        hashes.append(distinct.view(np.int64))
        counts.append(np.bincount(codes, n[hit] if n is not None else None, len(distinct)).astype(np.int64))
        return hit

    at = np.flatnonzero((w.codes != 0) & ~final)
    for k in EXACT:
        at = at[keep(w.hash(at, k), None)]
    letter = w.kinds > 0
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # texts begin with padding, so words start at even places
    start, stop = edge[::2], edge[1::2] if len(edge) % 2 == 0 else np.append(edge[1::2], len(letter))
    n, upper = stop - start - final[stop - 1], w.kinds[start] == _UPPER
    for k in CLASSED:
        hit = keep(w.classed(start, upper, k), n)
        start, upper, n = start[hit], upper[hit], n[hit]
    return _summed(np.concatenate(hashes), np.concatenate(counts))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with their counts added up, by a hash table."""
    codes, distinct = pd.factorize(h)
    return distinct, np.bincount(codes, n, len(distinct)).astype(np.int64)


def _blocks(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < chars:
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _chance(x: Column, own: Column) -> Column:
    """Probability of an end from (place, ends, continuations), from the shortest context to the longest."""
    ends = lambda r: F.greatest(F.lit(0), r["e"] - own)
    return F.aggregate(F.array_sort(x), F.lit(PRIOR), lambda p, r: (ends(r) + F.lit(SMOOTHING) * p) / (ends(r) + r["c"] + F.lit(SMOOTHING)))


def scores(documents: DataFrame) -> DataFrame:
    """documents: doc_id, lang, source, text -> doc_id, lang, source, score: log-odds that the text ends where it does."""
    spark = documents.sparkSession
    docs = spread(documents.filter("doc_id IS NOT NULL AND trim(text) <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", "text"))

    def finals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet = Alphabet()
        for pdf in batches:
            found = pd.DataFrame({n: pd.Series(v, dtype=object if n in ("full", "bare") else None) for n, v in final_contexts(pdf["text"].tolist(), alphabet).items()})
            out = pd.concat([pdf[["doc_id", "lang", "source"]].reset_index(drop=True), found], axis=1)
            yield out[found["full"].map(len) > 0]

    ends = stage(docs.mapInPandas(finals, "doc_id bigint, lang string, source string, full array<bigint>, skip int, bare array<bigint>, bare_skip int, dots boolean, ending bigint"), "ends")
    ended = ends.groupBy("ending").agg(F.first("full").alias("full")).select(F.explode("full").alias("h")).filter("h <> 0").groupBy("h").agg(F.count("*").alias("e"))
    # Texts with the same contexts are judged once.
    ends = ends.withColumn("g", F.xxhash64("full", "bare", "dots"))
    kinds = ends.groupBy("g").agg(*[F.first(c).alias(c) for c in ("full", "skip", "bare", "bare_skip", "dots")])
    slots = kinds.select("g", "skip", "bare_skip", F.posexplode(F.concat("full", "bare")).alias("i", "h")).filter("h <> 0")
    needed = stage(slots.groupBy("h").agg(F.count("*").alias("n")), "needed")
    bits = 1 << max(15, min(MOST_BITS.bit_length() - 1, (BITS_EACH * needed.count()).bit_length()))
    slot = F.pmod("h", F.lit(bits)) + 1
    bitmap = np.zeros(bits // 8, np.uint8)
    for r in needed.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).toLocalIterator():  # MOST_BITS / 32768 rows of 4 KB at most
        bitmap[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    held = spark.sparkContext.broadcast(bitmap)

    def goes_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alphabet, bitmap = Alphabet(), held.value

        def wanted(h: np.ndarray) -> np.ndarray:
            s = h & _U(bits - 1)  # pmod of a power of two
            return (bitmap[s >> _U(3)] >> (s & _U(7)).astype(np.uint8)) & 1 == 1

        hs: list[np.ndarray] = []
        ns: list[np.ndarray] = []
        size = 0
        for pdf in batches:
            for texts in _blocks(pdf["text"].tolist()):
                h, n = interior(texts, alphabet, wanted)
                hs.append(h)
                ns.append(n)
                size += len(h)
                if size > 2_000_000:
                    h, n = _summed(np.concatenate(hs), np.concatenate(ns))
                    hs, ns, size = [h], [n], len(h)
                    if size > 1_000_000:
                        yield pd.DataFrame({"h": h, "c": n})
                        hs, ns, size = [], [], 0
        if hs:
            h, n = _summed(np.concatenate(hs), np.concatenate(ns))
            yield pd.DataFrame({"h": h, "c": n})

    continued = docs.select("text").mapInPandas(goes_on, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    counts = needed.join(ended, "h", "left").join(continued, "h", "left")
    counts = stage(counts.select("h", "n", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("c", F.lit(0)).alias("c")), "counts")
    # Only contexts that hold the whole last word speak beside the class chain; the longest one also about dots.
    place, skip = F.col("i") % _PLACES, F.when(F.col("i") < _PLACES, F.col("skip")).otherwise(F.col("bare_skip"))
    speaks = (place < _AT_EXACT) | (place >= _AT_EXACT + skip)
    slots = slots.filter(speaks | (F.col("i") == _PLACES + _AT_DOTS - 1)).select("g", "h", F.when(speaks, F.col("i")).otherwise(-1).alias("i"))
    # A context of many texts is joined by broadcast: there are at most 2 * places / HOT_SHARE of them. The others are spread evenly.
    hot = F.col("n") >= max(LEAST_HOT, math.ceil(kinds.count() * HOT_SHARE))
    often = F.broadcast(counts.filter(hot).drop("n"))
    joined = slots.join(often, "h").unionByName(slots.join(often.select("h"), "h", "left_anti").join(counts.filter(~hot).drop("n"), "h"))
    by_kind = joined.groupBy("g").agg(F.collect_list(F.struct("i", "e", "c")).alias("x"))  # a few contexts of one text
    of = lambda test: F.filter("x", test)
    # Dots belong to an ending that has them in a fair share of the places of the characters before them.
    with_dots = F.aggregate(of(lambda r: r["i"] == _AT_DOTS), F.lit(0).cast("bigint"), lambda a, r: a + r["e"] - 1)
    before = of(lambda r: (r["i"] == _PLACES + _AT_DOTS - 1) | (r["i"] == -1))
    places = F.aggregate(before, F.lit(0).cast("bigint"), lambda a, r: a + r["e"] + r["c"])
    whole = (F.size("bare") == 0) | (F.col("dots") & (with_dots >= KNOWN_SHARE * (places + KNOWN_DOUBT)))
    p = F.when(whole, _chance(of(lambda r: (r["i"] >= 0) & (r["i"] < _AT_DOTS)), F.lit(1))).otherwise(_chance(of(lambda r: r["i"] >= _PLACES), F.lit(0)))
    scored = kinds.select("g", "dots", "bare").join(by_kind, "g").select("g", F.round(F.log(p / (1 - p)), 9).alias("score"))
    docs_of = ends.groupBy("doc_id").agg(F.min(F.struct("g", "lang", "source")).alias("d")).select("doc_id", "d.*")
    return docs_of.join(scored, "g").select("doc_id", "lang", "source", "score")  # g can be hot on the left only, which adaptive execution splits


def valley(shares: np.ndarray) -> float:
    """Middle of the deepest valley below the highest heap of a histogram: where the lower of the highest places on both
    sides is the largest multiple of what lies here. Of equal valleys the one next to the heap."""
    near = np.convolve(shares, np.ones(WIDE), "same")
    top = int(np.argmax(near))
    best, at = 1.0, None
    for i in range(top - 1, 0, -1):
        depth = (min(near[:i].max(), near[top]) + CHANCE) / (near[i] + CHANCE)
        if depth > best + 1e-9:
            best, at = depth, i
    return USUAL if at is None else RANGE[0] + (at + 0.5) * BIN


def thresholds(scored: DataFrame) -> DataFrame:
    """lang, source, least, total: the valley of each group's histogram.

    Groups of any size are judged alike: the fewer texts one has, the more the texts of its language and of the corpus say."""
    lo, hi = RANGE
    bins = round((hi - lo) / BIN)
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("score") - lo) / BIN))).cast("int")
    hist = stage(scored.groupBy("lang", "source", b.alias("b")).agg(F.count("*").alias("n")), "histogram")
    corpus = np.zeros(bins)
    for r in hist.groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most one row a bin
        corpus[r.b] = r.n
    if not corpus.sum():
        return hist.select("lang", "source", F.lit(USUAL).alias("least"), F.col("n").alias("total"))
    corpus /= corpus.sum()

    @F.pandas_udf("double")
    def least(own: pd.Series, language: pd.Series) -> pd.Series:
        def wide(rows) -> np.ndarray:
            out = np.zeros(bins)
            for r in rows:
                out[r["b"]] += r["n"]
            return out

        found = []
        for o, l in zip(own, language, strict=True):
            one, every = wide(o), wide(l)
            every = (every + POOLED * corpus) / (every.sum() + POOLED)
            found.append(valley((one + POOLED * every) / (one.sum() + POOLED)))
        return pd.Series(found, dtype=float)

    of_language = hist.groupBy("lang", "b").agg(F.sum("n").alias("n")).groupBy(F.col("lang").alias("l")).agg(F.collect_list(F.struct("b", "n")).alias("every"))
    groups = hist.groupBy("lang", "source").agg(F.collect_list(F.struct("b", "n")).alias("own"), F.sum("n").alias("total"))
    return groups.join(of_language, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", least("own", "every").alias("least"), "total")


def truncated(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, cut of all judged texts."""
    scored = stage(scores(documents), "scores")
    limits = stage(thresholds(scored).select(F.col("lang").alias("l"), F.col("source").alias("s"), "least"), "limits")
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    return scored.join(limits, same, "left").select("doc_id", "lang", "source", (F.col("score") < F.coalesce("least", F.lit(USUAL))).alias("cut"))


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, share."""
    by = truncated(documents).groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return by.withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
