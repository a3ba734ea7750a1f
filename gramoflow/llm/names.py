"""Variant spellings of names: a join on what near tokens have in common, with soft weighted verification.

1. Spellings are made distinct before anything else, so that a name on a third of all rows costs one row.
2. Every spelling becomes a bag of tokens: accents, case, punctuation and order go; titles, abbreviations of ensemble
   words and short forms of given names become one form; a text naming several artists is set aside; a number in
   parentheses stays with the key. Spellings of one bag form a class.
3. A class that has an artist id in the catalog is an anchor. The other classes look for partners: each rare token emits
   itself with up to as many letters left out as the edit bound allows, a long one pairs of its rarest q-grams instead (a
   two-gram prefix filter); a frequent token and what is near it emits that frequent token with another one or its initial;
   classes meet on those. Any two tokens within the edit bound share a key.
4. A candidate is verified token by token: each token needs a partner (equal, an initial of it, or within the edit
   bound), and the soft similarity weighs tokens by rarity, so that a family name counts more than ``trio``.
5. A class joins its most similar anchor; without one, its most frequent partner, whose root it inherits. An ``anv`` says
   by itself whose spelling it is. A class that is equally close to two anchors joins neither.

Weights depend on a token's share of all classes only, so they are the same at any size. Tokens and grams above a share
are the only ones kept in a broadcast list; their number is bounded by that share, not by the data.

What short forms and nicknames stand for is knowledge from outside, no matter of spelling: it is a parameter (``Knowledge``),
whose default holds forms of ensembles and of given names.

Cases: null and empty texts are no spellings; texts without any letter or digit form no class; repeated rows count once;
very long texts are compared by their tokens like others; an empty table gives no pairs; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramoflow.operators.scale import stage

#: A token or gram above this share of the classes is frequent: it is no join key by itself (tokens) or comes last (grams).
FREQUENT_SHARE = 1 / 400
LEAST_FREQUENT = 5
#: A token of this share of the classes, or less, has the full weight; a more frequent one weighs less by the logarithm of its share.
WEIGHT_SHARE = 1 / 100_000
#: Least soft similarity of a link.
THRESHOLD = 0.8
#: Texts of more tokens meet others by single tokens and their number of tokens, not by pairs of frequent tokens.
MOST_TOKENS = 40
#: What an initial without a partner takes from the similarity.
EXTRA_INITIAL = 0.02
#: Initials without a partner that a link can have.
MOST_EXTRA = math.ceil((1 - THRESHOLD) / EXTRA_INITIAL) + 1
Q = 3
#: Steps of doubling (ways of 2 to this power) after which links are searched for circles.
CIRCLE_STEPS = 5
#: Tokens of so many letters have two grams left after three edits.
LONG = 14

# Words of ensembles and titles with their usual short forms.
SHORT_FORMS = {
    "orch": "orchestra", "orchestre": "orchestra", "orq": "orchestra", "ens": "ensemble", "ensmbl": "ensemble", "qt": "quartet", "qrt": "quartet", "qtet": "quartet", "4tet": "quartet", "quart": "quartet",
    "qnt": "quintet", "5tet": "quintet", "quint": "quintet", "sxt": "sextet", "6tet": "sextet", "sext": "sextet", "7tet": "septet", "8tet": "octet", "co": "company", "comp": "company", "cie": "company",
    "coll": "collective", "collect": "collective", "bros": "brothers", "brs": "brothers", "srs": "sisters", "sis": "sisters", "sist": "sisters", "chmbr": "chamber", "chmb": "chamber", "ch": "choir", "chr": "choir",
    "bnd": "band", "bd": "band", "grp": "group", "gp": "group", "sys": "system", "syst": "system", "snd": "sound", "3": "trio", "4": "quartet", "5": "quintet", "6": "sextet",
    "deejay": "dj", "mister": "mr", "mistress": "mrs", "doctor": "dr", "doc": "dr", "emcee": "mc", "professor": "prof", "saint": "st",
}
JOINED_FORMS = {"soundsystem": ("sound", "system"), "bigband": ("big", "band"), "chamberchoir": ("chamber", "choir"), "chambrechoir": ("chamber", "choir")}
# Short forms of given names.
NICKNAMES = {
    "alex": "alexander", "sasha": "alexander", "al": "alan", "tony": "anthony", "andy": "andrew", "drew": "andrew", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "chuck": "charles",
    "charlie": "charles", "charly": "charles", "chris": "christopher", "topher": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "debra": "deborah",
    "dima": "dmitri", "mitya": "dmitri", "dolly": "dorothy", "dot": "dorothy", "dottie": "dorothy", "ed": "edward", "eddie": "edward", "eddy": "edward", "ted": "edward", "ned": "edward", "teddy": "theodore", "theo": "theodore",
    "betty": "elizabeth", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lizzy": "elizabeth", "eliza": "elizabeth", "bess": "elizabeth", "libby": "elizabeth", "lisa": "elizabeth", "ellie": "eleanor", "nell": "eleanor", "nora": "eleanor", "paco": "francisco", "pancho": "francisco",
    "fran": "francisco", "fred": "frederick", "freddy": "frederick", "freddie": "frederick", "fritz": "friedrich", "gerry": "gerald", "jerry": "gerald", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "lupe": "guadalupe", "lupita": "guadalupe", "hank": "henry", "harry": "henry", "nacho": "ignacio", "jim": "james", "jimmy": "james", "jamie": "james",
    "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "hans": "johannes", "hannes": "johannes", "jack": "john", "johnny": "john", "jon": "john", "joe": "joseph", "joey": "joseph", "pepe": "jose", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kay": "katherine", "kitty": "katherine", "larry": "lawrence", "laurie": "lawrence", "lars": "lawrence",
    "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "peg": "margaret", "marge": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "micky": "michael", "mickey": "michael", "misha": "mikhail", "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "klaus": "nicholas", "pat": "patricia", "patty": "patricia", "patti": "patricia", "trish": "patricia", "tricia": "patricia",
    "rich": "richard", "rick": "richard", "ricky": "richard", "dick": "richard", "rob": "robert", "robbie": "robert", "bob": "robert", "bobby": "robert", "bert": "robert", "sam": "samuel", "sammy": "samuel", "basti": "sebastian", "seb": "sebastian", "bastian": "sebastian", "sue": "susan", "susie": "susan", "suzy": "susan", "suzie": "susan", "tom": "thomas", "tommy": "thomas", "bill": "william", "billy": "william", "will": "william", "willy": "william", "willie": "william", "liam": "william", "vova": "vladimir", "volodya": "vladimir", "kolya": "nikolai", "tomek": "tomasz", "zosia": "zofia",
}
# Words that say what an artist is, not which.
KINDS = frozenset(
    "dj mc mr mrs ms dr prof st sir lady trio quartet quintet sextet septet octet band big orchestra ensemble collective company brothers sisters chamber choir sound system group his her their the and singers players project crew family".split()
)
_DROPPED = frozenset(("the", "and"))
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ħ": "h", "ŧ": "t"})
_NUMBER = re.compile(r"\s*\((\d{1,4})\)\s*$")
_QUOTED_NICK = re.compile(r"\s[\"“”‘'«(](\w[\w .-]*)[\"“”’'»)](?=\s)")
_SEVERAL = re.compile(r"\s(?:&|\+|/|and|und|et|y|with|feat\.?|ft\.?|featuring|vs\.?|presents|meets)\s(?!(?:his|her|their|the\s+(?:band|orchestra))\b)|\s?[;|]\s?|\s/\s?|/\s", re.I)
_DOTTED = re.compile(r"\b((?:\w\.){2,})")
_TITLE_GLUED = re.compile(r"^(DJ|MC|Mr|Dr)(?=[A-ZÀ-Þ][a-zà-ÿ])")


@dataclass(frozen=True)
class Knowledge:
    """What a word stands for: short forms, words written as one, nicknames."""

    short_forms: Mapping[str, str] = field(default_factory=lambda: SHORT_FORMS)
    joined_forms: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: JOINED_FORMS)
    nicknames: Mapping[str, str] = field(default_factory=lambda: NICKNAMES)


USUAL_KNOWLEDGE = Knowledge()


def tokens_of(text: str, known: Knowledge = USUAL_KNOWLEDGE) -> tuple[list[str], str, bool]:
    """Tokens in order of value, the number in parentheses, and whether the text names several artists."""
    text = " ".join(text.split())
    number = ""
    if m := _NUMBER.search(text):
        number, text = str(int(m.group(1))), text[: m.start()]
    several = bool(_SEVERAL.search(text))
    if text.count(",") > 1:
        several = True
    elif "," in text:
        left, right = (re.findall(r"\w{2,}", p) for p in text.split(","))
        lower = {w.lower() for w in right}
        several |= len([w for w in left if w.lower() not in KINDS]) > 1 and len([w for w in right if w.lower() not in KINDS]) > 1 and not lower <= KINDS
    text = _QUOTED_NICK.sub(" ", text) if text.count(" ") > 1 else text
    text = _TITLE_GLUED.sub(r"\1 ", text)
    text = unicodedata.normalize("NFKD", text).casefold().translate(_LETTERS)
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = _DOTTED.sub(lambda m: m.group(1).replace(".", "") + " ", text) if not re.search(r"\b\w\.\s*\w\.\s+\w", text) or re.match(r"(?:d\.j\.|m\.c\.)", text) else text
    out: list[str] = []
    for w in re.findall(r"[^\W_]+", text.replace("'", "").replace("’", "")):
        w = known.short_forms.get(w, w)
        w = known.nicknames.get(w, w)
        out.extend(known.joined_forms.get(w, (w,)))
    kept = [w for w in out if w not in _DROPPED] or out
    return sorted(kept), number, several


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        row = [i]
        for j, cb in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def edits_allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


def token_similarity(a: str, b: str) -> float:
    """1 for equal tokens, 0.9 for an initial, 1 - distance / length within the edit bound, else 0."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] and min(len(a), len(b)) == 1 and a not in KINDS and b not in KINDS else 0.0
    n = max(len(a), len(b))
    most = edits_allowed(n)
    d = edit_distance(a, b, most)
    return 1 - d / n if d <= most else 0.0


def soft_similarity(a: list[str], b: list[str], weight) -> float:
    """Weighted share of matched tokens. Each token longer than an initial needs a partner; else the similarity is 0."""
    if min(len(a), len(b)) == 0:
        return 1.0 if a == b else 0.0
    left, right = list(a), list(b)
    pairs: list[tuple[str, str, float]] = []
    for x in a:  # equal tokens first
        if x in right:
            left.remove(x)
            right.remove(x)
            pairs.append((x, x, 1.0))
    scored = []
    for x in left:
        of = [(token_similarity(x, y), x, y) for y in right]
        if len(x) > 1 and not any(s for s, *_ in of):
            return 0.0
        scored += of
    for s, x, y in sorted(scored, reverse=True):
        if s > 0 and x in left and y in right:
            left.remove(x)
            right.remove(y)
            pairs.append((x, y, s))
    if any(len(x) > 1 for x in left + right) or (left and right):  # initials that differ speak for different people
        return 0.0
    if not any(len(x) > 2 and len(y) > 2 and x not in KINDS for x, y, _ in pairs):
        return 0.0
    if any(len(x) == 1 < len(y) for x, y, _ in pairs) and any(len(y) == 1 < len(x) for x, y, _ in pairs):
        return 0.0  # "Pablo F. Babarem" and "Pablo B. Fapawevis"
    total = got = 0.0
    for x, y, s in pairs:
        w = max(weight(x), weight(y)) if min(len(x), len(y)) > 1 else 0.2
        total += w
        got += w * s
    extra = EXTRA_INITIAL * len(left + right)
    return got / total - extra


def spellings(sources: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """text, n, anchored: the distinct non-empty texts of the columns; with an id column, whether any row has an id."""
    out = None
    for df, text, anchor in sources:
        a = F.max((F.col(anchor).isNotNull() & (F.col(anchor) != 0)).cast("int")) if anchor else F.lit(0)
        one = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n"), F.coalesce(a, F.lit(0)).alias("anchored"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("text").agg(F.sum("n").alias("n"), F.max("anchored").alias("anchored"))


def _gram_hash(g: str) -> int:
    return xxhash.xxh64_intdigest(g) >> 1


def grams(token: str) -> list[str]:
    padded = f"^{token}$"
    return sorted({padded[i : i + Q] for i in range(len(padded) - Q + 1)})


def prefix_keys(token: str, order) -> list[str]:
    """The gram pairs within the token's prefix. Grams that repeat are numbered; an edit changes Q + 1 of them at most (a
    swap of letters), so that tokens within the edit bound share a pair as long as two grams are left."""
    seen: dict[str, int] = {}
    gs = []
    padded = f"^{token}$"
    for g in (padded[i : i + Q] for i in range(len(padded) - Q + 1)):
        seen[g] = seen.get(g, 0) + 1
        gs.append((order(g), seen[g], g if seen[g] == 1 else f"{g}{seen[g]}"))
    prefix = [g for *_, g in sorted(gs)[: (Q + 1) * edits_allowed(len(token)) + 2]]
    return [f"{a}|{b}" for a, b in combinations(sorted(prefix), 2)] or prefix


def deletions(token: str, most: int) -> set[str]:
    """The token with up to so many letters left out. Tokens within the edit bound have one of these in common: an edit
    leaves out a letter of either or of both, also a swap."""
    out = level = {token}
    for _ in range(most):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out = out | level
    return out


def near_keys(token: str, order) -> set[str]:
    """Keys of which any two tokens within the edit bound share one: deletions, for long tokens gram pairs. Tokens that can
    be near both kinds have both."""
    most = edits_allowed(len(token))
    out = {f"={d}" for d in deletions(token, most)} if len(token) < LONG + most else set()
    return out | set(prefix_keys(token, order)) if len(token) >= LONG else out


class Nearest:
    """The frequent tokens within the edit bound of a token, itself included; letter counts rule out most of them.

    ``kinds`` finds those of the kinds of artists, which are no words of a name."""

    def __init__(self, heavy: dict[str, int] | frozenset[str], kinds: bool = False):
        self.heavy = sorted(h for h in heavy if len(h) > 1 and (h in KINDS) == kinds)
        self.kinds = None if kinds else Nearest(KINDS, True)
        self.counts = np.array([self._count(h) for h in self.heavy], dtype=np.int16).reshape(-1, 32)
        self.lengths = self.counts.sum(1)
        self.known: dict[str, list[str]] = {}
        self.firsts: dict[str, frozenset[str]] = {}

    @staticmethod
    def _count(token: str) -> np.ndarray:
        return np.bincount([ord(c) % 32 for c in token], minlength=32)

    def __call__(self, token: str) -> list[str]:
        if token not in self.known:
            most = edits_allowed(len(token) + 3)
            apart = np.abs(self.counts - self._count(token)).sum(1)  # an edit changes it by 2 at most
            at = np.flatnonzero((apart <= 2 * most) & (np.abs(self.lengths - len(token)) <= most))
            self.known[token] = [h for h in (self.heavy[i] for i in at) if token_similarity(token, h) > 0]
        return self.known[token]

    def initials(self, token: str) -> frozenset[str]:
        """The first letters of the token and of the frequent tokens and kinds near it."""
        if token not in self.firsts:
            self.firsts[token] = frozenset(t[0] for t in (token, *((*self(token), *self.kinds(token)) if len(token) > 1 else ())))
        return self.firsts[token]


def _initials(rest: list[str], nearest: Nearest) -> list[str]:
    """The initials under which the other tokens are met, also if slips are in first letters: those of the frequent tokens
    and kinds near them count as well. None too if they are initials, as these may be missing."""
    return sorted(set().union(*map(nearest.initials, rest)) | ({""} if all(len(r) == 1 for r in rest) else set()))


def join_keys(tokens: list[str], nearest: Nearest, order, seeking: bool) -> set[tuple[int, str]]:
    """(key, token) under which a class meets others, as the one that seeks or the one that is found.

    Each rare token emits its near_keys, whatever the other tokens are, as these can have slips anywhere.

    Two classes without a rare token in common can still be one name: then all that they share is frequent tokens, slips
    in these and initials. For that a token stands for each frequent token near it. Two such tokens are a key together
    with the initial of a further one, and one such token with the initial of another one. As initials stand for names of
    one side only, one of the two classes has no word besides frequent ones (two tokens) or besides one (one token); it
    is "bare", and bare classes meet all, but the others only bare ones: a key on a third of all classes joins with few.
    A word near a kind (sister, sisters) can stand for that kind, so it counts for neither; where nothing but such words
    is shared, the class that seeks meets the held kind with the initial of another token."""
    out: set[tuple[int, str]] = set()
    words = [t for t in tokens if len(t) > 1 and t not in KINDS]
    for t in {t for t in words if t not in nearest(t)}:
        out.update((_gram_hash(k), t) for k in near_keys(t, order))

    def meet(key: str, bare: bool, token: str) -> None:
        # "<": sought by bare classes, held by all. ">": sought by the others, held by bare classes.
        if bare or not seeking:
            out.add((_gram_hash(f"<{key}"), token))
        if bare != seeking:
            out.add((_gram_hash(f">{key}"), token))

    known = [(t, nearest(t)) for t in words]
    if len(tokens) > MOST_TOKENS - MOST_EXTRA:
        # The pairs of a long text's tokens are too many. As all words need partners and only initials may be left over,
        # two names have a number between their words and their tokens in common, beside each of their words.
        for t, near in known:
            for h in near:
                out.update((_gram_hash(f"{h}#{n}"), t) for n in range(len([x for x in tokens if len(x) > 1]), len(tokens) + 1))
    if len(tokens) > MOST_TOKENS:
        return out
    common = [(t, near) for t, near in known if near]
    own = [(t, near) for t, near in known if not nearest.kinds(t)]
    single, all_common = len(own) < 2, all(near for _, near in own)
    for t in {t for t in tokens if len(t) > 2 and (t in KINDS) != seeking}:
        rest = list(tokens)
        rest.remove(t)
        for k in nearest.kinds(t) if seeking else [t]:
            out.update((_gram_hash(f"~{k}|{i}"), t) for i in _initials(rest, nearest))
    for j, (t, near) in enumerate(common):
        rest = list(tokens)
        rest.remove(t)
        met = _initials(rest, nearest)
        for h in near:
            for i in met:
                meet(f"{h}|{i}", single, t)
        for u, others in common[j + 1 :]:
            further = list(rest)
            further.remove(u)
            met = _initials(further, nearest)
            for h in near:
                for o in others:
                    for i in met:
                        first, token = min((h, t), (o, u))
                        meet(f"{first} {max(h, o)}|{i}", all_common, token)
    return out


def _follow(edges: DataFrame, steps: int | None = None) -> tuple[DataFrame, bool]:
    """cls, root, done with every way followed to its end, and whether all ended within the steps; each doubles the ways."""
    while not edges.filter("NOT done").isEmpty():
        if steps == 0:
            return edges, False
        steps = None if steps is None else steps - 1
        up = edges.select(F.col("cls").alias("root"), F.col("root").alias("above"), F.col("done").alias("end"))
        further = edges.filter("NOT done").join(up, "root").select("cls", F.col("above").alias("root"), F.col("end").alias("done"))
        edges = stage(edges.filter("done").unionByName(further).distinct(), "roots")
    return edges, True


def roots_of(parents: DataFrame) -> DataFrame:
    """cls, root: where the parents of each class lead. parents: cls, root; a class can have several and be one of its own.

    A class that is its own parent is a root, also if it has others. Classes that lead to each other in a circle have
    the same roots: those to which any way leads out of it, or else the least of them."""
    edges = stage(parents.select("cls", "root", (F.col("cls") == F.col("root")).alias("done")).distinct(), "roots")
    followed, whole = _follow(edges, CIRCLE_STEPS)
    if whole:
        return followed.select("cls", "root").distinct()
    # What still goes on leads into a circle, or is very long. Circles become one class each, then every way ends.
    core = stage(followed.filter("NOT done").select("cls").distinct(), "core")
    inner = edges.filter("NOT done").join(core, "cls", "left_semi").join(core.select(F.col("cls").alias("root")), "root", "left_semi").select("cls", "root")
    reach, n, known = stage(inner, "reach"), -1, 0
    while n != known:
        n, up = known, reach.select(F.col("cls").alias("root"), F.col("root").alias("above"))
        reach = stage(reach.unionByName(reach.join(up, "root").select("cls", F.col("above").alias("root"))).distinct(), "reach")
        known = reach.count()
    back = reach.select(F.col("root").alias("cls"), F.col("cls").alias("root"))
    heads = stage(reach.join(back, ["cls", "root"]).groupBy("cls").agg(F.min(F.least("cls", "root")).alias("head")), "heads")
    above = heads.select(F.col("cls").alias("root"), F.col("head").alias("top"))
    merged = edges.join(heads, "cls", "left").join(above, "root", "left").select(F.coalesce("head", "cls").alias("cls"), F.when(F.col("done"), F.col("root")).otherwise(F.coalesce("top", "root")).alias("root"), "done")
    merged = merged.filter("done OR cls <> root").distinct()
    closed = heads.select(F.col("head").alias("cls")).distinct().join(merged.select("cls"), "cls", "left_anti").select("cls", F.col("cls").alias("root"), F.lit(True).alias("done"))
    ended = _follow(stage(merged.unionByName(closed), "roots"))[0].select("cls", "root")
    others = heads.filter("cls <> head").join(ended.select(F.col("cls").alias("head"), "root"), "head").select("cls", "root")
    return ended.unionByName(others).distinct()


def links(texts: DataFrame, said: DataFrame | None = None, threshold: float = THRESHOLD, knowledge: Knowledge = USUAL_KNOWLEDGE) -> DataFrame:
    """text, root: the group of each spelling; a spelling can be of several artists.

    texts: text, n, anchored; said: name, anv - spellings whose artist is known."""
    spark = texts.sparkSession

    @F.pandas_udf("tokens array<string>, number string, several boolean")
    def parse(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tokens_of(t, knowledge) for t in column], columns=["tokens", "number", "several"])

    # Staged, as else the filters on what is parsed would move below the aggregation, to every row.
    parsed = stage(texts, "texts").withColumn("t", parse("text")).select("text", "n", "anchored", "t.tokens", "t.number", "t.several").filter(~F.col("several") & (F.size("tokens") > 0))
    named = stage(parsed.withColumn("cls", F.xxhash64("number", F.concat_ws(" ", "tokens"))).drop("several"), "spellings")
    classes = named.groupBy("cls").agg(F.first("tokens").alias("tokens"), F.first("number").alias("number"), F.sum("n").alias("n"), F.max("anchored").alias("anchored"))
    classes = stage(classes, "classes")
    total = classes.count()
    floor = max(LEAST_FREQUENT, math.ceil(total * FREQUENT_SHARE))
    held = stage(classes.select(F.explode(F.array_distinct("tokens")).alias("v")).groupBy("v").agg(F.count("*").alias("n")), "tokens")
    heavy_tokens = {r.v: r.n for r in held.filter(F.col("n") > floor).collect()}  # at most tokens a class / FREQUENT_SHARE
    token_list = spark.sparkContext.broadcast(heavy_tokens)
    rare = F.filter("tokens", lambda t: (F.length(t) > 1) & ~t.isin(*sorted(KINDS)))

    @F.pandas_udf("array<string>")
    def all_grams(lists: pd.Series) -> pd.Series:
        return pd.Series([sorted({g for t in ts if t not in token_list.value for g in grams(t)}) for ts in lists])

    weighed = spark.sparkContext.broadcast({r.v: r.n for r in held.filter(F.col("n") >= total * WEIGHT_SHARE).collect()})  # at most tokens a class / WEIGHT_SHARE

    gram_counts = classes.select(F.explode(all_grams(rare)).alias("v")).groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") > floor)
    gram_list = spark.sparkContext.broadcast({r.v: r.n for r in gram_counts.collect()})  # at most grams a class / FREQUENT_SHARE

    def keys(seeking: bool):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            many, nearest = gram_list.value, Nearest(token_list.value)
            order = lambda g: (many.get(g, 0), _gram_hash(g))
            for pdf in batches:
                rows = []
                for cls, number, ts in zip(pdf["cls"].tolist(), pdf["number"], pdf["tokens"], strict=True):
                    rows.extend((cls, k ^ _gram_hash(number) if number else k, t) for k, t in join_keys(list(ts), nearest, order, seeking))
                yield pd.DataFrame(rows, columns=["cls", "k", "t"])

        return of

    keyed = classes.select("cls", "number", "tokens").mapInPandas(keys(False), "cls bigint, k bigint, t string")
    seeking = classes.filter("anchored = 0").select("cls", "number", "tokens").mapInPandas(keys(True), "cls bigint, k bigint, t string").select(F.col("cls").alias("r"), "k", F.col("t").alias("rt"))
    # The token that led here must be near: a swap of letters counts twice in this distance.
    near = F.levenshtein("rt", "t", 6) >= 0
    longest = F.greatest(F.length("rt"), F.length("t"))
    bound = 2 * F.when(longest < 4, 0).when(longest < 6, 1).when(longest < 12, 2).otherwise(3)
    candidates = seeking.join(keyed.select(F.col("cls").alias("s"), "k", "t"), "k").filter((F.col("r") != F.col("s")) & near & (F.levenshtein("rt", "t", 6) <= bound)).select("r", "s").distinct()

    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        of, top = weighed.value, math.log(1 / WEIGHT_SHARE)
        weight = lambda t: max(0.05, min(1.0, math.log(total / of[t]) / top)) if t in of else 1.0
        return pd.Series([soft_similarity(list(x), list(y), weight) for x, y in zip(a, b, strict=True)], dtype=float)

    side = classes.select("cls", "tokens", "n", "anchored")
    scored = (
        candidates.join(side.select(F.col("cls").alias("r"), F.col("tokens").alias("ra"), F.col("n").alias("rn")), "r")
        .join(side.select(F.col("cls").alias("s"), F.col("tokens").alias("sa"), F.col("n").alias("sn"), "anchored"), "s")
        .withColumn("score", F.round(similar("ra", "sa"), 6))
        .filter(F.col("score") >= threshold)
        .select("r", "s", "rn", "sn", "anchored", "score")
    )
    scored = stage(scored, "scored")
    # The best anchor, if no other is as good.
    to_anchor = scored.filter("anchored = 1").groupBy("r").agg(F.max_by("s", "score").alias("s"), F.max("score").alias("top"), F.collect_list("score").alias("all"))
    to_anchor = to_anchor.select(F.col("r").alias("cls"), F.when(F.size(F.filter("all", lambda x: x >= F.col("top") - 1e-9)) == 1, F.col("s")).alias("parent"))
    # Without an anchor, the most frequent partner that comes before it in a fixed order.
    # A partner that has an anchor leads on to it, so that it need not come before.
    settled = to_anchor.filter("parent IS NOT NULL").select(F.col("cls").alias("s"), F.lit(True).alias("settled"))
    ahead = (F.col("sn") > F.col("rn")) | ((F.col("sn") == F.col("rn")) & (F.col("s") > F.col("r"))) | F.col("settled")
    to_other = scored.filter("anchored = 0").join(settled, "s", "left").filter(ahead).join(to_anchor.select(F.col("cls").alias("r")), "r", "left_anti")
    to_other = to_other.groupBy("r").agg(F.max_by("s", F.struct("score", "sn", "s")).alias("parent")).withColumnRenamed("r", "cls")
    parents = to_anchor.filter("parent IS NOT NULL").unionByName(to_other)
    roots = classes.select("cls").join(parents, "cls", "left").select("cls", F.coalesce("parent", "cls").alias("root"))
    if said is not None:
        of = named.select("text", "cls")
        pairs = said.join(of.withColumnsRenamed({"text": "name", "cls": "owner"}), "name").join(of.withColumnsRenamed({"text": "anv", "cls": "cls"}), "anv").filter("owner <> cls").select("cls", "owner").distinct()
        # What rows say replaces what similarity found, but an anchor stays its own artist as well.
        free = pairs.join(classes.filter("anchored = 0").select("cls"), "cls", "left_semi")
        roots = roots.join(free.select("cls").distinct(), "cls", "left_anti").unionByName(pairs.select("cls", F.col("owner").alias("root")))
        roots = roots.distinct()
    roots = roots_of(roots)
    return named.select("text", "cls").join(roots, "cls").select("text", "root").distinct()


def members(linked: DataFrame) -> DataFrame:
    """text, root, n_links: every spelling with its groups and the number of other spellings in each.

    Unlike ``pairs`` this stays in proportion to the spellings, whatever the size of a group."""
    return linked.join(linked.groupBy("root").agg((F.count("*") - 1).alias("n_links")), "root").select("text", "root", "n_links")


def pairs(linked: DataFrame) -> DataFrame:
    """spelling_a < spelling_b of one group, in byte order."""
    a, b = linked.select(F.col("text").alias("spelling_a"), "root"), linked.select(F.col("text").alias("spelling_b"), "root")
    return a.join(b, "root").filter("spelling_a < spelling_b").select("spelling_a", "spelling_b").distinct()

