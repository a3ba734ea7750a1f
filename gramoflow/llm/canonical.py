"""Free-entered values mapped to a canonical list: a BK-tree under a true edit metric.

The tree holds every written form of the reference entries: the entry, its label, the parts of the label, and other names
of the entry. Other names ("tape" for a cassette) are knowledge from outside, no matter of spelling: they are a parameter,
whose default holds those of record grades and carriers; another reference list brings its own or none. A value is reduced to its compact form (case, accents, punctuation and spaces go, a plus is spelled
out) and looked up with a radius that depends on its length only; the triangle inequality prunes the tree, and every form
within the radius comes back. The closest wins, then the entry with the lower position. A value that finds nothing as a
whole is looked up without its remarks ("poor - scratched", "mint (my grading)"); one that finds nothing at all is
reported as unmatched.

The distance is the unrestricted Damerau-Levenshtein distance, which, unlike optimal string alignment, satisfies the
triangle inequality.

Values are made distinct before the search. A reference list within SHARD_ENTRIES is broadcast whole; a longer one is cut
into shards that are searched one after the other and whose winners merge.

Cases: null and blank values are no cases; texts of any length are compared (a long one finds nothing within its
radius); ties go to the lower position; repeated rows come out once; without reference entries all values are
unmatched; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramoflow.operators.scale import sized_join, stage, within

UNMATCHED = "(unmatched)"
#: Entries of a reference list in one tree.
SHARD_ENTRIES = 20_000

# Other names of the entries, by entry.
OTHER_NAMES = {
    "M": ("mint", "mnt", "sealed", "still sealed", "brand new", "as new"),
    "NM": ("near mint", "nr mint", "nrmt", "n mint", "nearly mint", "almost mint", "mint minus", "mint-", "nm-", "m-", "nm/m-", "nm/m", "m/nm"),
    "VG+": ("very good plus", "vg plus", "vg++", "v good plus", "vgood plus", "v gd plus", "very gd plus", "very good +"),
    "VG": ("very good", "v good", "v gd", "very gd", "v g"),
    "G+": ("good plus", "gd plus", "g plus"),
    "G": ("good", "gd"),
    "F": ("fair", "fr"),
    "P": ("poor", "very poor", "pr"),
    "NG": ("not graded", "no grade", "ungraded", "n/g", "not graded yet", "not yet graded", "no grading"),
    "GENERIC": ("generic", "generic sleeve", "plain generic", "generic company sleeve", "company sleeve", "plain sleeve"),
    "NONE": ("none", "no cover", "no cvr", "no sleeve", "no slv", "without cover", "without sleeve", "w/o cover", "w/o sleeve", "missing cover", "missing sleeve", "cover missing", "sleeve missing", "disc only"),
    "Vinyl": ("vinyl record", "vinyls", "vynil", "vinly", "record", "lp", "lps", '12"', '10"', '7"', "12''", "10''", "7''", "12 inch", "10 inch", "7 inch", "12in", "10in", "7in", "vinyl lp"),
    "CD": ("cds", "compact disc", "compact disk", "cd album", "cd single", "audio cd"),
    "CDr": ("cd-r", "cdrs", "recordable cd", "burned cd", "cd recordable"),
    "Cassette": ("cass", "cassettes", "cassette tape", "tape cassette", "tape", "tapes", "mc", "k7", "musicassette"),
    "File": ("files", "mp3", "mp3 file", "flac", "wav", "digital", "digital file", "download", "digital download", "digital album", "flac file", "wav file"),
    "MiniDisc": ("md", "mini disc", "minidisk", "mini disk"),
    "Reel-To-Reel": ("reel", "reels", "reel tape", "reel 2 reel", "open reel", "r2r", "tape reel"),
    "8-Track Cartridge": ("8 track", "eight track", "8 track tape", "eight track cartridge", "8trk", "8-track cart"),
    "Shellac": ("78", "78 rpm", "shellac 78", "shellac record", "78 shellac"),
    "Flexi-disc": ("flexi", "flexi disk", "flexidisk", "flexible disc"),
    "Lathe Cut": ("lathe", "lathe cut record"),
    "Acetate": ("acetates", "dubplate", "dub plate", "dub plate acetate", "lacquer"),
    "SACD": ("super audio cd", "super audio compact disc", "sa-cd"),
    "DVD": ("dvds", "dvd disc", "dvd disk", "dvd video", "dvd audio"),
    "Box Set": ("box", "boxed set", "boxset", "box-set"),
}
# Words that add nothing to a grade.
_REMARKS = re.compile(r"\b(?:just|only|condition|cond|grade|graded as|about|approx|overall|maybe|i think|looks?|copy)\b\.?", re.I)
_PARENTHESES = re.compile(r"[(\[{][^)\]}]*[)\]}]")
_PIECES = re.compile(r"\s+[-–—/|]\s+|\s*[,;:]\s*|\s+[-–—/]|[(\[{)\]}]")


def compact(value: str) -> str:
    """Letters, digits and spelled-out signs only."""
    text = unicodedata.normalize("NFKD", value).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = text.replace("+", "plus").replace('"', "inch").replace("''", "inch").replace("”", "inch")
    text = re.sub(r"(?<=[mM])-(?=$|[\s/)\]!.])", "minus", text.strip())
    return re.sub(r"[^\w]|_", "", text)


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    if a == b:
        return 0
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, ca in enumerate(a, 1):
        match = 0
        for j, cb in enumerate(b, 1):
            k, m = last.get(cb, 0), match
            cost = 1
            if ca == cb:
                cost, match = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[ca] = i
    return d[-1][-1]


class BKTree:
    """Words with payloads; every word within a radius is found, by the triangle inequality."""

    def __init__(self) -> None:
        self.root: tuple[str, list, dict] | None = None

    def add(self, word: str, payload) -> None:
        if self.root is None:
            self.root = (word, [payload], {})
            return
        node = self.root
        while True:
            d = distance(word, node[0])
            if d == 0:
                node[1].append(payload)
                return
            if d not in node[2]:
                node[2][d] = (word, [payload], {})
                return
            node = node[2][d]

    def search(self, word: str, radius: int) -> list[tuple[int, str, list]]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            held, payloads, children = todo.pop()
            d = distance(word, held)
            if d <= radius:
                out.append((d, held, payloads))
            todo.extend(child for k, child in children.items() if d - radius <= k <= d + radius)
        return out


def radius(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def forms(entry: str, label: str | None, names: Mapping[str, tuple[str, ...]] = OTHER_NAMES) -> set[str]:
    """Compact written forms of a reference entry."""
    raw = {entry, label or entry, *names.get(entry, ())}
    if label:
        outside = _PARENTHESES.sub(" ", label).strip()
        inside = re.findall(r"[(\[{]([^)\]}]*)", label)
        raw |= {outside, *(p for i in inside for p in re.split(r"\s+or\s+|[,;/]", i))}
        raw |= {f"{outside} {p}" for i in inside for p in re.split(r"\s+or\s+|[,;/]", i)}
    return {c for r in raw if r and (c := compact(r))}


def trees(reference: Iterable[tuple[str, str, str | None, int]], names: Mapping[str, tuple[str, ...]] = OTHER_NAMES) -> dict[str, BKTree]:
    """field -> tree of the reference rows (field, entry, label, pos)."""
    out: dict[str, BKTree] = {}
    for field, entry, label, pos in sorted(reference, key=lambda r: (r[0], r[3], r[1])):
        for form in sorted(forms(entry, label, names)):
            out.setdefault(field, BKTree()).add(form, (pos, entry))
    return out


def closest(value: str, tree: BKTree | None) -> tuple[int, int, int, str] | None:
    """(step, distance, position, entry) of the best entry; step counts how much of the value was set aside."""
    if tree is None:
        return None
    tried: set[str] = set()
    whole = value.strip()
    bare = _REMARKS.sub(" ", whole)
    pieces = [p for p in _PIECES.split(whole) if p.strip()]
    steps = [[whole], [bare], [_PARENTHESES.sub(" ", bare)], pieces, [_REMARKS.sub(" ", p) for p in pieces], [w for w in bare.split() if len(w) > 3]]
    for step, texts in enumerate(steps):
        best = None
        for text in texts:
            word = compact(text)
            if not word or (word in tried and len(texts) == 1):
                continue
            tried.add(word)
            for d, _, payloads in tree.search(word, radius(word) if step < 5 else 0):
                for pos, entry in payloads:
                    if best is None or (step, d, pos, entry) < best:
                        best = (step, d, pos, entry)
        if best:
            return best
    return None


#: The trees of the reference list that this process searched last, by what they were built of.
_BUILT: dict[str, dict[str, BKTree]] = {}


def _trees_of(token: str, rows: list, names: Mapping[str, tuple[str, ...]]) -> dict[str, BKTree]:
    """The trees, built once in a process and not once a task."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = trees(rows, names)
    return _BUILT[token]


def map_values(values: DataFrame, reference: DataFrame, shard_entries: int = SHARD_ENTRIES, names: Mapping[str, tuple[str, ...]] = OTHER_NAMES) -> DataFrame:
    """values: field, value (distinct); reference: field, entry, entry_label, pos -> field, value, entry."""
    values = values.filter("trim(value) <> ''").select("field", "value").distinct()
    shards = 1 if within(reference, shard_entries) else -(-reference.count() // shard_entries)
    found = None
    for s in range(shards):
        part = reference if shards == 1 else reference.filter(F.pmod(F.xxhash64("entry"), F.lit(shards)) == s)
        rows = [(r.field, r.entry, r.entry_label, r.pos) for r in part.select("field", "entry", "entry_label", "pos").collect() if r.field is not None and r.entry is not None]  # at most about shard_entries
        held = values.sparkSession.sparkContext.broadcast(rows)

        def look(batches: Iterator[pd.DataFrame], held=held, token=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            by_field = _trees_of(token, held.value, names)
            for pdf in batches:
                best = [closest(v, by_field.get(f)) for f, v in zip(pdf["field"], pdf["value"], strict=True)]
                yield pd.DataFrame({"field": pdf["field"], "value": pdf["value"], "step": [b[0] if b else 99 for b in best], "d": [b[1] if b else 99 for b in best], "pos": [b[2] if b else 0 for b in best], "entry": [b[3] if b else UNMATCHED for b in best]})

        one = values.mapInPandas(look, "field string, value string, step int, d int, pos int, entry string")
        found = one if found is None else found.unionByName(one)
    if shards == 1:
        return found.select("field", "value", "entry")
    return found.groupBy("field", "value").agg(F.min_by("entry", F.struct("step", "d", "pos", "entry")).alias("entry"))


def map_rows(rows: DataFrame, values: DataFrame, reference: DataFrame, shard_entries: int = SHARD_ENTRIES, names: Mapping[str, tuple[str, ...]] = OTHER_NAMES) -> DataFrame:
    """rows: row_id, field, text; values: field, text, value for each distinct text -> row_id, field, entry.

    Values that already are an entry or a label are no cases."""
    exact = reference.select("field", F.explode(F.array("entry", "entry_label")).alias("value")).distinct()
    cases = values.filter("trim(value) <> ''").join(exact, ["field", "value"], "left_anti")
    entries = map_values(cases, reference, shard_entries, names)
    of_text = stage(cases.join(entries, ["field", "value"]).select("field", "text", "entry"), "entries")
    return sized_join(rows.filter("text IS NOT NULL").distinct(), of_text, ["field", "text"]).select("row_id", "field", "entry")
