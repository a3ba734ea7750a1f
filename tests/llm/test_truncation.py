import itertools
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gramoflow.llm import truncation as tr


def corpus(n, seed):
    rnd = random.Random(seed)
    nouns, adjectives, places = ["violin", "organ", "sleeve", "tape", "drone", "chorus"], ["smoky", "brittle", "gentle", "woozy", "solemn"], ["Kupe", "Zarond", "Towon", "Nogal"]
    sentence = lambda: rnd.choice([
        f"The {rnd.choice(adjectives)} {rnd.choice(nouns)} fades under a {rnd.choice(adjectives)} {rnd.choice(nouns)}.", f"Pressed in {rnd.choice(places)} in {rnd.randint(1950, 2020)}, this copy has a {rnd.choice(adjectives)} {rnd.choice(nouns)}.", f"What a {rnd.choice(adjectives)} {rnd.choice(nouns)} Mei found in spring!",
    ])
    docs = []
    for i in range(n):
        text = " ".join(sentence() for _ in range(rnd.randint(2, 7)))
        text += rnd.choice(["", "", "", "\n— " + "".join(rnd.choices("abcdefgh", k=6)).capitalize(), "\nthanks all", f"\nA1 Velvet Tape {rnd.randint(1, 9)}:{rnd.randint(10, 59)}"])
        cut = False
        if i % 10 == 0:
            body = text[: rnd.randint(30, 90)]
            while body.rstrip()[-1] in ".!?":
                body = body.rstrip()[:-1]
            text, cut = body + rnd.choice(["", "", "...", "�", "<b", "&am"]), True
        docs.append((i, text, cut))
    return docs


def test_held_out_accuracy(spark):
    docs = corpus(3000, 1)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in docs], "doc_id bigint, text string, lang string, source string, score int")
    got = {r.doc_id for r in tr.truncated(df).filter("cut").collect()}
    want = {i for i, _, c in docs if c}
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.02 * len(docs)
    rates = tr.truncation_rates(df).collect()
    assert rates[0].n_texts == 3000 and rates[0].n_cut == len(got)


def test_cases(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (3, "  \n", "en", "s"), (4, "x" * 100_000, None, "s"), (5, "A text.", "en", "s"), (5, "A text.", "en", "s"), (None, "A text.", "en", "s"), (6, "\ufffd", "en", "s"), (7, "." * 5000 + "x", "en", "s"), (8, "\u0301", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert sorted(r.doc_id for r in tr.truncated(df).collect()) == [4, 5, 6, 7, 8]
    assert tr.truncated(df.limit(0)).count() == 0


def brute_force(texts):
    """Counts of going on by context, as text: ("", characters) or (class of the word, characters before it)."""
    counts = {}
    for t in texts:
        t = "\0" * tr._PAD + "".join("0" if c.isdigit() else c for c in tr.plain(t))
        for i in range(tr._PAD, len(t) - 1):
            for k in tr.EXACT:
                key = ("", t[i + 1 - k : i + 1])
                counts[key] = counts.get(key, 0) + 1
        at = tr._PAD
        while at < len(t):
            end = at
            while end < len(t) and t[end].isalpha():
                end += 1
            for k in tr.CLASSED if end > at else ():
                key = ("U" if t[at].isupper() else "l", t[at - k : at])
                counts[key] = counts.get(key, 0) + end - at - (end == len(t))
            at = max(end, at + 1)
    return counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .\u00e9\u2026", min_size=1, max_size=30), min_size=1, max_size=4))
def test_counts_equal_brute_force(texts):
    alphabet = tr.Alphabet()
    h, n = tr.interior(texts, alphabet)
    got = dict(zip(h.tolist(), n.tolist(), strict=True))
    want = brute_force([t for t in texts if t.strip()])
    assert sum(n.tolist()) == sum(want.values())
    for t in texts:
        if p := tr.plain(t):
            row = tr.final_contexts([t], alphabet)["full"][0]
            p = "\0" * tr._PAD + "".join("0" if c.isdigit() else c for c in p)
            word = tr._word(p)
            for i, k in enumerate(tr.EXACT):
                assert got.get(row[len(tr.CLASSED) + i], 0) == want.get(("", p[len(p) - k :]), 0)
            if word:
                start = len(p) - word
                for i, k in enumerate(tr.CLASSED):
                    assert got.get(row[i], 0) == want.get(("U" if p[start].isupper() else "l", p[start - k : start]), 0)


def test_filter_drops_nothing_needed():
    """Counts behind a filter that knows all final contexts equal those without one, for these contexts."""
    alphabet = tr.Alphabet()
    texts = [t for _, t, _ in corpus(200, 5)]
    found = tr.final_contexts(texts, alphabet)
    needed = {h for row in found["full"] + found["bare"] for h in row} - {0}
    everything = dict(zip(*(x.tolist() for x in tr.interior(texts, alphabet)), strict=True))
    some = dict(zip(*(x.tolist() for x in tr.interior(texts, alphabet, lambda h: np.isin(h.view(np.int64), list(needed)))), strict=True))
    assert some == {h: n for h, n in everything.items() if h in needed}


def test_rare_final_signs_count(spark):
    """A sign that ends three texts and goes on in none speaks for an end, however rare it is."""
    texts = [f"the {a} of {b} is {c}." for a in ("sound", "song", "tape") for b in ("may", "june", "july") for c in ("good", "loud", "long", "slow")] + ["what a fine long song \u2602", "so slow and loud a tape \u2602"]
    docs = spark.createDataFrame([(i, "en", "w", t) for i, t in enumerate(texts)], "doc_id bigint, lang string, source string, text string")
    got = {r.doc_id: r.score for r in tr.scores(docs).collect()}
    p = tr.PRIOR
    for e in (1, 1, 0, 0):  # the other text's ending: the sign, and the sign behind a space; the texts differ before
        p = (e + tr.SMOOTHING * p) / (e + tr.SMOOTHING)
    for i in (len(texts) - 2, len(texts) - 1):
        assert abs(got[i] - math.log(p / (1 - p))) < 1e-6


def test_dots_of_known_endings(spark):
    """Dots that an ending usually has are no sign of a cut; dots put in place of the rest are."""
    words = ["violin", "organ", "sleeve", "tape", "drone", "chorus", "piano", "cymbal"]
    texts = [f"The {a} hums under the {b}.\nto be continued" + ("\u2026" if i % 2 else " ...") for i, (a, b) in enumerate(itertools.permutations(words, 2))]
    texts += [f"The {a} fades under the {b}." for a, b in itertools.permutations(words, 2)] * 3
    cut = [f"A {a} hums under the {a[:3]}..." for a in words[:4]]
    docs = spark.createDataFrame([(i, "en", "w", t) for i, t in enumerate(texts + cut)], "doc_id bigint, lang string, source string, text string")
    score = {r.doc_id: r.score for r in tr.scores(docs).collect()}
    assert min(score[i] for i in range(len(texts))) > max(score[i] for i in range(len(texts), len(texts) + 4))


def test_thresholds_do_not_switch_with_size(spark):
    """Groups of 30 to 3,000 texts of one histogram have the same threshold, and a tiny one its language's."""
    heap = [-11.0, -10.0, -9.0, -8.0] + [-3.0 + 0.01 * i for i in range(60)]
    rows = [("en", f"s{n}", heap[i % len(heap)]) for n in (32, 296, 304, 3200) for i in range(n)] + [("en", "tiny", -9.0), (None, "none", -9.0)]
    got = {(r.lang, r.source): r.least for r in tr.thresholds(spark.createDataFrame(rows, "lang string, source string, score double")).collect()}
    assert len(got) == 6 and len(set(got.values())) == 1 and -8 < next(iter(got.values())) < -3
    assert tr.thresholds(spark.createDataFrame([], "lang string, source string, score double")).count() == 0


def test_valley():
    bins = round((tr.RANGE[1] - tr.RANGE[0]) / tr.BIN)
    heaps = np.zeros(bins)
    heaps[40:50], heaps[10:20] = 0.09, 0.01
    assert tr.RANGE[0] + 20 * tr.BIN <= tr.valley(heaps) <= tr.RANGE[0] + 40 * tr.BIN
    assert tr.valley(np.eye(bins)[44]) == tr.USUAL  # nothing below the heap
