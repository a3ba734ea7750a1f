"""Texts put into containers of fixed capacity with little room left: bin completion by branch and bound.

Sizes are tokens of a public tokenizer. A text larger than a container is cut into full containers and a rest; nothing
else is ever split. The items of a capacity are spread over chunks of a bounded number of items; each chunk is packed by
branch and bound: around the largest item left, the undominated fillings of the remaining room are tried fullest first;
a branch ends when its waste exceeds what a better solution may waste; best-fit decreasing is the first incumbent
and the bound of all item sizes proves many chunks optimal at once. Containers that stay poorly filled are emptied and
their items packed again across chunks, as long as that saves containers.

Cases: null, empty and blank texts without tokens need no room and are left out; repeated rows (doc_id) count once; a
capacity that is null or below 1 holds nothing; very long texts fill as many containers as they need; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramoflow.operators.scale import spread, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how texts are cut into words before the ranks of a byte-level vocabulary join their bytes.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items packed together.
CHUNK_ITEMS = 4_000
#: Search steps of one chunk for each of its containers, and of any chunk.
NODES_EACH, LEAST_NODES = 4, 3_000
#: Fillings tried around one item, and steps in which they are looked for.
FILLINGS, STEPS = 4, 400
#: Containers filled less are packed again, at most so often.
GOOD_FILL, ROUNDS = 0.985, 3
#: Capacities packed together.
MOST_SPECS = 1_000
#: Parts into which the bounds divide a container.
BOUND_PARTS = 50


def counter(tokenizer: str):
    """The function that counts a text's tokens, by a vocabulary of ranks (.tiktoken) or of the tokenizers library (.json)."""
    if tokenizer.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of the texts that have tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [count(t) for t in pdf["text"]]})

    texts = documents.filter("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(texts).mapInPandas(run, "doc_id bigint, n_tokens bigint").filter("n_tokens > 0").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def least_bins(sizes: list[int], capacity: int) -> int:
    """Bins that any packing needs: by total size, by the items over half with those that cannot join them (bound L2), and
    by sizes counted in parts of a container (a dual feasible function: items over 1 / (k + 1) are k in a bin at most)."""
    best = -(-sum(sizes) // capacity)
    each = Counter(sizes)
    for k in range(1, min(BOUND_PARTS, capacity) + 1):
        # A size counts as floor((k + 1) s / capacity) / k of a bin, or as itself where that is a whole number.
        whole, own = 0, 0
        for s, n in each.items():
            parts, rest = divmod((k + 1) * s, capacity)
            if rest:
                whole += parts * n
            else:
                own += s * n
        best = max(best, -(-(whole * capacity + own * k) // (capacity * k)))
    falling = sorted(sizes, reverse=True)
    total = list(accumulate(falling, initial=0))
    half = _count_over(falling, capacity // 2)
    for k in {0, *falling[half:]}:
        alone, upto = _count_over(falling, capacity - k), _count_over(falling, k - 1)
        room = (half - alone) * capacity - (total[half] - total[alone])
        rest = total[max(upto, half)] - total[half]
        best = max(best, half + max(0, -(-(rest - room) // capacity)))
    return best


def _count_over(desc: list[int], limit: int) -> int:
    """How many of the falling sizes are larger than limit."""
    lo, hi = 0, len(desc)
    while lo < hi:
        mid = (lo + hi) // 2
        if desc[mid] > limit:
            lo = mid + 1
        else:
            hi = mid
    return lo


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing, as lists of sizes."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(rooms, (s, -1))
        if i == len(rooms):
            bins.append([s])
            insort(rooms, (capacity - s, len(bins) - 1))
        else:
            room, b = rooms.pop(i)
            bins[b].append(s)
            insort(rooms, (room - s, b))
    return bins


def fillings(room: int, counts: dict[int, int], falling: list[int]) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated sets of sizes that fit into the room, fullest first, and whether they are all.

    A set that fills the room is enough by itself only for the waste, not for what it leaves, so others follow it."""
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0
    every = True
    first = _count_over(falling, room)
    branches: list[tuple[int, int, tuple[int, ...]]] = [(room, first, ())]
    while branches and steps < STEPS:
        left, at, chosen = branches.pop()
        steps += 1
        while at < len(falling) and (falling[at] > left or counts[falling[at]] - chosen.count(falling[at]) <= 0):
            at += 1
        if at == len(falling) or left == 0:
            found.append((room - left, chosen))
            if left == 0:
                every = every and not branches
                break
            continue
        branches.append((left, at + 1, chosen))  # without this size
        branches.append((left - falling[at], at, (*chosen, falling[at])))
    every = every and not branches
    found.sort(key=lambda f: (-f[0], len(f[1]), tuple(-x for x in f[1])))
    out: list[tuple[int, ...]] = []
    for _, f in found:
        if not any(dominates(g, f) for g in out):
            if len(out) == FILLINGS:
                every = False
                break
            out.append(f)
    return out or [()], every


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """True if the sizes of b can be put into those of a: then a leaves the smaller items for later."""
    rooms = sorted(a, reverse=True)
    for s in sorted(b, reverse=True):
        for i, r in enumerate(rooms):
            if s <= r:
                rooms[i] = r - s
                break
        else:
            return False
    return True


def complete_bins(sizes: list[int], capacity: int, nodes: int | None = None) -> tuple[list[list[int]], int, bool]:
    """The best packing found, as lists of sizes, by bin completion within a number of steps; the least number of bins
    that is proven; and whether the packing is proven to be optimal."""
    best = best_fit(sizes, capacity)
    bound = least_bins(sizes, capacity)
    nodes = max(LEAST_NODES, NODES_EACH * len(best)) if nodes is None else nodes
    complete = True  # no filling was left out
    total = sum(sizes)
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    falling = sorted(counts, reverse=True)
    bins: list[list[int]] = []
    waste = 0
    trail: list[tuple[list[tuple[int, ...]], int]] = []  # fillings not tried yet at each depth, and waste before it
    used = 0
    n_left = len(sizes)
    descending = True
    while len(best) > bound and used < nodes:
        if descending:
            if n_left == 0:
                if len(bins) < len(best):
                    best = [list(b) for b in bins]
                descending = False
                continue
            used += 1
            largest = next(s for s in falling if counts[s] > 0)
            counts[largest] -= 1
            options, every = fillings(capacity - largest, counts, falling)
            complete = complete and every
            counts[largest] += 1
            trail.append(([(largest, *o) for o in reversed(options)], waste))
        elif bins:
            for s in bins[-1]:
                counts[s] += 1
            n_left += len(bins.pop())
            waste = trail[-1][1]
        moved = False
        while trail and not moved:
            options, before = trail[-1]
            waste = before
            while options:
                o = options.pop()
                w = waste + capacity - sum(o)
                if w <= (len(best) - 1) * capacity - total:  # a packing with one bin less may waste so much
                    bins.append(list(o))
                    for s in o:
                        counts[s] -= 1
                    n_left -= len(o)
                    waste = w
                    moved = True
                    break
            if not moved:
                trail.pop()
                if not trail:
                    return best, len(best) if complete else bound, complete or len(best) == bound
                for s in bins[-1]:
                    counts[s] += 1
                n_left += len(bins.pop())
        descending = True
    return best, bound, len(best) == bound


def pack(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Rows of one chunk with the number of their bin, and the chunk's bound and whether it is proven. Rows of one size are
    interchangeable."""
    by_size: dict[int, list[int]] = {}
    frame = frame.sort_values(["n", "doc_id", "piece"]).reset_index(drop=True)
    for i, s in enumerate(frame["n"].tolist()):
        by_size.setdefault(s, []).append(i)
    seq = [0] * len(frame)
    bins, bound, proven = complete_bins(frame["n"].tolist(), capacity)
    for b, sizes in enumerate(bins):
        for s in sizes:
            seq[by_size[s].pop()] = b
    return frame.assign(seq=seq, bound=bound, proven=proven)


_PACKED = "spec_id int, capacity int, doc_id bigint, piece int, first_token bigint, n bigint, container string"


def _pack_round(items: DataFrame, n_items: dict[int, int], number: int, chunk_items: int) -> DataFrame:
    """items: spec_id, capacity, doc_id, piece, first_token, n -> the same with container, chunk, bound, proven."""
    many = F.create_map(*[F.lit(x) for spec, n in sorted(n_items.items()) for x in (spec, max(1, math.ceil(n / chunk_items)))])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack(pdf, int(pdf["capacity"].iloc[0]))
        out["container"] = [f"{key[0]}-{number}-{key[1]}-{s}" for s in out["seq"]]
        return out[["spec_id", "capacity", "doc_id", "piece", "first_token", "n", "container", "chunk", "bound", "proven"]]

    chunked = items.drop("container").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), F.element_at(many, F.col("spec_id"))))
    return chunked.groupBy("spec_id", "chunk").applyInPandas(run, f"{_PACKED}, chunk bigint, bound bigint, proven boolean")


def _blocks(specs: DataFrame) -> Iterator[list]:
    """The distinct capacities in order, MOST_SPECS at a time."""
    last = None
    while True:
        rest = specs if last is None else specs.filter((F.col("spec_id") > last[0]) | ((F.col("spec_id") == last[0]) & (F.col("capacity") > last[1])))
        few = rest.orderBy("spec_id", "capacity").limit(MOST_SPECS).collect()  # MOST_SPECS rows at most
        if few:
            yield few
        if len(few) < MOST_SPECS:
            return
        last = few[-1]


def _rounds(counts: DataFrame, few: list, chunk_items: int) -> tuple[DataFrame, list[DataFrame]]:
    """The containers of some capacities, and what each round packed, with chunk, bound and proven."""
    each = F.explode(F.array(*[F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.capacity).alias("capacity")) for r in few]))
    every = counts.select("doc_id", "n_tokens", each.alias("s")).select("doc_id", "n_tokens", "s.spec_id", "s.capacity")
    pieces = every.select(
        "spec_id", "capacity", "doc_id",
        F.explode(F.transform(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")), lambda i: F.struct(i.alias("piece"), (i * F.col("capacity")).cast("bigint").alias("first_token"), F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - i * F.col("capacity")).alias("n")))).alias("p"),
    ).select("spec_id", "capacity", "doc_id", "p.piece", "p.first_token", "p.n")
    pieces = stage(pieces, "pieces")
    done = pieces.filter("n = capacity").withColumn("container", F.concat_ws("-", "spec_id", F.lit("full"), "doc_id", "piece"))
    columns, rounds = done.columns, []
    todo = pieces.filter("n < capacity")
    for number in range(ROUNDS):
        n_items = {r.spec_id: r.n for r in todo.groupBy("spec_id").agg(F.count("*").alias("n")).collect()}  # one row a capacity
        if not n_items:
            break
        packed = stage(_pack_round(todo, n_items, number, chunk_items), "packed")
        rounds.append(packed)
        filled = packed.groupBy("container").agg(F.sum("n").alias("used"), F.first("capacity").alias("c"))
        poor = filled.filter(F.col("used") < GOOD_FILL * F.col("c")).select("container")
        if number == ROUNDS - 1:
            done = done.unionByName(packed.select(columns))
            break
        done = done.unionByName(packed.select(columns).join(poor, "container", "left_anti").select(columns))
        todo = packed.select(columns).join(poor, "container", "left_semi").select(columns)
    return done, rounds


def _distinct_specs(specs: DataFrame) -> DataFrame:
    return specs.filter("spec_id IS NOT NULL AND capacity_tokens >= 1").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("int").alias("capacity")).distinct()


def containers(counts: DataFrame, specs: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """counts: doc_id, n_tokens; specs: spec_id, capacity_tokens -> spec_id, container, doc_id, piece, first_token, n_tokens."""
    done = None
    for few in _blocks(_distinct_specs(specs)):
        one, _ = _rounds(counts, few, chunk_items)
        done = one if done is None else done.unionByName(one)
    if done is None:
        done = counts.sparkSession.createDataFrame([], _PACKED)
    return done.select("spec_id", "container", "doc_id", "piece", "first_token", F.col("n").alias("n_tokens"))


def search_report(counts: DataFrame, specs: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """spec_id, capacity, round, chunks, proven (chunks proven optimal), containers, bound (least number proven, of all
    chunks): what the search reached in each round."""
    out = None
    for few in _blocks(_distinct_specs(specs)):
        for number, packed in enumerate(_rounds(counts, few, chunk_items)[1]):
            chunk = packed.groupBy("spec_id", "capacity", "chunk").agg(F.first("bound").alias("bound"), F.first("proven").alias("proven"), F.count_distinct("container").alias("n"))
            one = chunk.groupBy("spec_id", "capacity").agg(F.count("*").alias("chunks"), F.count_if("proven").alias("proven"), F.sum("n").alias("containers"), F.sum("bound").alias("bound")).withColumn("round", F.lit(number))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return counts.sparkSession.createDataFrame([], "spec_id int, capacity int, round int, chunks bigint, proven bigint, containers bigint, bound bigint")
    return out.select("spec_id", "capacity", "round", "chunks", "proven", "containers", "bound")


def fill_rates(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """spec_id, capacity_tokens, n_containers, n_tokens, fill."""
    used = packed.groupBy("spec_id").agg(F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    out = used.join(F.broadcast(specs.select(F.col("spec_id").cast("int").alias("spec_id"), "capacity_tokens").distinct()), "spec_id")  # MOST_SPECS rows at most
    return out.withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
