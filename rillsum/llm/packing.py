"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents are dealt to blocks of a few thousand.  Each block is evolved on several islands from
packings of items in noisy or random order: crossover injects whole well-filled bins of one parent into the
other, drops the bins that repeat an item, and best-fits what was displaced; mutation opens a few bins anew.
After each epoch every island's elite migrates to the next island.  Bins that can still take an item go on
to a coarser level.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillsum.llm.common import TokenBytes, byte_chunks, discard, kept_in_worker, returning, text_or_empty, written

CAPACITY = 2048
#: Items of a block, and about the most of a coarser one.
BLOCK, COARSE = 4096, 65_536
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 5, 4
#: Share of the children that mutate, and how many bins a mutation opens besides the emptiest.
MUTANTS, OPENED = 0.5, 3
#: A bin with at most so many free places is settled where it is.
SETTLED = 8
#: Bytes of text that a worker cuts and numbers at once; what it holds meanwhile is about 20 times as much.
CHUNK = 2 << 20


class Bins:
    """Bins as lists of items, found by free space in a bit mask."""

    def __init__(self, capacity: int):
        self.cap, self.bins, self.free, self.mask, self.by = capacity, [], [], 0, {}

    def _file(self, b: int) -> None:
        r = self.free[b]
        self.by.setdefault(r, []).append(b)
        self.mask |= 1 << r

    def add(self, items: list[int], used: int) -> None:
        self.bins.append(items)
        self.free.append(self.cap - used)
        self._file(len(self.bins) - 1)

    def best_fit(self, order: list[int], size: list[int]) -> None:
        """Puts each item where it leaves the least space, or in a new bin."""
        by, bins, free = self.by, self.bins, self.free
        for i in order:
            s = size[i]
            m = self.mask >> s
            if not m:
                self.add([i], s)
                continue
            r = s + (m & -m).bit_length() - 1
            own = by[r]
            b = own.pop()
            if not own:
                self.mask ^= 1 << r
            bins[b].append(i)
            free[b] = r - s
            own = by.setdefault(r - s, [])
            own.append(b)
            self.mask |= 1 << (r - s)


def fitness(bins: list[list[int]], size: list[int], cap: int) -> tuple[int, float]:
    """Smaller is better: bins, then minus the mean squared fill."""
    fill = [sum(size[i] for i in b) / cap for b in bins]
    return len(bins), -sum(f * f for f in fill) / max(1, len(fill))


def cross(a: list[list[int]], b: list[list[int]], size: list[int], cap: int, rng: random.Random) -> list[list[int]]:
    """Injects well-filled bins of b into a; what they displace is placed by best fit, with a's two emptiest bins."""
    full = [x for x in b if sum(size[i] for i in x) >= cap - SETTLED]
    if not full:
        full = sorted(b, key=lambda x: -sum(size[i] for i in x))[: max(1, len(b) // 4)]
    chosen = rng.sample(full, max(1, len(full) // 3))
    taken = {i for x in chosen for i in x}
    out, loose = Bins(cap), []
    for x in chosen:
        out.add(list(x), sum(size[i] for i in x))
    rest = []
    for x in a:
        if taken.isdisjoint(x):
            rest.append((sum(size[i] for i in x), x))
        else:
            loose += [i for i in x if i not in taken]
    rest.sort(key=lambda t: t[0])
    for used, x in rest[:2]:
        loose += x
    for used, x in rest[2:]:
        out.add(list(x), used)
    out.best_fit(sorted(loose, key=lambda i: (-size[i], i)), size)
    return out.bins


def mutate(bins: list[list[int]], size: list[int], cap: int, rng: random.Random) -> list[list[int]]:
    """Opens the emptiest bin and a few others, and best-fits their items in random order."""
    if len(bins) <= OPENED:
        return bins
    fill = [sum(size[i] for i in b) for b in bins]
    opened = {min(range(len(bins)), key=lambda k: (fill[k], k)), *rng.sample(range(len(bins)), OPENED)}
    out, loose = Bins(cap), [i for k in sorted(opened) for i in bins[k]]
    for k, b in enumerate(bins):
        if k not in opened:
            out.add(list(b), fill[k])
    rng.shuffle(loose)
    out.best_fit(loose, size)
    return out.bins


def seeded(size: list[int], cap: int, rng: random.Random, noise: float | None) -> list[list[int]]:
    """Best fit of the items from large to small, with their sizes raised by up to `noise`; in random order for None."""
    order = list(range(len(size)))
    if noise is None:
        rng.shuffle(order)
    else:
        order = sorted(order, key=lambda i: (-size[i] * (1 + noise * rng.random()), i))
    out = Bins(cap)
    out.best_fit(order, size)
    return out.bins


def evolve(size: list[int], cap: int, seed: int, elites: list[list[list[int]]], population: int = POPULATION, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing that an island finds from its elites and seeded packings.

    One generation is bred at least; after it the search ends when no packing can have fewer bins.  Island 0
    begins with one packing by best fit decreasing, so the result is never worse than that.
    """
    rng = random.Random(seed)
    bound = -(-sum(size) // cap)
    pop = list(elites)
    while len(pop) < population:
        pop.append(seeded(size, cap, rng, 0.0 if not pop and seed % ISLANDS == 0 else 0.1 if len(pop) % 2 else None))
    rank = lambda x: fitness(x, size, cap)
    pop.sort(key=rank)
    for g in range(generations):
        if g and len(pop[0]) <= bound:
            break
        kids = [cross(pop[i % len(pop)], pop[rng.randrange(len(pop))], size, cap, rng) for i in range(population - 1)]
        kids = [mutate(k, size, cap, rng) if rng.random() < MUTANTS else k for k in kids]
        pop = sorted([*pop, *kids], key=rank)[:population]
    return pop[0]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, specials: bool = True) -> DataFrame:
    """(doc_id, th, piece, start, length, crc): documents tokenised whole, ended, and cut only where longer than capacity."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept_in_worker((tokenizer, specials), lambda: TokenBytes(tokenizer, spaced=False, specials=specials))
        for b in batches:
            for lo, hi in byte_chunks(b["text"], CHUNK):
                ids, n = enc.encode_ended(b["text"][lo:hi], end_id)
                own, piece, length, crc, raw, at = [], [], [], [], memoryview(ids), 0
                for i, k in zip(range(lo, hi), n.tolist(), strict=True):
                    for j in range(0, k, capacity):
                        size = min(capacity, k - j)
                        own.append(i)
                        piece.append(j // capacity)
                        length.append(size)
                        crc.append(zlib.crc32(raw[at + j : at + j + size]))
                    at += k
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(at), b["th"].take(at), pa.array(piece, pa.int32()), pa.array([capacity * p for p in piece], pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "th", "piece", "start", "length", "crc"],
                )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    return d.mapInArrow(returning(run, keeps=True), "doc_id long, th long, piece int, start long, length long, crc long")


ITEM = "doc_id long, th long, piece int, start long, length long, crc long"


def _evolved(blocks: DataFrame, elites: DataFrame | None, epoch: int, capacity: int) -> DataFrame:
    """(block, island, elite): one epoch; elite is the bin number of each item, as 32-bit integers."""
    import numpy as np
    import pyarrow as pa

    sizes = blocks.select("block", F.transform("items", lambda x: x["length"]).alias("size"))
    on = sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    if elites is None:
        on = on.withColumn("elites", F.array().cast("array<binary>"))
    else:
        arrive = elites.select("block", "island", "elite").unionByName(elites.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), "elite"))
        on = on.join(arrive.groupBy("block", "island").agg(F.sort_array(F.collect_set("elite")).alias("elites")), ["block", "island"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                size = b["size"][i].as_py()
                pops = []
                for e in b["elites"][i].as_py():
                    bins: dict[int, list[int]] = {}
                    for k, x in enumerate(np.frombuffer(e, "<i4").tolist()):
                        bins.setdefault(x, []).append(k)
                    pops.append(list(bins.values()))
                block, island = b["block"][i].as_py(), b["island"][i].as_py()
                best = evolve(size, capacity, (block * 1009 + epoch) * ISLANDS + island, pops)
                out = np.zeros(len(size), "<i4")
                for n, x in enumerate(best):
                    out[x] = n
                f = fitness(best, size, capacity)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([island], pa.int32()), pa.array([out.tobytes()], pa.binary()), pa.array([f[0]]), pa.array([f[1]])], ["block", "island", "elite", "bins", "worth"])

    return on.select("block", "island", "size", "elites").mapInArrow(run, "block long, island int, elite binary, bins long, worth double")


def sequence_ids(level: int, block: int, bins):
    """Ids of the bins of a block, without clashes: 5 bits of level, 25 of block and 32 of bin below 2^62, where whole pieces begin."""
    if level >> 5 or block >> 25 or (len(bins) and int(bins.max()) >> 32):
        raise OverflowError(f"no sequence id for level {level}, block {block}")
    return (level << 57) | (block << 32) | bins


def _laid(blocks: DataFrame, best: DataFrame, level: int, capacity: int) -> DataFrame:
    """Rows of ITEM with block, sequence_id, offset and free, the free places of the bin."""
    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "th", "piece", "start", "length", "crc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                items, block = b["items"][i].values, b["block"][i].as_py()
                bins = np.frombuffer(b["elite"][i].as_py(), "<i4").astype("i8")
                ids = sequence_ids(level, block, bins)
                size = np.asarray(items.field("length"))
                order = np.argsort(bins, kind="stable")
                run_ = np.cumsum(size[order]) - size[order]
                used = np.bincount(bins, size).astype("i8")
                base = np.concatenate(([0], np.cumsum(used)[:-1]))
                offset = np.empty(len(size), "i8")
                offset[order] = run_ - base[bins[order]]
                free = capacity - used[bins]
                yield pa.RecordBatch.from_arrays(
                    [items.field(c) for c in names] + [pa.array(np.full(len(size), block)), pa.array(ids), pa.array(offset), pa.array(free)],
                    [*names, "block", "sequence_id", "offset", "free"],
                )

    return blocks.join(best, "block").select("block", "items", "elite").mapInArrow(run, ITEM + ", block long, sequence_id long, offset long, free long")


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset; sequences hold at most capacity tokens, offsets are gapless.

    Full pieces are sequences of their own.  Repeated rows are items of their own; an empty table
    packs to no row.
    """
    parts = written(parts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = parts.where(F.col("length") >= capacity).withColumn("sequence_id", F.lit(1 << 62) + F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    items = parts.where(F.col("length") < capacity)
    n = items.count()
    blocks, level, out = max(1, -(-n // BLOCK)), 0, [whole.drop("uid")]
    fields = [c.split()[0] for c in ITEM.split(", ")]
    rows = items.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), *fields)
    while n:
        item = F.struct((-F.col("length")).alias("less"), "doc_id", "th", "piece", "start", "length", "crc")
        held = written(rows.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items")), "blocks")
        elites = None
        for epoch in range(EPOCHS):
            elites = written(_evolved(held, elites, epoch, capacity), "elites")
        best = elites.groupBy("block").agg(F.min(F.struct("bins", "worth", "island", "elite")).alias("b")).select("block", F.col("b.elite").alias("elite"))
        laid = written(_laid(held, best, level, capacity), "laid")
        discard(held, elites)
        # a bin is settled where it is well filled, or where no item of the bins that are not would fit
        least = laid.where(F.col("free") > SETTLED).agg(F.min("length")).first()[0] or 0
        settled = F.col("free") < max(SETTLED + 1, least)
        left = -(-laid.where(~settled).count() // COARSE) if blocks > 1 else 0
        if not left or left >= blocks:  # no coarser level would help: all bins stay as they are
            out.append(laid.select(*fields, "sequence_id", "offset"))
            break
        out.append(laid.where(settled).select(*fields, "sequence_id", "offset"))
        rows = laid.where(~settled).select(F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(left)).alias("block"), *fields)
        blocks, level = left, level + 1
    got = out[0]
    for x in out[1:]:
        got = got.unionByName(x)
    return got


def digest(docs: DataFrame, tokenizer: str, specials: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    return pack(pieces(docs, tokenizer, specials=specials)).select("doc_id", "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
