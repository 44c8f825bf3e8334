"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints are cut in segments of 32 bits.  Each segment's table is probed with the ball of radius 1; of a
flipped pair only the side with the set bit probes.  Two 64-bit fingerprints that differ in at most 3 bits
have a segment that differs in at most 1, so all their links are found.  `unique` goes further, to a Jaccard
similarity of 0.8 over five-word shingles: 256 bits over the distinct words, 8 segments, then the complete
distance, then the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillsum.llm.common import WORD, bitmap, byte_chunks, cut_words, discard, flagged, flat_bytes, mix64, ones, returning, written
from rillsum.llm.graph import candidates, components, grouped, linked, near_edges

SEED, DISTANCE = 42, 3
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Of near copies: words of a shingle, least similarity, fingerprint words, and the bits in which 64 and all 256 may differ.
SHINGLE, SIMILARITY, WIDE, NEAR, FAR = 5, 0.8, ["f0", "f1", "f2", "f3"], 18, 56


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, f0): 64-bit SimHash (bit pattern) of the word shingles, repeats included; th: hash of the text.

    Null, empty and wordless texts have fingerprint 0.  A long text is folded in slices of its hashes.
    """
    import numpy as np
    import pyarrow as pa

    word = WORD.pattern.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        from xxhash import xxh64_intdigest

        find, seed = re.compile(word).finditer, SEED
        for b in batches:
            out = np.zeros(b.num_rows, "u8")
            hs, owner, count = [], [], []

            def fold():
                h = np.fromiter(hs, "u8", len(hs))
                n = np.array(count)
                at = np.concatenate(([0], np.cumsum(n)[:-1]))
                bits = np.unpackbits(h.astype(">u8").view("u1").reshape(-1, 8), axis=1)
                ones = np.add.reduceat(bits, at, axis=0, dtype="i4")
                tally.append((list(owner), ones, n))
                hs.clear(), owner.clear(), count.clear()

            tally = []
            for i, t in enumerate(b["text"]):
                t = t.as_py()
                if not t:
                    continue
                raw = t.encode("utf-8", "surrogatepass").translate(LOWER)
                raw = b" ".join(raw.split())  # bytes.split cuts at the same six characters
                if not raw:
                    continue
                ends = [m.start() for m in re.finditer(b" ", raw)]
                ends.append(len(raw))
                if len(ends) <= shingle:
                    hs.append(xxh64_intdigest(raw, seed))
                    n = 1
                else:
                    starts = [0] + [e + 1 for e in ends[:-shingle]]
                    hs.extend([xxh64_intdigest(raw[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)])
                    n = len(starts)
                owner.append(i)
                count.append(n)
                if len(hs) > 200_000:
                    fold()
            if hs:
                fold()
            for own, ones, n in tally:
                out[own] = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel()
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["th"], pa.array(out.view("i8"))], ["doc_id", "th", "f0"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return d.mapInArrow(returning(run), "doc_id long, th long, f0 long")


def ball_keys(words: list[str]) -> Callable:
    """Keys for near_edges: the own value of every 32-bit segment, and its neighbours with one set bit cleared."""

    def keys(batch):
        import numpy as np

        rows, key, base, every = [], [], [], np.arange(batch.num_rows)
        for s, (c, shift) in enumerate((c, shift) for c in words for shift in (32, 0)):
            v = (np.asarray(batch[c]).view("u8") >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
            at = np.uint64(s << 32)
            rows.append(every)
            key.append(v | at)
            base.append(np.ones(len(v), bool))
            for i in range(32):
                on = np.flatnonzero(v & np.uint64(1 << i))
                rows.append(on)
                key.append((v[on] ^ np.uint64(1 << i)) | at)
                base.append(np.zeros(len(on), bool))
        return np.concatenate(rows), np.concatenate(key), np.concatenate(base)

    return keys


def groups(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(f0, component_id): component_id is the least doc_id that a fingerprint reaches by links.

    prints: (doc_id, f0).  Equal fingerprints are one node, so copies cost nothing further on.
    """
    if distance > 3:
        raise ValueError("two segments with balls of radius 1 find links of 3 bits at most")
    nodes = written(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "nodes")
    edges = near_edges(nodes.select("f0"), ["f0"], ball_keys(["f0"]), 34, distance)
    comp = components(edges)
    rooted = written(nodes.join(comp, F.col("f0") == F.col("node"), "left").select("f0", "least", F.coalesce("root", "f0").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    out = written(rooted.join(ids, "root").select("f0", "component_id"), "groups")
    discard(nodes, rooted)
    return out


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs; null doc_ids reach but don't name components."""
    prints = written(fingerprints(docs), "prints")
    out = prints.select("doc_id", "f0").join(groups(prints), "f0")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


class Texts:
    """Words of an Arrow array of texts, A-Z in lower case: count, u: their hashes, owner: the text of each word."""

    def __init__(self, texts):
        import numpy as np
        import pyarrow as pa

        raw, at = flat_bytes(texts.fill_null("").cast(pa.large_string()))
        raw = np.frombuffer(LOWER, "u1")[raw]
        begin, self.length, self.byte, self.head, self.u = cut_words(raw, at)
        self.owner = np.searchsorted(at, begin, "right") - 1
        self.n = np.bincount(self.owner, minlength=len(texts))
        self.first = np.cumsum(self.n) - self.n
        self.texts = len(texts)

    def digests(self) -> list[bytes]:
        """128-bit hash of each text's words, joined by one space; without words that of the empty string."""
        import numpy as np
        from xxhash import xxh3_128_digest

        out = np.full(len(self.byte) + len(self.u) + 1, 32, "u1")
        out[np.arange(len(self.byte)) + np.repeat(np.arange(len(self.u)), self.length)] = self.byte
        start = np.append(self.head, len(self.byte)) + np.arange(len(self.u) + 1)
        raw, end = memoryview(out), self.first + self.n
        return [xxh3_128_digest(raw[s : max(s, e - 1)]) for s, e in zip(start[self.first].tolist(), start[end].tolist(), strict=True)]

    def prints(self):
        """The words of a SimHash of 64 * len(WIDE) bits over the distinct words of each text; 0 without words."""
        import numpy as np

        out = np.zeros((len(WIDE), self.texts), "u8")
        order = np.lexsort((self.u, self.owner))
        u, owner = self.u[order], self.owner[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (owner[1:] != owner[:-1])
        u, n = u[new], np.bincount(owner[new], minlength=self.texts)
        has = np.flatnonzero(n)
        if len(has):
            n = n[has]
            at = np.cumsum(n) - n
            for k in range(len(WIDE)):
                most = 2 * ones(mix64(u ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)), at, n) > n[:, None]
                out[k, has] = np.packbits(most, axis=1).view("<u8").ravel()
        return out

    def shingles(self, size: int) -> list[bytes]:
        """The sorted distinct 64-bit hashes of each text's runs of `size` words; a shorter text is one run, an empty one has none."""
        import numpy as np

        h = np.zeros(len(self.u), "u8")
        for j in range(size):
            h += mix64(np.concatenate((self.u[j:], np.zeros(min(j, len(self.u)), "u8"))) + np.uint64(j + 1)) * np.uint64(2 * j + 1)
        out = []
        for i, n in zip(self.first.tolist(), self.n.tolist(), strict=True):
            if n >= size:
                out.append(np.unique(h[i : i + n - size + 1]).tobytes())
            else:
                own = mix64(self.u[i : i + n] + np.arange(1, n + 1, dtype="u8")).sum(dtype="u8")
                out.append(np.array([own] if n else [], "u8").tobytes())
        return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, nf, f0 to f3, words): th hashes the text, nf the words in order, the f words are the SimHash."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in byte_chunks(b["text"], 1 << 20):
                x = Texts(b["text"][lo:hi])
                f = [pa.array(w.view("i8")) for w in x.prints()]
                yield pa.RecordBatch.from_arrays([b["doc_id"][lo:hi], b["th"][lo:hi], pa.array(x.digests(), pa.binary()), *f, pa.array(x.n.astype("i8"))], ["doc_id", "th", "nf", *WIDE, "words"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(returning(run), "doc_id long, th long, nf binary, " + ", ".join(f"{c} long" for c in WIDE) + ", words long")


def _shingled(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(nf, payload): the shingles of the texts that the candidates need; a bitmap of fixed size thins the scan."""
    import numpy as np
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, F.col("th")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = shared.value
        for b in batches:
            texts = b["text"].take(pa.array(np.flatnonzero(flagged(on, np.asarray(b["th"])))))
            for lo, hi in byte_chunks(texts, 1 << 20):
                x = Texts(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(x.digests(), pa.binary()), pa.array(x.shingles(size), pa.binary())], ["nf", "payload"])

    d = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(returning(run), "nf binary, payload binary").dropDuplicates(["nf"])


def jaccard_at_least(least: float) -> Callable:
    def same(x, y) -> bool:
        import numpy as np

        n, m = len(x), len(y)
        if min(n, m) < least * max(n, m) - 1e-9:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (n + m - both) - 1e-9

    return same


def unique(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs less all rows but one of each group: the one with the least (doc_id, text hash), null doc_ids last.

    Groups are the connected components of texts whose shingle sets have a Jaccard similarity of `least`.
    Texts without a word, null ones included, are one group.  Of rows that agree in doc_id and text one
    stays.  All columns of docs stay; an empty table stays empty.
    """
    import numpy as np

    prints = written(signed(docs), "signed")
    kinds = prints.where("words > 0").groupBy("nf").agg(*[F.min(c).alias(c) for c in WIDE], F.min("th").alias("th"))
    kinds = written(kinds, "kinds")
    near = candidates(kinds.select(*WIDE), WIDE[:1], ball_keys(WIDE), 34 * len(WIDE), NEAR)
    wanted = written(grouped(kinds, near, "f0"), "wanted")
    shingled = written(_shingled(docs, wanted, shingle), "shingles")
    members = wanted.select("root", F.col("nf").alias("id"), *WIDE)
    alike = jaccard_at_least(least)
    links = linked(members, shingled.select(F.col("nf").alias("id"), "payload"), WIDE, FAR, lambda x: np.frombuffer(x, "u8"), lambda pairs: [alike(x, y) for x, y in pairs])
    comp = written(components(links), "comps")
    g = prints.select("doc_id", "th", "nf").join(comp, F.col("nf") == F.col("node"), "left")
    best = g.groupBy(F.coalesce("root", "nf").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("k"))
    place = F.col("k.doc_id")
    keep = written(best.select(F.coalesce(place, F.lit(0)).alias("__id"), place.isNull().alias("__none"), F.col("k.th").alias("__th")), "kept")
    discard(prints, kinds, wanted, shingled)
    key, own = ["__id", "__none", "__th"], F.col("doc_id").cast("long")
    d = docs.withColumn("__id", F.coalesce(own, F.lit(0))).withColumn("__none", own.isNull()).withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    return d.dropDuplicates(key).join(keep, key, "left_semi").select(*docs.columns)
