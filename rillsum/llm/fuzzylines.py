"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, phrases, verified edit similarity.

A line's 128-bit fingerprint is cut in 4 blocks of 32 bits, which are join keys: lines within 3 bits
agree in a block.  An edit similarity of 0.8 lies far beyond what blocks reach, so min-wise chosen phrases
of three words are keys too.  What meets within RADIUS bits is verified by edit similarity, and of each
connected group the first occurrence in (doc_id, text hash, line number) order stays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillsum.llm.common import WORD, bit_words, bitmap, byte_chunks, discard, flagged, flat_bytes, hash_words, marked, mix64, ones, per_word, returning, written
from rillsum.llm.graph import candidates, components, grouped, linked

SIMILARITY = 0.8
#: Fingerprint words and pigeonhole blocks; lines that differ in more bits of 128 are not compared.
FPS, BLOCKS, RADIUS = ["f0", "f1"], 4, 34
#: Lines whose normal form has fewer characters are left alone.  1: every line with a word takes part.
MIN_CHARS = 1
#: A line with more characters a word is read as pairs of characters, as scripts without spaces need.
WIDE_WORD = 16
#: Min-wise phrases of a line.
PHRASES, PACKED = 6, ["p0", "p1", "p2"]
#: Lines of fewer words also choose among their word pairs; phrases of fewer letters are chosen last.
SHORT_LINE, SHORT_PHRASE = 12, 12


def normal(line: str) -> str:
    return " ".join(WORD.findall(line.lower()))


def _common(a, b) -> int:
    """Length of the common prefix, by halving slices."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def places(a) -> dict:
    """Bit i of a character's number is set where it is character i of a string or list."""
    marks: dict = {}
    if isinstance(a, str) and len(a) > 128:
        import numpy as np

        code = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = set(a)
        if len(kinds) <= 256:
            for c in kinds:
                marks[c] = int.from_bytes(np.packbits(code == ord(c), bitorder="little").tobytes(), "little")
            return marks
    bit = 1
    for c in a:
        marks[c] = marks.get(c, 0) | bit
        bit <<= 1
    return marks


def edit_within(a, b, most: int) -> bool:
    """Levenshtein distance of two strings or lists <= most, bit-parallel over the shorter one."""
    if abs(len(a) - len(b)) > most:
        return False
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    if k:
        a, b = a[:-k], b[:-k]
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if len(b) <= most:
        return True
    if m == 0:
        return False
    full, at, end, none = (1 << m) - 1, places(a).get, len(b), (0,) * 32
    vp, vn = full, 0
    for j in range(0, end, 32):
        for x in map(at, b[j : j + 32], none):
            x |= vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hp = ((vn | (~(d0 | vp) & full)) << 1) | 1
            vp, vn = (((d0 & vp) << 1) | ~(d0 | hp)) & full, hp & d0 & full
        # neighbours in a column differ by one at most, so the distance is at least the value that leaves equal rests
        j = min(j + 32, end)
        own = (1 << max(0, m - end + j)) - 1
        if j + (vp & own).bit_count() - (vn & own).bit_count() > most:
            return False
    return True


@lru_cache(maxsize=2)
def _places(a: str) -> dict:
    """As places; a line is compared with many others in a row."""
    return places(a)


def common_subsequence(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, or -1 once it can't reach `least`; bit-parallel over a, common ends are not read.

    Zeros of v mark the characters of a that lengthen the subsequence with what is read of b; a common beginning
    of k characters leaves the first k of them.  When i characters of b are read, the rest of b adds at most its
    length, and only beyond the place in a that leaves as many: the subsequence of the two beginnings and that
    rest bound the whole.
    """
    k = _common(a, b)
    e = min(_common(a[::-1], b[::-1]), len(a) - k, len(b) - k)
    long, end = len(a) - e, len(b) - e
    least -= e
    at = _places(a).get
    v = ((1 << long) - 1) ^ ((1 << k) - 1)
    for i in range(k, end, 32):
        for m in map(at, b[i : min(i + 32, end)]):
            if m:
                u = v & m
                v = (v + u) | (v ^ u)
        rest = max(0, end - i - 32)
        begun = max(0, long - rest)
        if begun - (v & ((1 << begun) - 1)).bit_count() + min(rest, long) < least:
            return -1
    return e + long - (v & ((1 << long) - 1)).bit_count()


#: Characters that must agree where an alignment goes on after a difference, and how far it looks first.
ANCHOR, NEAR = 8, 24


def aligned_cost(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance, given up (returning more than `most`) once it exceeds `most`.

    A greedy alignment: after each difference both strings go on at the next place where they agree in ANCHOR
    characters, and what is left out costs its longer side.
    """
    e = _common(a[::-1], b[::-1])
    if e:
        a, b = a[:-e], b[:-e]
    i = j = cost = 0
    while True:
        step = 16
        while step and a[i : i + step] == b[j : j + step] and i < len(a):
            i, j, step = i + step, j + step, 2 * step
        while step > 1:
            step >>= 1
            if a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        i, j = min(i, len(a)), min(j, len(b))
        left = min(most - cost, len(a) - i - ANCHOR)
        for far, by in ((NEAR, 1), (most - cost, 8)):
            for d in range(0, min(left, 2 * NEAR) + 1, by):
                p = b.find(a[i + d : i + d + ANCHOR], j, j + d + far + ANCHOR)
                if p >= 0:
                    break
            else:
                continue
            break
        else:
            return cost + max(len(a) - i, len(b) - j)
        cost += max(d, p - j)
        if cost > most:
            return cost
        i, j = i + d, p


#: Lines with more characters are compared by their characters' numbers first.
LONG = 4000


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """1 - distance / longer length >= least.

    A greedy alignment proves most similar pairs.  The longest common subsequence leaves the longer
    line's other characters to be edited at least, and all others of both at most, which settles nearly every
    other pair; else the distance decides.
    """
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if aligned_cost(a, b, most) <= most:
        return True
    if n > LONG:
        p, q = Counter(a), Counter(b)
        if max((p - q).total(), (q - p).total()) > most:
            return False
    shared = common_subsequence(a, b, n - most)
    if n - shared > most:
        return False
    return len(a) + len(b) - 2 * shared <= most or edit_within(a, b, most)


#: Lines with more characters are compared one pair after the other; so are fewer pairs than FEW_LANES.
LANE_CHARS, FEW_LANES, LANES = 1600, 160, 2048
#: Kinds of characters of lines that are compared at once; lines with rarer ones are compared one pair after the other.
KINDS = 200


def similar_pairs(pairs: list, least: float = SIMILARITY) -> list[bool]:
    """similar of each pair; many pairs are compared at once."""
    out, rest = [False] * len(pairs), []
    for i, (a, b) in enumerate(pairs):
        if len(a) < len(b):
            a, b = b, a
        most = int((1 - least) * len(a) + 1e-9)
        if len(a) - len(b) > most:
            continue
        if len(a) > LANE_CHARS or not b:
            out[i] = similar(a, b, least)
        else:
            bits = len(a).bit_length()
            rest.append((bits, len(a) >> max(0, bits - 3), len(a) - len(b), i, a, b, most))  # alike in length, then in the difference
    rest.sort(key=lambda r: r[:4])
    for lo in range(0, len(rest), LANES):
        part = rest[lo : lo + LANES]
        got = lanes([r[4:] for r in part]) if len(part) >= FEW_LANES else [None] * len(part)
        for (*_, i, a, b, _), on in zip(part, got, strict=True):
            out[i] = similar(a, b, least) if on is None else on
    return out


def lanes(pairs: list) -> list:
    """Whether the edit distance of each (a, b, most), a not shorter than b, is at most `most`; None for rare characters.

    A band of diagonals, bit-parallel (Hyyro 2003), one pair beside the other in numpy's words.  Bit r of the band
    stands, when t characters of b are read, for character t + r - base of a, and bit `mid` for the
    diagonal on which both strings end: the distance is their difference in length and one more for
    each step whose bit is not set there.  Paths of at most `most` edits don't leave the band.  Past its end b
    reads a character that equals all others.
    """
    import numpy as np

    texts: dict = {}
    ia = np.array([texts.setdefault(a, len(texts)) for a, _, _ in pairs])
    tables = len(texts)
    ib = np.array([texts.setdefault(b, len(texts)) for _, b, _ in pairs])
    size = np.array([len(t) for t in texts])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(code.max()) + 1, bool)
    seen[code] = True
    kinds = np.flatnonzero(seen)
    if len(kinds) > KINDS:
        often = np.bincount(np.searchsorted(kinds, code))
        kinds = kinds[np.sort(np.argsort(-often, kind="stable")[:KINDS])]
    number = np.zeros(len(seen), "u1")
    number[kinds] = np.arange(1, len(kinds) + 1)
    code, any_char = number[code], len(kinds) + 1
    first = np.cumsum(size) - size
    rare = np.logical_or.reduceat(code == 0, first)
    wide = -(-int(size.max()) // 64) * 64
    chars = np.full((len(size), wide), any_char, "u1")
    chars[np.arange(wide) < size[:, None]] = code

    most, more = np.array([m for _, _, m in pairs]), size[ia] - size[ib]
    mid, beyond = int(((most + more) // 2).max()), int(((most - more) // 2).max())
    words = (mid + beyond) // 64 + 1
    front = mid // 64 + 1  # words before a line's first character
    row = (64 * front + int(more.max()) + int(size[ib].max())) // 64 + words + 2
    step = np.arange(any_char + 1) * row
    table = np.zeros(tables * len(step) * row, "u8")
    place = (np.arange(tables) * len(step) * row)[:, None] + front + np.arange(wide // 64)
    for bit in range(64):
        table[step[chars[:tables, bit::64]] + place] |= np.uint64(1 << bit)
    table.reshape(tables, len(step), row)[:, any_char] = ~np.uint64(0)

    out = np.zeros(len(pairs), bool)
    own = np.flatnonzero(~(rare[ia] | rare[ib]))
    base, read, end = mid - more[own], np.ascontiguousarray(chars[ib[own]].T), size[ib[own]]
    own_row, most, more = ia[own] * len(step) * row, most[own], more[own]
    one, all_bits, top = np.uint64(1), ~np.uint64(0), np.uint64(63)
    at = np.maximum(base - 64 * np.arange(words)[:, None], 0)
    vp = np.where(at < 64, all_bits << np.minimum(at, 63).astype("u8"), np.uint64(0))
    vn, same, t = np.zeros_like(vp), np.zeros(len(own), "u8"), 0
    word, turn, nth = mid // 64, np.uint64(mid % 64), np.arange(words + 1)[:, None]
    from_bit = 64 * front - base
    while len(own):
        for t in range(t, t + 32):
            start = from_bit + t
            x = table.take(nth + (own_row + (start >> 6) + step.take(read[t])))
            shift = (start & 63).astype("u8")
            x, high = x[:-1] >> shift, x[1:] << one
            high <<= top - shift
            x |= high
            d0 = x & vp
            total = d0 + vp
            for k in range(1, words):
                total[k] += (d0[k - 1] | (vp[k - 1] & ~total[k - 1])) >> top
            d0 = total
            d0 ^= vp
            d0 |= x
            d0 |= vn
            same += (d0[word] >> turn) & one
            hp = d0 | vp
            np.invert(hp, out=hp)
            hp |= vn
            vp &= d0  # hn
            down = d0 >> one
            down[:-1] |= d0[1:] << top
            vn = down & hp
            down |= hp
            np.invert(down, out=down)
            vp |= down
            if t + 1 >= len(read):
                break
        t += 1
        cost = more + t - same.astype("i8")
        near = cost + np.maximum(end - t, 0) <= most
        out[own[near]] = True
        going = ~near & (cost <= most)
        if not going.any():
            break
        if going.sum() < 0.9 * len(own):
            own, base, end, own_row, most, more, same, from_bit = (z[going] for z in (own, base, end, own_row, most, more, same, from_bit))
            vp, vn, read = vp[:, going], vn[:, going], read[:, going]
    return [None if odd else on for on, odd in zip(out.tolist(), (rare[ia] | rare[ib]).tolist(), strict=True)]


def keyed_docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))


class Lines:
    """The lines with a word of an Arrow array of texts, cut and hashed by numpy.

    owner, line: place of the text and number of the line in it; raw[start:end]: the normal form, lower-case
    words joined by one space; size: its characters; n: words of each line; u, letters: hash and characters
    of each word.  A word without a letter or digit has the hash 0.
    """

    def __init__(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # a line feed after each text: every word is followed by white space
        raw, at = flat_bytes(pc.binary_join_element_wise(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())), *[pa.scalar(c, pa.large_string()) for c in ("", "\n")]))
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        turn = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(raw) and not space[0]:
            turn = np.concatenate(([0], turn))
        begin, stop = turn[::2], turn[1::2]
        length = stop - begin
        self.count = len(begin)
        if not self.count:
            return
        byte, head = raw[~space], np.cumsum(length) - length
        u = hash_words(byte, head, length)
        dumb = (byte < 48) | ((byte > 57) & (byte < 97)) | ((byte > 122) & (byte < 128))
        u |= np.uint64(1)
        u[per_word(dumb, head) == length] = 0  # a mark between words says nothing by itself
        self.u, self.letters = u, length - per_word((byte & 0xC0) == 0x80, head)
        ends = np.cumsum(raw == 10, dtype="i8")
        text, row = np.searchsorted(at, begin, "right") - 1, ends[begin]
        self.first = np.concatenate(([0], np.flatnonzero((np.diff(text) != 0) | (np.diff(row) != 0)) + 1))
        self.n = np.diff(np.append(self.first, self.count))
        self.owner = text[self.first]
        self.line = row[self.first] - np.concatenate(([0], ends))[at[self.owner]]
        space[stop] = False  # a word's normal form takes one space along
        self.raw = raw[~space]
        self.raw[head + length + np.arange(self.count)] = 32
        last = self.first + self.n - 1
        self.start, self.end = head[self.first] + self.first, head[last] + length[last] + last
        self.size = np.add.reduceat(self.letters, self.first) + self.n - 1

    def digests(self) -> list[bytes]:
        from xxhash import xxh3_128_digest

        raw = memoryview(self.raw)
        return [xxh3_128_digest(raw[s:e]) for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def phrases(u, pair, letters, at, n):
    """32-bit min-wise phrases of lines, PHRASES of each: u, pair, letters of the words, at and n of the lines.

    Phrases are three words; short lines choose among pairs too, and a line of one word has that word.
    """
    import numpy as np

    third = np.concatenate((u[2:], np.zeros(2, "u8")))[: len(u)]
    three = (pair ^ (third * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9FB21C651E98DF25)
    three ^= three >> np.uint64(32)
    left = np.repeat(at + n, n) - np.arange(len(u))  # words from here to the end of the line
    own = np.repeat(n, n)
    after = np.concatenate((letters[1:], [0, 0]))
    short2 = letters + after[: len(u)]
    short3 = short2 + after[1 : len(u) + 1]
    two = np.where(own == 1, u, pair)
    two = two ^ (two >> np.uint64(32))
    at2 = np.flatnonzero((own < SHORT_LINE) & ((left > 1) | (own == 1)))
    at3 = left > 2
    out = np.empty((len(n), PHRASES), "u4")
    for k in range(PHRASES):
        odd = np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
        v = ((three * odd) >> np.uint64(33)).astype("u4") | ((short3 < SHORT_PHRASE).astype("u4") << np.uint32(31))
        v[~at3] = 0xFFFFFFFF
        w = ((two[at2] * odd) >> np.uint64(33)).astype("u4") | ((short2[at2] < SHORT_PHRASE).astype("u4") << np.uint32(31))
        v[at2] = np.minimum(v[at2], w)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


def prints(u, letters, n):
    """(f0, f1, phrases) of lines given by the hashes and characters of their words, and their numbers of words.

    The SimHash weighs words that hold a letter or digit and pairs of neighbours alike.
    """
    import numpy as np

    at = np.cumsum(n) - n
    follow = np.concatenate((u[1:], np.zeros(1, "u8")))
    pair = mix64((u * np.uint64(0x9E3779B97F4A7C15)) ^ (follow * np.uint64(0xC2B2AE3D27D4EB4F)))
    ph = phrases(u, pair, letters, at, n)
    pair[at + n - 1] = 0  # a pair doesn't reach into the next line
    said = np.add.reduceat((u != 0).astype("i8"), at) + n - 1
    f = []
    for salt in (0, 0x632BE59BD9B4E019):
        x, y = (u, pair) if not salt else (np.where(u, mix64(u ^ np.uint64(salt)), u), np.where(pair, mix64(pair ^ np.uint64(salt)), pair))
        most = 2 * ones(x, at, n, y) > said[:, None]
        f.append(np.packbits(most, axis=1).view("<u8").ravel())
    return f[0], f[1], ph


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, line, h, f0, f1, p0 to p2): lines with at least min_chars characters in normal form.

    h is the 128-bit hash of the normal form, f0 and f1 are its SimHash; p0 to p2 hold its phrases, two 32-bit
    integers each.
    """
    import numpy as np
    import pyarrow as pa

    def wide(x: Lines, i: int):
        s = x.raw[x.start[i] : x.end[i]].tobytes().decode("utf-8", "surrogatepass")
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        return mix64((c[:-1] << np.uint64(21)) | c[1:]) | np.uint64(1)

    def fixed(a):
        return pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * a.shape[1] * a.itemsize).astype("i4")), pa.py_buffer(np.ascontiguousarray(a))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in byte_chunks(b["text"], 1 << 20):
                x = Lines(b["text"][lo:hi])
                if not x.count:
                    continue
                f0, f1, ph = prints(x.u, x.letters, x.n)
                odd = np.flatnonzero(x.size > WIDE_WORD * x.n)
                if len(odd):
                    own = [wide(x, i) for i in odd]
                    n = np.array([len(c) for c in own])
                    u = np.concatenate(own)
                    f0[odd], f1[odd], ph[odd] = prints(u, np.full(len(u), 2), n)
                keep = np.flatnonzero(x.size >= min_chars)
                h = np.frombuffer(b"".join(x.digests()), "u1").reshape(-1, 16)
                at = pa.array(lo + x.owner[keep])
                cells = [pa.array(x.line[keep].astype("i4")), fixed(h[keep]), pa.array(f0[keep].view("i8")), pa.array(f1[keep].view("i8")), *[pa.array(c) for c in np.ascontiguousarray(ph[keep].astype("<u4")).view("<i8").T.copy()]]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["th"].take(at), *cells], ["doc_id", "th", "line", "h", *FPS, *PACKED])

    return keyed_docs(docs).mapInArrow(returning(run), "doc_id long, th long, line int, h binary, " + ", ".join(f"{c} long" for c in (*FPS, *PACKED)))


def block_and_phrase_keys(batch):
    """(rows, keys, base) for near_edges: the blocks of the fingerprint and the phrases."""
    import numpy as np

    f = np.stack([np.asarray(batch[c]).view("u8") for c in FPS], 1)
    ph = np.stack([np.asarray(batch[c]) for c in PACKED], 1).astype("<i8").view("<u4").astype("u8")
    key = np.concatenate((f >> np.uint64(32), f & np.uint64(0xFFFFFFFF), ph), 1) | (np.arange(BLOCKS + PHRASES, dtype="u8") << np.uint64(32))
    return np.repeat(np.arange(len(f)), BLOCKS + PHRASES), key.ravel(), np.ones(key.size, bool)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, payload): the normal forms of the wanted line hashes, each from the text and line where its spot lies.

    Fixed-size bitmaps of the spots and of the hashes thin the scan; what they let pass is joined exactly.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    shared = docs.sparkSession.sparkContext.broadcast((bitmap(wanted, F.xxhash64("h")), bitmap(wanted, F.col("spot"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        on_lines, on_spots = shared.value
        for b in batches:
            for lo, hi in byte_chunks(b["text"], 1 << 20):
                raw, at = flat_bytes(pc.binary_join_element_wise(b["text"][lo:hi].cast(pa.large_string()), *[pa.scalar(c, pa.large_string()) for c in ("", "\n")]))
                ends = np.flatnonzero(raw == 10)
                first = np.searchsorted(ends, at)  # the text's first line
                n = np.diff(first)
                line = np.arange(len(ends)) - np.repeat(first[:-1], n)
                own = np.flatnonzero(flagged(on_spots, np.repeat(np.asarray(b["th"][lo:hi]), n) ^ line))
                if not len(own):
                    continue
                x = Lines(pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends + 1)), pa.py_buffer(raw)).take(pa.array(own)))
                if not x.count:
                    continue
                h = x.digests()
                own = np.flatnonzero(flagged(on_lines, np.array([xxh64_intdigest(d, 42) for d in h], "u8").view("i8")))
                t = [x.raw[x.start[i] : x.end[i]].tobytes().decode("utf-8", "surrogatepass") for i in own]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for i in own], pa.binary()), pa.array(t, pa.string())], ["id", "payload"])

    return keyed_docs(docs).select("text", "th").mapInArrow(returning(run), "id binary, payload string").dropDuplicates(["id"])


def removals(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, line) of the lines to drop: all but the first of each connected group.

    Rows that agree in doc_id and text are one document here.
    """
    t = written(lines(docs, min_chars), "lines")
    spot = F.col("th").bitwiseXOR(F.col("line").cast("long"))  # text and line of one occurrence
    kinds = t.groupBy("h").agg(*[F.min(c).alias(c) for c in (*FPS, *PACKED)], F.min(spot).alias("spot"), F.count(F.lit(1)).alias("n"))
    kinds = written(kinds, "kinds")
    near = candidates(kinds.select(*FPS, *PACKED), FPS, block_and_phrase_keys, BLOCKS + PHRASES, RADIUS)
    wanted = written(grouped(kinds.select("h", *FPS, "spot"), near, "f0"), "wanted")
    texts = written(_texts(docs, wanted), "texts")
    links = components(linked(wanted.select("root", F.col("h").alias("id"), *FPS), texts, FPS, RADIUS, str, similar_pairs, spread=1 - SIMILARITY))
    # only kinds that repeat or are linked can lose a line
    named = kinds.where("n > 1").select("h", F.col("h").alias("g")).join(links.select(F.col("node").alias("h")), "h", "left_anti")
    named = written(named.unionByName(links.select(F.col("node").alias("h"), F.col("root").alias("g"))), "named")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "line")
    again = written(t.select("doc_id", "th", "line", "h").join(named, "h").select("doc_id", "th", "line", "g"), "again")
    discard(t, kinds, wanted, texts, named)
    first = written(again.groupBy("g").agg(F.min(place).alias("f")), "first")
    return again.join(first, "g").where(place > F.col("f")).select("doc_id", "th", "line")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the repeated lines taken out of text, and n_lines_dropped beside it.

    Null texts stay null, texts without a dropped line are untouched, and no row is removed.  Of rows that
    agree in doc_id and text one keeps the lines that stand there first; the others lose every line with a
    word of min_chars characters.  Only documents that lose a line are joined; the rest pass by a bitmap.
    """
    drop = removals(docs, min_chars)
    gone = written(drop.groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone")), "gone")
    again = keyed_docs(docs).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "th")
    lossy = written(gone.join(again, gone["doc_id"].eqNullSafe(again["doc_id"]) & (gone["th"] == again["th"]), "full_outer").select(F.coalesce(gone["doc_id"], again["doc_id"]).alias("doc_id"), F.coalesce(gone["th"], again["th"]).alias("th"), "gone"), "lossy")
    place = [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))]
    both = marked(docs, bit_words(lossy, F.xxhash64("doc_id", "th")), F.xxhash64(*place))
    hit = written(both.where("__hit").select(*docs.columns, F.coalesce(place[0], F.lit(0)).alias("__id"), place[0].isNull().alias("__none"), place[1].alias("__th"), F.monotonically_increasing_id().alias("__row")), "lossy_docs")
    key = ["__id", "__none", "__th"]
    first = hit.groupBy(*key).agg(F.min("__row").alias("__first"))
    info = first.join(lossy.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("th").alias("__th"), F.col("gone").alias("__gone")), key, "left")

    @F.pandas_udf("text string, n long")
    def cut(text: pd.Series, gone: pd.Series, first: pd.Series) -> pd.DataFrame:
        out, n = [], []
        for t, g, f in zip(text, gone, first, strict=True):
            if t is None:
                out.append(None)
                n.append(0)
                continue
            own = t.split("\n")
            lost = set() if g is None else set(g)
            kept = [x for i, x in enumerate(own) if i not in lost] if f else [x for x in own if len(normal(x)) < min_chars]
            out.append("\n".join(kept))
            n.append(len(own) - len(kept))
        return pd.DataFrame({"text": out, "n": n})

    changed = hit.join(info, key).withColumn("__cut", cut("text", "__gone", F.col("__row") == F.col("__first")))
    changed = changed.withColumn("text", F.col("__cut.text")).withColumn("n_lines_dropped", F.col("__cut.n").cast("int"))
    discard(gone)
    passed = both.where("NOT __hit").withColumn("n_lines_dropped", F.lit(0))
    names = [*docs.columns, "n_lines_dropped"]
    return passed.select(*names).unionByName(changed.select(*names))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines_kept, n_lines_dropped, kept_crc32): lines and checksum of the text that is kept."""
    d = dedup(docs.select("doc_id", "text"))
    t = F.coalesce("text", F.lit(""))
    return d.select("doc_id", F.size(F.split(t, "\n", -1)).cast("long").alias("n_lines_kept"), F.col("n_lines_dropped").cast("long").alias("n_lines_dropped"), F.crc32(t.cast("binary")).alias("kept_crc32"))
