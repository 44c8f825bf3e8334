"""What several operators share: shared storage, words, cached tokenisation, folds."""

from __future__ import annotations

import re
import unicodedata
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES_JVM = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (`spark.checkpoint.dir`).

    Where the setting is absent a session on one machine (master `local`) gets a folder of its own; on a
    cluster that is an error, because executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="rillsum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a table in shared storage: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again; without a JVM gateway they stay."""
    for t in tables:
        jvm = getattr(t.sparkSession, "_jvm", None)
        if jvm is not None and (path := getattr(t, "scratch_path", None)):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Bits of a bitmap, whatever the input: 2 MB.  More marked rows let more others pass, to be joined exactly.
BITMAP = 1 << 24


def bit_words(rows: DataFrame, key: Column) -> DataFrame:
    """(w, bits): the words with a set bit of a bitmap over a 64-bit key; 2^18 rows at most."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    return rows.select(F.shiftright(F.pmod(key, F.lit(BITMAP)), 6).alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))


def bitmap(rows: DataFrame, key: Column) -> np.ndarray:
    out = np.zeros(BITMAP // 64, "i8")
    for r in bit_words(rows, key).collect():
        out[r["w"]] = r["bits"]
    return out.view("u8")


def flagged(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds the keys."""
    slot = key & np.int64(BITMAP - 1)
    return ((bits[slot >> 6] >> (slot & 63).astype("u8")) & np.uint64(1)).astype(bool)


def marked(docs: DataFrame, words: DataFrame, key: Column) -> DataFrame:
    """docs with __hit: whether the bitmap of `words` holds the key.  The broadcast side has 2^18 rows at most."""
    d = docs.withColumn("__slot", F.pmod(key, F.lit(BITMAP)))
    d = d.join(F.broadcast(words.select(F.col("w").alias("__w"), F.col("bits").alias("__bits"))), F.shiftright("__slot", 6) == F.col("__w"), "left")
    hit = F.call_function("shiftrightunsigned", F.col("__bits"), F.pmod("__slot", F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return d.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__slot", "__w", "__bits")


def mix64(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, bounds of the texts); no nulls."""
    at = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    n = int(at[-1] - at[0])
    return np.frombuffer(texts.buffers()[2], "u1", n, int(at[0])) if n else np.empty(0, "u1"), at - at[0]


def cut_words(raw: np.ndarray, at: np.ndarray):
    """The words of texts laid end to end in raw: (first byte, length, bytes of all words, where each word starts in them, 64-bit hash)."""
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    begin = np.flatnonzero(~space & (before | first[:-1]))
    length = np.flatnonzero(~space & (after | first[1:])) - begin + 1
    byte = raw[~space]
    head = np.cumsum(length) - length
    return begin, length, byte, head, hash_words(byte, head, length)


def hash_words(byte: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their bytes, one word after the other, and where each starts."""
    if not len(head):
        return np.empty(0, "u8")
    weight = mix64(np.arange(1, int(length.max()) + 1, dtype="u8")) | np.uint64(1)
    place = np.ones(len(byte), "i4")  # steps within a word, and back to its first byte
    place[0] = 0
    place[head[1:]] -= length[:-1].astype("i4")
    return mix64(np.add.reduceat(weight[np.cumsum(place, dtype="i4")] * (byte.astype("u8") + np.uint64(1)), head))


def per_word(on: np.ndarray, head: np.ndarray) -> np.ndarray:
    """How many bytes of each word are marked."""
    at = np.flatnonzero(on)
    if len(at) * 16 > len(on):
        return np.add.reduceat(on, head, dtype="i8")
    return np.bincount(np.searchsorted(head, at, "right") - 1, minlength=len(head))


def ones(u, at, n, v=None):
    """How many of each line's numbers have each bit set, with v those of both: eight passes that count in the bytes of 64-bit sums."""
    per = -(-n // (255 if v is None else 127))  # a byte counts up to 255
    if int(per.max()) > 1:
        piece = np.cumsum(per) - per
        step = np.arange(int(per.sum())) - np.repeat(piece, per)
        cut = np.repeat(at, per) + (255 if v is None else 127) * step
    else:
        piece, cut = None, at
    out = np.empty((len(cut), 8, 8), "u1")
    low = np.uint64(0x0101010101010101)
    for s in range(8):
        x = (u >> np.uint64(s)) & low
        if v is not None:
            x += (v >> np.uint64(s)) & low
        out[:, s, :] = np.add.reduceat(x, cut).astype("<u8").view("u1").reshape(-1, 8)
    out = out.reshape(len(cut), 64).astype("i4")
    return out if piece is None else np.add.reduceat(out, piece, axis=0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def text_or_empty() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def n_words_expr(text: Column) -> Column:
    """Words of a text (null: 0): split pieces less the empty ones at the ends."""
    parts = F.split(text, SPACES_JVM)
    return F.coalesce(F.size(F.filter(parts, lambda x: x != "")), F.lit(0)).cast("long")


def returning(run, keeps: bool = False):
    """`run` for mapInArrow; when its task ends the worker, which goes on to other tasks, returns freed memory to the system.

    Unless the operator keeps a value itself (`kept_in_worker`), what another one kept in the worker is dropped first.
    """

    def out(batches):
        import ctypes
        import sys

        if not keeps and (held := sys.modules.get("_rillsum_worker")):
            held.__dict__.pop("key", None)
            held.__dict__.pop("value", None)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return out


def kept_in_worker(key: str, make):
    """make() once per Python worker: its value serves all tasks of one operator that the worker runs.

    A worker keeps one value; another operator's takes its place, so a long session does not pile them up.
    """
    import sys
    import types

    held = sys.modules.setdefault("_rillsum_worker", types.ModuleType("_rillsum_worker")).__dict__
    if held.get("key") != key:
        held["value"] = None
        held["key"], held["value"] = key, make()
    return held["value"]


#: White space as the tokenizers' patterns know it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pairs(marks: str) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, whether a piece starts at a byte after one of another class).

    Classes: 0 other, 1 space, 2 other white space, 3 ASCII letter, 4 ASCII mark, 5 apostrophe.
    """
    kind = np.zeros(256, "u1")
    kind[32], kind[9:14] = 1, 2
    for c in range(128):
        if chr(c).isalpha():
            kind[c] = 3
        elif chr(c) in marks:
            kind[c] = 5 if chr(c) == "'" else 4
    cut = np.zeros((6, 6), bool)  # [before, here]
    cut[[0, 3, 4, 5], 1] = cut[[0, 3, 4, 5], 2] = True  # white space begins
    cut[2, [0, 3, 4, 5]] = True  # a word takes a space along, but no other white space
    cut[3, [4, 5]] = True
    cut[4, 3] = True  # an apostrophe may belong to the letters after it
    return kind, cut.ravel()


# The normalisers and pre-tokenisers, as tokenizer files state them, that TokenBytes cuts for.
BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
WORD_LEVEL = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class TokenBytes:
    """Token ids of whole texts, as flat arrays.

    Both public BPE vocabularies treat the cuts made here as pre-token boundaries, so the ids of a
    text are the ids of its pieces in order.  The pieces of a chunk are cut and numbered by numpy and
    Arrow, and each distinct piece is tokenised once per worker while it stays in the cache.  spaced:
    a leading space counts (byte-level BPE); else white space is dropped.  The cache holds two
    generations of `limit` pieces; the older one goes when the newer is full.  specials: a special token
    that stands literally in a text gets its own id, as the tokenizer does by default; else it is text.
    """

    #: A run of other characters with one space before it; white space up to its last character; the rest.
    SPACED = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
    #: White space of more than one byte; texts that hold it are cut by the pattern above.
    WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
    #: A run of these after a letter is a pre-token of its own.
    ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, spaced: bool, limit: int = 250_000, specials: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self._known(spaced)
        self.t.encode_special_tokens = True
        added = [a.content.encode() for a in self.t.get_added_tokens_decoder().values()] if specials else []
        self.special = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.spaced, self.limit, self.new, self.old = spaced, limit, {}, {}
        # Runs of letters are single pre-tokens: the model takes them as they are, in byte-level letters.
        self.model = self.t.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: 256 + i for i, b in enumerate(others)}
        self.kind, self.after = _pairs(self.ENDS + "'")
        self.tails: dict[str, bytes] = {}

    def _known(self, spaced: bool) -> None:
        """Raises for a tokenizer whose normaliser or pre-tokeniser is not one that the cuts are made for."""
        import json

        t = json.loads(self.t.to_str())
        got = {k: t[k] for k in ("normalizer", "pre_tokenizer")}
        if got != (BYTE_LEVEL if spaced else WORD_LEVEL) or t["model"]["type"] != "BPE" or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in t["added_tokens"]):
            raise ValueError(f"no cuts are known for a tokenizer with {got}")

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.t.encode_batch_fast(pieces, add_special_tokens=False)]

    def _word(self, p: str) -> str | None:
        """A run of letters, with or without a space before it, in byte-level letters; None for any other piece."""
        led = p[0] == " "
        body = p[1:] if led else p
        if not body.isalpha():
            return None
        if body.isascii():
            return ("\u0120" + body if led else body) if self.spaced else body.lower()
        if self.spaced:
            body = p
        else:
            body = "".join([c.lower() for c in unicodedata.normalize("NFC", body)])  # letter by letter, as the tokenizer does
            if not body.isalpha():
                return None
        return body.encode("utf-8").decode("latin-1").translate(self.letters)

    def _letter(self, c: str) -> bool:
        """Whether a mark after c starts a pre-token; lower case may end in a combining mark, which joins it."""
        if c.isascii() or self.spaced:
            return c.isalpha()
        c = unicodedata.normalize("NFC", c)
        return c.isalpha() and c[-1].lower()[-1].isalpha()

    def _learn(self, missing: list[str]) -> None:
        new, rest, ends, tails, marks, word, model = self.new, [], [], self.tails, self.ENDS, self._word, self.model.tokenize
        for p in missing:
            x = word(p)
            if x is not None:
                new[p] = array("I", [t.id for t in model(x)]).tobytes()
                continue
            q = p.rstrip(marks) if not p[-1].isalpha() else ""
            if not q or q == p or not self._letter(q[-1]):
                rest.append(p)
                continue
            end = p[len(q) :]
            tail = tails.get(end)
            if tail is None:
                tail = self._whole([end])[0]
                if len(tails) < 100_000:
                    tails[end] = tail
            if q not in new:
                x = word(q)
                if x is None:
                    rest.append(q)
                else:
                    new[q] = array("I", [t.id for t in model(x)]).tobytes()
            ends.append((p, q, tail))
        for a in range(0, len(rest), 5000):
            part = rest[a : a + 5000]
            new.update(zip(part, self._whole(part), strict=True))
        for p, q, tail in ends:
            new[p] = new[q] + tail

    def _starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte positions where pieces start; at: the bounds of the texts in raw."""
        first = np.zeros(len(raw) + 1, bool)
        first[at] = True
        kind = self.kind[raw]
        start = first[:-1].copy()
        start[1:] |= self.after[kind[:-1] * np.uint8(6) + kind[1:]]
        space = (kind == 1) | (kind == 2)
        # the last white space before a word is a piece of its own, or leads the word if it is a space
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
        wide = {int(np.searchsorted(at, m.start(), "right")) - 1 for m in self.WIDE_SPACE.finditer(raw)}
        for i in wide:
            lo, hi = at[i], at[i + 1]
            start[lo:hi] = False
            size = [len(p.encode("utf-8")) for p in self.SPACED.findall(raw[lo:hi].tobytes().decode("utf-8"))]
            start[lo + np.cumsum([0, *size[:-1]])] = True
        return np.flatnonzero(start)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); a null counts as empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
        lo, at = int(bounds[0]), bounds - bounds[0]
        if not at[-1]:
            return np.empty(0, "u4"), np.zeros(len(texts), "i8")
        raw = np.frombuffer(texts.buffers()[2], "u1", int(at[-1]), lo)
        if self.special and (odd := sorted({int(np.searchsorted(at, m.start(), "right")) - 1 for m in self.special.finditer(raw)})):
            return self._with_specials(texts, odd)
        start = self._starts(raw, at)
        cuts = np.append(start, len(raw))
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        kinds = pieces.dictionary.to_pylist()
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        got = list(map(self.new.get, kinds))
        missing = [p for p, x in zip(kinds, got, strict=True) if x is None]
        if missing:
            old = self.old
            again = [p for p in missing if p in old]
            self.new.update((p, old[p]) for p in again)
            self._learn([p for p in missing if p not in old] if again else missing)
            now = self.new
            got = [now[p] if x is None else x for p, x in zip(kinds, got, strict=True)]
        cells = pa.array(got, pa.large_binary()).take(pieces.indices)
        end = np.frombuffer(cells.buffers()[1], "i8", len(cells) + 1) >> 2
        return np.frombuffer(cells.buffers()[2], "<u4", int(end[-1])), np.diff(end[np.searchsorted(start, at)])

    def _with_specials(self, texts: pa.Array, odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_array, where the texts at odd, which hold special tokens, are left to the tokenizer."""
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        ids, n = self.encode_array(pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), texts))
        ends, parts, at = np.cumsum(n), [], 0
        self.t.encode_special_tokens = False
        for i in odd:
            own = np.array(self.t.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            parts += [ids[at : ends[i]], own]
            at, n[i] = ends[i], len(own)
        self.t.encode_special_tokens = True
        return np.concatenate([*parts, ids[at:]]), n

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_array, with end_id after each text."""
        ids, n = self.encode_array(texts)
        n = n + 1
        out, own = np.empty(len(ids) + len(n), "<u4"), np.ones(len(ids) + len(n), bool)
        own[np.cumsum(n) - 1] = False
        out[own], out[~own] = ids, end_id
        return out, n

    @staticmethod
    def rest() -> None:
        """At the end of a task: else the worker keeps the most that any chunk took."""
        pa.default_memory_pool().release_unused()

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, n = self.encode_array(pa.array(texts, pa.string()))
        end = np.cumsum(n)
        return [ids[e - k : e].tobytes() for e, k in zip(end, n, strict=True)]


def byte_chunks(texts: pa.Array, limit: int = 8 << 20):
    """Bounds of slices of an Arrow array of texts that hold about `limit` bytes, one text at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), "i8"))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def chunks(texts: list, limit: int = 4 << 20):
    """Slices of a batch whose texts have about `limit` characters, one text at least."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= limit:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
