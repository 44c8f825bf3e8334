"""Token ids in a static rANS file format.

Format of a segment (one binary cell; all integers little-endian):
  magic "RSG2", u32 table checksum, u32 documents, u64 tokens, u32 lanes, u32 step count of a checkpoint interval, u32 crc32 of the document records
  documents x (u8 has_id, i64 doc_id, u32 tokens)
  blocks: u32 tokens, u32 crc32 of the ids, u32 words, u32 checkpoints, checkpoints x (u32 word offset, lanes x u64 state), words x u32
Blocks are coded independently by `lanes` interleaved coders: lane j holds ids j, j + lanes, ...  Checkpoint i
holds all states before step i * interval, so every interval decodes by itself.  One frequency table
(sum 2^20) serves all segments; it counts the ids of the whole corpus.  A file set is a folder: `table` holds the
frequencies (id, frequency), `segments` the segments (part, seq, start, payload), both as Parquet, so a path is all
that a reader needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillsum.llm.common import TokenBytes, byte_chunks, discard, kept_in_worker, scratch, text_or_empty, written

BITS, LOW = 20, 1 << 31
LANES, BLOCK, INTERVAL = 64, 1 << 15, 128
SEGMENT = 1 << 20
HEAD = "<4sIIQIII"
DOC = np.dtype([("has", "u1"), ("id", "<i8"), ("n", "<u4")])
COUNT = np.dtype([("id", "<u4"), ("n", "<i8")])


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2^20, at least 1 for every id that occurs."""
    counts = np.asarray(counts, "f8")
    seen = counts > 0
    if seen.sum() > 1 << BITS:
        raise ValueError("more distinct ids than table slots")
    f = np.zeros(len(counts), "i8")
    if seen.any():
        f[seen] = np.maximum(1, np.floor(counts[seen] / counts.sum() * (1 << BITS))).astype("i8")
        while (over := int(f.sum()) - (1 << BITS)) > 0:
            top = np.argsort(-f, kind="stable")[:over]
            f[top[f[top] > 1]] -= 1
        f[int(np.argmax(counts))] -= over
    return f.astype("u8")


class Table:
    """Lookups of the scaled frequencies."""

    def __init__(self, f: np.ndarray):
        self.f = f
        self.c = np.concatenate(([0], np.cumsum(f)[:-1])).astype("u8")
        self.slot = np.repeat(np.arange(len(f), dtype="u4"), f.astype("i8"))
        self.check = zlib.crc32(f.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, t: Table, group: int = 32) -> list[bytes]:
    """The coded blocks of ids (u32); `group` blocks advance together, one numpy step per lane row."""
    out = []
    for g in range(0, len(ids), BLOCK * group):
        part = ids[g : g + BLOCK * group]
        nb = -(-len(part) // BLOCK)
        sizes = [min(BLOCK, len(part) - i * BLOCK) for i in range(nb)]
        pad = np.zeros(nb * BLOCK, "u4")
        pad[: len(part)] = part
        steps = -(-max(sizes) // LANES)
        live = (np.arange(nb * BLOCK) < len(part)).reshape(nb, BLOCK // LANES, LANES)[:, :steps]
        sym = pad.reshape(nb, BLOCK // LANES, LANES)[:, :steps]
        x = np.full((nb, LANES), LOW, "u8")
        words = np.zeros((nb, steps, LANES), "u4")
        sent = np.zeros((nb, steps, LANES), bool)
        marks = {}
        for s in range(steps - 1, -1, -1):
            f, c, on = t.f[sym[:, s]], t.c[sym[:, s]], live[:, s]
            f = np.where(on, f, 1)
            full = on & (x >= (f << np.uint64(43)))
            words[:, s], sent[:, s] = x & np.uint64(0xFFFFFFFF), full
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            x = np.where(on, (q << np.uint64(BITS)) + (x - q * f) + c, x)
            if s % INTERVAL == 0:
                marks[s] = x.copy()
        for b in range(nb):
            per = np.concatenate(([0], np.cumsum(sent[b].sum(1))))
            stream = words[b][sent[b]]
            own = [s for s in sorted(marks) if s * LANES < sizes[b] or s == 0]
            raw = part[b * BLOCK : b * BLOCK + sizes[b]].astype("<u4").tobytes()
            head = struct.pack("<IIII", sizes[b], zlib.crc32(raw), len(stream), len(own))
            # the word that lane state s needs next is sent in the step before it: offset after step s - 1 has refilled
            out.append(head + b"".join(struct.pack("<I", int(per[s])) + marks[s][b].astype("<u8").tobytes() for s in own) + stream.astype("<u4").tobytes())
    return out


def decode_blocks(blocks: list[tuple[int, int, list, np.ndarray]], t: Table, group: int = 2048) -> list[np.ndarray]:
    """Ids of blocks (tokens, crc, [(offset, states)], words); all checkpoint intervals advance side by side."""
    units = [(b, i * INTERVAL, off, st) for b, (_, _, marks, _) in enumerate(blocks) for i, (off, st) in enumerate(marks)]
    out = [np.zeros(-(-n // LANES) * LANES, "u4") for n, _, _, _ in blocks]
    starts = np.cumsum([0] + [len(w) for _, _, _, w in blocks])
    stream = np.concatenate([w for _, _, _, w in blocks] + [np.zeros(LANES + 1, "u4")]).astype("u8")
    for g in range(0, len(units), group):
        own = units[g : g + group]
        x = np.array([st for _, _, _, st in own], "u8")
        at = np.array([starts[b] + off for b, _, off, _ in own], "i8")
        left = np.array([blocks[b][0] - s0 * LANES for b, s0, _, _ in own], "i8")
        got = np.zeros((len(own), INTERVAL, LANES), "u4")
        lane = np.arange(LANES)
        for s in range(INTERVAL):
            on = lane < (left - s * LANES)[:, None]
            if not on.any():
                break
            slot = x & np.uint64((1 << BITS) - 1)
            sym = t.slot[slot.astype("i8")]
            got[:, s] = sym
            x = np.where(on, t.f[sym] * (x >> np.uint64(BITS)) + slot - t.c[sym], x)
            need = on & (x < np.uint64(LOW))
            rank = np.cumsum(need, 1)
            # lanes refill in ascending order, as the encoder stored them
            x = np.where(need, (x << np.uint64(32)) | stream[np.minimum(at[:, None] + rank - 1, len(stream) - 1)], x)
            at += rank[:, -1]
        for u, (b, s0, _, _) in enumerate(own):
            room = out[b][s0 * LANES : (s0 + INTERVAL) * LANES]
            room[:] = got[u].ravel()[: len(room)]
    done = []
    for ids, (n, crc, _, _) in zip(out, blocks, strict=True):
        ids = ids[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum mismatch in a block")
        done.append(ids)
    return done


def pack_segment(docs: list[tuple[int | None, int]], ids: np.ndarray, t: Table) -> bytes:
    rec = np.array([(d is not None, d or 0, n) for d, n in docs], DOC)
    head = struct.pack(HEAD, b"RSG2", t.check, len(docs), len(ids), LANES, INTERVAL, zlib.crc32(rec.tobytes()))
    return head + rec.tobytes() + b"".join(encode_blocks(ids, t))


def unpack_segment(raw: bytes, t: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, tokens per document, all ids)."""
    magic, check, n_docs, n, lanes, interval, crc = struct.unpack_from(HEAD, raw)
    if magic != b"RSG2" or check != t.check or (lanes, interval) != (LANES, INTERVAL):
        raise ValueError("not a segment of this table")
    rec = np.frombuffer(raw, DOC, n_docs, struct.calcsize(HEAD))
    if zlib.crc32(rec.tobytes()) != crc:
        raise ValueError("checksum mismatch in the document records")
    at, blocks = struct.calcsize(HEAD) + rec.nbytes, []
    while at < len(raw):
        size, crc, words, marks = struct.unpack_from("<IIII", raw, at)
        at += 16
        own = []
        for _ in range(marks):
            own.append((struct.unpack_from("<I", raw, at)[0], np.frombuffer(raw, "<u8", LANES, at + 4)))
            at += 4 + 8 * LANES
        blocks.append((size, crc, own, np.frombuffer(raw, "<u4", words, at)))
        at += 4 * words
    ids = np.concatenate(decode_blocks(blocks, t) or [np.empty(0, "u4")])
    if len(ids) != n:
        raise ValueError("segment is cut short")
    return [int(r["id"]) if r["has"] else None for r in rec], rec["n"].astype("i8"), ids


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, specials: bool = True) -> DataFrame:
    """(part, seq, doc_id, n, before, ids, counts): documents in ascending (doc_id, text hash) order, nulls first.

    Rows of one part are one contiguous range; before counts the part's ids before the row.  Ids are
    stored as 16-bit cells where they fit.  A part's last row holds no document but counts: how often
    each id occurs in the part.
    """
    names = ["part", "seq", "doc_id", "n", "before", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seq, before = kept_in_worker((tokenizer, specials), lambda: TokenBytes(tokenizer, spaced=True, specials=specials)), 0, 0
        wide = enc.t.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        total, part = np.zeros(max(enc.t.get_vocab_size(), end_id + 1), "i8"), None
        for b in batches:
            for lo, hi in byte_chunks(b["text"]):
                ids, n = enc.encode_ended(b["text"][lo:hi], end_id)
                total += np.bincount(ids, minlength=len(total))
                ids = ids if wide else ids.astype("<u2")
                at = np.concatenate(([0], np.cumsum(n)))
                cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b["part"][lo:hi], pa.array(np.arange(seq, seq + hi - lo)), b["doc_id"][lo:hi], pa.array(n), pa.array(before + at[:-1]), cells, pa.nulls(hi - lo, pa.binary())],
                    names,
                )
                seq, before, part = seq + hi - lo, before + len(ids), b["part"][lo]
        enc.rest()
        if part is not None:
            seen = np.flatnonzero(total)
            counts = np.empty(len(seen), COUNT)
            counts["id"], counts["n"] = seen, total[seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()], pa.int32()), pa.array([seq]), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([before]), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())],
                names,
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # the row number splits a range of rows that repeat one document; among them any order is right
    d = d.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h")
    d = d.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    return d.mapInArrow(run, "part int, seq long, doc_id long, n long, before long, ids binary, counts binary")


def _ids(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, "<u2" if len(cell) == 2 * n else "<u4")


def frequencies(tokens: DataFrame) -> Table:
    """Counts over all documents; one row per id and task is shuffled, one per id reaches the driver (at most the vocabulary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, "i8")
        for b in batches:
            for cell in b["counts"]:
                c = np.frombuffer(cell.as_buffer(), COUNT)
                more = int(c["id"][-1]) + 1 - len(total)  # ascending, and the end id at least
                if more > 0:
                    total = np.concatenate((total, np.zeros(more, "i8")))
                total[c["id"]] += c["n"]
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["id", "n"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1)
    for r in rows:
        counts[r["id"]] = r["n"]
    return Table(scaled(counts))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, specials: bool = True) -> None:
    """Tokenises, counts, and writes the file set at path.

    Null text counts as empty, so every document has its end id; a null doc_id sorts first and stays
    null.  Repeated rows are written as often as they occur.  An empty table writes no segment.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer, end_id, specials), "tokens")
    t = frequencies(tokens)
    per = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row per task
    offset, at = {}, 0
    for p in sorted(per):
        offset[p], at = at, at + per[p]
    frequency = [(i, int(x)) for i, x in enumerate(t.f) if x]  # at most the vocabulary
    spark.createDataFrame(frequency, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((t.f, offset))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, offset = shared.value
        t = Table(f)
        docs, cells, size, first = [], [], 0, None

        def flush():
            raw = pack_segment(docs, np.concatenate(cells), t)
            part, seq, before = first
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "start": offset[part] + before, "payload": raw}], schema=out)

        out = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int64()), ("payload", pa.binary())])
        due = None
        for b in batches:
            for part, seq, d, n, before, cell in zip(*[b[c].to_pylist() for c in ("part", "seq", "doc_id", "n", "before", "ids")], strict=True):
                if docs and (size >= SEGMENT or due != (part, seq)):
                    yield flush()
                    docs, cells, size = [], [], 0
                if not docs:
                    first = (part, seq, before)
                docs.append((d, n))
                cells.append(_ids(cell, n).astype("u4"))
                size, due = size + n, (part, seq + 1)
        if docs:
            yield flush()

    tokens.where("counts IS NULL").drop("counts").mapInArrow(encode, "part int, seq long, start long, payload binary").write.option("compression", "none").parquet(f"{path}/segments")
    discard(tokens)


def read_table(spark: SparkSession, path: str) -> Table:
    """The frequency table of a file set; one row per id, at most the vocabulary."""
    rows = spark.read.parquet(f"{path}/table").collect()
    f = np.zeros(max((r["id"] for r in rows), default=0) + 1, "u8")
    for r in rows:
        f[r["id"]] = r["frequency"]
    return Table(f)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the file set at path; checksums are verified.

    ids_crc32 is taken over the decoded ids; without `ids` the last column is left out.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, path).f)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared.value)
        for b in batches:
            for start, raw in zip(b["start"].to_pylist(), b["payload"].to_pylist(), strict=True):
                docs, n, all_ids = unpack_segment(raw, t)
                end = np.cumsum(n)
                cells = [all_ids[e - k : e].astype("<u4").tobytes() for e, k in zip(end, n, strict=True)]
                out = [pa.array(docs, pa.int64()), pa.array(start + end - n), pa.array(n), pa.array([zlib.crc32(x) for x in cells], pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(cells, pa.binary())] * ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return spark.read.parquet(f"{path}/segments").select("start", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def digest(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, specials: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents, from the files written for them."""
    path = scratch(spark, "tokens")
    write(docs, path, tokenizer, end_id, specials)
    return read(spark, path, ids=False)
