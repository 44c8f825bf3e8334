"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (1 to 3 characters of padded words) by rank.  A document's
own profile is compared with each language's by the out-of-place distance: the sum of rank
differences, an absent n-gram counting as the profile's length.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillsum.llm.common import fold, kept_in_worker

TOP = 300
#: Learn from about so many documents of a language, those whose hash falls under SAMPLE / documents.
SAMPLE = 2048
FOLDS, HELD = 4, 2


def _letters():
    """Lookup over all code points: the lower-case letter itself, 32 for anything else."""
    import sys

    import numpy as np

    t = np.full(sys.maxunicode + 1, 32, "u4")
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            t[i] = ord(low[0])
    return t


def grams(text: str, letters):
    """(n-gram codes, counts) of a whole text, 21 bits a character; empty if it has no letter."""
    import numpy as np

    c = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    c = np.concatenate((np.array([32], "u4"), c, np.array([32], "u4")))
    gap = c == 32
    c = c[~(gap & np.concatenate(([False], gap[:-1])))].astype("u8")  # one space between words
    if len(c) < 3:
        return np.empty(0, "u8"), np.empty(0, "i8")
    s = c == 32
    two = c[:-1] | (c[1:] << np.uint64(21))
    three = two[:-1] | (c[2:] << np.uint64(42))
    every = np.concatenate((c[~s], two[~(s[:-1] & s[1:])], three[~s[1:-1]]))
    every.sort()
    start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[start], np.diff(np.concatenate((start, [len(every)])))


def ranked(codes, counts, top: int = TOP):
    """The `top` most frequent codes, ties to the smaller code."""
    import numpy as np

    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))[:top]]


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles by language from the learning folds; rows with null text, lang or doc_id teach nothing.

    n-grams are counted where the documents are; a task sends one row per language and n-gram, and
    the driver receives TOP rows per language.
    """
    import numpy as np
    import pyarrow as pa

    known = docs.select("doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), FOLDS) != HELD)
    per = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row per language
    share = F.broadcast(per.select(F.col("lang").alias("p_lang"), (F.lit(float(SAMPLE)) / F.col("n")).alias("share")))
    draw = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.withColumn("draw", draw).join(share, F.col("lang") == F.col("p_lang")).where(F.col("draw") < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = kept_in_worker("letters", _letters)
        parts: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                parts.setdefault(lang, []).append(grams(text, letters))
        for lang, x in parts.items():
            codes, inv = np.unique(np.concatenate([c for c, _ in x]), return_inverse=True)
            n = np.bincount(inv, np.concatenate([k for _, k in x]), minlength=len(codes)).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view("i8")), pa.array(n)], ["lang", "gram", "n"])

    total = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.withColumn("rank", rank).where(F.col("rank") <= TOP).collect()
    out: dict[str, list[int]] = {r["lang"]: [] for r in sorted(rows, key=lambda r: r["lang"])}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out[r["lang"]].append(r["gram"])
    return out


class Ranks:
    """All profiles as one sorted table of n-grams by language ranks."""

    def __init__(self, profiles: dict[str, list[int]]):
        import numpy as np

        self.langs = sorted(profiles)
        self.codes = np.array(sorted({g for p in profiles.values() for g in p}), "u8")
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, "i4")
        for j, lang in enumerate(self.langs):
            own = np.array(profiles[lang], "u8")
            self.rank[np.searchsorted(self.codes, own), j] = np.arange(len(own))

    def nearest(self, codes) -> tuple[str, float]:
        """(language, score) of a ranked profile; score is 1 - distance / largest distance; ties to the lesser name."""
        import numpy as np

        if not len(codes) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        r = self.rank[at]
        d = np.where(r < 0, TOP, np.minimum(TOP, np.abs(r - np.arange(len(codes))[:, None]))).sum(0)
        j = int(np.argmin(d))
        return self.langs[j], 1.0 - float(d[j]) / (TOP * len(codes))


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs, from the whole text alone.

    Null texts, texts without a letter and, without any profile, all texts get `und` and 0.  A null
    doc_id is in no fold: held_out is false.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, ranks = kept_in_worker("letters", _letters), Ranks(profiles)
        for b in batches:
            lang, score = [], []
            for t in b["text"]:
                name, s = ranks.nearest(ranked(*grams(t.as_py() or "", letters)))
                lang.append(name)
                score.append(s)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
