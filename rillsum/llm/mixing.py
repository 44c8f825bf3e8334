"""Mixing sources to target weights by pivotal dependent rounding.

A document is copied floor(r) times and once more with probability r - floor(r), r = target / size of
its source.  The pivotal method settles the fractions in pairs: mass in words moves from one document
to the other until one is all or nothing, the direction drawn so that expectations hold.  Cells of
documents leave at most one open document per source; a reduction tree settles those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillsum.llm.common import n_words_expr, text_or_empty, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
CELL, FAN = 32_768, 64


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source; sizes: (source, words).

    Sources in code-point order, null last, weigh WEIGHTS in turn.  A target stops at most * size; the
    excess goes to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(n for _, n in order), [s for s, _ in order]
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
        open_ = [s for s in open_ if s not in out]
    return out


def settle(mass: list[float], size: list[float], draws: list[float]) -> list[float]:
    """Pivotal rounding in order: all of mass end at 0 or size but for one at most; the sum stays."""
    mass, i = list(mass), -1
    for j in range(len(mass)):
        if not 0 < mass[j] < size[j]:
            continue
        if i < 0:
            i = j
            continue
        up, down = min(size[i] - mass[i], mass[j]), min(mass[i], size[j] - mass[j])
        if draws[j] * (up + down) < down:  # i gains
            i_full, j_full = size[i] - mass[i] <= mass[j], mass[j] <= size[i] - mass[i]
            mass[i], mass[j] = (size[i] if i_full else mass[i] + up), (0.0 if j_full else mass[j] - up)
        else:
            i_full, j_full = mass[i] <= size[j] - mass[j], size[j] - mass[j] <= mass[i]
            mass[i], mass[j] = (0.0 if i_full else mass[i] - down), (size[j] if j_full else mass[j] + down)
        i = i if 0 < mass[i] < size[i] else j if 0 < mass[j] < size[j] else -1
    return mass


ROW = "key long, cell long, doc_id long, th long, source string, size long, whole long, mass double"


def _round(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """Settles each cell, large documents first; with last, the one open document of a source goes to the nearer end."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "size", "key", "doc_id", "th", "mass"], kind="stable", na_position="last", ascending=[True, False, True, True, True, True]).reset_index(drop=True)
        salt = np.uint64(seed * 0xD1B54A32D192ED03 % 2**64)
        u = ((pdf["key"].to_numpy().view("u8") * np.uint64(0x9E3779B97F4A7C15) + salt) >> np.uint64(11)).astype("f8") / 2**53
        mass = pdf["mass"].to_numpy().copy()
        size = pdf["size"].to_numpy().astype("f8")
        for _, at in pdf.groupby("source", dropna=False, sort=False).indices.items():
            m = settle(mass[at].tolist(), size[at].tolist(), u[at].tolist())
            if last:
                m = [x if not 0 < x < n else (n if 2 * x >= n else 0.0) for x, n in zip(m, size[at], strict=True)]
            mass[at] = m
        pdf["mass"] = mass
        return pdf

    return rows.groupBy("cell").applyInPandas(run, ROW)


def mix(docs: DataFrame, seed: int = 29) -> DataFrame:
    """(doc_id, th, source, size, source_size, target, copies): th is the xxhash64 of the text.

    Null and empty texts have size 0 and are copied 0 times beyond floor(r).  A null source is a source
    of its own.  Cells and draws depend on doc_id and text alone, so reruns agree.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col("source").cast("string").alias("source"), n_words_expr(text).alias("size"))
    base = written(base, "sizes")
    per = [(r["source"], r["n"]) for r in base.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # one row per source
    goal = targets(per)
    plan = spark.createDataFrame([(s, n, goal[s]) for s, n in per], "source string, source_size long, target double")
    n = base.count()
    cells = max(1, -(-n // CELL))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    key = F.xxhash64(F.lit(seed), "doc_id", "th")
    mapped = base.join(F.broadcast(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).withColumn("key", key)
    rows = mapped.select("key", F.pmod("key", F.lit(cells)).alias("cell"), "doc_id", "th", "source", "size", whole.cast("long").alias("whole"), ((ratio - whole) * F.col("size")).alias("mass"))
    is_open = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    done = []
    while True:
        last = cells == 1
        out = written(_round(rows, seed, last), "mixed")
        if last:
            done.append(out)
            break
        done.append(out.where(~is_open))
        cells = -(-cells // FAN)
        rows = out.where(is_open).withColumn("cell", F.floor(F.col("cell") / FAN).cast("long"))
        seed += 1
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.unionByName(d)
    extra = F.when((F.col("mass") >= F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    return all_.join(F.broadcast(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "th", "source", "size", "source_size", "target", (F.col("whole") + extra).alias("copies")
    )


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, seed: int = 29) -> DataFrame:
    """docs with every row repeated as often as the mix copies it, 0 times included; columns stay.

    Rows that agree in doc_id, text and source share their copies: each gets the same whole number, and what
    is left over goes to one of them.  An empty table stays empty.
    """
    plan = mix(docs, seed)
    key = ["__id", "__none", "__th", "__source", "__other"]
    place = [F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("th"), F.coalesce("source", F.lit("")), F.col("source").isNull()]
    plan = plan.groupBy(*[c.alias(k) for c, k in zip(place, key, strict=True)]).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = written(plan.select(*key, F.expr("copies DIV rows").alias("__each"), F.expr("copies % rows").alias("__rest")).where("__each > 0 OR __rest > 0"), "copies")
    own, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    place = [F.coalesce(own, F.lit(0)), own.isNull(), F.xxhash64(text_or_empty()), F.coalesce(source, F.lit("")), source.isNull()]
    d = docs.select("*", *[c.alias(k) for c, k in zip(place, key, strict=True)])

    def times(rows: DataFrame, n: str) -> DataFrame:
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)

    rest = d.join(plan.where("__rest > 0"), key).dropDuplicates(key)
    return times(d.join(plan.where("__each > 0"), key), "__each").unionByName(times(rest, "__rest"))
