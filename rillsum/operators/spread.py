"""Super-spreaders: per hashed cell a register array of the distinct elements and one candidate source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillsum.config import SpreadConfig
from rillsum.functions.hashing import with_hash32
from rillsum.functions.scalars import cardinality, cardinality_corrected, column_of, pack_pair, rank_of


class Spread:
    def __init__(self, config: SpreadConfig = SpreadConfig()):
        self.c = config

    def _updates(self, df: DataFrame, src: str, dst: str) -> DataFrame:
        """(row_id, pos, reg, rank, src).  Max is idempotent, so duplicates need no prior distinct.

        The rank gate is applied to the maxima: a filter here would be pushed through the hash chain.
        """
        c = self.c
        p = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
            F.col(src).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("src"), pack_pair(F.col(src), F.col(dst)).alias("pair")
        )
        h = with_hash32(p, "pair", [c.element_seed], prefix="e")
        h = h.select("src", rank_of(F.col(f"e{c.element_seed}"), c).alias("rank"), (F.col(f"e{c.element_seed}") % c.registers).cast("int").alias("reg"))
        h = with_hash32(h, "src", list(range(c.rows)), width=4, prefix="h")
        cells = F.array(*[F.struct(F.lit(r).alias("row_id"), column_of(F.col(f"h{r}"), c.length).alias("pos")) for r in range(c.rows)])
        return h.select("src", "rank", "reg", F.explode(cells).alias("x")).select("x.row_id", "x.pos", "reg", "rank", "src")

    def cells(self, df: DataFrame, src: str, dst: str) -> DataFrame:
        """(row_id, pos, reg, code): per register the highest rank, and of its sources the smallest, in one integer.

        One aggregate from which registers and candidates both follow; at most rows * length * registers rows.
        """
        code = F.shiftleft(F.col("rank").cast("long"), 32) + (F.lit(0xFFFFFFFF) - F.col("src"))
        return self._updates(df, src, dst).withColumn("code", code).groupBy("row_id", "pos", "reg").agg(F.max("code").alias("code"))

    def registers_of(self, cells: DataFrame) -> DataFrame:
        """(row_id, pos, reg, rank) over the rank gate."""
        return cells.select("row_id", "pos", "reg", F.shiftright("code", 32).cast("int").alias("rank")).where(F.col("rank") > self.c.min_rank)

    def candidates_of(self, cells: DataFrame) -> DataFrame:
        """(row_id, pos, level, candidate): the source of the highest rank, ties to the smallest source."""
        top = cells.groupBy("row_id", "pos").agg(F.max("code").alias("code"))
        level, source = F.shiftright("code", 32).cast("int"), F.lit(0xFFFFFFFF) - F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
        return top.select("row_id", "pos", level.alias("level"), source.alias("candidate")).where(F.col("level") > self.c.min_rank)

    def registers(self, df: DataFrame, src: str, dst: str) -> DataFrame:
        return self.registers_of(self.cells(df, src, dst))

    def candidates(self, df: DataFrame, src: str, dst: str) -> DataFrame:
        return self.candidates_of(self.cells(df, src, dst))

    @staticmethod
    def merge_cells(*cells: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, cells).groupBy("row_id", "pos", "reg").agg(F.max("code").alias("code"))

    @staticmethod
    def merge_registers(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("row_id", "pos", "reg").agg(F.max("rank").alias("rank"))

    @staticmethod
    def merge_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
        top = a.unionByName(b).groupBy("row_id", "pos").agg(F.max(F.struct("level", (-F.col("candidate")).alias("neg"))).alias("x"))
        return top.select("row_id", "pos", F.col("x.level").alias("level"), (-F.col("x.neg")).alias("candidate"))

    def cell_cardinality(self, registers: DataFrame, corrected: bool = False) -> DataFrame:
        """(row_id, pos, card); registers never written count as 2^0."""
        c = self.c
        inv = F.sum(F.pow(F.lit(2.0), -F.col("rank"))) + (F.lit(c.registers) - F.count(F.lit(1)))
        card = cardinality_corrected(inv, F.lit(c.registers) - F.count(F.lit(1)), c) if corrected else cardinality(inv, c)
        return registers.groupBy("row_id", "pos").agg(card.alias("card"))

    def estimate(self, registers: DataFrame, candidates: DataFrame, corrected: bool = False) -> DataFrame:
        """(src, est) of every candidate source: the least cardinality over its cells."""
        c = self.c
        srcs = candidates.select(F.col("candidate").alias("src")).distinct()
        h = with_hash32(srcs, "src", list(range(c.rows)), width=4)
        cells = F.array(*[F.struct(F.lit(r).alias("row_id"), column_of(F.col(f"h{r}"), c.length).alias("pos")) for r in range(c.rows)])
        at = h.select("src", F.explode(cells).alias("x")).select("src", "x.row_id", "x.pos")
        card = self.cell_cardinality(registers, corrected)
        card = F.broadcast(card) if c.rows * c.length <= 1 << 19 else card
        empty = cardinality(F.lit(float(c.registers)), c)
        got = at.join(card, ["row_id", "pos"], "left").select("src", F.coalesce("card", empty).alias("card"))
        return got.groupBy("src").agg(F.min("card").alias("est"))

    def spreads(self, df: DataFrame, src: str, dst: str, corrected: bool = False) -> DataFrame:
        cells = self.cells(df, src, dst)  # one exchange in the executed plan, read by both
        return self.estimate(self.registers_of(cells), self.candidates_of(cells), corrected)
