import pytest
from pyspark.sql import functions as F

from rillsum.config import CountMinConfig, CountSketchConfig, SpreadConfig, UnivConfig
from rillsum.functions.hashing import MULTIPLIERS, SEED_PRIMES, with_hash32
from rillsum.operators import exact, linear
from rillsum.operators.linear import CountMin, CountSketch, Univ
from rillsum.operators.quantiles import LogBuckets
from rillsum.operators.spread import Spread
from rillsum.sources import keys as K

M = 1 << 32


def plain_hash(key, seed, width=8):
    r = (width + SEED_PRIMES[seed] + MULTIPLIERS[4]) % M
    for i in range(width // 4):
        r = (r + ((key >> (32 * i)) % M) * MULTIPLIERS[2]) % M
        r = ((r << 17) | (r >> 15)) % M * MULTIPLIERS[3] % M
    r = (r ^ (r >> 15)) * MULTIPLIERS[1] % M
    r = (r ^ (r >> 13)) * MULTIPLIERS[2] % M
    return r ^ (r >> 16)


def test_hash_vectors(spark):
    want = {0: (2036091990, 1636227117, 459894152, 1980626050, 1180116665), 1: (763085552, 2596574360, 160044287, 4082596250, 3628468765),
            42: (1379071481, 3574808733, 434152443, 263503641, 2034501772), (7 << 32) | 9: (338860738, 1956141242, 2175219032, 2975723589, 1430104059)}
    df = with_hash32(spark.createDataFrame([(k,) for k in want], "key long"), "key", [0, 1, 2, 101, 199])
    assert {r.key: (r.h0, r.h1, r.h2, r.h101, r.h199) for r in df.collect()} == want
    df = with_hash32(spark.createDataFrame([(0,), (1,), (42,)], "key long"), "key", [0, 1, 2], width=4)
    assert [tuple(r)[1:] for r in df.orderBy("key").collect()] == [(1452700636, 2650542982, 1189516558), (1949310205, 166609804, 57015396), (1123726879, 1698614180, 457072812)]


def test_hash_edges(spark):
    keys = [0, -1, 2**63 - 1, -(2**63), 5]
    df = with_hash32(spark.createDataFrame([(k,) for k in keys], "key long"), "key", [3, 17])
    assert {r.key: (r.h3, r.h17) for r in df.collect()} == {k: (plain_hash(k % 2**64, 3), plain_hash(k % 2**64, 17)) for k in keys}


def keys_of(spark, rows, parts=4):
    return spark.createDataFrame([(k,) for k in rows], "key long").repartition(parts)


ROWS = [k * k % 311 for k in range(3000)] + [0, -1, 2**63 - 1] + [None] * 5


def test_count_min_against_plain(spark):
    op = CountMin(CountMinConfig(length=64))
    cells = {}
    for k in ROWS:
        if k is not None:
            for r in range(3):
                cells[r, plain_hash(k % 2**64, r) % 64] = cells.get((r, plain_hash(k % 2**64, r) % 64), 0) + 1
    df = keys_of(spark, ROWS)
    assert {(r.row_id, r.pos): r.v for r in op.build(df, "key").collect()} == cells
    for r in op.point_estimates(df, "key").collect():
        assert r.est == min(cells[i, plain_hash(r.key % 2**64, i) % 64] for i in range(3)) >= r.cnt


def test_count_sketch_against_plain(spark):
    op = CountSketch(CountSketchConfig(length=64))
    cells = {}
    sp = lambda k, r: ((h := plain_hash(k % 2**64, r)) // 2 % 64, 1 - 2 * (h % 2))
    for k in ROWS:
        if k is not None:
            for r in range(3):
                p, s = sp(k, r)
                cells[r, p] = cells.get((r, p), 0) + s
    for r in op.point_estimates(keys_of(spark, ROWS), "key").collect():
        assert r.est == sorted(cells[i, sp(r.key, i)[0]] * sp(r.key, i)[1] for i in range(3))[1]


def test_univ_against_plain(spark):
    op = Univ(UnivConfig(length=64))
    cells, depth = {}, lambda k: min(5, 32 - plain_hash(k % 2**64, 199).bit_length())
    sp = lambda k, s: ((h := plain_hash(k % 2**64, s)) // 2 % 64, 1 - 2 * (h % 2))
    real = [k for k in ROWS if k is not None]
    for k in real:
        for lv in range(depth(k) + 1):
            for r in range(3):
                p, s = sp(k, lv * 3 + r)
                cells[lv, r, p] = cells.get((lv, r, p), 0) + s
    df = keys_of(spark, ROWS)
    assert {(r.level, r.row_id, r.pos): r.v for r in op.build(df, "key").collect()} == cells
    got = {(r.key, r.level): r.est for r in op.estimate(op.build(df, "key"), linear.keyed(df, "key")).collect()}
    assert got == {(k, lv): sorted(cells[lv, r, sp(k, lv * 3 + r)[0]] * sp(k, lv * 3 + r)[1] for r in range(3))[1] for k in set(real) for lv in range(depth(k) + 1)}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_partitioning_changes_nothing(spark, parts):
    op = CountMin(CountMinConfig(length=64))
    assert sorted(op.build(keys_of(spark, ROWS, parts), "key").collect()) == sorted(op.build(keys_of(spark, ROWS, 3), "key").collect())


def test_merge_is_union(spark):
    a, b = keys_of(spark, ROWS[:1000]), keys_of(spark, ROWS[1000:])
    for op in (CountMin(CountMinConfig(length=64)), CountSketch(CountSketchConfig(length=64)), Univ(UnivConfig(length=64))):
        assert sorted(linear.merge(op.build(a, "key"), op.build(b, "key")).collect()) == sorted(op.build(a.union(b), "key").collect())


def test_empty_input(spark):
    e = spark.createDataFrame([], "key long, src long, dst long")
    for df in (CountMin().point_estimates(e, "key"), CountMin().heavy_hitters(e, "key"), CountSketch().heavy_hitters(e, "key"), Univ().heavy_hitters(e, "key"),
               LogBuckets().quantiles(LogBuckets().build(e, "key")), Spread().spreads(e, "src", "dst")):
        assert df.collect() == []


def test_quantile_error_bound(spark, sf):
    p = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.floor("l_extendedprice").cast("long").alias("v"))
    qs = LogBuckets().c.quantiles
    true = {r.quantile_index: r.value for r in exact.quantiles(p, "v", qs).collect()}
    for r in LogBuckets().quantiles(LogBuckets().build(p, "v")).collect():
        assert abs(r.value - true[r.quantile_index]) <= 0.0005 * true[r.quantile_index] + 1


def test_quantiles_leave_out_non_positive(spark):
    df = spark.createDataFrame([(0,), (-3,), (None,), (7,)], "v long")
    assert [tuple(r) for r in LogBuckets().build(df, "v").select("cnt").collect()] == [(1,)]


def test_spread_idempotent_and_gate(spark):
    df = K.pair_keys(spark, 32, 100)
    s = Spread()
    assert sorted(s.registers(df, "src", "dst").collect()) == sorted(s.registers(df.distinct(), "src", "dst").collect())
    assert Spread(SpreadConfig(min_rank=4)).registers(df, "src", "dst").agg(F.min("rank")).first()[0] > 4
    corrected = {r.src: r.est for r in s.spreads(df, "src", "dst", corrected=True).collect()}
    truth = {r.src: r.spread for r in exact.spread(df, "src", "dst").collect()}
    assert sum(abs(corrected[k] - truth[k]) / truth[k] for k in corrected) / len(corrected) < 0.2


def test_u64_round_trip(spark, tmp_path):
    import numpy as np

    np.array([1, -1, 2**40], dtype="<i8").tofile(tmp_path / "k.bin")
    with open(tmp_path / "k.bin", "ab") as f:
        f.write(b"xyz")
    assert [r.key for r in K.read_u64(spark, str(tmp_path / "k.bin")).collect()] == [1, -1, 2**40]
    K.write_u64(spark.range(1000).withColumnRenamed("id", "key"), "key", str(tmp_path / "out"))
    assert sorted(r.key for r in K.read_packed_u64(spark, str(tmp_path / "out")).collect()) == list(range(1000))


def test_zipf_forms_agree(spark):
    a = sorted(map(tuple, K.zipf_keys(spark, 3000, 500).collect()))
    assert a == sorted(map(tuple, K.zipf_keys_sql(spark, 3000, 500).collect()))


def test_stream_snapshots(spark, tmp_path):
    from rillsum.streaming.snapshots import SketchStream

    for i in range(3):
        spark.range(i * 100, i * 100 + 100).selectExpr("id % 17 AS key").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    op = CountMin(CountMinConfig(length=64))
    s = SketchStream(spark, lambda b: op.build(b, "key"), linear.merge, str(tmp_path / "s"))
    stream = spark.readStream.schema("key long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s.run(stream, min_rows=150)  # the second batch is published, the third waits
    whole = spark.read.parquet(str(tmp_path / "in"))
    assert [tuple(r) for r in s.log().orderBy("batch_id").collect()] == [(0, 100, 100, False), (1, 100, 200, True), (2, 100, 100, False)]
    total = lambda x: x.where("row_id = 0").agg(F.sum("v")).first()[0]
    assert total(s.snapshot()) == 200 and s.snapshot(0).collect() == []
    before = sorted(s.snapshot().collect())
    s.compact()
    assert sorted(s.snapshot().collect()) == before
    s = SketchStream(spark, lambda b: op.build(b, "key"), linear.merge, str(tmp_path / "s2"))
    s.run(stream)
    s.compact()
    assert sorted(s.snapshot().collect()) == sorted(op.build(whole, "key").collect())
    assert total(s.snapshot(0)) == s.staleness().where("batch_id = 0").first().n_total == 100


def test_count_min_build_has_one_exchange(spark):
    df = keys_of(spark, ROWS)
    plan = CountMin(CountMinConfig(length=64)).build(df, "key")._jdf.queryExecution().sparkPlan().toString()
    built = CountMin(CountMinConfig(length=64)).build(spark.range(10).withColumnRenamed("id", "key"), "key")
    text = built._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "HashAggregate(keys=[key" not in plan


def test_large_files_are_split(spark, tmp_path):
    import numpy as np

    np.arange(200_000, dtype="<i8").tofile(tmp_path / "k.bin")
    got = K.read_u64_split(spark, str(tmp_path / "k.bin"))
    assert got.agg(F.count(F.lit(1)), F.sum("key")).first()[:] == (200_000, 200_000 * 199_999 // 2)


def test_exact_quantiles_of_a_heavy_tail(spark):
    df = spark.range(5000).select(F.floor(F.pow(F.lit(1.004), F.col("id").cast("double"))).cast("long").alias("v"))
    v = sorted(r.v for r in df.collect())
    qs = (0.125, 0.5, 0.999)
    got = {r.quantile_index: r.value for r in exact.quantiles(df, "v", qs).collect()}
    assert got == {i: next(x for k, x in enumerate(v, 1) if k > q * len(v) and (k == len(v) or v[k] != x)) for i, q in enumerate(qs)}


def test_metrics_are_written(spark, tmp_path):
    est = spark.createDataFrame([(1, 100, 110), (2, 1, 1)], "key long, cnt long, est long")
    exact.write_metrics(exact.accuracy(est, 0.5), str(tmp_path / "m"))
    r = spark.read.json(str(tmp_path / "m")).first()
    assert (r.cr, r.pr, r.aae, r["are"]) == (1.0, 1.0, 10.0, 0.1)
