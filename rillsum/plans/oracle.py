"""DuckDB SQL for the registered queries, generated apart from the Spark plans."""

from __future__ import annotations

from rillsum.functions.hashing import MULTIPLIERS, SEED_PRIMES

ALPHA = "2e-3"
SMALL, WIDE = 64, 65536
QS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 0.999)
SKEWED = "SELECT CAST(floor(value) AS BIGINT) AS key, event_id FROM events"
PARTS = "SELECT l_partkey AS key FROM lineitem"
PRICES = "SELECT CAST(floor(l_extendedprice) AS BIGINT) AS v, l_orderkey FROM lineitem"
PAIRS = "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem"
#: HUGEINT products need no halves.
MOD = "4294967296"


def mul(a: str, b: int) -> str:
    return f"CAST(({a})::HUGEINT * {b} % {MOD} AS BIGINT)"


def hash_cte(name: str, source: str, key: str, seeds: str, width: int = 8) -> str:
    """CTEs that add (seed, h) to `source`, a relation with column `key`; seeds: SQL list of seed indexes."""
    table = ", ".join(f"({s}, {p})" for s, p in SEED_PRIMES.items())
    words = [f"CAST(({key} & 4294967295) AS BIGINT)"] + ([f"CAST((({key} >> 32) & 4294967295) AS BIGINT)"] if width == 8 else [])
    ctes = [f"{name}0 AS (SELECT s.*, t.seed, (t.p + {width + MULTIPLIERS[4]}) % {MOD} AS r FROM {source} s, (VALUES {table}) t(seed, p) WHERE t.seed IN ({seeds}))"]
    steps = []
    for w in words:
        steps += [f"(r + {mul(w, MULTIPLIERS[2])}) % {MOD}", "((r & 32767) << 17) | (r >> 15)", mul("r", MULTIPLIERS[3])]
    steps += ["xor(r, r >> 15)", mul("r", MULTIPLIERS[1]), "xor(r, r >> 13)", mul("r", MULTIPLIERS[2]), "xor(r, r >> 16)"]
    for i, e in enumerate(steps):
        ctes.append(f"{name}{i + 1} AS (SELECT * EXCLUDE (r), CAST({e} AS BIGINT) AS r FROM {name}{i})")
    ctes.append(f"{name} AS (SELECT * EXCLUDE (r), r AS h FROM {name}{len(steps)})")
    return ", ".join(ctes)


def clz(h: str) -> str:
    return f"(CASE WHEN {h} = 0 THEN 32 ELSE 32 - length(bin({h})) END)"


def keyed(src: str) -> str:
    return f"keyed AS (SELECT key, CAST(count(*) AS BIGINT) AS cnt FROM ({src}) WHERE key IS NOT NULL GROUP BY key)"


def cells(kind: str, length: int, src: str) -> str:
    """CTE cells(key, cnt, level, row_id, pos, sgn)."""
    if kind == "um":
        seeds = ",".join(map(str, range(18)))
        return (
            f"{keyed(src)}, {hash_cte('d', 'keyed', 'key', '199')}, depth AS (SELECT key, cnt, least(5, {clz('h')}) AS depth FROM d), "
            f"{hash_cte('hh', 'depth', 'key', seeds)}, cells AS (SELECT key, cnt, CAST(seed // 3 AS INTEGER) AS level, CAST(seed % 3 AS INTEGER) AS row_id, (h >> 1) % {length} AS pos, 1 - 2 * (h % 2) AS sgn FROM hh WHERE seed // 3 <= depth)"
        )
    pos, sgn = (f"(h >> 1) % {length}", "1 - 2 * (h % 2)") if kind == "cs" else (f"h % {length}", "1")
    return f"{keyed(src)}, {hash_cte('hh', 'keyed', 'key', '0,1,2')}, cells AS (SELECT key, cnt, 0 AS level, CAST(seed AS INTEGER) AS row_id, {pos} AS pos, {sgn} AS sgn FROM hh)"


def counters(kind: str, length: int, src: str) -> str:
    lv = "level, " if kind == "um" else ""
    return f"WITH {cells(kind, length, src)} SELECT {lv}row_id, CAST(pos AS BIGINT) AS pos, CAST(sum(sgn * cnt) AS BIGINT) AS v FROM cells GROUP BY {lv}row_id, pos"


def est(kind: str, length: int, src: str) -> str:
    """CTEs up to est(key, cnt, level, est)."""
    agg = "min(e)" if kind == "cm" else "median(e)"
    return (
        f"{cells(kind, length, src)}, read AS (SELECT key, cnt, level, sgn * sum(sgn * cnt) OVER (PARTITION BY level, row_id, pos) AS e FROM cells), "
        f"est AS (SELECT key, cnt, CAST(level AS INTEGER) AS level, CAST({agg} AS BIGINT) AS est FROM read GROUP BY key, cnt, level), tot AS (SELECT CAST(floor(sum(cnt) * {ALPHA}) AS BIGINT) AS t FROM keyed)"
    )


def point(kind: str, length: int, src: str) -> str:
    return f"WITH {est(kind, length, src)} SELECT key, cnt, est FROM est"


def heavy(kind: str, length: int, src: str) -> str:
    lv = "level, " if kind == "um" else ""
    return f"WITH {est(kind, length, src)} SELECT {lv}key, est FROM est, tot WHERE est > t AND est > 0"


def accuracy(kind: str, length: int, src: str) -> str:
    return f"""WITH {est(kind, length, src)}, c AS (SELECT *, est > t AS e, cnt > t AS x, abs(est - cnt) AS err FROM est, tot WHERE level = 0),
    a AS (SELECT CAST(count(*) FILTER (x) AS BIGINT) AS n_true, CAST(count(*) FILTER (e) AS BIGINT) AS n_est, CAST(count(*) FILTER (e AND x) AS BIGINT) AS n_both,
      CAST(coalesce(sum(err) FILTER (e AND x), 0) AS BIGINT) AS abs_error, CAST(coalesce(sum(err * 1000000 // cnt) FILTER (e AND x), 0) AS BIGINT) AS rel_error_ppm,
      CAST(count(*) FILTER (NOT e AND t - est < 10000) AS BIGINT) AS n_near FROM c)
    SELECT *, CASE WHEN n_true > 0 THEN CAST(n_both * 1000000 // n_true AS BIGINT) END AS cr_ppm, CASE WHEN n_est > 0 THEN CAST(n_both * 1000000 // n_est AS BIGINT) END AS pr_ppm FROM a"""


DD = "least(65535, CAST(floor(ln(v::DOUBLE) / ln(1.001e0)) AS BIGINT))"


def hist(src: str) -> str:
    return f"SELECT CAST({DD} AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS cnt FROM ({src}) WHERE v > 0 GROUP BY 1"


def quantiles(src: str) -> str:
    qs = ", ".join(f"({i}, {q}e0)" for i, q in enumerate(QS))
    return f"""WITH h AS ({hist(src)}), c AS (SELECT bucket, sum(cnt) OVER (ORDER BY bucket) AS cum, sum(cnt) OVER () AS n FROM h),
    b AS (SELECT i AS quantile_index, min(bucket) AS bucket FROM c, (VALUES {qs}) q(i, q) WHERE cum > q * n GROUP BY i)
    SELECT CAST(quantile_index AS INTEGER) AS quantile_index, bucket, CAST(floor(2e0 * pow(1.001e0, bucket + 1) / (1e0 + 1.001e0)) AS BIGINT) AS value FROM b"""


def spread_cells(length: int, min_rank: int = 0) -> str:
    return (
        f"p AS (SELECT DISTINCT src, src * 4294967296 + dst AS pair FROM ({PAIRS}) WHERE src IS NOT NULL AND dst IS NOT NULL), {hash_cte('e', 'p', 'pair', '101')}, "
        f"r AS (SELECT src, CAST(least(31, 1 + {clz('h')}) AS INTEGER) AS rank, CAST(h % 63 AS INTEGER) AS reg FROM e), "
        f"{hash_cte('g', 'r', 'src', '0,1,2', 4)}, cells AS (SELECT src, rank, reg, CAST(seed AS INTEGER) AS row_id, h % {length} AS pos FROM g WHERE rank > {min_rank}), "
        "regs AS (SELECT row_id, CAST(pos AS BIGINT) AS pos, reg, max(rank) AS rank FROM cells GROUP BY ALL), "
        "cand AS (SELECT row_id, CAST(pos AS BIGINT) AS pos, rank AS level, src AS candidate FROM cells QUALIFY row_number() OVER (PARTITION BY row_id, pos ORDER BY rank DESC, src) = 1)"
    )


def spreads(length: int, tail: str = "") -> str:
    return f"""WITH {spread_cells(length)}, card AS (SELECT row_id, pos, CAST(floor(0.7213e0 * 63 / (63 + 1.079e0) * 63 / (sum(pow(2e0, -rank)) + (63 - count(*))) * 63) AS BIGINT) AS card FROM regs GROUP BY ALL),
    s AS (SELECT DISTINCT candidate AS src FROM cand), spots AS (SELECT DISTINCT src, row_id, pos FROM cells)
    SELECT s.src, CAST(min(coalesce(card, 44)) AS BIGINT) AS est FROM s JOIN spots USING (src) LEFT JOIN card USING (row_id, pos) GROUP BY s.src {tail}"""


def uniform(x: str, salt: int) -> str:
    m = 2147483647
    a = f"(({x} + {salt}) % {m})"
    a = f"(({a} * 48271 + 11) % {m})"
    a = f"(({a} * 69621 + ({a} // 65536)) % {m})"
    return f"(({a} * 16807 + ({a} // 32768)) % {m})"


def zipf(n: int, universe: int) -> str:
    return f"""WITH w AS (SELECT k, pow(k::DOUBLE, -0.99e0) AS w FROM range(1, {universe + 1}) t(k)),
    c AS (SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS hi FROM w), u AS (SELECT {uniform('id', 42)}::DOUBLE / 2147483647e0 AS u FROM range({n}) t(id)),
    b AS (SELECT k, coalesce(lag(hi) OVER (ORDER BY k), 0e0) AS lo, CASE WHEN k < {universe} THEN hi ELSE 2e0 END AS hi FROM c)
    SELECT CAST(k AS BIGINT) AS key, CAST(count(*) AS BIGINT) AS cnt FROM u JOIN b ON u >= lo AND u < hi GROUP BY k"""


def oracle_sql() -> dict[str, str]:
    qs = ", ".join(f"({i}, {q}e0)" for i, q in enumerate(QS))
    wide_hash = hash_cte("a", "k", "key", "0,1,2,101,199")
    narrow_hash = hash_cte("b", "k", "key", "0,1,2", 4)
    pick = ", ".join(f"max(h) FILTER (seed = {s}) AS h{s}" for s in (0, 1, 2, 101, 199))
    narrow = ", ".join(f"max(h) FILTER (seed = {s}) AS src{s}" for s in (0, 1, 2))
    o = {
        "exact_frequency": f"SELECT key, CAST(count(*) AS BIGINT) AS cnt FROM ({SKEWED}) WHERE key IS NOT NULL GROUP BY key",
        "exact_heavy_hitters": f"WITH {keyed(SKEWED)} SELECT key, cnt FROM keyed WHERE cnt > (SELECT floor(sum(cnt) * {ALPHA}) FROM keyed)",
        "exact_quantiles": f"WITH f AS (SELECT v, count(*) AS c FROM ({PRICES}) WHERE v IS NOT NULL GROUP BY v), c AS (SELECT v, sum(c) OVER (ORDER BY v) AS cum, sum(c) OVER () AS n FROM f) SELECT CAST(i AS INTEGER) AS quantile_index, min(v) AS value FROM c, (VALUES {qs}) q(i, q) WHERE cum > q * n GROUP BY i",
        "exact_spread": f"SELECT src, CAST(count(DISTINCT dst) AS BIGINT) AS spread FROM ({PAIRS}) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src",
        "hash32_probe": f"WITH k AS (SELECT o_orderkey AS key FROM orders), {wide_hash}, {narrow_hash}, x AS (SELECT key, {pick} FROM a GROUP BY key), y AS (SELECT key, {narrow} FROM b GROUP BY key) SELECT * FROM x JOIN y USING (key)",
        "median3": "SELECT CAST(list_sort([l_partkey, l_suppkey, l_linenumber])[2] AS BIGINT) AS m3, CAST((list_sort([l_partkey, l_suppkey, l_linenumber, l_orderkey])[2] + list_sort([l_partkey, l_suppkey, l_linenumber, l_orderkey])[3]) // 2 AS BIGINT) AS m4, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL",
        "cm_counters": counters("cm", WIDE, SKEWED),
        "cm_row_totals": f"WITH c AS ({counters('cm', WIDE, PARTS)}) SELECT row_id, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS cells FROM c GROUP BY row_id",
        "cm_partkey_small": point("cm", SMALL, PARTS),
        "cm_merge": counters("cm", SMALL, SKEWED),
        "cm_stream": counters("cm", SMALL, SKEWED),
        "cs_merge": counters("cs", SMALL, SKEWED),
        "cm_keeper": f"WITH {est('cm', SMALL, SKEWED)}, {hash_cte('kb', 'est', 'key', '101')} SELECT CAST(h % 12 AS BIGINT) AS bucket, CAST(row_number() OVER (PARTITION BY h % 12 ORDER BY est DESC, key) AS INTEGER) AS slot, key, est FROM kb QUALIFY slot <= 4",
        "cs_stream": counters("cs", SMALL, SKEWED),
        "um_stream": counters("um", SMALL, SKEWED),
        "dd_stream": quantiles(PRICES),
        "ss_stream": spreads(4096),
        "cm_snapshot": counters("cm", SMALL, f"SELECT * FROM ({SKEWED}) WHERE event_id % 4 < 2"),
        "cm_staleness": "WITH b AS (SELECT CAST(event_id % 4 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n_rows FROM events GROUP BY 1) SELECT *, CAST(sum(n_rows) OVER (ORDER BY batch_id) AS BIGINT) AS n_total FROM b",
        "cm_gate": "WITH b AS (SELECT CAST(n_nationkey // 6 AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n_rows FROM nation GROUP BY 1), p AS (SELECT *, CAST(CASE WHEN batch_id % 2 = 0 THEN n_rows ELSE n_rows + lag(n_rows) OVER (ORDER BY batch_id) END AS BIGINT) AS pending FROM b) SELECT *, pending > 10 AS published FROM p",
        "cs_counters": counters("cs", WIDE, SKEWED),
        "cs_keeper": f"WITH {est('cs', SMALL, SKEWED)}, pos AS (SELECT * FROM est WHERE est > 0), {hash_cte('kb', 'pos', 'key', '101')} SELECT CAST(h % 12 AS BIGINT) AS bucket, CAST(row_number() OVER (PARTITION BY h % 12 ORDER BY est DESC, key) AS INTEGER) AS slot, key, est FROM kb QUALIFY slot <= 4",
        "um_keeper": f"WITH {est('um', SMALL, SKEWED)}, pos AS (SELECT * FROM est WHERE est > 0), {hash_cte('kb', 'pos', 'key', '101,102,103,104,105,106')} SELECT level, CAST(h % 12 AS BIGINT) AS bucket, CAST(row_number() OVER (PARTITION BY level, h % 12 ORDER BY est DESC, key) AS INTEGER) AS slot, key, est FROM kb WHERE seed = 101 + level QUALIFY slot <= 4",
        "um_accuracy": accuracy("um", WIDE, SKEWED),
        "um_accuracy_small": accuracy("um", SMALL, SKEWED),
        "cm_metrics": f"WITH m AS ({accuracy('cm', SMALL, SKEWED)}) SELECT n_both::DOUBLE / n_true AS cr, n_both::DOUBLE / n_est AS pr, abs_error::DOUBLE / n_both AS aae, rel_error_ppm::DOUBLE / n_both / 1e6 AS are FROM m",
        "ss_candidates_gated": f"WITH {spread_cells(4096, 4)} SELECT * FROM cand",
        "packed_sources": f"SELECT src, CAST(count(*) AS BIGINT) AS n FROM ({PAIRS}) WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src",
        "um_levels": f"WITH {keyed('SELECT o_orderkey AS key FROM orders')}, {hash_cte('d', 'keyed', 'key', '199')}, l AS (SELECT cnt, unnest(range(0, 1 + least(5, {clz('h')}))) AS level FROM d) SELECT CAST(level AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(cnt) AS BIGINT) AS n_rows FROM l GROUP BY level",
        "um_counters": counters("um", WIDE, SKEWED),
        "um_counters_small": counters("um", SMALL, SKEWED),
        "um_merge": counters("um", SMALL, SKEWED),
        "dd_histogram": hist(PRICES),
        "dd_quantiles": quantiles(PRICES),
        "dd_merge": quantiles(PRICES),
        "dd_quantiles_zero": quantiles(f"SELECT key AS v FROM ({SKEWED})"),
        "ss_registers": f"WITH {spread_cells(4096)} SELECT * FROM regs",
        "ss_registers_gated": f"WITH {spread_cells(4096, 4)} SELECT * FROM regs",
        "ss_candidates": f"WITH {spread_cells(4096)} SELECT * FROM cand",
        "ss_candidates_small": f"WITH {spread_cells(16)} SELECT * FROM cand",
        "ss_spread": spreads(4096),
        "ss_merge": spreads(4096),
        "ss_spread_small": spreads(16),
        "ss_topk": spreads(4096, "ORDER BY est DESC, src LIMIT 10"),
        "zipf_keys": zipf(20_000, 1000),
        "pair_keys": "SELECT CAST(s AS BIGINT) AS src, CAST(1 + s * 200 // 64 AS BIGINT) AS spread FROM range(64) t(s)",
        "snapshot_cardinality_empty": "SELECT CAST(floor(0.7213e0 * 63 / (63 + 1.079e0) * 63 / 63e0 * 63) AS BIGINT) AS card",
    }
    for kind in ("cm", "cs"):
        for tag, n in (("", WIDE), ("_small", SMALL)):
            o[f"{kind}_point_estimate{tag}"] = point(kind, n, SKEWED)
            o[f"{kind}_heavy_hitters{tag}"] = heavy(kind, n, SKEWED)
            o[f"{kind}_accuracy{tag}"] = accuracy(kind, n, SKEWED)
    for tag, n in (("", WIDE), ("_small", SMALL)):
        o[f"um_level_heavy_hitters{tag}"] = heavy("um", n, SKEWED)
        o[f"um_heavy_hitters{tag}"] = f"WITH x AS ({heavy('um', n, SKEWED)}) SELECT key, level, est FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY level) = 1"
    return o
