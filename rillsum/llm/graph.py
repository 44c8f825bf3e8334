"""Near-duplicate graphs: candidates that meet on keys, verified groups, connected components.

A node is a 64-bit number, the first word of a fingerprint.  Keys travel packed: a task sends one
binary cell for each bucket of keys instead of one row for each key.  Where the distance is the link, a
spanning forest of each run of equal keys leaves the task.  Where a link is still to be verified, pairs and
the near members of longer runs go on as groups of their own: candidates of different keys are never chained
together, because what is unverified would chain without end as the data grow.  What is too
large for one task (a run of more than HOT nodes, a group of more than CHUNK members) is cut in chunks
whose pairs are compared in tasks of their own, so no link is lost and no task grows with a hot key
beyond the bytes of its packed nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rillsum.llm.common import discard, mix64, returning, written

#: Keys of a bucket, about; nodes of the longest run that its own task compares; nodes of a chunk of a longer one.
BUCKET, HOT, CHUNK = 1 << 18, 1 << 15, 1 << 13
#: In runs up to this length all links are sent, longer ones go on as groups (or as a spanning forest).
SHORT = 4
#: Groups up to this size are compared one pair after the other, larger ones by numpy.
FEW = 8
#: Pairs that a task asks for at once, about; characters (or bytes) of the groups that wait for answers; pairs whose answers it remembers.
ASKED, HELD, KNOWN = 1 << 13, 1 << 24, 1 << 16


def distance(f, g):
    """Differing bits of fingerprints given as lists of 64-bit words."""
    import numpy as np

    return sum(np.bitwise_count(x ^ y).astype("i2") for x, y in zip(f, g, strict=True))


def forest(f, radius: int, g=None) -> Iterator[tuple]:
    """(node, its new neighbours) of a spanning forest of the links within radius; with g only links between the two sides."""
    import numpy as np

    side = None if g is None else np.repeat([0, 1], [len(f[0]), len(g[0])])
    f = f if g is None else [np.concatenate(p) for p in zip(f, g, strict=True)]
    left = np.arange(len(f[0]))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = distance([w[left] for w in f], [w[x] for w in f]) <= radius
            if side is not None:
                near &= side[left] != side[x]
            if near.any():
                hit, left = left[near], left[~near]
                todo.extend(hit)
                yield f[0][x], f[0][hit]


def near_members(f, radius: int, split: int | None = None):
    """Which nodes have another one within radius; with split only one on the other side of that place."""
    import numpy as np

    n = len(f[0])
    on, side = np.zeros(n, bool), np.arange(n) >= (split or n)
    for i in range(n):
        if not on[i]:
            near = distance(f, [w[i] for w in f]) <= radius
            near[i] = False
            if split is not None:
                near &= side != side[i]
            if near.any():
                on[i] = True
                on |= near
    return on


def _edges(pairs: list):
    """A batch (a, b), a > b, each pair once."""
    import numpy as np
    import pyarrow as pa

    a = np.concatenate([np.broadcast_to(x, np.shape(y)) for x, y in pairs]) if pairs else np.empty(0, "u8")
    b = np.concatenate([y for _, y in pairs]) if pairs else np.empty(0, "u8")
    a, b = a.view("i8"), b.view("i8")
    e = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1)[a != b], axis=0)
    return pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))


def near_edges(nodes: DataFrame, fps: list[str], keys: Callable, per: int, radius: int) -> DataFrame:
    """(a, b), a > b: a spanning forest, for each key, of the links between nodes that share it and differ in at most radius bits."""
    return _met(nodes, fps, keys, per, radius, False).select("a", "b")


def candidates(nodes: DataFrame, fps: list[str], keys: Callable, per: int, radius: int) -> DataFrame:
    """(node, root): groups in which every two nodes that share a key and differ in at most radius bits meet."""
    got = _met(nodes, fps, keys, per, radius, True)
    pairs = got.where("run IS NULL").select("a", "b").distinct().withColumn("root", F.xxhash64("a", "b"))
    pairs = pairs.select(F.explode(F.array("a", "b")).alias("node"), "root")
    return pairs.unionByName(got.where("run IS NOT NULL").select(F.col("a").alias("node"), F.col("run").alias("root")))


def _met(nodes: DataFrame, fps: list[str], keys: Callable, per: int, radius: int, group: bool) -> DataFrame:
    """(a, b, run): links, and, if they are to be grouped, the near members a of a run.

    nodes: the words fps of a fingerprint and what `keys` reads; a node's number is its first word.
    keys(batch) gives (rows, 64-bit keys, base): a run of equal keys matters only if it has a base row.
    per: keys of a node, about.  Nodes with the same first word are one node, but each of their fingerprints is compared.
    """
    import numpy as np
    import pyarrow as pa

    buckets = max(1, -(-nodes.count() * per // BUCKET))
    cell = pa.schema([("bucket", pa.int32()), ("key", pa.binary())] + [(c, pa.binary()) for c in fps])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            key, *words = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((key >> np.uint64(33)) % np.uint64(buckets)).astype("u4" if buckets >> 16 else "u2")
            order = np.argsort(bucket, kind="stable")
            own, first = np.unique(bucket[order], return_index=True)
            at = np.append(first, len(order))
            parts = [(key & np.uint64(0xFFFFFFFF)).astype("<u4"), *words]
            cells = [pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((at * p.itemsize).astype("i4")), pa.py_buffer(p[order])]) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(own.astype("i4")), *cells], schema=cell)

        for b in batches:
            if not b.num_rows:
                continue
            rows, key, base = keys(b)
            key = (mix64(key) & ~np.uint64(1)) | base.astype("u8")
            held.append((key, *[np.asarray(b[c]).view("u8")[rows] for c in fps]))
            n += len(rows)
            if n >= 1 << 20:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts, bucket):
            rem, *f = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*parts, strict=True), ["<u4"] + ["<u8"] * len(fps), strict=True))
            order = np.argsort(rem, kind="stable")
            k, base = rem[order] >> 1, (rem[order] & 1).astype(bool)
            start = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            size = np.diff(np.append(start, len(k)))
            on = (size > 1) & np.logical_or.reduceat(base, start)
            start, size = start[on], size[on]
            pairs = []
            for m in range(2, SHORT + 1):
                at = start[size == m]
                for i in range(m):
                    for j in range(i + 1, m):
                        x, y = [w[order[at + i]] for w in f], [w[order[at + j]] for w in f]
                        near = distance(x, y) <= radius
                        pairs.append((x[0][near], y[0][near]))
            cells, runs = [], []
            for s, e in zip(start[size > SHORT], (start + size)[size > SHORT], strict=True):
                own = order[s:e]
                own = own[np.lexsort([w[own] for w in f[::-1]])]
                own = own[np.append(True, np.any([w[own[1:]] != w[own[:-1]] for w in f], axis=0))]
                if len(own) > HOT:
                    cut = [own[i : i + CHUNK] for i in range(0, len(own), CHUNK)]
                    raw = [b"".join(w[c].tobytes() for w in f) for c in cut]
                    cells += [(raw[i], raw[j] if j > i else None) for i in range(len(cut)) for j in range(i, len(cut))]
                elif group:
                    on = near_members([w[own] for w in f], radius)
                    if on.any():
                        runs.append((np.unique(f[0][own[on]]), int(mix64(np.array([(bucket << 32) | int(k[s])], "u8")).view("i8")[0])))
                else:
                    pairs += forest([w[own] for w in f], radius)
            yield links(pairs, runs)
            for x, y in cells:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 3, pa.array([x], pa.binary()), pa.array([y], pa.binary())], ["a", "b", "run", "one", "other"])

        held, bucket = [], None
        for b in batches:
            for row in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if held and row[0] != bucket:
                    yield from flush(held, bucket)
                    held = []
                bucket = row[0]
                held.append(row[1:])
        if held:
            yield from flush(held, bucket)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, other in zip(b["one"].to_pylist(), b["other"].to_pylist(), strict=True):
                x, y = (None if z is None else list(np.frombuffer(z, "<u8").reshape(len(fps), -1)) for z in (one, other))
                if group:
                    both = x if y is None else [np.concatenate(z) for z in zip(x, y, strict=True)]
                    on = near_members(both, radius, None if y is None else len(x[0]))
                    yield links([], [(np.unique(both[0][on]), xxh64_intdigest(one + (other or b"")) - (1 << 63))]).drop_columns(["one", "other"])
                else:
                    yield links(list(forest(x, radius, y)), []).drop_columns(["one", "other"])

    def links(pairs, runs):
        a, b = _edges(pairs)
        node = np.concatenate([x for x, _ in runs]).view("i8") if runs else np.empty(0, "i8")
        run = np.repeat(np.array([r for _, r in runs], "i8"), [len(x) for x, _ in runs]) if runs else np.empty(0, "i8")
        a, b = pa.concat_arrays([a, pa.array(node)]), pa.concat_arrays([b, pa.nulls(len(node), pa.int64())])
        none = pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.nulls(len(a) - len(run), pa.int64()), pa.array(run)]), none, none], ["a", "b", "run", "one", "other"])

    binary = ", ".join(f"{c} binary" for c in fps)
    packed = nodes.mapInArrow(returning(pack), f"bucket int, key binary, {binary}").repartition("bucket").sortWithinPartitions("bucket")
    got = written(packed.mapInArrow(returning(meet), "a long, b long, run long, one binary, other binary"), "met")
    hot = got.where("one IS NOT NULL").select("one", "other").repartition(F.xxhash64("one", "other")).mapInArrow(returning(across), "a long, b long, run long")
    return got.where("one IS NULL").select("a", "b", "run").unionByName(hot)


def grouped(nodes: DataFrame, member: DataFrame, node: str) -> DataFrame:
    """The rows of nodes once for each group of member (node, root), and rows that share their node's number as a group."""
    shared = nodes.groupBy(node).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col(node).alias("node"), F.col(node).alias("root"))
    return nodes.join(member.unionByName(shared), F.col(node) == F.col("node")).drop("node")


def linked(members: DataFrame, payloads: DataFrame, fps: list[str], radius: int, load: Callable, same: Callable, limit: int = 512, spread: float = 1.0) -> DataFrame:
    """(a, b) of id: a spanning forest, within each root, of the links that `same` confirms.

    members: (root, id, fps), payloads: (id, payload), one of each id; only the dealt rows carry payloads, and
    members without one are left out.  Pairs of more than radius bits are no links, nor are those whose payloads
    differ in length by more than `spread` of the longer.  load(payload) is what is compared: same([(x, y), ...])
    says of each pair whether it is a link.  A task asks for many groups at once, each going on by what it
    is told.  A root of more than `limit` members is cut in chunks by hash, and every pair of
    chunks is a group of its own.  Other groups are dealt by their least member, so that groups with the same
    members meet in a task, which seldom compares a pair twice.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(members.dtypes)["id"]
    arrow = {"binary": pa.binary(), "bigint": pa.int64()}[kind]
    names = ["part", "root", "i", "j", "side", "id", "payload", *fps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        edges: list = []
        pool: list = []  # (group, what it asks for, characters that it holds)
        asked = held = 0

        def question(p, q):
            return ((p[1], q[1]) if p[1] < q[1] else (q[1], p[1])), p[2], q[2]

        def close(p, q, cross) -> bool:
            bits = 0
            for v, w in zip(p[4:], q[4:], strict=True):
                bits += ((v ^ w) & 0xFFFFFFFFFFFFFFFF).bit_count()
            return bits <= radius and not (cross and p[0] == q[0]) and abs(p[3] - q[3]) <= spread * max(p[3], q[3]) + 1e-9

        def few(rows, cross):
            left = list(range(len(rows)))
            while len(left) > 1:
                todo, left = [left[0]], left[1:]
                while todo and left:
                    x = todo.pop()
                    near = [y for y in left if close(rows[x], rows[y], cross)]
                    if near:
                        told = yield [question(rows[x], rows[y]) for y in near]
                        hit = [y for y, on in zip(near, told, strict=True) if on]
                        left = [y for y in left if y not in hit]
                        todo.extend(hit)
                        edges.extend((rows[y][1], rows[x][1]) for y in hit)

        def many(rows, cross):
            f = [np.array([r[c] for r in rows], "i8").view("u8") for c in range(4, 4 + len(fps))]
            side, size = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
            left, group, wide = np.arange(len(rows)), np.arange(len(rows)), 1
            while len(left) > 1:
                # what is taken out of left is compared with all that is in it and not yet in its group
                pairs, taken = [], 0
                while taken < wide and taken < len(left) and len(pairs) < ASKED >> 3:
                    x, y = left[taken], left[taken + 1 :]
                    taken += 1
                    near = (distance([w[y] for w in f], [w[x] for w in f]) <= radius) & (group[y] != group[x])
                    near &= np.abs(size[y] - size[x]) <= spread * np.maximum(size[y], size[x]) + 1e-9
                    if cross:
                        near &= side[y] != side[x]
                    pairs += [(x, z) for z in y[near].tolist()]
                left = left[taken:]
                told = (yield [question(rows[x], rows[y]) for x, y in pairs]) if pairs else []
                hit = [p for p, on in zip(pairs, told, strict=True) if on]
                for x, y in hit:
                    if group[x] != group[y]:
                        group[group == group[y]] = group[x]
                        edges.append((rows[y][1], rows[x][1]))
                wide = max(1, wide >> 1) if hit else min(2 * wide, len(rows))

        def join(group, told, size):
            nonlocal asked, held
            try:
                ask = group.send(told)
            except StopIteration:
                return
            pool.append((group, ask, size))
            asked, held = asked + len(ask), held + size

        def compare():
            nonlocal asked, held
            todo = {key: (x, y) for _, ask, _ in pool for key, x, y in ask if key not in known}
            known.update(zip(todo, same(list(todo.values())), strict=True))
            waiting = pool.copy()
            pool.clear()
            asked = held = 0
            for group, ask, size in waiting:
                join(group, [known[key] for key, _, _ in ask], size)
            if len(known) > KNOWN:
                known.clear()

        def flush():
            cross = cell[2] != cell[3]
            if len(rows) == 2 and not close(*rows, cross):
                return
            own = [(*r[:2], load(r[2]), *r[3:]) for r in rows]
            join((few if len(own) <= FEW else many)(own, cross), None, sum(r[3] for r in rows))
            while asked >= ASKED or held >= HELD:
                compare()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], arrow) for k in (0, 1)], ["a", "b"])
            edges.clear()
            return out

        cell, rows = None, []
        for batch in batches:
            for part, root, i, j, side, key, payload, *words in zip(*[batch[c].to_pylist() for c in names], strict=True):
                if (part, root, i, j) != cell and rows:
                    flush()
                    rows = []
                cell = part, root, i, j
                rows.append((side, key, payload, len(payload), *words))
            yield sent()
        if rows:
            flush()
        while pool:
            compare()
        yield sent()

    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("id")).alias("lead")).where("n > 1")
    m = members.join(sizes, "root").withColumn("side", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    m = m.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("side", "x")).withColumn("j", F.greatest("side", "x"))
    m = m.withColumn("part", F.when(F.col("chunks") == 1, F.col("lead")).otherwise(F.xxhash64("root", "i", "j")))
    m = m.drop("x", "chunks", "n", "lead").join(payloads, "id")
    dealt = m.select(*names).repartition("part").sortWithinPartitions("part", "root", "i", "j", "id")
    return dealt.mapInArrow(returning(run), f"a {kind}, b {kind}")


#: Edges that one task turns into stars.
BLOCK = 1 << 20


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b), a > b, with the components of the edges: each block of a task's edges becomes stars around its least nodes."""
    import pyarrow as pa

    kind, block = dict(edges.dtypes)["a"], BLOCK
    arrow = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def flush():
            out = [(x, r) for x in list(up) if (r := top(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], arrow) for k in (0, 1)], ["a", "b"])

        n = 0
        for batch in batches:
            for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                if n == block:
                    yield flush()
                    up.clear()
                    n = 0
                n += 1
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        if up:
            yield flush()

    return edges.select("a", "b").mapInArrow(returning(run), f"a {kind}, b {kind}")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the least node of its component.

    Tasks turn a block of BLOCK edges each into stars.  While several blocks are left, large-star and
    small-star steps let their stars touch and the blocks are formed anew.  Minima are partially aggregated;
    joins read written tables, so adaptive execution may split a hub's rows.
    """
    e = written(_stars(edges), "edges")
    for _ in range(rounds):
        blocks = max(1, -(-e.count() // BLOCK))
        last, e = e, written(_stars(e.coalesce(blocks)), "edges")
        discard(last)
        if blocks == 1:
            break
        several = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if several.isEmpty() and e.select(F.col("b").alias("a")).distinct().join(e.select("a"), "a", "left_semi").isEmpty():
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = written(both.where("v > u").join(near, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, written(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(near, large, low, last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
