"""Each operator against a plain version on a fixture with nulls, empties, ties, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillsum.llm import ans, fuzzylines, langid, mixing, packing, rules, shards, simhash, toxicity, vafile
from rillsum.llm.common import TokenBytes
from rillsum.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, bucket string, shard int, h string, part int, th string, cell string, block int"
EXTRA = (1, "x", "y", 2, "z", 3, "t", "c", 4)


def tok(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return public_tokenizers.path(name), lambda s: t.encode(s or "", add_special_tokens=False).ids


def texts():
    rng = random.Random(7)
    vocab = ["the", "of", "Alpha", "beta,", "GAMMA.", "delta", "épée", "straße", "x1", "'s", "don't", "!!", "|", "漢字"] + [f"w{i}" for i in range(60)]
    out = [None, "", " \n\t ", "one", "two words", "Three little words", "<|endoftext|> and  two  spaces\n\n\nend ", "a\r\nb\x0bc \x85 d\xa0e", "same text here", "same text here", "123 456 !!!"]
    for k in range(24):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 9))]
        out.append("\n".join(lines))
    out += [out[-1], out[-1] + " tail", " ".join(rng.choice(vocab) for _ in range(9000))]
    return out


@pytest.fixture(scope="module")
def rows():
    ids = [*range(36), None, 5]
    t = texts()
    return [(i, x, [None, "en", "fr"][k % 3], [None, "a", "b", "é"][k % 4], 0, *EXTRA) for k, (i, x) in enumerate(zip(ids, t, strict=True))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_are_the_tokenizers(name, spaced):
    path, plain = tok(name)
    enc = TokenBytes(path, spaced, limit=50)
    odd = ["İstanbul ΑΣ. x's 'll", "\x1c a \x1f b", "a  b\n c", "🙂👍🏽 a‍b", "e.g., 1,2.3", "trail   ", "   lead", "naïve x́"]
    for t in odd + [x or "" for x in texts()]:
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == plain(t), t


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 8191, 8192, 32768, 32769, 70000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_000).astype("u4")
    t = ans.Table(ans.scaled(np.bincount(ids, minlength=3)))
    raw = ans.pack_segment([(None, n)], ids, t)
    d, k, got = ans.unpack_segment(raw, t)
    assert d == [None] and k.tolist() == [n] and (got == ids).all()
    if n > 100:
        with pytest.raises(ValueError):
            ans.unpack_segment(raw[: len(raw) // 2] + bytes([raw[len(raw) // 2] ^ 0xFF]) + raw[len(raw) // 2 + 1 :], t)


def test_op1(spark, docs, empty, rows):
    path, plain = tok("byte_bpe_50k.json")
    got = ans.digest(spark, docs, path).orderBy("start").collect()
    want = Counter((r[0], len(i := plain(r[1]) + [2]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert ans.digest(spark, empty, path).collect() == []


def test_op1_files_are_read_by_their_path_and_guarded(spark, docs, rows, tmp_path):
    path, plain = tok("byte_bpe_50k.json")
    ans.write(docs, str(tmp_path / "t"), path, 2)
    got = ans.read(spark.newSession(), str(tmp_path / "t")).collect()
    want = Counter((r[0], np.array([*plain(r[1]), 2], "<u4").tobytes()) for r in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    t = ans.read_table(spark, str(tmp_path / "t"))
    raw = bytearray(spark.read.parquet(str(tmp_path / "t/segments")).first().payload)
    ans.unpack_segment(bytes(raw), t)
    raw[40] ^= 1  # in the document records
    with pytest.raises(ValueError):
        ans.unpack_segment(bytes(raw), t)


def test_unknown_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, normalizers

    path, _ = tok("byte_bpe_50k.json")
    with pytest.raises(ValueError):
        TokenBytes(path, spaced=False)
    t = Tokenizer.from_file(path)
    t.normalizer = normalizers.Lowercase()
    t.save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        TokenBytes(str(tmp_path / "t.json"), spaced=True)


def test_op2(spark, docs, empty, rows):
    got = shards.digest(spark, docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    n = Counter(r.shard for r in got)
    assert set(n) <= set(range(8)) and max(n.values()) - min(n[s] for s in range(8)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n[s])) for s in n)
    assert shards.digest(spark, empty).collect() == []
    maps = docs.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    assert Counter((r.doc_id, r["size"]) for r in shards.digest(spark, maps).collect()) == Counter((r.doc_id, r["size"]) for r in got)


def test_op3(spark):
    rng = np.random.default_rng(3)
    e = [(i, [float(x) for x in rng.standard_normal(6)], 0) for i in range(150)]
    e += [(200 + i, e[3][1], 0) for i in range(9)] + [(300, None, 0), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (350, [1e12] * 6, 0), (400, [1.0, 2.0], 0), (None, [0.5] * 6, 0)]
    df = spark.createDataFrame(e, "vec_id long, embedding array<float>, label int")
    ok = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in e if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    ok = list(ok.items())
    ok += [(50, ok[7][1]), (50, ok[50][1]), (7, ok[7][1])]  # ids that repeat: every row is a query and a candidate
    df = df.unionByName(spark.createDataFrame([(50, e[7][1], 1), (50, e[50][1], 1), (7, e[7][1], 1)], "vec_id long, embedding array<float>, label int"))
    got = vafile.search(df, 50, 5, query_block=2).collect()
    want = []
    for n, (q, v) in enumerate(ok):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(ok) if m != n and len(w) == len(v))[:5]
            want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -x))) for k, (x, i) in enumerate(s)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert vafile.search(df.limit(0), 50, 5).collect() == []


def test_op3_reads_the_file_by_passes(spark):
    """No pair of blocks is shuffled, a task carries each query's best, and wide grids and ties stay exact."""
    rng = np.random.default_rng(5)
    v = np.concatenate((rng.standard_normal((2000, 64)) / 8, rng.standard_normal((1000, 64)) * 40, [[3e5] * 64]))
    v = np.concatenate((v, v)).astype("f4")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    sc = spark.sparkContext
    arrays, lists = sc._gateway.new_array, sc._jvm.java.util.ArrayList

    def shuffled():
        stages = sc._jsc.sc().statusStore().stageList(lists(), False, False, arrays(sc._jvm.double, 0), lists())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of any size
    try:
        got = sorted(tuple(r) for r in vafile.search(df, 10, 5, query_block=100).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = shuffled() - before
    x = np.floor(256.0 * v.astype("f8")).astype("i8")
    want = []
    for q in range(0, len(x), 10):
        s = x @ x[q]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5])]
    assert got == want
    assert sent < v.nbytes, (sent, v.nbytes)  # k rows a query and task, and no vectors


def test_op4_gradients_and_learning():
    rng = np.random.default_rng(0)
    w = toxicity.Words(["idiot", "the", "foo", "x"], {"the": 1})
    p = {k: v.astype("f8") for k, v in toxicity.fresh(1, rng).items()}
    idx, n, y = rng.integers(0, 4, (3, toxicity.WINDOW)), np.array([64, 5, 30]), np.array([1.0, 0, 1])
    vec = w.vectors(p).astype("f8")
    _, g = toxicity.backward(p, vec @ p["W"] + p["b"], idx, n, w, vec, y)

    def loss():
        s = toxicity.forward(p, vec @ p["W"] + p["b"], idx, n).astype("f8")
        return float(np.mean(np.logaddexp(0, s) - y * s))

    for k in ("U", "b", "bn", "Wa", "va", "wo", "bo", "W"):
        f, i = p[k].reshape(-1), int(np.argmax(np.abs(g[k])))
        o = f[i]
        f[i] = o + 1e-3
        up = loss()
        f[i] = o - 1e-3
        down = loss()
        f[i] = o
        assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 1e-4, k


def test_op4(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(30)] + [(None, 1, 1), (31, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.digest(empty, labels).collect() == []
    assert {r.score for r in toxicity.digest(docs, labels.limit(0)).collect()} == {0.0}


def test_op4_windows_cover_texts():
    for n in range(0, 400):
        w = toxicity.windows(n)
        assert w[0] == 0 and w[-1] + toxicity.WINDOW >= n and (np.diff(w) <= toxicity.STRIDE).all() and (n == 0 or w[-1] < n)


def plain_stats(t):
    w = WORD.findall(t or "")
    c, m = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            m |= {i, i + 1, i + 2}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(ls) - len(set(ls)), len(m)


def test_op5(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    got = rules.assess(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((r[0], *plain_stats(r[1])) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.assess(empty, labels).collect() == []
    assert all(r.kept != r.base_failed for r in rules.assess(docs, labels.limit(0)).collect())


def test_op5_repeated_and_contradicting_labels(spark, docs):
    labels = [(i, int(i >= 10), 0) for i in range(30)]
    one = rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    many = rules.fit(docs.unionByName(docs), spark.createDataFrame(labels * 20 + [(3, 1, 1)] * 5, "doc_id long, quality int, toxic int"))
    assert one == many


def test_op5_learner_finds_a_threshold():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(rules.FEATURES)))
    bad = (x[:, 1] > 0.7) & (x[:, 3] <= 0.5)
    learned = rules.learn(x, bad)
    on = np.any([rules._covers(r, x) for r in learned], axis=0)
    assert (on == bad).mean() > 0.97


def plain_print(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    import xxhash

    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(s))


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_op6(docs, empty, rows):
    got = simhash.digest(docs).collect()
    fp = [plain_print(r[1]) for r in rows]
    comp = plain_components([(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3], range(len(fp)))
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[comp[k]] = min(least.get(comp[k], 10**9), r[0])
    want = Counter((r[0], f"{fp[k]:016x}", least.get(comp[k])) for k, r in enumerate(rows))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.digest(empty).collect() == []


def plain_unique(rows, n=5, least=0.8):
    """Indexes of the rows that stay: least (doc_id, place) of each group of near copies."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [WORD.findall((r[1] or "").translate(low)) for r in rows]
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in words]
    near = lambda a, b: a == b or len(a & b) >= least * len(a | b) - 1e-9
    comp = plain_components([(a, b) for a in range(len(rows)) for b in range(a) if near(sets[a], sets[b])], range(len(rows)))
    best = {}
    for k, r in enumerate(rows):
        c = comp[k]
        if c not in best or (r[0] is None, r[0] or 0) < (rows[best[c]][0] is None, rows[best[c]][0] or 0):
            best[c] = k
    return sorted(best.values())


def test_op6_unique_keeps_one_of_each_group(spark, docs, empty, rows):
    got = simhash.unique(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(rows[k][0] for k in plain_unique(rows))
    three = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 13)] * 3 + [(None, None, None, None, None)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.doc_id for r in simhash.unique(three).collect()) == {1: 1, None: 1}
    assert simhash.unique(empty).collect() == []


def test_op6_links_at_every_distance(spark):
    rng = random.Random(5)
    fps = []
    for d in range(6):
        for _ in range(40):
            x = rng.getrandbits(64)
            y = x
            for bit in rng.sample(range(64), d):
                y ^= 1 << bit
            fps += [x, y]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    prints = spark.createDataFrame(list(enumerate(signed)), "doc_id long, f0 long")
    got = {r.f0: r.component_id for r in simhash.groups(prints).collect()}
    comp = plain_components([(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3], range(len(fps)))
    assert all(got[s] == comp[k] for k, s in enumerate(signed))


def test_components(spark, monkeypatch):
    from rillsum.llm import graph

    rng = random.Random(2)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(900, i) for i in range(901, 960)]
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long").repartition(6)).collect()}
    one = {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long").coalesce(1)).collect()}
    assert one == got
    monkeypatch.setattr(graph, "BLOCK", 50)  # many blocks, whose stars must meet
    assert {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long").repartition(6)).collect()} == got
    e = [(a, b) for a, b in e if a != b]
    assert got == plain_components(e, {x for p in e for x in p})


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_op7_edit_distance():
    rng = random.Random(3)
    for _ in range(500):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 30)))
        b = "".join(x for x in a if rng.random() > 0.1) + rng.choice(["", "c", "ab"])
        d = levenshtein(a, b)
        assert all(fuzzylines.edit_within(a, b, m) == (d <= m) for m in (max(0, d - 1), d, d + 1))
        assert fuzzylines.similar(a, b) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_op7(spark, empty):
    line = " ".join(f"word{i} of the long passage" for i in range(12))
    near = line.replace("word7", "word8", 1)
    clean = [" ".join(f"q{k}x{i}" for i in range(15)) for k in range(3)]
    data = [(1, f"{clean[0]}\n{line}"), (2, f"{line.upper()}\nshort\n{clean[1]}"), (3, near), (4, "short\nshort"), (5, None), (6, ""), (None, line), (7, f"{clean[2]}\n{clean[2]}")]
    df = spark.createDataFrame([(i, t, None, None, 0, *EXTRA) for i, t in data], SCHEMA)
    out = {r.doc_id: (r.text, r.n_lines_dropped) for r in fuzzylines.dedup(df).collect()}
    assert out == {1: (data[0][1], 0), 2: (f"short\n{clean[1]}", 1), 3: ("", 1), 4: ("", 2), 5: (None, 0), 6: ("", 0), None: ("", 1), 7: (clean[2], 1)}
    assert {r.doc_id: r.n_lines_dropped for r in fuzzylines.dedup(df, min_chars=6).collect()}[4] == 0
    assert fuzzylines.digest(empty).collect() == []


def test_op7_rows_that_repeat_keep_one_occurrence(spark):
    data = [(1, "alpha beta gamma\n\nalpha beta gamma\ndelta epsilon", {"a": 1})] * 3 + [(None, "only here once", None)] * 2 + [(2, None, None)] * 2
    out = fuzzylines.dedup(spark.createDataFrame(data, "doc_id long, text string, extra map<string,int>").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in out) == {(1, "alpha beta gamma\n\ndelta epsilon"): 1, (1, ""): 2, (None, "only here once"): 1, (None, ""): 1, (2, None): 2}
    assert sorted(r.n_lines_dropped for r in out) == [0, 0, 0, 1, 1, 3, 3]


def test_op7_lines_are_cut_as_plain_python_cuts_them():
    import pyarrow as pa

    data = [*texts(), "\n\n  x \t y\n\r\n z\u2003q\n", "İ Ǆ\nß", "a" * 5000 + "\n" + "b " * 3000]
    x, want = fuzzylines.Lines(pa.array(data)), []
    for i, t in enumerate(data):
        want += [(i, k, norm, len(norm), len(norm.split(" "))) for k, line in enumerate((t or "").split("\n")) if (norm := fuzzylines.normal(line))]
    got = [(int(o), int(k), x.raw[s:e].tobytes().decode(), int(z), int(n)) for o, k, s, e, z, n in zip(x.owner, x.line, x.start, x.end, x.size, x.n, strict=True)]
    assert [g for g in got if "i" not in g[2][:2]] == [w for w in want if "i" not in w[2][:2]] and len(got) == len(want)


def test_op7_groups_are_those_of_brute_force(spark, monkeypatch):
    from rillsum.llm import graph

    monkeypatch.setattr(graph, "HOT", 20)
    monkeypatch.setattr(graph, "CHUNK", 7)
    rng = random.Random(21)
    stem = [f"word{rng.randrange(500)}" for _ in range(30)]
    data = []
    for k in range(90):  # one large group of near copies, in which a phrase is hot, and lines of their own
        own = list(stem)
        for i in rng.sample(range(8, 30), rng.choice([0, 1, 2, 3])):
            own[i] = f"other{rng.randrange(500)}"
        data.append((k, " ".join(own)))
    data += [(100 + k, " ".join(f"single{rng.randrange(5000)}" for _ in range(20))) for k in range(30)]
    comp = plain_components([(a, b) for a in range(len(data)) for b in range(a) if fuzzylines.similar(data[a][1], data[b][1])], range(len(data)))
    want = {data[k][0]: int(comp[k] != k) for k in range(len(data))}
    got = {r.doc_id: r.n_lines_dropped for r in fuzzylines.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and sum(want.values()) > 40


@pytest.mark.parametrize("edit", ["one word", "three words", "one character", "tenth of the words"])
def test_op7_recall_of_planted_edits(spark, sf, edit):
    rng = random.Random(edit)
    lines = sorted({x for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("text").dropna().collect() for x in r.text.split("\n") if len(x.split()) >= 10})
    rng.shuffle(lines)
    data, pairs = [], []
    for k, line in enumerate(lines[:300]):
        w = line.split()
        n = {"one word": 1, "three words": 3, "one character": 0, "tenth of the words": max(1, len(w) // 10)}[edit]
        for i in rng.sample(range(len(w)), n):
            w[i] = "zq" + str(rng.randrange(10**6))
        near = " ".join(w)
        if not n:
            i = rng.randrange(len(near))
            near = near[:i] + "#" + near[i + 1 :]
        data += [(2 * k, line), (2 * k + 1, near)]
        if fuzzylines.similar(fuzzylines.normal(line), fuzzylines.normal(near)):
            pairs.append(2 * k + 1)
    got = {r.doc_id: r.n_lines_dropped for r in fuzzylines.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    recall = sum(got[k] for k in pairs) / len(pairs)
    print(edit, len(pairs), recall)
    assert len(pairs) > 100 and recall >= 0.95


def test_op8(docs, empty, rows):
    path, plain = tok("word_bpe_49k.json")
    got = packing.digest(docs, path).collect()
    want = Counter()
    for r in rows:
        ids = plain(r[1]) + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.digest(empty, path).collect() == []


def test_op8_workers_cut_little_text_at_once(spark, monkeypatch):
    """A large batch is numbered in small chunks, with the ids of one text after the other, and freed memory is returned once the task ends."""
    import ctypes

    import pyarrow as pa

    path, plain = tok("word_bpe_49k.json")
    rng = random.Random(6)
    held = [" ".join(f"w{rng.randrange(50)}" for _ in range(100_000)) for _ in range(12)]
    seen, ran, whole = [], [], TokenBytes.encode_ended
    monkeypatch.setattr(TokenBytes, "encode_ended", lambda self, t, e: seen.append(sum(map(len, t.to_pylist()))) or whole(self, t, e))
    frame = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: ran.append(f) or self)
    trimmed = []
    monkeypatch.setattr(ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(trimmed.append)}))
    packing.pieces(frame, path)
    ids = pa.array(range(12))
    got = pa.Table.from_batches(ran[0]([pa.RecordBatch.from_arrays([ids, ids, pa.array(held)], ["doc_id", "th", "text"])])).to_pylist()
    assert len(seen) > 1 and max(seen) <= packing.CHUNK <= 2 << 20 and sum(seen) == sum(map(len, held))
    assert trimmed == [0]
    want = [[*plain(t), 0] for t in held]
    assert [(r["doc_id"], r["start"], r["length"], r["crc"]) for r in got] == [(i, k, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for i, x in enumerate(want) for k in range(0, len(x), 2048)]


def test_op8_search_beats_or_meets_best_fit():
    rng = random.Random(4)
    size = [rng.randrange(300, 1200) for _ in range(300)]
    plain = packing.seeded(size, 2048, rng, 0.0)
    best = packing.evolve(size, 2048, 1, [plain], generations=6)
    assert len(best) <= len(plain) and sorted(i for b in best for i in b) == list(range(300))
    assert all(sum(size[i] for i in b) <= 2048 for b in best)


def test_op8_search_runs_and_large_items_settle(spark, monkeypatch):
    rng = random.Random(9)
    bred = []
    plain = packing.cross
    monkeypatch.setattr(packing, "cross", lambda *a: bred.append(1) or plain(*a))
    size = [rng.choice([rng.randrange(20, 400), rng.randrange(400, 1500)]) for _ in range(600)]
    best = packing.evolve(size, 2048, 0, [])
    assert bred and len(best) <= len(packing.seeded(size, 2048, rng, 0.0)) and sorted(i for b in best for i in b) == list(range(600))
    from_random = packing.evolve(size, 2048, 1, [], generations=8)
    assert len(from_random) < len(packing.seeded(size, 2048, random.Random(1), None))
    monkeypatch.undo()
    monkeypatch.setattr(packing, "BLOCK", 64)
    parts = [(i, i, 0, 0, rng.randrange(1025, 1500), i) for i in range(500)]
    got = packing.pack(spark.createDataFrame(parts, packing.ITEM)).collect()
    assert len({r.sequence_id for r in got}) == 500 and {r.sequence_id >> 57 for r in got} == {0}  # none goes on


def test_op9(docs, empty, rows):
    got = mixing.digest(docs).collect()
    size = [len(WORD.findall(r[1] or "")) for r in rows]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], n) for r, n in zip(rows, size, strict=True))
    per = Counter()
    for r, n in zip(rows, size, strict=True):
        per[r[3]] += n
    goal = mixing.targets(list(per.items()))
    assert abs(sum(goal.values()) - 1.5 * sum(size)) < 1e-6 and all(goal[s] <= 2 * per[s] + 1e-9 for s in per)
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"]
        taken[r.target] += r.taken
    assert all(abs(taken[g] - g) <= max(size) for g in goal.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.digest(docs.repartition(5)).collect()), key=repr)
    assert mixing.digest(empty).collect() == []
    assert mixing.apply(docs).columns == docs.columns
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixing.apply(docs).collect()) == +plan
    assert mixing.apply(empty).collect() == []


def test_op9_same_text_from_two_sources_and_repeated_rows(spark):
    data = [(1, "a b c", s, k) for k, s in enumerate(["x"] * 4 + ["y"] * 3 + [None] * 2)] + [(None, "d e", "x", 20)] * 3 + [(2, None, "y", 30)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, place int")
    plan, got = Counter(), Counter()
    for r in mixing.mix(df).collect():
        plan[r.doc_id, r.source] += r.copies
    for r in mixing.apply(df).collect():
        got[r.doc_id, r.source] += 1
    assert got == +plan


def test_op9_rounding_keeps_mass_and_expectation():
    rng = random.Random(1)
    size = [float(rng.randrange(1, 50)) for _ in range(40)]
    mass = [s * 0.37 for s in size]
    hits = np.zeros(40)
    for _ in range(3000):
        out = mixing.settle(mass, size, [rng.random() for _ in size])
        assert abs(sum(out) - sum(mass)) < 1e-6 and sum(0 < m < s for m, s in zip(out, size, strict=True)) <= 1
        hits += np.array(out) / size
    assert np.abs(hits / 3000 - 0.37).max() < 0.05


def test_op10(spark, empty):
    en, fr = "the house of the people and the word ", "les maisons et le pain du peuple ça où "
    data = [(i, (en if i % 2 else fr) * (1 + i % 5), "en" if i % 2 else "fr") for i in range(60)] + [(60, None, "en"), (61, "12 34", "fr"), (62, en, None), (None, fr, "fr"), (63, "", "en")]
    df = spark.createDataFrame([(i, t, g, None, 0, *EXTRA) for i, t, g in data], SCHEMA)
    got = {r.doc_id: r for r in langid.digest(df).collect()}
    assert len(got) == len(data)
    for i, t, _ in data:
        want = "und" if not t or t == "12 34" else "en" if t.startswith("the") else "fr"
        assert got[i].lang_pred == want and 0 <= got[i].score <= 1
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    assert langid.digest(empty).collect() == []
    assert {r.lang_pred for r in langid.digest(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op7_finds_what_brute_force_finds(spark):
    rng = random.Random(11)
    vocab = ["the", "of", "and", "to"] * 20 + ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(4, 10))) for _ in range(600)]
    data = []
    for k in range(120):
        line = [rng.choice(vocab) for _ in range(rng.choice([10, 14, 25, 60]))]
        near = list(line)
        for i in rng.sample(range(len(line)), max(1, int(len(line) * rng.choice([0, 0.05, 0.12])))):
            near[i] = rng.choice(vocab)
        data += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(near))]
    pairs = [k for k in range(0, 240, 2) if levenshtein(data[k][1], data[k + 1][1]) <= 0.2 * max(len(data[k][1]), len(data[k + 1][1]))]
    got = {r.doc_id: r.n_lines_dropped for r in fuzzylines.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = sum(got[k + 1] for k in pairs)
    assert len(pairs) > 80 and found >= 0.97 * len(pairs)
    assert sum(got.values()) == found


def test_op7_short_lines_and_scripts_without_spaces(spark):
    han = "".join(chr(0x4E00 + 37 * i % 5000) for i in range(60))
    data = [(1, f"Read more here\n{han}\nok"), (2, f"READ  more here\nok\n{han}"), (3, han[:30] + "漢" + han[31:])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.text for r in fuzzylines.dedup(df, min_chars=6).collect()} == {1: data[0][1], 2: "ok", 3: ""}
    assert {r.doc_id: r.text for r in fuzzylines.dedup(df).collect()} == {1: data[0][1], 2: "", 3: ""}


def test_op8_ids_of_large_blocks(spark, monkeypatch):
    ids = np.concatenate([packing.sequence_ids(1, b, np.arange(70_000)) for b in (0, 1)])
    assert len(np.unique(ids)) == 140_000 and ids.max() < 1 << 62
    monkeypatch.setattr(packing, "BLOCK", 64)
    monkeypatch.setattr(packing, "COARSE", 128, raising=False)
    rng = random.Random(6)
    parts = [(i, i, 0, 0, rng.randrange(1100, 1900), i) for i in range(1000)]
    got = packing.pack(spark.createDataFrame(parts, packing.ITEM)).collect()
    bins = Counter(r.sequence_id for r in got)
    assert sorted(r.doc_id for r in got) == list(range(1000)) and set(bins.values()) == {1}
    level = max(x >> 57 for x in bins)
    blocks = Counter(x >> 32 & 0x1FFFFFF for x in bins if x >> 57 == level)
    assert level == 0 and max(blocks.values()) < 200  # no item fits beside another, so every bin is settled


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_tokens_are_the_unmodified_tokenizers(name, spaced):
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, enc = Tokenizer.from_file(path), TokenBytes(path, spaced, specials=True)
    odd = ["a <|endoftext|> <|startoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "<|ENDOFTEXT|> <|endoftext", "é <|startoftext|>é"]
    data = [None, "plain text", *odd, "", *texts(), *odd]
    for part in (pa.array(data), pa.array(data)[3:9]):
        ids, n = enc.encode_array(part)
        want = [plain.encode(x or "", add_special_tokens=False).ids for x in part.to_pylist()]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_op1_and_op8_queries_keep_special_tokens(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from rillsum.llm import registry

    text = "a <|endoftext|> <|startoftext|> b"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(registry, "table", lambda *_: df)
    for query, name, column in ((registry.op1, "byte_bpe_50k.json", "n_tokens"), (registry.op8, "word_bpe_49k.json", "length")):
        n = len(Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids)
        assert query(spark, "").collect()[0][column] in (n, n + 1)


def test_aligned_cost_bounds_the_distance():
    """The greedy alignment never understates the edit distance, and bounded subsequences are exact or refused."""
    import random

    from rillsum.llm.fuzzylines import aligned_cost, common_subsequence, similar

    def plain(a, b, row, step):
        for i, x in enumerate(a, 1):
            new = [step(i, None, None, None, None)]
            for j, y in enumerate(b, 1):
                new.append(step(i, new[-1], row[j], row[j - 1], x == y))
            row = new
        return row[-1]

    rng = random.Random(5)
    for k in range(800):
        x = [rng.choice(["a", "ab", "abc", "bb", "cab", "x" * rng.randint(1, 9)]) for _ in range(rng.randint(1, 30))]
        y = list(x) if k % 2 else x[::-1]
        for _ in range(rng.randint(0, 5)):
            y[rng.randrange(len(y))] = rng.choice(["a", "cab", "xyz", "bb ab"])
        a, b = " ".join(x), " ".join(y)
        d = plain(a, b, list(range(len(b) + 1)), lambda i, left, up, cross, same: i if left is None else min(left + 1, up + 1, cross + (not same)))
        n = plain(a, b, [0] * (len(b) + 1), lambda i, left, up, cross, same: 0 if left is None else max(left, up, cross + same))
        for most in (2, 10, 1000):
            cost = aligned_cost(a, b, most)
            assert cost >= d or cost > most
        assert common_subsequence(a, b) == n
        assert common_subsequence(a, b, n) == n
        assert common_subsequence(a, b, n + 2) in (n, -1)
        assert similar(a, b) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_candidates_compare_every_fingerprint_of_a_first_word(spark):
    import numpy as np
    from rillsum.llm.graph import candidates

    far = (1 << 62) - 1
    rows = [(7, 0), (7, far)] + [(64 + i, far ^ (0x5555555555 << i)) for i in range(5)] + [(1 << 40, 1)]

    def one_key(batch):
        n = batch.num_rows
        return np.arange(n), np.full(n, 1, "u8"), np.ones(n, bool)

    def plain(x, y):
        return sum(bin(a ^ b).count("1") for a, b in zip(x, y)) <= 24

    want = {x[0] for x in rows if any(y is not x and plain(x, y) for y in rows)}
    for order in (rows, rows[::-1]):
        nodes = spark.createDataFrame(order, "f0 long, f1 long").coalesce(1)
        got = candidates(nodes, ["f0", "f1"], one_key, 1, 24).collect()
        assert {r["node"] for r in got} == want
        assert len(got) == len(set(got))


def test_op7_texts_come_from_one_place_each(spark, monkeypatch):
    """A wanted line is cut from one occurrence, not from every text that holds it, and dealt rows alone carry it."""
    rng = random.Random(12)
    vocab = [f"word{i}" for i in range(300)]
    common = [" ".join(rng.choice(vocab) for _ in range(12)) for _ in range(4)]
    near = [" ".join(["other", *c.split(" ")[1:]]) for c in common]
    own = [" ".join(rng.choice(vocab) for _ in range(14)) for _ in range(40)]  # two texts each have a line like it
    held = ["\n".join([f" {common[i % 4]} ", "", f"{own[i // 2]} {'xy'[i % 2]}", "É " + common[i % 3], near[i % 4].upper()]) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate([*held, None, "", "\n", held[0]])), "doc_id long, text string")
    frame, emitted = type(docs), []
    plain = frame.dropDuplicates

    def counted(self, on=None):
        if on in (["h"], ["id"]):
            emitted.append(self.count())
        return plain(self, on)

    monkeypatch.setattr(frame, "dropDuplicates", counted)
    got = {r["doc_id"]: r["n_lines_dropped"] for r in fuzzylines.dedup(docs).collect()}
    assert len(emitted) == 1 and 84 <= emitted[0] <= 120
    assert [got[i] for i in range(80)] == [(2 if i < 4 else 3) + i % 2 for i in range(80)] and got[83] >= 4 and got[80] == got[81] == got[82] == 0


def test_op7_work_on_lines():
    """Where characters and words stand, however long or odd the line; the marks of a long line take few steps."""
    import pyarrow as pa

    rng = random.Random(2)
    for alphabet in ("ab c", "abcé漢\U0001f600 \udc80", "".join(map(chr, range(97, 1000)))):
        for n in (0, 1, 128, 129, 700):
            a = "".join(rng.choice(alphabet) for _ in range(n))
            assert fuzzylines.places(a) == {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)} == fuzzylines.places(list(a))
    rows = [None, "", " \n ", "One  two\n\n  !! \tthree\n", "é — x\r\ny", "漢 字", "last"]
    x = fuzzylines.Lines(pa.array(rows, pa.string()))
    want = [(i, k, fuzzylines.normal(line)) for i, t in enumerate(rows) for k, line in enumerate((t or "").split("\n")) if fuzzylines.normal(line)]
    assert [(o, k, x.raw[s:e].tobytes().decode()) for o, k, s, e in zip(x.owner.tolist(), x.line.tolist(), x.start, x.end, strict=True)] == want
    assert x.size.tolist() == [len(t) for _, _, t in want] and x.n.tolist() == [t.count(" ") + 1 for _, _, t in want]
    words = [w for _, _, t in want for w in t.split(" ")]
    assert x.letters.tolist() == [len(w) for w in words] and (x.u == 0).tolist() == [w in ("!!",) for w in words]


def test_op7_pairs_are_compared_side_by_side(monkeypatch):
    """Many pairs at once have the answers that the edit distance gives, at its bound too, whatever their lengths and characters."""
    rng = random.Random(8)
    kinds, pairs = "ab cdefgé漢\U0001f600", []
    for k in range(900):
        a = "".join(rng.choice(kinds[: rng.choice([3, 9, 11])]) for _ in range(rng.choice([0, 1, 2, 7, 20, 64, 65, 130])))
        b = list(a)
        for _ in range(rng.choice([0, 1, len(a) // 8, len(a) // 5, len(a) // 5 + 1, len(a) // 3])):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "a", "bb"])
        cut = rng.choice([0, 0, len(a) // 9])
        b = "".join(b)[cut:] + a[:cut]
        pairs.append((a, b) if k % 2 else (b, a))
    pairs += [("".join(map(chr, range(300 + k, 700 + k))), "".join(map(chr, range(360 + k, 760 + k)))) for k in range(0, 200, 10)]  # rare characters
    pairs += [("a" * 1700, "a" * 1400), ("a" * 1700, "a" * 1300), ("\udc80b" * 9, "\udc80b" * 8), ("", "")]
    want = [levenshtein(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) if max(len(a), len(b)) < 1000 else len(b) == 1400 for a, b in pairs]
    for few, most in ((1, 4096), (1, 100), (160, 2048)):
        monkeypatch.setattr(fuzzylines, "FEW_LANES", few)
        monkeypatch.setattr(fuzzylines, "LANES", most)
        assert fuzzylines.similar_pairs(pairs) == want
    assert 300 < sum(want) < 800 and None in fuzzylines.lanes([(a, b, 60) for a, b in pairs[900:920]])


def test_links_are_asked_for_many_groups_at_once(spark, tmp_path):
    """No link is lost where groups wait for their answers together, and a task asks seldom."""
    from rillsum.llm.graph import components, linked

    rng = random.Random(4)
    value = {i: rng.randrange(10**6) for i in range(1000)}
    groups = [rng.sample(range(1000), rng.choice([2, 2, 2, 3, 5, 8])) for _ in range(400)] + [rng.sample(range(1000), n) for n in (9, 40, 200)]
    log = str(tmp_path)

    def same(pairs):
        import tempfile

        with tempfile.NamedTemporaryFile("w", dir=log, delete=False) as f:
            f.write(str(len(pairs)))
        return [abs(int(x) - int(y)) < 30_000 and len(x) == len(y) for x, y in pairs]

    members = spark.createDataFrame([(r, i, 0) for r, g in enumerate(groups) for i in g], "root long, id long, f long")
    payloads = spark.createDataFrame([(i, str(v)) for i, v in value.items()], "id long, payload string")
    links = linked(members.coalesce(1), payloads, ["f"], 0, str, same).collect()
    near = [(a, b) for g in groups for a in g for b in g if a > b and abs(value[a] - value[b]) < 30_000 and len(str(value[a])) == len(str(value[b]))]
    want = plain_components(near, range(1000))
    got = plain_components([(max(r.a, r.b), min(r.a, r.b)) for r in links], range(1000))
    assert got == want and len(set(want.values())) < 700
    asked = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(asked) > 3000 and len(asked) < 200
    alone = linked(members, payloads, ["f"], 0, str, lambda pairs: [True for _ in pairs], limit=16, spread=0.0)
    assert components(alone).count() > 0 and all(len(str(value[r.a])) == len(str(value[r.b])) for r in alone.collect())
