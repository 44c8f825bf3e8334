"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding (words frequent in the learning sample), the mean of its characters'
embeddings and the mean of its character trigrams' embeddings.  Windows of WINDOW words overlap and
cover the whole text; a text's score is the highest of its windows' scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillsum.llm.common import WORD, fold, kept_in_worker, returning

WINDOW, STRIDE = 64, 48
E_WORD, E_CHAR, E_TRI, H, A = 12, 4, 8, 8, 8
CHARS, TRIS = 256, 4096
#: Learn from at most so many labelled rows, those with the least hash of doc_id.
SAMPLE = 5000
#: Longer labelled texts are scored like any other, but not learned from: the sample has a bounded size.
LEARN_CHARS = 200_000
FOLDS, HELD = 5, 0
DIM = E_WORD + E_CHAR + E_TRI


def stem(token: str) -> str:
    """Lower case without ASCII punctuation at the ends."""
    return token.lower().strip(".,;:!?\"'()[]{}*#$%&|<>-_") or token


def scatter(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of values by row number."""
    out = np.zeros((size, values.shape[1]), values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Words:
    """Ragged inputs of distinct words: vocabulary number, characters, trigrams."""

    def __init__(self, words: list[str], vocab: dict[str, int]):
        self.id = np.array([vocab.get(w, 0) for w in words], "i8")
        # all words in one array of code points, each between ^ and $
        flat = np.frombuffer("".join([f"^{w or ' '}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        size = np.array([len(w) or 1 for w in words], "i8") + 2
        end = np.cumsum(size)
        inner, three = np.ones(len(flat), bool), np.ones(len(flat), bool)
        inner[end - 1] = inner[end - size] = three[end - 1] = three[end - 2] = False
        self.c, self.cn = (flat[inner] % CHARS).astype("i8"), size - 2
        code = (flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * 2654435761 % (1 << 32) >> np.uint64(20)
        self.t, self.tn = code[three[:-2]].astype("i8"), size - 2

    @staticmethod
    def mean(table, flat, n):
        at = np.concatenate(([0], np.cumsum(n)[:-1]))
        return np.add.reduceat(table[flat], at, axis=0) / n[:, None].astype("f4")

    def vectors(self, p: dict) -> np.ndarray:
        return np.concatenate((p["word"][self.id], self.mean(p["char"], self.c, self.cn), self.mean(p["tri"], self.t, self.tn)), 1).astype("f4")

    def spread(self, d: np.ndarray, g: dict) -> None:
        """Adds the gradient of the vectors to the tables' gradients."""
        g["word"] += scatter(self.id, d[:, :E_WORD], len(g["word"]))
        g["char"] += scatter(self.c, np.repeat(d[:, E_WORD : E_WORD + E_CHAR] / self.cn[:, None], self.cn, 0), CHARS)
        g["tri"] += scatter(self.t, np.repeat(d[:, E_WORD + E_CHAR :] / self.tn[:, None], self.tn, 0), TRIS)


def fresh(vocab: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    n = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype("f4")
    return {
        "word": n(vocab + 1, E_WORD), "char": n(CHARS, E_CHAR), "tri": n(TRIS, E_TRI), "W": n(2, DIM, 3 * H), "U": n(2, H, 3 * H), "b": np.zeros((2, 1, 3 * H), "f4"),
        "bn": np.zeros((2, 1, H), "f4"), "Wa": n(2 * H, A), "ba": np.zeros(A, "f4"), "va": n(A), "wo": n(2 * H), "bo": np.full(1, -1.0, "f4"),
    }


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(p: dict, proj: np.ndarray, idx: np.ndarray, n: np.ndarray, keep: bool = False):
    """Logits of windows.  proj: (2, words, 3H) input projections; idx: (B, T) word rows; n: words of each window."""
    B, T = idx.shape
    h = np.zeros((2, B, H), "f4")
    hs = np.empty((T, 2, B, H), "f4")
    saved = []
    short = n.min(initial=T) < T
    for t in range(T):
        x = np.stack((proj[0][idx[:, t]], proj[1][idx[:, T - 1 - t]]))
        a = h @ p["U"]
        zr = sigmoid(x[..., : 2 * H] + a[..., : 2 * H])
        z, r = zr[..., :H], zr[..., H:]
        an = a[..., 2 * H :] + p["bn"]
        c = np.tanh(x[..., 2 * H :] + r * an)
        new = c + z * (h - c)
        if short:
            on = np.stack((t < n, T - 1 - t < n))[..., None]
            new = np.where(on, new, h)
        else:
            on = None
        if keep:
            saved.append((h, z, r, an, c, on))
        h = new
        hs[t] = h
    seq = np.concatenate((hs[:, 0], hs[::-1, 1]), 2)  # (T, B, 2H), both at word t
    u = np.tanh(seq @ p["Wa"] + p["ba"])
    e = u @ p["va"]
    if short:
        e = np.where(np.arange(T)[:, None] < np.maximum(n, 1), e, -1e9)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tb,tbk->bk", w, seq)
    logit = pooled @ p["wo"] + p["bo"][0]
    return (logit, saved, seq, u, w, pooled) if keep else logit


def backward(p: dict, proj, idx, n, words: Words, vec: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean log loss and its gradients by back-propagation through time."""
    logit, saved, seq, u, w, pooled = forward(p, proj, idx, n, keep=True)
    B, T = idx.shape
    g = {k: np.zeros_like(v) for k, v in p.items()}
    prob = sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d = ((prob - y) / B).astype("f4")
    g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], "f4")
    dp = d[:, None] * p["wo"]
    dseq = w[..., None] * dp
    dw = np.einsum("tbk,bk->tb", seq, dp)
    de = w * (dw - (w * dw).sum(0))
    g["va"] = np.einsum("tb,tba->a", de, u)
    du = de[..., None] * p["va"] * (1 - u * u)
    g["Wa"], g["ba"] = np.einsum("tbk,tba->ka", seq, du), du.sum((0, 1))
    dseq += du @ p["Wa"].T
    dxs = np.empty((T, 2, B, 3 * H), proj.dtype)
    dh = np.zeros((2, B, H), "f4")
    for t in range(T - 1, -1, -1):
        h, z, r, an, c, on = saved[t]
        dh = dh + np.stack((dseq[t][:, :H], dseq[T - 1 - t][:, H:]))
        through = dh
        if on is not None:
            through = np.where(on, dh, 0)
        dc = through * (1 - z) * (1 - c * c)
        dz = through * (h - c) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        da = np.concatenate((dz, dr, dc * r), 2)
        g["U"] += np.swapaxes(h, 1, 2) @ da
        g["bn"] += (dc * r).sum(1, keepdims=True)
        back = da @ np.swapaxes(p["U"], 1, 2) + through * z
        dh = back if on is None else np.where(on, back, dh)
        dxs[t] = np.concatenate((dz, dr, dc), 2)
    at = (idx.T.ravel(), idx[:, ::-1].T.ravel())
    dproj = np.stack([scatter(at[i], dxs[:, i].reshape(-1, 3 * H), proj.shape[1]) for i in (0, 1)])
    g["b"] = dproj.sum(1, keepdims=True)
    g["W"] = np.stack((vec.T @ dproj[0], vec.T @ dproj[1]))
    words.spread(dproj[0] @ p["W"][0].T + dproj[1] @ p["W"][1].T, g)
    return loss, g


def project(p: dict, vec: np.ndarray) -> np.ndarray:
    return (vec @ p["W"] + p["b"]).astype("f4")


def windows(n: int) -> np.ndarray:
    """First words of the windows over n words: every STRIDE, up to the one that reaches the end."""
    return np.arange(max(1, -(-max(0, n - WINDOW) // STRIDE) + 1)) * STRIDE


def cut(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idx, n, owner) of all windows of documents laid end to end in rows."""
    base = np.cumsum(counts) - counts
    per = [windows(int(c)) for c in counts]
    owner = np.repeat(np.arange(len(counts)), [len(w) for w in per])
    first = np.concatenate(per) if per else np.empty(0, "i8")
    n = np.minimum(WINDOW, counts[owner] - first)
    at = (base[owner] + first)[:, None] + np.minimum(np.arange(WINDOW), np.maximum(n, 1)[:, None] - 1)
    return rows[np.minimum(at, max(len(rows) - 1, 0))] if len(rows) else np.zeros((len(first), WINDOW), "i8"), n, owner


def train(texts: list[str], y: np.ndarray, steps: int = 320, batch: int = 192, seed: int = 5) -> dict:
    """Multiple-instance training: a toxic text's loss sits on its highest window, a clean text's on its highest and a random one.

    Runs whole epochs, 8 and `steps` batches at least; the highest windows are found anew three times.
    """
    rng = np.random.default_rng(seed)
    row: dict[str, int] = {}
    docs = [np.fromiter((row.setdefault(stem(w), len(row)) for w in WORD.findall(t)), "i4") for t in texts]
    names = list(row) or [""]
    df, pos = np.zeros(len(names), "i8"), np.zeros(len(names), "i8")
    for ids, label in zip(docs, y, strict=True):
        own = np.unique(ids)
        df[own] += 1
        pos[own] += int(label)
    common = sorted(np.flatnonzero(df >= 8).tolist(), key=lambda i: (-df[i], names[i]))[:20_000]
    vocab = {names[i]: k + 1 for k, i in enumerate(common)}
    counts = np.array([len(w) for w in docs], "i8")
    idx, n, owner = cut(np.concatenate(docs), counts)
    del row, docs
    # the first choice of windows: the sum of the words' log-odds between the classes
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((df - pos + 0.5) / ((1 - y).sum() + 1))
    odds[df < 8] = 0
    score = np.where(np.arange(WINDOW) < n[:, None], np.maximum(odds, 0).astype("f4")[idx], 0).sum(1)
    p = fresh(len(vocab), rng)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    starts = np.searchsorted(owner, np.arange(len(texts)))
    per = np.diff(np.append(starts, len(owner)))
    epochs = max(8, -(-steps * batch // int(len(texts) + (y == 0).sum())))
    for epoch in range(epochs):
        order = np.lexsort((-score, owner))
        top = order[starts]
        other = starts + (rng.random(len(texts)) * per).astype("i8")
        use = np.concatenate((top, other[(y == 0)]))
        rng.shuffle(use)
        for a in range(0, len(use), batch):
            part = use[a : a + batch]
            own, inv = np.unique(idx[part], return_inverse=True)
            sub = Words([names[i] for i in own], vocab)
            vec = sub.vectors(p)
            _, g = backward(p, project(p, vec), inv.reshape(len(part), WINDOW), n[part], sub, vec, y[owner[part]].astype("f4"))
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k in p:
                x = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                if k in ("word", "char", "tri", "W"):
                    p[k] *= 0.998
                p[k] -= 0.01 * 0.25 ** (epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
        if epoch + 1 in {epochs // 4, epochs // 2, 3 * epochs // 4}:
            proj = np.concatenate([project(p, Words(names[a : a + 20_000], vocab).vectors(p)) for a in range(0, len(names), 20_000)], 1)
            score = np.concatenate([forward(p, proj, idx[a : a + 2048], n[a : a + 2048]) for a in range(0, len(idx), 2048)])
            del proj
    return {"p": p, "vocab": vocab}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from the learning folds; without both classes, the share of toxic labels as a constant."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id"), FOLDS) != HELD)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.select(F.col("doc_id").alias("label_id"), "toxic")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= LEARN_CHARS).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    own = own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # a doc_id that repeats teaches once
    got = sorted((r["doc_id"], r["text"], int(r["toxic"])) for r in own.collect())
    y = np.array([r[2] for r in got], "i8")
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    return train([r[1] for r in got], y)


class Scorer:
    """Scores whole texts; keeps the projections of the words that it has met, up to `limit`."""

    def __init__(self, model: dict, limit: int = 150_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.proj = np.zeros((2, 1024, 3 * H), "f4")
        self.used = 0

    def _learn(self, tokens: set[str]) -> None:
        new = sorted(tokens)
        p, vocab = self.model["p"], self.model["vocab"]
        stems = [stem(w) for w in new]
        distinct = sorted(set(stems))
        at = {w: i for i, w in enumerate(distinct)}
        own = project(p, Words(distinct, vocab).vectors(p))[:, [at[s] for s in stems]]
        while self.used + len(new) > self.proj.shape[1]:
            self.proj = np.concatenate((self.proj, np.zeros_like(self.proj)), 1)
        self.proj[:, self.used : self.used + len(new)] = own
        self.row.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if "constant" in self.model:
            out[:] = self.model["constant"]
            return out
        a = 0
        while a < len(texts):
            toks, size, lo = [], 0, a
            while a < len(texts) and (size < 150_000 or a == lo):
                toks.append(WORD.findall(texts[a]))
                size += len(toks[-1])
                a += 1
            if self.used > self.limit:
                self._clear()
            if new := set().union(*toks) - self.row.keys():
                self._learn(new)
            rows = np.fromiter((self.row[w] for t in toks for w in t), "i8", size)
            idx, n, owner = cut(rows, np.array([len(t) for t in toks], "i8"))
            full = n == WINDOW
            logit = np.empty(len(idx), "f4")
            for part in (np.flatnonzero(full), np.flatnonzero(~full)):
                for b in range(0, len(part), 2048):
                    at = part[b : b + 2048]
                    logit[at] = forward(self.model["p"], self.proj, idx[at], n[at])
            best = np.full(len(toks), -np.inf)
            np.maximum.at(best, owner, logit)
            out[lo:a] = sigmoid(best)
        return out


def score(docs: DataFrame, model: dict, *keep: str) -> DataFrame:
    """(*keep, held_out, score, predicted), one row per row of docs; keep: integer or string columns.

    Null and empty texts are scored as a window without words.  A null doc_id is in no fold: held_out is false.
    """
    import pyarrow as pa

    shared, uid = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept_in_worker("toxicity", dict)
        if held.get("uid") != uid:
            held.update(uid=uid, scorer=Scorer(shared.value))
        s = held["scorer"]
        for b in batches:
            x = s.scores([t or "" for t in b["text"].to_pylist()])
            names = [*keep, "held_out"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(x), pa.array((x >= 0.5).astype("i4"))], [*names, "score", "predicted"])

    d = docs.select(*keep, F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(returning(run, keeps=True), ", ".join(f"{c} {kinds[c]}" for c in keep) + ", held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(d, fit(docs, labels), "doc_id")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic; rows that agree in doc_id and text share one verdict."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    from rillsum.llm.common import written

    bad = score(d, fit(docs, labels), "doc_id", "th").where("predicted = 1").select(F.col("doc_id").alias("b_id"), F.col("th").alias("b_th"))
    bad = written(bad, "toxic")
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.withColumn("__th", th).join(bad, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("__th") == F.col("b_th")), "left_anti").drop("__th")
