"""Learned decision lists over text statistics, in DataFrame functions alone.

The statistics and the verdict are column expressions.  Learning reads the statistics of a bounded,
hash-chosen set of labelled rows; the learned list is a chain of CASE branches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillsum.llm.common import SPACES_JVM

#: At most so many labelled rows are learned from, those with the least hash of doc_id.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
FEATURES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "n_words", "words_per_line", "distinct_rate")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct); null text counts as empty.

    Repeated windows are found by sorting 64-bit window hashes within the row: one array per
    document, no shuffle.  Only texts that repeat a window at all pay for locating it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").alias("doc_id"), text.alias("t"))
    d = d.select("doc_id", "t", F.array_remove(F.split("t", SPACES_JVM), "").alias("w"), F.split("t", "\n", -1).alias("l"))
    n = F.size("w")
    lines = F.filter("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    )
    d = d.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.regexp_replace("t", SPACES_JVM, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("ls"), hashes.alias("h"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )
    # (hash, place) sorted: a window repeats if a neighbour has its hash
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select("*", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).alias("p"))
    same = lambda i, j: F.coalesce(F.get("p", i)["h"] == F.get("p", j)["h"], F.lit(False))
    hit = F.filter(F.transform("p", lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull())
    d = d.select("*", F.sort_array(hit).alias("at"))
    # a repeated window adds 3 words, less those that the window before it has already covered
    gain = lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get("at", i - 1)))
    covered = F.aggregate(F.transform("at", gain), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("ls").cast("long").alias("n_lines"), "n_distinct",
    )


def feature(name: str) -> Column:
    per = lambda a, b: F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {
        "mean_word": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"), "n_words": F.col("n_words").cast("double"), "words_per_line": per("n_words", "n_lines"), "distinct_rate": per("n_distinct", "n_words"),
    }[name]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


Rule = list[tuple[int, str, float]]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, op, t in rule:
        on &= (x[:, f] > t) if op == ">" else (x[:, f] <= t)
    return on


def _grow(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray], most: int) -> Rule:
    """Adds the condition of the best information gain until the rule covers no good row or gains nothing."""
    rule, on = [], np.ones(len(x), bool)
    info = lambda p, n: np.log2((p + 1e-9) / (p + n + 1e-9))
    while len(rule) < most:
        p, n = bad[on].sum(), (~bad[on]).sum()
        if n == 0 or p == 0:
            break
        best = (1e-6, None)
        for f in range(x.shape[1]):
            col, y = x[on, f], bad[on]
            order = np.argsort(col, kind="stable")
            cum = np.concatenate(([0], np.cumsum(y[order])))
            at = np.searchsorted(col[order], cuts[f], side="right")
            for op, ps, tot in ((">", p - cum[at], len(col) - at), ("<=", cum[at], at)):
                gain = ps * (info(ps, tot - ps) - info(p, n))
                i = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[i] > best[0]:
                    best = (gain[i], (f, op, float(cuts[f][i])))
        if best[1] is None:
            break
        rule.append(best[1])
        on = _covers(rule, x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on rows that it wasn't grown on; longer only if better."""
    worth = []
    for k in range(1, len(rule) + 1):
        on = _covers(rule[:k], x)
        p, n = bad[on].sum(), (~bad[on]).sum()
        worth.append((p - n) / (p + n) if p + n else -1.0)
    return rule[: int(np.argmax(worth)) + 1] if worth else rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.95, least: int = 3, most_rules: int = 12, most_terms: int = 4) -> list[Rule]:
    """Sequential covering: rules for rejection, in order.  x: statistics; bad: label says low quality.

    Every third row prunes, the others grow.  A rule is taken if at least `precision` of the pruning
    rows and of all remaining rows that it covers are bad; then its rows leave.  No labelled or no bad row: no rule.
    """
    rules: list[Rule] = []
    if not len(x) or not bad.any():
        return rules
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 201))) for f in range(x.shape[1])]
    rest = np.ones(len(x), bool)
    prune = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and bad[rest].sum() >= least:
        grow = rest & ~prune
        rule = _grow(x[grow], bad[grow], cuts, most_terms)
        if not rule:
            break
        rule = _prune(rule, x[rest & prune], bad[rest & prune])
        on = rest & _covers(rule, x)
        held = on & prune
        if bad[on].sum() < least or bad[on].mean() < precision or (held.any() and bad[held].mean() < precision):
            break
        rules.append(rule)
        rest &= ~on
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule rejects: an ordered chain of CASE branches."""
    out = None
    for rule in rules:
        cond = None
        for f, op, t in rule:
            c = feature(FEATURES[f]) > F.lit(t) if op == ">" else feature(FEATURES[f]) <= F.lit(t)
            cond = c if cond is None else cond & c
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{FEATURES[f]} {op} {t:.6g}" for f, op, t in r) for r in rules]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled documents; rows without a quality label teach nothing.

    Of labels that contradict each other the lowest counts; a doc_id that repeats teaches once.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("label_id"), "quality")
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text")
    stats = statistics(own).select("doc_id", F.struct(*[feature(f).alias(f"f{i}") for i, f in enumerate(FEATURES)]).alias("f")).groupBy("doc_id").agg(F.min("f").alias("f"))
    stats = stats.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "f.*", "quality")
    rows = sorted(tuple(r) for r in stats.collect())  # one row per chosen label at most
    x = np.array([r[1:-1] for r in rows], "f8").reshape(len(rows), len(FEATURES))
    return learn(x, np.array([r[-1] == 0 for r in rows], bool))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    One row per row of docs, repeated rows included; other columns of docs are left out.
    """
    rules = fit(docs, labels)
    s = statistics(docs)
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
