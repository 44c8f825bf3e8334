import random

from rillsum.llm import simhash


def jaccard(a, b):
    s, t = ({tuple(x.lower().split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))} for x in (a, b))
    return len(s & t) / len(s | t)


def test_stage_finds_near_copies_from_a_similarity_of_080(spark):
    import corpus_pipeline as C

    rng = random.Random(4)
    data, want = [], 0
    for k in range(150):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 150, 400]))]
        near = list(words)
        for i in rng.sample(range(len(words)), rng.choice([1, 2, 4, 8])):
            near[i] = "x"
        a, b = " ".join(words), " ".join(near).upper()
        data += [(2 * k, a), (2 * k + 1, b)]
        want += jaccard(a, b) >= 0.8
    data += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one three"), (None, data[0][1])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = {r.doc_id for r in C.drop_near_copies(spark, df, "").collect()}
    assert {900, 902, 904} <= kept and not kept & {901, 903, None}
    lost = {i for i in range(300)} - kept
    assert all(i % 2 and jaccard(data[i - 1][1], data[i][1]) >= 0.8 for i in lost)
    assert 30 < want < 150 and len(lost) >= 0.98 * want
    assert simhash.unique(df.limit(0)).collect() == []
