import random

import pytest

from quillspan.llm import spans


def brute(texts, n):
    occ = {}
    for i, t in texts:
        for q in range(len(t or "") - n + 1):
            occ.setdefault(t[q : q + n], set()).add(i)
    out = {}
    for i, t in texts:
        cov, end = 0, 0
        for q in range(len(t or "") - n + 1):
            if len(occ[t[q : q + n]]) > 1:
                cov += q + n - max(end, q)
                end = q + n
        out[i] = cov
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh é\n") for _ in range(k))
    shared = [word(rng.randint(20, 90)) for _ in range(6)]
    texts = []
    for i in range(40):
        t = "".join(rng.choice([word(rng.randint(5, 40)), rng.choice(shared)]) for _ in range(rng.randint(0, 5)))
        texts.append((i, t))
    texts += [(40, None), (41, ""), (42, "x" * 300), (43, "ab" * 200), (44, "ab" * 180 + "c"), (45, texts[3][1]), (46, shared[0][:39])]
    df = spark.createDataFrame(texts, "id bigint, t string").selectExpr("id", "t", "1 as rid", "'x' as text")
    got = {r.record_id: r for r in spans.shared_spans(df, "id", "t", 40, 12, 5).collect()}
    want = brute(texts, 40)
    assert {i: r.shared_chars for i, r in got.items()} == want
    for r in got.values():
        assert sum(e - s for s, e in r.spans) == r.shared_chars
    assert got[40].n_chars == 0 and got[40].shared_share == 0.0


def test_empty_table_and_same_id(spark):
    df = spark.createDataFrame([(1, "q" * 50 + "w"), (1, "q" * 50 + "w")], "id bigint, t string")
    assert spans.shared_spans(df.limit(0), "id", "t", 40, 12, 5).count() == 0
    assert [r.shared_chars for r in spans.shared_spans(df, "id", "t", 40, 12, 5).collect()] == [0, 0]


def test_sliding_min():
    import numpy as np

    a = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert spans.sliding_min(a, 3).tolist() == [3, 1, 1, 1, 2]


def test_hot_hashes_are_not_shuffled(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9000).select((F.col("id") % 50).alias("rid"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 4000 + 10).alias("k"), F.lit(1).alias("other"))
    keys = spans._recurring(rows, ["k"])
    want = sorted(map(tuple, rows.join(keys.select("k"), "k", "left_semi").select("rid", "k").collect()))
    got = spans._among(rows, keys, ["k"], 9000)
    assert sorted(map(tuple, got.select("rid", "k").collect())) == want and sum(k == 7 for _, k in want) == 3000
    plan = got._jdf.queryExecution().toString()
    assert "Union" in plan and plan.count("LeftAnti") > 0  # the hot key's rows are kept apart, and met by broadcast
    # What is shuffled holds no key of more than a thousandth of the rows.
    assert rows.join(keys.where("n >= 10"), "k", "left_anti").groupBy("k").count().agg(F.max("count")).first()[0] < 10
    assert spans._among(rows.limit(0), keys, ["k"], 0).count() == 0


def test_a_passage_in_a_third_of_all_records(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    shared = word(90)
    texts = [(i, word(60) + (shared if i % 3 == 0 else "") + word(50)) for i in range(120)]
    df = spark.createDataFrame(texts, "id bigint, t string").repartition(5)
    got = {r.record_id: r.shared_chars for r in spans.shared_spans(df, "id", "t", 40, 12, 5).collect()}
    assert got == brute(texts, 40) and sum(v >= 90 for v in got.values()) == 40
