import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import heavy, leaks, mixing, repetition, split


def test_frequent_items_are_exact(spark):
    rng = random.Random(1)
    vals = [rng.choice(["hot"] * 30 + ["warm"] * 5 + ["é", "", None] + ["v%d" % i for i in range(50)]) for _ in range(3000)]
    df = spark.createDataFrame([(v, v and v.upper(), "x") for v in vals], "a string, `b c` string, item string").repartition(7)
    got = [(r.field, r.item, r.n) for r in heavy.frequent_items(df, ["a", "b c"], 10, partitions=3).collect()]
    want = [("a", k, n) for k, n in sorted(((k, n) for k, n in Counter(vals).items() if k is not None), key=lambda x: (-x[1], x[0].encode()))[:10]]
    assert sorted(x for x in got if x[0] == "a") == sorted(want)
    assert sorted((i, n) for f, i, n in got if f == "b c") == sorted((i.upper(), n) for _, i, n in want)
    share = heavy.frequent_items(df, ["a"], 10, 0.1).collect()
    assert {r.item for r in share} == {k for k, n in Counter(vals).items() if k is not None and n >= 300}
    assert heavy.frequent_items(df.limit(0), ["a"], 3).count() == 0
    assert heavy.frequent_items(df.where("a is null"), ["a"], 3).count() == 0
    with pytest.raises(ValueError):
        heavy.frequent_items(df, ["a"], 10, 0.01)


def test_heaps_merge_through_a_tree(spark):
    rng = random.Random(3)
    vals = ["hot"] * 2000 + ["v%d" % rng.randint(0, 900) for _ in range(4000)]
    rng.shuffle(vals)
    df = spark.createDataFrame([(v,) for v in vals], "a string").repartition(6)
    got = [(r.item, r.n) for r in heavy.frequent_items(df, ["a"], 7, partitions=200).collect()]
    assert sorted(got) == sorted(sorted(Counter(vals).items(), key=lambda x: (-x[1], x[0]))[:7])
    plan = heavy.frequent_items(df, ["a"], 7, partitions=200)._jdf.queryExecution().toString()
    assert plan.count("RepartitionByExpression") + plan.count("Repartition 4") >= 2 and "collect_list" not in plan


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["alpha beta gamma();", "", "delta", "é漢😀 words", "x" * 130, "  indented line of text", "\t"]), max_size=60), st.integers(0, 8))
def test_pieces_give_the_text_again(lines, overlap):
    text = "\n".join(lines)
    ps = split.pieces(text, 120, overlap)
    assert all(len(text[s:e].encode()) <= 120 for s, e, _ in ps)
    assert all(b[0] == a[1] - overlap for a, b in zip(ps, ps[1:], strict=False))
    assert "".join(text[s + (overlap if i else 0) : e] for i, (s, e, _) in enumerate(ps)) == text


def test_pieces_end_at_lines_and_carry_them(spark):
    t = "\n".join(f"line number {i} with words" for i in range(100))
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (4, "short"), (5, "x" * 5000)], "id bigint, t string").selectExpr("*", "1 as piece", "2 as i")
    rows = split.split_items(df, "id", "t", 600, 20).orderBy("record_id", "piece_no").collect()
    assert {r.record_id for r in rows} == {1, 4, 5}
    for r in rows:
        if r.record_id == 1:
            assert r.boundary in ("valley", "line", "end") and (r.piece.endswith("\n") or r.boundary == "end")
            assert r.start_line == t.count("\n", 0, r.start_char) + 1 and r.end_line == t.count("\n", 0, r.end_char - 1) + 1
    assert [r.boundary for r in rows if r.record_id == 5][:-1] == ["hard"] * 8
    assert split.split_items(df.limit(0), "id", "t", 600, 20).count() == 0


def test_cuts_fall_between_topics():
    rng = random.Random(12)
    hit = n = 0
    for _ in range(20):
        text, borders = "", set()
        for _ in range(14):
            topic = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
            text += "".join("  " + " ".join(rng.choice(topic) for _ in range(5)) + "\n" for _ in range(rng.randint(12, 20)))
            borders.add(len(text))
        for _, end, kind, depth in split.cuts(text, 1600, 50)[:-1]:
            n += 1
            hit += end in borders
            assert kind == "valley" and depth > 0.1
    assert n > 100 and hit / n > 0.95


def test_cohesion_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        lines = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x", "Alpha"]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 25))]
        block = rng.randint(1, 6)
        count = lambda part: Counter(w for x in part for w in x.lower().split() if len(w) > 2)
        for i, got in enumerate(split._similarity(lines, block)):
            a, b = count(lines[max(0, i + 1 - block) : i + 1]), count(lines[i + 1 : i + 1 + block])
            norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
            assert abs(got - (sum(a[w] * b[w] for w in a) / norm if norm else 0)) < 1e-9


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(9)
    item = words(rng, 80)
    part = item[20:50]
    changed = list(part)
    changed[5], changed[15], changed[25] = "zzz", "yyy", "xxx"
    worse = [w if i % 5 else "qqq" for i, w in enumerate(part)]
    f = lambda ws: " ".join(words(rng, 30)) + " " + ws + " " + " ".join(words(rng, 30))
    docs = [
        (1, f(" ".join(part))), (2, f("> " + "\n> ".join(" ".join(part[i : i + 4]).upper() + "," for i in range(0, 30, 4)))), (3, f(" ".join(changed))), (4, f(" ".join(worse))), (5, f(" ".join(item[20:44]))), (6, None), (7, ""),
        (8, f("<b>" + "</b> <br/>\n".join(part[:30]))), (9, " ".join(item)), (10, f("1. " + "\n2. ".join(" ".join(part[i : i + 10]) for i in range(0, 30, 10)))),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as n")
    it = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, " ".join(words(rng, 60)))], "item_id bigint, text string")
    for limit, size in ((500_000, 32_000_000), (1, 32_000_000), (1, 0), (500_000, 0)):
        got = {(r.doc_id, r.item_id): (r.n_words, r.n_replaced) for r in leaks.leaked_items(d, it, "doc_id", "text", "item_id", "text", broadcast_rows=limit, broadcast_bytes=size).collect()}
        assert set(got) == {(1, 1), (2, 1), (3, 1), (8, 1), (9, 1), (10, 1)}
        assert got[(9, 1)] == (80, 0) and got[(3, 1)][1] == 3
    assert leaks.leaked_items(d.limit(0), it, "doc_id", "text", "item_id", "text").count() == 0


def test_a_fingerprint_of_a_third_of_all_documents(spark):
    rng = random.Random(4)
    opening = words(rng, 8)
    items = [(i, " ".join(opening + words(rng, 40))) for i in range(12)]
    docs = [(i, " ".join(words(rng, 20) + (opening if i % 3 == 0 else []) + words(rng, 20))) for i in range(300)] + [(1000, items[5][1])]
    d, it = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string")
    for rows, size in ((500_000, 32_000_000), (1, 0)):
        got = leaks.leaked_items(d, it, "doc_id", "text", "item_id", "text", broadcast_rows=rows, broadcast_bytes=size)
        assert [(r.doc_id, r.item_id) for r in got.collect()] == [(1000, 5)]


def test_longest_match_equals_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(5, 30)
        a = ["w%d" % i for i in range(n)]
        b = [w if rng.random() < 0.85 else "?" for w in a]
        best = max((j - i for i in range(n) for j in range(i + 5, n + 1) if a[i] == b[i] and a[j - 1] == b[j - 1] and 10 * sum(x != y for x, y in zip(a[i:j], b[i:j], strict=True)) <= j - i), default=0)
        got = leaks.longest_match(a, b, 0, 5, 10)
        assert (got[1] if got else 0) == best


def test_repetition(spark):
    s = "one two three four five six seven eight nine ten. "
    docs = [(1, s * 4), (2, s), (3, None), (4, ""), (5, "1 2 3 --- 4"), (6, s + "Other words stand here and say something quite different now. " * 1)]
    df = spark.createDataFrame([(i, t, "EN" if i % 2 else None, None) for i, t in docs], "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as n_words", "2 as threshold")
    got = {r.doc_id: r for r in repetition.repetition(df, "doc_id", "text").collect()}
    assert (got[1].n_words, got[1].repeated_words, got[1].repetitive) == (40, 30, True)
    assert [got[i].repetitive for i in (2, 3, 4, 5, 6)] == [False] * 5
    assert got[1].lang == "en" and got[2].lang == "und" and got[3].n_words == 0
    assert all(r.threshold <= 0.3 for r in got.values())
    assert repetition.repetition(df.limit(0), "doc_id", "text").count() == 0


def test_thresholds_adapt_to_the_group(spark):
    plain = lambda i: " ".join("%c%c%c" % (97 + i % 26, 97 + j // 26, 97 + j % 26) for j in range(60))
    part = lambda i, k: plain(i) + " " + " ".join(plain(i).split()[:k])
    rows = [(i, part(i, 0), "en", "calm") for i in range(40)] + [(100, part(3, 50), "en", "calm"), (101, part(4, 8), "en", "calm")]
    rows += [(200 + i, part(i, 58), "en", "spam") for i in range(20)] + [(300 + i, part(i, 10 + i % 3), "de", "echo") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in repetition.repetition(df, "doc_id", "text").collect()}
    # The group's own jump decides; a group that repeats throughout is held to the others' level.
    assert {i for i, r in got.items() if r.repetitive} == {100} | set(range(200, 220))
    assert got[200].threshold == got[0].threshold or got[200].threshold < 0.4
    flat = repetition.repetition(df.where("doc_id < 40 or doc_id >= 300"), "doc_id", "text").where("repetitive")
    assert flat.count() == 0  # nothing jumps by 0.15, so nothing is repetitive


def test_repeated_words_equals_brute_force():
    rng = random.Random(8)
    for _ in range(100):
        ws = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        cov = set()
        for i in range(len(ws) - 5):
            if any(ws[j : j + 6] == ws[i : i + 6] for j in range(i)):
                cov |= set(range(i, i + 6))
        assert repetition.repeated_words(" ".join(ws)) == (len(ws), len(cov))


def test_mixture_meets_its_shares(spark):
    rng = random.Random(5)
    sized = [(i, rng.choice(["big"] * 8 + ["small", "other", None]), rng.choice([0, 5, 40, 200])) for i in range(4000)]
    s = spark.createDataFrame(sized, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 as base", "2 as p").repartition(5)
    t = spark.createDataFrame([("big", 0.6, 2), ("small", 0.4, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(s, t).cache()
    r = {x.source: x for x in mixing.mix_report(m, t).collect()}
    assert abs(r["big"].actual_share - 0.6) < 0.01 and r["small"].most_copies <= 3 and r["big"].most_copies <= 2
    assert m.where("source is null or source = 'other'").count() == 0
    assert m.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mix(s.limit(0), t).count() == 0


def test_shares_of_the_tables_are_met_to_a_document(spark):
    from quillspan.llm import queries

    rows = queries.p9_shares(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 13 and abs(sum(r.actual_share for r in rows) - 1) < 1e-9
    assert all(abs(r.share_error) <= 2 * r.error_bound for r in rows), rows
    caps = {r.source: r.max_repeats for r in spark.read.parquet("/root/testdata/sf0.01/mix_targets.parquet").collect()}
    assert all(r.most_copies <= caps[r.source] for r in rows)


def test_many_sources_are_not_broadcast(spark):
    sized = spark.createDataFrame([(i, "s%d" % (i % 5), 10 + i % 7) for i in range(500)], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("s%d" % i, 0.2, 2) for i in range(5)], "source string, target_share double, max_repeats int")
    key = lambda df: sorted((r.doc_id, r.copies) for r in df.collect())
    a, b = key(mixing.mix(sized.coalesce(1), t)), key(mixing.mix(sized.coalesce(1), t, broadcast_sources=1))
    assert len(a) == len(b) == 500 and abs(sum(c for _, c in a) - sum(c for _, c in b)) < 20


def test_a_move_keeps_tokens():
    rng = random.Random(2)
    for _ in range(200):
        rows = [[rng.uniform(0.05, 0.95), rng.randint(1, 50), i, 0] for i in range(rng.randint(1, 12))]
        before = sum(p * w for p, w, *_ in rows)
        done, left = mixing.round_pairs(rows, 3)
        every = [*done, *([left] if left else [])]
        assert len(every) == len(rows) and all(x[0] in (0.0, 1.0) for x in done)
        assert abs(sum(p * w for p, w, *_ in every) - before) < 1e-6


def test_tokens(spark):
    df = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None)], "doc_id bigint, source string, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in mixing.count_tokens(df, "doc_id", "text", "source").collect()) == [(1, 2), (2, 0)]


def test_a_leak_with_one_fingerprint(spark):
    items, docs = [], []
    for i in (84, 541, 571):  # seeds of which the two sides share one fingerprint
        item = words(random.Random(i), 30)
        doc = list(item)
        for at in (6, 13, 20):
            doc[at] = "zzz" + doc[at]
        items.append((i, " ".join(item)))
        docs.append((i, " ".join(doc)))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert leaks.leaked_items(d, e, "doc_id", "text", "item_id", "text").count() == 3


def test_soft_boundaries_are_sought_in_the_whole_window():
    text = "word " * 1600 + "x" * 3800 + "y" * 9000
    start, end, kind = split.pieces(text, 12_000, 200)[0]
    assert kind == "soft" and end == 8000
