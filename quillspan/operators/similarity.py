"""Near-duplicate texts by shingles: exact Jaccard pairs by prefix filtering, and greedy clusters."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.operators.graph import together
from quillspan.session import cut


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 5, least_chars: int = 100, least_shingles: int = 10) -> DataFrame:
    """``id``, ``size`` (characters), ``hash`` and distinct sorted ``shingles`` of the texts long enough to compare.

    The text is normalised first. Null texts, and those with fewer than ``least_chars``
    characters or ``least_shingles`` shingles (not distinct), are left out.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    d = d.withColumn("n", tx.normalized("t")).where(F.length("n") >= least_chars)
    d = d.withColumn("w", F.split("n", " ")).where(F.size("w") - (words - 1) >= least_shingles)
    sh = tx.over_words(F.col("w"), words, lambda w, i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))
    return d.select("id", F.length("t").cast("bigint").alias("size"), tx.short_sha("n").alias("hash"), F.sha2("n", 256).alias("text_class"), F.array_sort(F.array_distinct(sh)).alias("shingles"))


def classes(prints: DataFrame) -> DataFrame:
    """``id``, ``rep`` (least id with the same normalised text): groups of exact copies become one row to compare."""
    rep = prints.groupBy("text_class").agg(F.min("id").alias("rep"))
    return prints.select("id", "size", "hash", "text_class").join(rep, "text_class").select("id", "rep", "size", "hash")


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs ``a`` < ``b`` of representatives of different texts with Jaccard similarity of at least ``threshold``.

    Exact: two sets that similar share a shingle among the rarest ``n - ceil(t n) + 1`` of
    each, so only those are joined, and pairs whose sizes cannot reach the threshold are
    dropped before their sets are compared. Copies are compared once (see ``classes``).
    """
    one = prints.groupBy("text_class").agg(F.min_by(F.struct("id", "shingles"), "id").alias("s")).select("s.id", "s.shingles")
    one = cut(one.withColumn("n", F.size("shingles")))
    flat = one.select("id", "n", F.explode("shingles").alias("h"))
    freq = flat.groupBy("h").agg(F.count("*").alias("df"))
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    ranked = flat.join(freq.where("df > 1"), "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"), F.count("*").alias("shared"))
    # Shingles of one text only come first in the order and match nothing; they take their places in the prefix.
    alone = F.col("n") - F.col("shared").cast("int")
    prefix = ranked.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("r", F.lit(1), F.greatest(keep - alone, F.lit(0)))).alias("i", "x")).select("id", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), F.col("x.h").alias("h"))
    a, b = prefix.toDF("a", "na", "la", "h"), prefix.toDF("b", "nb", "lb", "h")
    near = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - F.lit(1e-9)) & (F.col("a") < F.col("b"))
    # From the first shared shingle on, two sets share at most what is left of the smaller rest: pairs that cannot reach
    # the threshold are dropped before any set travels.
    met = a.join(b, "h").where(near).groupBy("a", "b").agg(F.max(F.least("la", "lb")).alias("most"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = met.where(F.col("most") >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - F.lit(1e-9)).select("a", "b")
    sets = one.select("id", "shingles")
    full = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    sim = both / (F.size("sa") + F.size("sb") - both)
    return full.select("a", "b", sim.cast("double").alias("similarity")).where(F.col("similarity") >= threshold)


def links(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per document: ``id``, ``class_id`` and ``n_links``, its links to documents with other texts."""
    c = classes(prints).select("id", "rep")
    size = c.groupBy("rep").agg(F.count("*").alias("k"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    per = ends.join(size.toDF("other", "k"), "other").groupBy("rep").agg(F.sum("k").alias("n_links"))
    return c.join(per, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def greedy_clusters(pairs: DataFrame) -> DataFrame:
    """``id``, ``leader``, ``similarity`` to it: what claiming in order of id would give.

    In that order an unclaimed text claims every later unclaimed one it is similar to. So
    a text leads iff no earlier neighbour leads, and any other belongs to its first leading
    neighbour. Rounds decide all texts whose earlier neighbours are decided; only texts
    with a neighbour take part. Leaders without members do not appear.
    """
    edges = cut(pairs.select("a", "b", "similarity"))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    rounds = [cut(nodes.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti").withColumn("leads", F.lit(True)))]
    while True:
        state = together(rounds)
        left = nodes.join(state, "id", "left_anti")
        before = edges.join(left.select(F.col("id").alias("b")), "b").join(state.toDF("a", "leads"), "a", "left")
        facts = before.groupBy("b").agg(F.max(F.coalesce("leads", F.lit(False))).alias("claimed"), F.count_if(F.col("leads").isNull()).alias("open"))
        new = facts.where("claimed or open = 0").select(F.col("b").alias("id"), (~F.col("claimed")).alias("leads"))
        new = cut(new)
        if new.isEmpty():
            break
        rounds.append(new)
    lead = state.where("leads").select(F.col("id").alias("a"))
    member = state.where("not leads").select(F.col("id").alias("b"))
    return edges.join(lead, "a").join(member, "b").groupBy("b").agg(F.min_by(F.struct("a", "similarity"), "a").alias("s")).select(F.col("b").alias("id"), F.col("s.a").alias("leader"), F.col("s.similarity").alias("similarity"))


def cluster_table(members: DataFrame, prints: DataFrame) -> DataFrame:
    """Per leader: ``cluster_id``, ``n``, ``total_chars`` and mean ``similarity`` of the members to it."""
    size = prints.select("id", "size", "hash")
    m = members.join(size.select("id", "size"), "id").groupBy("leader").agg(F.count("*").alias("k"), F.sum("size").alias("chars"), F.avg("similarity").alias("similarity"))
    return m.join(size.toDF("leader", "own", "hash"), "leader").select(
        F.concat(F.lit("cluster-"), F.col("hash")).alias("cluster_id"), "leader", (F.col("k") + 1).alias("n"), (F.col("chars") + F.col("own")).cast("bigint").alias("total_chars"), "similarity"
    )


def duplication_summary(docs_total: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: texts, texts in clusters, their characters, the largest cluster and the share of texts in clusters."""
    c = clusters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_clusters"), F.coalesce(F.sum("total_chars"), F.lit(0)).alias("cluster_chars"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count("*").alias("n_clusters"))
    t = docs_total.agg(F.count("*").alias("n_docs"))
    return t.crossJoin(c).withColumn("ratio", F.when(F.col("n_docs") > 0, F.col("in_clusters") / F.col("n_docs")).otherwise(0.0))  # one row each


def exact_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts that occur more than once: ``sha256``, ``n`` and the least id."""
    d = docs.select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("sha256")).where("sha256 is not null")
    return d.groupBy("sha256").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


union_all = functools.partial(functools.reduce, DataFrame.unionByName)
