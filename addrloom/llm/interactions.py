"""How filters overlap and what their order changes: an audit over the lattice of filter subsets.

A document fails some of the filters, and whatever the order, what happens to it
at a filter depends on the set of filters before it alone. So documents
contribute to edges (set already applied, next filter) of the lattice of subsets:
80 of them for five filters. Documents of one part that fail the same filters
contribute alike and are counted before they are spread over the edges. The
summed edges are joined to the steps of all orders, 600 for five filters, each of
which is one edge of a path through the lattice. Summed over all orders, a
filter's removals weigh each edge by the number of paths through it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SPACE = r"[\x20\x09-\x0D]+"


def bits(failures: Sequence[Column]) -> Column:
    """The failed filters as a number, the first one's bit the lowest; null is no failure."""
    out = F.lit(0)
    for k, fails in enumerate(failures):
        out = out + F.when(F.coalesce(fails, F.lit(False)), 1 << k).otherwise(0)
    return out


def edge_counts(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, before, filter, and the counts) of rows (part, fails, good, toxic): every edge of every part, zeros included.

    ``fails`` and ``before`` hold a bit for each filter.
    """
    classes = rows.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    edges = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(name).alias("filter"), F.lit(1 << k).alias("own")) for k, name in enumerate(filters) for s in range(1 << len(filters)) if not s >> k & 1])
    met = classes.withColumn("edge", F.explode(edges)).select("*", "edge.*").drop("edge")
    there = F.col("fails").bitwiseAND(F.col("before")) == 0
    fails = F.col("fails").bitwiseAND(F.col("own")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    counts = (total(there & ~fails), total(there & fails), total(~there & fails), total(F.col("fails") == F.col("own")), total(there & fails, "good"), total(there & fails, "toxic"))
    return met.groupBy("part", "before", "filter").agg(*[c.alias(x) for c, x in zip(counts, COUNTS)])


def order_steps(filters: Sequence[str]) -> list[tuple[str, int, str, int]]:
    """(filter_order, step, filter, before) of all orders."""
    out = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            out.append(("".join(order), step, name, before))
            before |= 1 << list(filters).index(name)
    return out


def audit(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, filter_order, step, the counts, shapley) for rows (part, fails, good, toxic) and filters of one letter each.

    Rows are read once. There are as many orders as permutations, so six filters
    are the most. An empty table gives no rows.
    """
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("one to six different filters")
    edges = store.cut(edge_counts(rows, filters))
    # At most 720 * 6 rows.
    steps = F.broadcast(rows.sparkSession.createDataFrame(order_steps(filters), "filter_order string, step int, filter string, before int"))
    paths = steps.groupBy("filter", "before").agg(F.count(F.lit(1)).alias("paths"))
    shapley = edges.join(F.broadcast(paths), ["filter", "before"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("paths")).alias("shapley"))
    return edges.join(steps, ["filter", "before"]).join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every document by five filters A to E.

    A: fewer than 200 words; B: fewer than half of them distinct; C: more than 2 %
    capitals; D: one of ``#$%&*|``; E: the text of a smaller doc_id. A null text is
    empty, a null source an empty one. Rows without a doc_id neither fail E nor make
    others fail it, and have no labels; repeated rows count each, and the first of
    equal texts is every row with the least doc_id. Of several labels of a doc_id
    one that says good or toxic is enough. Texts are told apart by SHA-256. A text's
    words are an array in its task, so a text of n bytes takes some 10 n there.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words"))
    n, distinct, size = F.size("words"), F.size(F.array_distinct("words")), F.length("text")
    capitals = size - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    alone = bits([n < 200, 100 * distinct < 50 * n, 100 * capitals > 2 * size, F.col("text").rlike(r"[#$%&*|]")])
    rows = rows.select("doc_id", "part", alone.alias("alone"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = store.table(rows, "failures")
    # Only the first of a text meets its digest, so no key holds a group of copies.
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(firsts, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.select("doc_id", "part", (F.col("alone") + F.when(copy, 16).otherwise(0)).alias("fails"), "row")
    # Written first, so that the join can split a doc_id that many rows share.
    flags = store.table(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "flags")
    # Rows without a doc_id have a key each, so they don't meet in one task.
    keyed = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), "row")))
    return keyed.join(flags, "key", "left").select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over whole documents, a part for each source; see ``document_failures``."""
    return audit(document_failures(docs, labels), "ABCDE")
