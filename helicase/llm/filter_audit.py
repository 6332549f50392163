"""Filter interaction audit by inclusion and exclusion.

For a set of filters, the documents that fail all filters of a subset are
counted for every subset, as sums of products of 0/1 flags.  Everything
else follows from those joint counts:

- survivors of a set of filters: the alternating sum over its subsets (the
  Moebius inversion), whatever the order;
- what a filter removes at its place in an order: the difference of two
  survivors; what it would have removed had nothing gone before it, its
  redundancy;
- unique failures: the alternating sum over the supersets of one filter;
- Shapley values: the removed documents are a game whose Harsanyi dividend
  of a subset is its joint count with alternating sign, and a dividend is
  shared equally by the subset's filters.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Orders grow as the factorial of the filters, sums as a power of two.
MAX_FILTERS = 7
WORD = r"[^\x20\x09-\x0D]+"


def subsets(k: int) -> range:
    """Subsets of ``k`` filters as bit masks."""
    return range(1 << k)


def joint_counts(flags: DataFrame, part: str, names: list[str], weights: list[str]) -> DataFrame:
    """One row per part: for each weight, an array with the joint failures of every subset at its mask.

    ``flags`` has a 0/1 column for each filter and each weight.  The sum of
    a product of flags counts the rows that fail all of a subset.
    """
    def product(mask: int, weight: str) -> Column:
        flags_of = [weight, *[n for i, n in enumerate(names) if mask >> i & 1]]
        return F.expr(f"sum({' * '.join(f'`{c}`' for c in flags_of)})")

    cells = [product(mask, w).alias(f"{w}_{mask}") for w in weights for mask in subsets(len(names))]
    sums = flags.groupBy(part).agg(*cells)
    return sums.select(part, *[F.array(*[f"{w}_{mask}" for mask in subsets(len(names))]).alias(w) for w in weights])


def _signed(joint: Column, sign: int) -> Column:
    """Dividends: each subset's count, negative for an even or, with ``sign`` -1, odd number of filters."""
    return F.transform(joint, lambda x, s: x * F.when(F.bit_count(s) % 2 == 1, sign).otherwise(-sign))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def survivors(joint: Column, k: int) -> Column:
    """For each mask, how many rows none of its filters rejects."""
    def within(mask: Column) -> Column:
        return _total(F.filter(_signed(joint, -1), lambda x, s: s.bitwiseAND(F.bitwise_not(mask)) == 0))

    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), within)


def _over_supersets(joint: Column, k: int, share) -> Column:
    """For each filter, the sum of the dividends of the subsets that hold it, each times ``share`` of its size."""
    def of(i: Column) -> Column:
        shared = F.transform(_signed(joint, 1), lambda x, s: x * F.when(F.getbit(s.cast("long"), i) == 1, share(F.bit_count(s))).otherwise(0))
        return _total(shared)

    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), of)


def unique_failures(joint: Column, k: int) -> Column:
    """For each filter, the rows that fail it and no other."""
    return _over_supersets(joint, k, lambda size: F.lit(1))


def shapley_totals(joint: Column, k: int) -> Column:
    """For each filter, what it removes summed over all orders: its share of the dividends, times the orders.

    k! is divisible by every subset's size, so the sum stays whole.
    """
    orders = math.factorial(k)
    return _over_supersets(joint, k, lambda size: F.get(F.array(*[F.lit(orders // n) for n in range(1, k + 1)]), size - 1))


def audit(flags: DataFrame, part: str, names: list[str], weights: dict[str, str]) -> DataFrame:
    """One row per part, order and step from 0/1 flags.

    ``names`` are the filters' columns, each named by one letter; ``weights``
    names 0/1 columns whose losses are wanted, by the name of the result.
    Returns ``part, filter_order, step, kept, removed, redundant,
    unique_fails, shapley`` and a column for each of ``weights``.

    Defined cases: an empty table has no parts and gives no rows; a part in
    which nothing fails gives zeros.

    Scale: rows are summed before the shuffle, which holds one row for each
    task and part.  Orders are unfolded from the sums of a part alone.
    """
    k = len(names)
    if not 0 < k <= MAX_FILTERS:
        raise ValueError(f"an audit takes 1 to {MAX_FILTERS} filters, not {k}")
    if any(len(n) != 1 for n in names) or len(set(names)) < k:
        raise ValueError("filters are named by different letters")
    joint = joint_counts(flags.withColumn("_one", F.lit(1).cast("long")), part, names, ["_one", *weights.values()])
    # on the summed rows alone, so that the sums aren't worked out for each order again
    solved = stage(joint.select(
        part, F.col("_one").alias("joint"), survivors(F.col("_one"), k).alias("left"), unique_failures(F.col("_one"), k).alias("unique"),
        shapley_totals(F.col("_one"), k).alias("share"), *[survivors(F.col(w), k).alias(f"left_{w}") for w in weights.values()]), name="audit")
    steps = [
        {"filter_order": "".join(names[i] for i in order), "step": at + 1, "filter": order[at], "alone": 1 << order[at],
         "before": sum(1 << i for i in order[:at]), "after": sum(1 << i for i in order[:at + 1])}
        for order in itertools.permutations(range(k)) for at in range(k)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, filter int, alone int, before int, after int>>")
    one = solved.withColumn("s", F.explode(steps))

    def at(table: str, index: str) -> Column:
        return F.get(F.col(table), F.col(f"s.{index}"))

    removed = at("left", "before") - at("left", "after")
    failing = at("joint", "alone")
    return one.select(
        F.col(part).alias("part"), F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step"), at("left", "after").alias("kept"),
        removed.alias("removed"), (failing - removed).alias("redundant"), at("unique", "filter").alias("unique_fails"),
        *[(at(f"left_{w}", "before") - at(f"left_{w}", "after")).alias(name) for name, w in weights.items()], at("share", "filter").alias("shapley"))


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone, as conditions of failure."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    } | {"words": words}


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """The audit of five text filters, in all orders, for each part of a corpus.

    A document fails A with under 100 words, B if under 80% of its words are
    different, C if over 10% of its code points are A-Z, D if it holds any of
    ``#$%&*|`` and E if a document with a smaller id has the same text.
    ``labels`` (``doc_id, quality, toxic``) tells good and toxic documents.
    Returns ``part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley``, as :func:`audit`.

    Defined cases: a null text is empty, and equal to an empty one; it fails
    A alone.  A null part is the empty string.  A null id counts as larger
    than any other; rows of one id are not smaller than each other.
    Documents without label, or of null id, are neither good nor toxic; with
    several labels one of the kind is enough.  Repeated rows count each.
    Other columns are not read.

    Scale: whole texts are read once and leave a digest and flags.  Equal
    texts meet as digests, counted before the shuffle; those that occur once
    need no further join.  Joins split hot keys, as the right side is a written
    table of one row for each.  Nothing is broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rules = text_flags(F.col("text"))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", rules.pop("words")).withColumn("n_words", F.size("words")).withColumn("n_distinct", F.size(F.array_distinct("words")))
    judged = rows.select(
        "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[F.coalesce(rule, F.lit(False)).cast("long").alias(name) for name, rule in rules.items()])
    judged = stage(judged, name="flags")

    # of each text that occurs again, the least id; null ids come last
    repeated = stage(judged.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"), name="repeated")
    later = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("least")))
    told = judged.join(repeated.hint("merge"), "digest", "left").withColumn("E", F.coalesce(later, F.lit(False)).cast("long"))

    def has(column: str) -> Column:
        return F.max(F.coalesce(F.col(column) == 1, F.lit(False)).cast("long"))

    marks = stage(labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(
        has("quality").alias("good"), has("toxic").alias("toxic")), name="marks")
    flags = told.join(marks.hint("merge"), "id", "left").select(
        "part", *"ABCDE", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return audit(flags, "part", list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})
