"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is ``e`` whole sizes and a remainder gives every
document ``e`` times (complete epochs) and then whole documents in the order
of their exponential keys ``-ln(u) / weight`` until the remainder is met.

Everything is DataFrame operations.  No source is ever sorted in one task:
keys are dealt into ranges, range sums are added up per source, and only the
one range in which a source's budget ends is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, row_key, salted_join, stage

#: Characters that clean prose seldom has; they lower a document's weight.
NOISE = "#*$%&|<>{}[]~^=_\\"
#: Ranges of keys in each unit of their natural logarithm.
RANGES = 1024


def n_words(text: Column) -> Column:
    """Words are runs without space, tab, line feed, vertical tab, form feed, return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def prose_weight(text: Column) -> Column:
    """Quality weight in (0, 1]: how little of the text is markup-like noise."""
    kept = F.length(F.translate(text, NOISE, ""))
    share = kept / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(share * share * share * share, F.lit(0.05)), F.lit(1.0)).cast("double")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: list[float], budget: float, max_epochs: float) -> DataFrame:
    """Water-filling over one row per source: (source, source_size, target).

    Weights go round the sources by code point, null last.  A source is full
    at ``max_epochs`` sizes; what it can't take is shared by the others'
    weights.  The windows below run over sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(order)).select(
        "source", "source_size", F.get(table, F.pmod(F.col("rank") - 1, F.lit(len(weights)))).alias("w"),
    )
    # in the order in which sources fill up, a source is full if the level
    # that its successors would share reaches its own
    cap = F.col("source_size") * float(max_epochs)
    filling = Window.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(everything) * float(budget)
         - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(max_epochs)).alias("left"),
        F.sum("w").over(onward).alias("w_left"),
    ).withColumn("full", cap * F.col("w_left") <= F.col("left") * F.col("w"))
    # the first source that doesn't fill up sets the level for all after it
    level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") * float(max_epochs) / F.col("w"), "left", "w_left"))).over(everything)
    return levels.select(
        "source", "source_size",
        F.when(F.col("full"), cap).otherwise(F.col("w") * level["left"] / level["w_left"]).cast("double").alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: list[float] | None = None,
    budget: float = 1.5,
    max_epochs: float = 2.0,
    quality=prose_weight,
    seed: int = 17,
    ranges: int = RANGES,
) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per document: ``id, source, size, source_size, target,
    copies, taken, row_key`` with ``size`` in words, ``target`` the words wanted from
    its source and ``taken = copies * size``; ``row_key``, a hash of text and source, tells
    rows of one id apart.  A source's taken words differ
    from its target by at most half the document at which its budget ends.

    Defined cases: a null or empty text has size 0; null sources are one
    source, last in the order; an empty table gives no rows.  A null id is a
    key like any other.  Rows that agree in id have equal keys and are
    ordered by size; rows that also agree in size are interchangeable.  Other
    columns are not read.

    Scale: texts are read once, for a digest of ids and sizes.  Documents
    meet their source's row through salted keys.  Only the range of keys
    where a source's budget ends is sorted.  Ranges are cut along the
    logarithm of the keys, where the density of an exponential variable is at
    most 1/e whatever its weight, so about 1/(e * ``ranges``) of a source's
    documents is the most that a range holds.
    """
    weights = weights or [5.0, 2.0, 1.0]
    u = uniform(F.col(id_col), seed)
    digest = stage(docs.select(
        F.col(id_col).alias("id"), row_key(F.col(text_col), F.col(source_col)).alias("row_key"), F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"), quality(F.col(text_col)).alias("weight"), u.alias("u"),
    ), name="sizes").select(
        "id", "row_key", "source", "size", (-F.log("u") / F.col("weight")).alias("key"),
        F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit(""))).alias("skey"),
    ).withColumn("part", F.floor((F.ln(F.greatest("key", F.lit(1e-300))) + 700) * ranges).cast("int"))

    sums = stage(digest.groupBy("source", "skey", "part").agg(F.sum("size").alias("words")), name="ranges")
    targets = source_targets(
        sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    targets = stage(targets.select(
        F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit(""))).alias("skey"),
        "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), name="targets")

    # the range in which the rest of a source's budget ends
    along = Window.partitionBy("skey").orderBy("part")
    cut = (
        sums.join(targets.select("skey", "rest"), "skey")
        .withColumn("upto", F.sum("words").over(along))
        .where("rest > 0 AND upto - words <= rest AND upto > rest")
        .groupBy("skey").agg(
            F.min("part").alias("cut"),
            F.min_by(F.col("upto") - F.col("words"), "part").alias("before"),
        )
    )
    plan = targets.join(cut, "skey", "left")
    known = salted_join(digest, plan, "skey", ["id", "size"])
    within = F.col("part") == F.col("cut")
    base = ["id", "row_key", "source", "size", "source_size", "target", "epochs"]
    # without a cut the rest covers nothing (0) or, by rounding, everything
    early = F.when(F.col("part") < F.coalesce("cut", F.when(F.col("rest") > 0, F.lit(2**31 - 1)).otherwise(F.lit(-1))), 1).otherwise(0)
    clear = known.where(~F.coalesce(within, F.lit(False))).select(*base, early.alias("more"))
    inside = Window.partitionBy("skey").orderBy("key", "id", "size")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a document is taken if stopping after it is nearer than stopping before it
    edge = known.where(within).withColumn("upto", F.col("before") + upto).select(
        *base, F.when(F.col("upto") * 2 - F.col("size") <= F.col("rest") * 2, 1).otherwise(0).alias("more"))
    return clear.unionByName(edge).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("epochs") + F.col("more")).alias("copies"),
        ((F.col("epochs") + F.col("more")) * F.col("size")).alias("taken"), "row_key",
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; its columns are kept.

    Rows of one id, or of none, are told apart by text and source.  Rows that
    agree in all three come as often as the mix takes them together, all as
    one of them.  Rows that ``mixed`` lacks are dropped.
    """
    plan = mixed.groupBy(F.col(id_col).alias("_id"), F.col("row_key").alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    rows = boxed(docs, own_id=F.col(id_col), own_key=row_key(F.col(text_col), F.col(source_col)))
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_key") == F.col("_key"))
    joined = rows.join(stage(plan, name="copies"), same)
    once = joined.where("_rows = 1").unionByName(joined.where("_rows > 1").dropDuplicates(["_id", "_key"]))
    often = once.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return often.select("row.*")
