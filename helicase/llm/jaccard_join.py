"""N-gram Jaccard join with several global token orders.

Two documents link when the Jaccard similarity of their sets of word n-grams
reaches a threshold.  Then each has nearly all its n-grams in common with
another document, and under any order of all n-grams the two share one of the
first few (the prefix filter).  The steps:

1.  Count for every document the n-grams that no other document has.  A
    document with too many of them links with nothing and is done.  N-grams
    travel in compact blocks, one entry for each task batch that has them.
2.  Documents with equal sets become one; the count is repeated among them.
3.  The rest are sorted by several global orders (rare n-grams first, ties by
    a different hash each).  Candidates share an n-gram of their prefixes under
    every order.
4.  Candidates are verified on their whole sets.  In each prefix group all
    members meet the group's most typical member first.  What is then in
    different components is compared only where the differences already known
    leave room for a link; large groups are split by those differences first,
    so copies of one text are not expanded into pairs.
5.  Connected components of the verified links.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, components, in_batches, row_key, salted_join, shuffle_partitions, stage, without_rows
from .words import shingles

#: Seeds of the global orders.
ORDERS = (1, 2, 3)
#: A batch of documents ends at so many of them, or so many n-grams.
BATCH_DOCS = 20_000
BATCH_GRAMS = 1_500_000
#: Members of a prefix group that are compared pair by pair; a larger group is split first.
PAIRED = 48
#: The same for groups that have been split, whose members bounds tell apart better.
PAIRED_SPLIT = 512
#: How often groups are split; what is large even then is compared pair by pair.
SPLITS = 12
#: Blocks for each shuffle partition.
BLOCKS_EACH = 4
MANY = 65_535

ROWS = "block int, batch long, kind int, payload binary"
COUNTED = "doc_id long, text_key long, digest binary, n int, uniques int"


def _digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(struct.pack("<q", len(grams)) + grams.tobytes())


def _from_text(size: int):
    """(id, key, digest, n-grams) of documents given as (id, key, text)."""
    def read(batches):
        for b in batches:
            for i, key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                grams = shingles((raw or b"").lower().split(), size)
                yield i, key, _digest(grams), grams

    return read


def _from_sets(batches):
    """The same of stored sets (id, key, digest, n-grams)."""
    for b in batches:
        values, ends = b.column(3).values.to_numpy(), b.column(3).offsets.to_numpy()
        for k, (i, text_key, digest) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)))):
            yield i, text_key, digest, values[ends[k]:ends[k + 1]].view(np.uint64)


def _to_blocks(read, blocks: int):
    """Documents to rows: per batch and block the n-grams there (kind 0), per batch its documents (kind 1)."""
    def run(batches):
        from pyspark import TaskContext

        batch = TaskContext.get().partitionId() << 24
        docs, held, size = [], [], 0

        def flush():
            counts = np.array([len(g) for g in held])
            grams = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), counts)
            block = ((grams >> np.uint64(32)) % np.uint64(blocks)).astype(np.uint32)
            low = grams.astype(np.uint32)
            order = np.lexsort((low, block))
            block, low, owner = block[order], low[order], owner[order]
            # one entry for an n-gram of the batch: its owner, or MANY
            first = np.ones(len(low), bool)
            first[1:] = (low[1:] != low[:-1]) | (block[1:] != block[:-1])
            last = np.append(first[1:], True) if len(first) else first
            owner = np.where(first & last, owner, np.uint16(MANY))[first]
            block, low = block[first], low[first]
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(block)]):
                keys = np.ascontiguousarray(low[lo:hi].astype("<u4"))
                planes = keys.view(np.uint8).reshape(-1, 4).T.tobytes()  # equal bytes side by side compress
                rows.append((int(block[lo]), batch, 0, planes + owner[lo:hi].astype("<u2").tobytes()))
            ids = np.array([0 if i is None else i for i, _, _ in docs], "<i8").tobytes()
            keys = np.array([k for _, k, _ in docs], "<i8").tobytes()
            none = bytes(i is None for i, _, _ in docs)
            rows.append((batch % blocks, batch, 1, ids + keys + none + counts.astype("<u4").tobytes() + b"".join(d for _, _, d in docs)))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["block", "batch", "kind", "payload"])

        for i, key, digest, grams in read(batches):
            docs.append((i, key, digest))
            held.append(grams)
            size += len(grams)
            if size >= BATCH_GRAMS or len(docs) >= BATCH_DOCS:
                yield flush()
                docs, held, size, batch = [], [], 0, batch + 1
        if docs:
            yield flush()

    return run


def _count_in_blocks(batches):
    """Sorted by block: per block and batch, how many n-grams each document has alone (kind 2); documents pass."""
    block, held = None, []

    def done():
        keys, owners, whose = [], [], []
        for k, (_, payload) in enumerate(held):
            n = len(payload) // 6
            keys.append(np.frombuffer(payload, np.uint8, 4 * n).reshape(4, n).T.copy().view("<u4").ravel())
            owners.append(np.frombuffer(payload, "<u2", n, 4 * n))
            whose.append(np.full(n, k, np.int32))
        key, owner, who = np.concatenate(keys), np.concatenate(owners), np.concatenate(whose)
        order = np.argsort(key, kind="stable")
        key, owner, who = key[order], owner[order], who[order]
        alone = np.ones(len(key), bool)
        same = key[1:] == key[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        alone &= owner != MANY
        slot, count = np.unique(who[alone].astype(np.int64) << 16 | owner[alone], return_counts=True)
        cuts = np.searchsorted(slot >> 16, np.arange(len(held) + 1))
        rows = []
        for k, (batch, _) in enumerate(held):
            lo, hi = cuts[k], cuts[k + 1]
            if hi > lo:
                rows.append((batch, (slot[lo:hi] & 0xFFFF).astype("<u2").tobytes() + count[lo:hi].astype("<u4").tobytes()))
        return table([(block, b, 2, p) for b, p in rows])

    def table(rows):
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["block", "batch", "kind", "payload"])

    for b in batches:
        passed = []
        for k, batch, kind, payload in zip(*(b.column(i).to_pylist() for i in range(4))):
            if kind == 1:
                passed.append((k, batch, kind, payload))
                continue
            if k != block:
                if held:
                    yield done()
                block, held = k, []
            held.append((batch, payload))
        if passed:
            yield table(passed)
    if held:
        yield done()


def _gather(batches):
    """Sorted by batch and kind: each document with the number of n-grams it has alone."""
    batch, docs, uniques = None, None, None

    def done():
        n = len(docs) // 37
        ids = np.frombuffer(docs, "<i8", n)
        keys = np.frombuffer(docs, "<i8", n, 8 * n)
        none = np.frombuffer(docs, "u1", n, 16 * n).astype(bool)
        counts = np.frombuffer(docs, "<u4", n, 17 * n).astype(np.int32)
        digests = [docs[21 * n + 16 * i:21 * n + 16 * i + 16] for i in range(n)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=none), pa.array(keys), pa.array(digests, pa.binary()), pa.array(counts), pa.array(uniques[:n].astype(np.int32))],
            ["doc_id", "text_key", "digest", "n", "uniques"])

    for b in batches:
        for k, kind, payload in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            if k != batch:
                if docs is not None:
                    yield done()
                batch, docs, uniques = k, None, None
            if kind == 1:
                docs, uniques = payload, np.zeros(MANY + 1, np.int64)
            else:
                n = len(payload) // 6
                uniques[np.frombuffer(payload, "<u2", n)] += np.frombuffer(payload, "<u4", n, 2 * n)
    if docs is not None:
        yield done()


def count_uniques(rows: DataFrame, read, *, name: str) -> DataFrame:
    """(doc_id, digest, n, uniques) of each document: the size of its set and how many n-grams no other document has.

    A block that hash bits name holds its n-grams of all batches.  An n-gram
    counts once for a batch, so a common one brings no more entries than there
    are batches.  Chance meetings within a block only lower ``uniques``.
    """
    parts = shuffle_partitions(rows.sparkSession)
    blocks = parts * BLOCKS_EACH
    sent = in_batches(rows, _to_blocks(read, blocks), ROWS)
    counted = in_batches(sent.repartition(parts, "block").sortWithinPartitions("block"), _count_in_blocks, ROWS)
    return stage(in_batches(counted.repartition(parts, "batch").sortWithinPartitions("batch", "kind"), _gather, COUNTED), name=name)


def parities(grams: np.ndarray) -> list[int]:
    """256 bits: whether the set has an odd number of n-grams in each of 256 hash classes.

    Two sets differ in at least as many n-grams as these bits differ.
    """
    at = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    odd = np.bincount(at.astype(np.int64), minlength=256).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8").tolist()


def _keep_sets(size: int):
    """(digest, n, grams, mark) of the documents whose digest is the wanted one."""
    def run(batches):
        for b in batches:
            rows = []
            for raw, wanted in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                grams = shingles((raw or b"").lower().split(), size)
                if _digest(grams) == wanted:
                    rows.append((wanted, len(grams), grams.view(np.int64), parities(grams)))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["digest", "n", "grams", "mark"])

    return run


def may_link(percent: int, n_x: Column, n_y: Column, apart: Column) -> Column:
    """Whether sets of these sizes that differ in at least ``apart`` n-grams can reach the threshold."""
    sizes = (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y))
    return sizes & ((100 + percent) * apart <= (100 - percent) * (n_x + n_y))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (x, y, wide) with sizes and whether they link; wide ones also with the n-grams ``d`` that one of the two has alone.

    Whole sets meet only where the prefixes of the further orders share an
    n-gram too, or the pair is wide.  Pairs are staged and joined to the sets
    twice; those of a hub are split as a skewed join.
    """
    pairs = stage(pairs, name="pairs")
    side = sets.select("digest", "n", "grams", "prefix_2", "prefix_3")

    def of(s: str) -> DataFrame:
        return side.select(F.col("digest").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in side.columns[1:]])

    known = pairs.join(of("x"), "x").join(of("y"), "y")
    agreed = F.arrays_overlap("prefix_2_x", "prefix_2_y") & F.arrays_overlap("prefix_3_x", "prefix_3_y")
    both = F.when(F.col("agreed"), F.size(F.array_intersect("grams_x", "grams_y"))).otherwise(0)
    apart = F.concat(F.array_except("grams_x", "grams_y"), F.array_except("grams_y", "grams_x"))
    return known.withColumn("agreed", agreed).where("agreed OR wide").select(
        "x", "y", "n_x", "n_y", (100 * both >= percent * (F.col("n_x") + F.col("n_y") - both)).alias("linked"), F.when(F.col("wide"), apart).alias("d"))


def prefixed(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` with the n-grams of its prefix under each order that other sets have too."""
    rows = sets.select("digest", F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1")
    # n-grams of one set alone come first under every order and match nothing
    shared = salted_join(rows, often, "gram", ["digest"], how="inner")
    per = shared.groupBy("digest").agg(F.collect_list(F.struct(F.floor(F.log2("often")).alias("band"), "gram")).alias("tokens"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    room = F.greatest(length - (F.col("n") - F.size("tokens")), F.lit(0)).cast("int")

    def first(seed: int) -> Column:
        ranked = F.array_sort(F.transform("tokens", lambda t: F.struct(t["band"], F.xxhash64(t["gram"], F.lit(seed)).alias("mix"), t["gram"].alias("gram"))))
        return F.transform(F.slice(ranked, F.lit(1), room), lambda t: t["gram"])

    out = sets.join(per, "digest")
    for seed in ORDERS:
        out = out.withColumn(f"prefix_{seed}", first(seed))
    return stage(out.drop("tokens").where(F.size("prefix_1") > 0), name="prefixed")


def star_pairs(groups: DataFrame, first: str, *, wide: Column, percent: int) -> DataFrame:
    """In each group, pairs of its hub, the member with the least ``first``, and every other: (x, y, wide).

    Of groups that aren't wide, only pairs that may link.
    """
    hub = groups.groupBy("key").agg(F.min(F.struct(F.col(first).alias("first"), "n", "digest", "uniques")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    # staged, so that a large group is split as a skewed join
    met = groups.join(stage(hub, name="hubs"), "key").where("hub.digest <> digest").withColumn("wide", wide)
    met = met.where(F.col("wide") | may_link(percent, F.col("n"), F.col("hub.n"), F.col("uniques") + F.col("hub.uniques")))
    return met.groupBy(F.col("digest").alias("x"), F.col("hub.digest").alias("y")).agg(F.max("wide").alias("wide"))


def pairs_within(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one group in different components that their sizes, lone n-grams and parities leave room for."""
    def side(s: str) -> DataFrame:
        return groups.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("digest", "n", "uniques", "mark", "joined", "own", "width", "label")])

    marked = sum((F.bit_count(F.col("mark_x")[i].bitwiseXOR(F.col("mark_y")[i])) for i in range(4)), F.lit(0))
    # what a set has alone is in its own difference from the hub only; of the rest no more than the smaller number can agree
    rest = F.abs(F.col("width_x") - F.col("uniques_x") - F.col("width_y") + F.col("uniques_y"))
    apart = F.greatest(marked, F.col("uniques_x") + F.col("uniques_y") + F.coalesce(rest, F.lit(0)))
    met = (F.col("own_x") & F.col("own_y")) | F.col("joined_x") | F.col("joined_y")
    pairs = side("x").join(side("y"), "key").where(
        (F.col("digest_x") < F.col("digest_y")) & (F.col("label_x") != F.col("label_y")) & met & ~(F.col("joined_x") & F.col("joined_y"))
        & may_link(percent, F.col("n_x"), F.col("n_y"), apart))
    return pairs.select(F.col("digest_x").alias("x"), F.col("digest_y").alias("y"), F.lit(False).alias("wide")).distinct()


def split_groups(members: DataFrame, percent: int) -> DataFrame:
    """Groups of the members of a hub by what they differ from it in: (key, digest, width, joined, own).

    ``members`` has ``hub, n_hub, digest, n, joined, d``; ``joined`` tells
    whether the member links with the hub, ``d`` holds the n-grams that only
    one of the two has.  Members x and y differ in |d_x| + |d_y| - 2 |d_x & d_y|
    n-grams, so a link needs a number of common ones that grows with their
    distance from the hub, and a prefix filter on ``d`` finds them.  What all
    copies of a text share is in no ``d``.  Two that both link with the hub
    need no pair; two that don't meet only where both are ``own``, as a
    longer prefix of one that doesn't is there for those that do.
    """
    width = F.size("d")
    told = members.select("hub", "digest", "n", "n_hub", "joined", width.alias("width"))
    tokens = members.select("hub", "digest", F.explode("d").alias("gram")).select("hub", "digest", F.xxhash64("hub", "gram").alias("key"))
    often = tokens.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    shared = salted_join(tokens, often, "key", ["digest"], how="inner")
    per = shared.groupBy("hub", "digest").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("tokens"))
    # the least number of common n-grams, with a partner that doesn't link with the hub, or one that does
    apart = ((100 + percent) * F.col("width") - (100 - percent) * (F.col("n") - F.col("n_hub"))) / (2 * (100 + percent))
    largest = F.least(F.floor(100 * F.least("n", "n_hub") / percent), F.coalesce("n_joined", F.lit(0)))
    beside = ((100 + percent) * F.col("width") - (100 - percent) * (F.col("n") + largest)) / (100 + percent)

    def room(common: Column) -> Column:
        return F.greatest(F.size("tokens") - F.greatest(F.lit(1), F.ceil(common)) + 1, F.lit(0)).cast("int")

    joined = members.where("joined").groupBy("hub").agg(F.max("n").alias("n_joined"))
    near = salted_join(told, joined, "hub", ["digest"]).join(per, ["hub", "digest"])
    near = near.withColumn("inner", room(apart)).withColumn("outer", F.when(F.col("joined"), F.col("inner")).otherwise(room(F.least(apart, beside))))
    rows = near.select(F.posexplode(F.slice("tokens", F.lit(1), F.col("outer"))).alias("at", "t"), "digest", "width", "joined", "inner")
    return rows.select("t.key", "digest", "width", "joined", (F.col("at") < F.col("inner")).alias("own"))


def link_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Components (node, label) of the links between ``sets`` (as :func:`prefixed` gives them), by candidates that share prefix n-grams.

    First all members of a prefix group meet its hub.  Of groups that still
    hold several components, small ones are compared pair by pair, where
    bounds leave room; large ones are split by what their members differ from
    the hub in, and the same again.  So a group of m copies makes m pairs
    with each of its hubs, not m squared.
    """
    about = sets.select("digest", "n", "uniques", "mark")
    groups = stage(about.join(sets.select("digest", F.explode("prefix_1").alias("key")), "digest"), name="groups")
    told = stage(verify(star_pairs(groups, "uniques", wide=F.col("members") > PAIRED, percent=percent), sets, percent), name="verified")
    labels = stage(components(told.where("linked"), src="x", dst="y"), name="labels")
    # further links come on top of these components, which are enough to tell what is still open
    known = labels.select(F.col("node").alias("x"), F.col("label").alias("y"))
    links = known.limit(0)
    groups = groups.select("*", F.lit(False).alias("joined"), F.lit(True).alias("own"), F.lit(None).cast("int").alias("width"))
    for split in range(SPLITS + 1):
        last = split == SPLITS
        members = groups.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        members = stage(members, name="members")
        held = members.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        held = stage(held.select("key", (F.lit(not last) & (F.col("members") > (PAIRED_SPLIT if split else PAIRED))).alias("large")), name="held")
        opened = stage(members.join(held, "key"), name="open")
        pairs = pairs_within(opened.where("NOT large"), percent)
        if split:
            pairs = pairs.unionByName(star_pairs(opened.where("large"), "width", wide=F.lit(True), percent=percent))
        more = stage(verify(pairs, sets, percent), name="verified")
        told = more if split else told.unionByName(more)
        links = links.unionByName(more.where("linked").select("x", "y"))
        near = told.where("d IS NOT NULL").select(
            F.col("y").alias("hub"), F.col("n_y").alias("n_hub"), F.col("x").alias("digest"), F.col("n_x").alias("n"), F.col("linked").alias("joined"), "d")
        place = near.select("hub", "digest", "joined").join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        active = place.groupBy("hub").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("joined").alias("all_joined")).where(
            "a <> b AND NOT all_joined").select("hub")
        active = stage(active, name="active")
        if last or active.isEmpty():
            return labels if links.isEmpty() else stage(components(known.unionByName(links), src="x", dst="y"), name="labels")
        near = stage(near.join(active, "hub"), name="near")
        groups = stage(split_groups(near, percent).join(about, "digest"), name="groups")
    return labels


def jaccard_components(
    docs: DataFrame,
    *,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Group documents by links of Jaccard similarity ``percent`` / 100 or more.

    Returns one row per document: ``id, n_shingles, component_id, text_key,
    leads``; ``leads`` marks the document of each component that
    :func:`first_of_each` keeps, told from others of its id by ``text_key``.  A
    document's set is its distinct word ``size``-grams, A-Z lower-cased, or
    its whole sequence of words if that is shorter.  ``component_id`` is the
    smallest id that links reach, its own included.

    Defined cases: a null text, or one without words, has an empty set and
    links with nothing.  A null id is never the smallest; a component of null
    ids alone has none.  Rows of one id count each with their own text.
    Repeated rows get one component.  An empty table gives no rows.  Other
    columns are not read.

    Scale: every step is a shuffle on hashes; hot keys are salted, or split by
    Spark as skewed joins between staged tables, so that plans stay short and
    the driver has little to hold.  Nothing is collected but a few sums.  Documents are read twice: for their
    n-grams, and once more for those of a document per set that survives
    step 1.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    counted = count_uniques(rows, _from_text(size), name="counted").withColumn(
        "copied", (F.col("n") > 0) & (100 * (F.col("n") - F.col("uniques")) >= percent * F.col("n")))
    copied = counted.where("copied")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_key")

    # one document stands for each distinct set; its n-grams are fetched
    stand = copied.groupBy("digest").agg(F.min(place).alias("place")).select("digest", "place.*")
    placed = rows.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("none"), "text_key", "text")
    sets = stage(in_batches(placed.join(stand, ["id", "none", "text_key"]).select("text", "digest"),
        _keep_sets(size), "digest binary, n int, grams array<long>, mark array<long>").dropDuplicates(["digest"]), name="sets")
    again = count_uniques(sets.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("text_key"), "digest", "grams"), _from_sets, name="recounted")
    near = again.where(100 * (F.col("n") - F.col("uniques")) >= percent * F.col("n")).select("digest", "uniques")
    labels = link_sets(prefixed(sets.join(near, "digest"), percent), percent)

    # copies of one text, and members of one component, are split as skewed joins
    members = copied.select("doc_id", "text_key", "n", "digest").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    members = stage(members.select("doc_id", "text_key", "n", F.coalesce("label", "digest").alias("label")), name="labelled")
    least = stage(members.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(place).alias("lead")), name="least")
    joined = members.join(least, "label").select(
        "doc_id", "n", "component_id", "text_key", (place == F.col("lead")).alias("leads"))
    alone = counted.where("NOT copied").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_key", F.lit(True).alias("leads"))
    return joined.unionByName(alone).select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id", "text_key", "leads")


def first_of_each(docs: DataFrame, grouped: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with its columns: that of the smallest id (null last), of those the least hash of the text.

    Documents without words stay, all of them.  Of rows that agree in id and
    text one stays.
    """
    key = row_key(F.col(text_col))
    gone = grouped.where("NOT leads").select(F.col(id_col).cast("long").alias("_id"), F.col("text_key").alias("_key")).distinct()
    left = without_rows(docs, stage(gone, name="gone"), id_col, key)
    repeated = grouped.where("leads AND n_shingles > 0").groupBy(F.col(id_col).cast("long").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.count("*").alias("n")).where("n > 1")
    repeated = stage(repeated, name="repeated")
    if repeated.isEmpty():
        return left
    kept = without_rows(left, repeated, id_col, key)
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_key") == F.col("_key"))
    rows = boxed(left, own_id=F.col(id_col).cast("long"), own_key=key)
    once = rows.join(repeated.select("_id", "_key"), same).dropDuplicates(["_id", "_key"]).select("row.*")
    return kept.unionByName(once)
