"""Line deduplication by a deletion-neighbourhood join.

Two lines match when they are equal or one word edit (a word inserted, deleted
or replaced) apart, words being what white space separates.  Of matching lines
the earliest stays.

Equal lines are found first and collapse to distinct lines.  A distinct line
emits every variant with one word deleted, as a hashed key together with
the position of the deletion:

- two lines that share the variant of one position differ there alone, so all
  members of such a key match each other and the earliest stands for them;
- a line equal to another's variant is that line without a word.

Keys are joined through grouped minima, so no pair within a key is ever
listed.  Each match is verified on the words themselves.  Lines whose first and
second half no other distinct line shares have no neighbour within one edit
and emit nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, in_batches, likely_in, row_key, salted_join, stage
from .words import finish, word_hashes

#: Lines with fewer words are only compared for equality: one edit would be over a fifth of them.
MIN_WORDS_NEAR = 5
#: Lines with fewer words are left alone altogether, unless ``min_words`` says otherwise: op8 and the pipeline take every line with a word.
MIN_WORDS = 3

LINES = "doc_id long, text_key long, line_no int, line binary, halves array<long>"
#: Words of the lines whose variants leave a task together.
VARIANT_WORDS = 20_000


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _short_digest(words: list[bytes]) -> int:
    """64 bits, signed; where two meet by chance a line merely emits variants for nothing."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the halves that a line one edit away must share one of.

    Lines of at most m words, one edit apart, have m - 1 words in common,
    before and after the edit.  So they share the first a or the last m - 1 - a
    words, whatever a is; here it is half of them.  A line doesn't know whether its
    neighbour is longer, so it gives keys for m = n and m = n + 1.
    """
    n, keys = len(words), []
    for m in (n, n + 1):
        a = (m - 1) // 2
        b = m - 1 - a
        keys.append(_short_digest([b"<", str(m).encode(), *words[:a]]))
        keys.append(_short_digest([b">", str(m).encode(), *words[n - b:]]))
    return keys


def _lines(min_words: int, near_words: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    names = ["doc_id", "text_key", "line_no", "line", "halves"]

    def table(rows):
        cols = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for doc, key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                for i, line in enumerate((raw or b"").split(b"\n")):
                    words = line.split()
                    if len(words) < min_words:
                        continue
                    near = len(words) >= near_words
                    rows.append((doc, key, i, _digest(words), half_keys(words) if near else []))
                    size += len(line)
                    if size > 2_000_000:
                        yield table(rows)
                        rows, size = [], 0
            yield table(rows)

    return run


def _chosen_words(min_words: int):
    """The words of the lines of a document that are asked for by number."""
    def run(batches):
        for b in batches:
            out = []
            for wanted, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                lines = (raw or b"").split(b"\n")
                for i in wanted:
                    words = lines[i].split() if i < len(lines) else []
                    if len(words) >= min_words:
                        out.append((_digest(words), b" ".join(words)))
            cols = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], ["line", "words"])

    return run


def variant_keys(words: list[bytes]) -> np.ndarray:
    """128-bit keys, as two columns of signed 64 bits: of the line's n variants with one word deleted, then of the line itself.

    A key is a sum of mixed word hashes, each mixed with its place in the
    variant, so all variants come from running sums in linear time.
    """
    n = len(words)
    halves = []
    for seed in (1, 2):
        h = word_hashes(words, seed)
        place = finish(np.arange(n, dtype=np.uint64) + np.uint64(seed))
        stay = finish(h ^ place)  # words before the deletion keep their place
        moved = finish(h[1:] ^ place[:-1]) if n else h  # those after it move up
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(stay, dtype=np.uint64)])
        after = np.concatenate([np.cumsum(moved[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])
        halves.append(np.append(before[:n] + after[:n], before[n]))
    return np.stack(halves, axis=1).view(np.int64)


def _variants(batches):
    """(line, k1, k2, place): each variant's key with the place of the deletion; -2 marks the whole line."""
    for b in batches:
        texts = [text.split() for text in b.column("words").to_pylist()]
        # so many lines at a time as bound their words, as a line has a variant for each of them
        part = np.cumsum([len(t) for t in texts]) // VARIANT_WORDS
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            some = b.slice(lo, hi - lo)
            keys = [variant_keys(t) for t in texts[lo:hi]]
            counts = [len(k) for k in keys]
            places = np.concatenate([np.append(np.arange(n - 1), -2) for n in counts])
            both = np.concatenate(keys)
            back = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [some.column("line").take(back), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(places.astype(np.int32))],
                ["line", "k1", "k2", "place"])


def _within_one_edit(a: bytes, b: bytes) -> bool:
    x, y = a.split(), b.split()
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)):] == y[i + 1:]


def _verify(batches):
    for b in batches:
        ok = [_within_one_edit(x, y) for x, y in zip(b.column("words").to_pylist(), b.column("other_words").to_pylist())]
        yield b.select(["line", "first"]).filter(pa.array(ok, pa.bool_()))


def occurrence() -> Column:
    """Order of occurrence: by document id (null last), of rows of one id by the hash of their text, then line."""
    return F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_key", F.col("line_no").alias("no"))


def neighbours_wanted(distinct: DataFrame) -> DataFrame:
    """(line, order) of the distinct lines that share a half with another."""
    # a hash stands for the line: where two meet, one more line is asked
    keys = distinct.select(F.xxhash64("line").alias("short"), F.explode("halves").alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    # a common half is split between tasks as a skewed join
    sharing = keys.join(shared.hint("merge"), "half", "left_semi").select("short").distinct()
    return distinct.select("line", "order", F.xxhash64("line").alias("short")).join(sharing, "short", "left_semi").drop("short")


def words_of(asked: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(line, words, order) of lines, from the document in which each occurs first.

    Documents without such a line are passed over before the shuffle.
    """
    per_doc = asked.groupBy(F.col("order.none").alias("none"), F.col("order.id").alias("doc_id"), F.col("order.text_key").alias("text_key")).agg(
        F.collect_set("order.no").alias("wanted"))
    texts = docs.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text_key", "text")
    likely = likely_in(texts, F.col("text_key"), per_doc, F.col("text_key")).where("_likely").drop("_likely")
    # what is asked of documents grows with the corpus, so this is a merge join at any size
    found = in_batches(likely.join(per_doc.hint("merge"), ["none", "doc_id", "text_key"]).select("wanted", "text"), _chosen_words(min_words), "line binary, words binary")
    return found.dropDuplicates(["line"]).join(asked, "line").select("line", "words", "order")


def near_earlier(distinct: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(line, first): each distinct line with the earliest line that a key matches it to, verified.

    ``distinct`` has ``line, order, halves``; ``docs`` has ``doc_id, text_key, text``.
    """
    asked = stage(neighbours_wanted(distinct), name="asked")
    words = stage(words_of(asked, docs, min_words), name="words")

    # only variants that another line (or variant) shares go on
    emitted = in_batches(words.select("line", "words"), _variants, "line binary, k1 long, k2 long, place int")
    shared = emitted.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1")
    live = emitted.join(shared.hint("merge"), "k1", "left_semi")
    live = stage(live.join(words.select("line", "order"), "line").withColumn("key", F.struct("k1", "k2")), name="variants")

    at = live.where("place >= 0")
    # replaced: all lines of a (key, place) match each other
    slots = at.select("line", "order", F.struct("k1", "k2", "place").alias("slot"))
    least = slots.groupBy("slot").agg(F.min(F.struct("order", "line")).alias("least"), F.count("*").alias("n")).where("n > 1")
    replaced = least.select("slot", F.col("least.line").alias("first"), F.col("least.order").alias("first_order"))
    one = salted_join(slots, replaced, "slot", ["line"], how="inner").where("first_order < order").select("line", "first", "first_order")
    # deleted or inserted: the whole line meets the variants of longer ones
    whole = live.where("place = -2").select("key", F.col("line").alias("short"), F.col("order").alias("short_order"))
    grown = at.groupBy("key").agg(F.min(F.struct("order", "line")).alias("long"))
    both = whole.join(grown, "key")
    from_short = both.where("long.order < short_order").select(
        F.col("short").alias("line"), F.col("long.line").alias("first"), F.col("long.order").alias("first_order"))
    earlier = both.select("key", F.col("short").alias("first"), F.col("short_order").alias("first_order"))
    from_long = salted_join(at.select("line", "order", "key"), earlier, "key", ["line"], how="inner").where(
        "first_order < order").select("line", "first", "first_order")
    pairs = one.unionByName(from_short).unionByName(from_long).groupBy("line").agg(F.min(F.struct("first_order", "first")).alias("least"))
    pairs = stage(pairs.select("line", F.col("least.first").alias("first")), name="pairs")

    # words are staged too: a line that many others match is split as a skewed join
    text_of = words.select("line", "words")
    told = pairs.join(text_of, "line")
    other = text_of.select(F.col("line").alias("first"), F.col("words").alias("other_words"))
    return in_batches(told.join(other, "first").select("line", "first", "words", "other_words"),
                      _verify, "line binary, first binary")


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_words_near: int = MIN_WORDS_NEAR,
) -> DataFrame:
    """Find the lines that repeat an earlier one: ``id, text_key, line_no, near``.

    A row is a line to drop: ``near`` is false where an earlier line is equal
    word for word, true where one is a single word edit away.  Lines come in
    the order of their document's id (null last) and their number from 0;
    documents of one id, or of none, in the order of ``text_key``, a hash of
    the text that also tells their rows apart.  A line counts as repeated whether or not the earlier one itself stays.

    Defined cases: a null or empty text has one empty line; lines under
    ``min_words`` are never dropped, those under ``min_words_near`` only if
    equal.  Rows with the same id and text keep the same lines.  An empty
    table gives no rows.  Other columns are not read.

    Scale: lines travel as 16-byte digests.  Equal lines and keys are counted
    before the shuffle and joined back with salted keys.  Only lines that
    share half of themselves with another distinct line fetch their words and
    emit variants, one for each word.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    lines = stage(in_batches(rows, _lines(min_words, min_words_near), LINES), name="lines")
    distinct = stage(lines.withColumn("order", occurrence()).groupBy("line").agg(F.min("order").alias("order"), F.first("halves").alias("halves"), F.count("*").alias("n")), name="distinct")
    near = stage(near_earlier(distinct, rows, min_words), name="near").select("line", F.lit(True).alias("near"))
    verdict = distinct.join(near, "line", "left").where("n > 1 OR near").select(
        "line", F.col("order").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    verdict = stage(verdict, name="verdict")
    # lines that occur once and have no neighbour need no join
    likely = likely_in(lines.select("doc_id", "text_key", "line_no", "line"), F.col("line"), verdict, F.col("line")).where("_likely").drop("_likely")
    told = salted_join(likely, verdict, "line", ["doc_id", "text_key", "line_no"], how="inner").withColumn("order", occurrence())
    dropped = told.where(F.col("near") | (F.col("order") > F.col("first")))
    return dropped.select(
        F.col("doc_id").alias(id_col), "text_key", "line_no", (F.col("order") == F.col("first")).alias("near")).distinct()


def without_lines(
    docs: DataFrame, dropped: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("_n_lines", "_n_dropped"),
) -> DataFrame:
    """``docs`` without the dropped lines, with its columns and two more: its lines and how many of them went, named by ``counts``.

    A null text without dropped lines stays null.  Rows are told apart by id
    and text, so those that share an id, or have none, lose only their own
    lines.  Documents that lose nothing pass straight through; only the others
    are shuffled.  A text is cut in time linear in its lines, however many
    of them go.  Columns may have any names but those of ``counts``.
    """
    if {c.lower() for c in counts} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column named {' or '.join(counts)}")
    per = dropped.groupBy(F.col(id_col).alias("_line_id"), F.col("text_key").alias("_line_key")).agg(F.sort_array(F.collect_set("line_no")).alias("_gone"))
    per = stage(per, name="gone")
    rows = boxed(docs, own_id=F.col(id_col).cast("long"), own_key=row_key(F.col(text_col)))
    known = likely_in(rows, F.col("own_key"), per, F.col("_line_key"))
    text = F.col("row").getField(text_col)
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    n_lines = F.size(parts).cast("long").alias(counts[0])

    # lists of lines grow with the corpus, so this is a merge join at any size
    same = F.col("own_id").eqNullSafe(F.col("_line_id")) & (F.col("own_key") == F.col("_line_key"))
    joined = known.where("_likely").join(per.hint("merge"), same, "left")
    # runs of false up to each dropped line, then true: one flag a line, made once
    runs = F.transform("_gone", lambda no, i: F.concat(
        F.array_repeat(F.lit(False), no - F.when(i > 0, F.get("_gone", i - 1)).otherwise(-1) - 1), F.array(F.lit(True))))
    marked = F.zip_with(parts, F.flatten(runs), lambda line, gone: F.when(~F.coalesce(gone, F.lit(False)), line))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(marked, "\n"))  # nulls are passed over
    touched = joined.select(F.col("row").withField(f"`{text_col}`", kept).alias("row"), n_lines, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(counts[1]))
    clear = known.where("NOT _likely").select("row", n_lines, F.lit(0).cast("long").alias(counts[1]))
    return clear.unionByName(touched).select("row.*", *counts)
