"""Fill-in-the-middle transformation with an index of distinct texts.

A text is cut at two code points into prefix, middle and suffix, which come
back in another order between markers.  Cuts are drawn from a hash of the
document's id; where they lie in the bytes is read off an Elias-Fano list of
the code points' offsets.

Identical texts share one list: texts that occur again are found by hash and
indexed once, each document's text is compared with the indexed one in
full, and the list is joined back to all of them, whose cuts differ.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, likely_in, stage

#: Markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LIST = "n long, size long, low_bits int, low binary, high binary"


class Offsets(NamedTuple):
    """A rising list of ``n`` offsets below ``size`` in Elias-Fano form.

    The lowest ``low_bits`` bits of each offset are packed one after another;
    bit ``(offset >> low_bits) + i`` of ``high`` is set for the i-th.
    """

    n: int
    size: int
    low_bits: int
    low: bytes
    high: bytes

    @classmethod
    def of(cls, offsets: np.ndarray, size: int) -> Offsets:
        n = len(offsets)
        bits = max(0, (size // n).bit_length() - 1) if n else 0
        high = np.zeros(n + (size >> bits) + 1, np.uint8)
        high[(offsets >> bits) + np.arange(n)] = 1
        low = (offsets[:, None] >> np.arange(bits)) & 1
        return cls(n, size, bits, np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def select(self, i: int) -> int:
        """The i-th offset; the size behind the last."""
        if i >= self.n:
            return self.size
        filled = np.bitwise_count(np.frombuffer(self.high, np.uint8)).cumsum(dtype=np.int64)
        byte = int(np.searchsorted(filled, i + 1))
        left = i - (int(filled[byte - 1]) if byte else 0)
        bit = [b for b in range(8) if self.high[byte] >> b & 1][left]
        top = 8 * byte + bit - i
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first // 8:(last + 7) // 8], "little") >> first % 8
        return top << self.low_bits | low & ((1 << self.low_bits) - 1)


def boundaries(text: bytes) -> Offsets:
    """Where each code point of UTF-8 text begins: bytes that continue none."""
    data = np.frombuffer(text, np.uint8)
    return Offsets.of(np.flatnonzero((data & 0xC0) != 0x80), len(text))


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    if form == "spm":
        return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return prefix + middle + suffix


def restore(form: str, output: bytes) -> bytes:
    """The text from output and form alone.

    Texts that hold a marker are never cut, and no marker can begin within
    another's end, so the first marker found is the one that was put there.
    """
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    first, rest = output[3:].split(second, 1)
    other, middle = rest.split(MIDDLE, 1)
    return first + middle + other if form == "psm" else other + middle + first


def _lists(batches):
    for b in batches:
        rows = [boundaries(x) for x in b.column("text").cast(pa.binary()).to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("text").cast(pa.binary()), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            ["key", "text", "n", "size", "low_bits", "low", "high"])


def _cut(plain_from: int, spm_below: int):
    def one(text: bytes, known: Offsets | None, h: tuple[int, int, int, int]):
        at = known or boundaries(text)
        x, y = sorted((h[0] % (at.n + 1), h[1] % (at.n + 1)))
        marked = PREFIX in text or SUFFIX in text or MIDDLE in text
        if not text or marked or h[2] % 100 >= plain_from:
            return at.n, "plain", None, None, text, text
        form = "spm" if h[3] % 100 < spm_below else "psm"
        a, z = at.select(x), at.select(y)
        output = arrange(form, text[:a], text[a:z], text[z:])
        return at.n, form, x, y - x, output, restore(form, output)

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            listed = zip(*(b.column(c).to_pylist() for c in ("n", "size", "low_bits", "low", "high")))
            hashes = zip(*(b.column(f"h{i}").to_pylist() for i in (1, 2, 3, 4)))
            rows = [one(t, Offsets(*k) if k[0] is not None else None, h) for t, k, h in zip(texts, listed, hashes)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])

    return run


def seeded(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the seed and the id in decimal."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def text_index(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """(key, text, n, size, low_bits, low, high): one text of each repeated key with its list of boundaries.

    Of a key, tasks choose a text each before the shuffle.  Where two texts
    share a hash only one is indexed; the other's documents make their own.
    """
    again = likely_in(rows.select("key", "text"), F.col("key"), repeats, F.col("key")).where("_likely")
    chosen = again.groupBy("key").agg(F.first("text").alias("text"))
    return stage(in_batches(chosen, _lists, f"key long, text binary, {LIST}"), name="texts")


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    plain_from: int = 90,
    spm_below: int = 20,
) -> DataFrame:
    """Cut every document: ``id, n, form, prefix_chars, middle_chars, output, restored``.

    ``n`` counts code points.  ``form`` is ``psm`` (prefix, suffix, middle),
    ``spm`` (suffix first) or ``plain`` (left as it is: an empty text, one
    that holds a marker, and by chance ``100 - plain_from`` in a hundred);
    of the cut ones, ``spm_below`` in a hundred are ``spm``.
    ``prefix_chars`` and ``middle_chars`` are null if plain.  ``restored`` is
    the text rebuilt from ``output`` and ``form``.

    Defined cases: a null text is empty and plain; a null id draws as one
    named ``null``; rows of one id draw the same numbers, which cut texts of
    different lengths at different places; repeated rows come back each; an
    empty table gives no rows.  Bytes that are no UTF-8 are kept as they are.
    Other columns are not read.

    Scale: a digest of texts is counted before the shuffle.  Documents whose
    text occurs once (all that a filter of bounded size clears) are cut where
    they are read; only the others shuffle, to the one row of their text, as a
    join that splits hot keys.  Texts are compared there in full.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    repeats = stage(rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key"), name="repeats")
    known = likely_in(rows, F.col("key"), repeats, F.col("key"))
    index = text_index(rows, repeats)

    names = ["n", "size", "low_bits", "low", "high"]
    listed = index.select("key", F.col("text").alias("indexed"), *names)
    same = F.col("text").cast("binary") == F.col("indexed")
    shared = known.where("_likely").join(listed.hint("merge"), "key", "left").select(
        "id", "text", *[F.when(same, F.col(c)).alias(c) for c in names])
    alone = known.where("NOT _likely").select("id", "text", *[F.lit(None).cast(f.dataType).alias(f.name) for f in listed.schema if f.name in names])
    asked = shared.unionByName(alone).select("*", *seeded(F.col("id"), seed))
    cut = in_batches(asked, _cut(plain_from, spm_below), "id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary")
    return cut.select(
        F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"),
        F.col("restored").cast("string").alias("restored"))
