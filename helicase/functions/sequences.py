"""Scalar functions on gapped sequences, all plain Column expressions.

A gapped sequence holds letters and ``-``; lower case marks repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits within which the regression models were trained (fixed values).
MIN_LENGTH, MAX_LENGTH, MIN_SHARE, MAX_SHARE = 50, 400, 0.25, 0.75


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` evaluated once, however often ``of`` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``."""
    # replacing goes through bytes, translating through a map of characters
    rest = seq
    for x in letters:
        rest = F.replace(rest, F.lit(x))
    return F.length(seq) - F.length(rest)


def ungapped(seq: Column) -> Column:
    return F.replace(F.replace(seq, F.lit("-")), F.lit("."))


def as_rna(seq: Column) -> Column:
    """Upper case with U for T."""
    return F.replace(F.upper(seq), F.lit("T"), F.lit("U"))


def as_dna(seq: Column) -> Column:
    return F.replace(F.upper(seq), F.lit("U"), F.lit("T"))


def reverse_complement_rna(seq: Column) -> Column:
    """Upper-case letters only; A pairs with U."""
    return F.reverse(F.translate(seq, "ACGTU", "UGCAA"))


def reverse_complement_dna(seq: Column) -> Column:
    """Both cases; A pairs with T."""
    return F.reverse(F.translate(seq, "AGCTUagctu", "TCGAAtcgaa"))


def flip_strand(strand: Column) -> Column:
    return F.when(strand == "+", "-").otherwise("+")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many places as SQL rounds doubles: by the product in binary, where ``F.round`` goes by the decimal text."""
    return F.round(x * 10.0**places) / 10.0**places


def gc_share(seq: Column) -> Column:
    """Share of G and C among the letters that aren't gaps."""
    s = F.upper(ungapped(seq))
    return ratio(count_of(s, "GC"), F.length(s))


def masked_share(seq: Column, n_cols: Column) -> Column:
    """Share of lower-case letters among all columns."""
    return ratio(F.length(F.regexp_replace(seq, "[^a-z]", "")), n_cols)


def gap_share_against(reference: Column, seq: Column) -> Column:
    """Gaps of either sequence against the other, after common gaps are removed, as a share of the columns left."""
    a, b = F.split(reference, ""), F.split(seq, "")
    kind = F.zip_with(a, b, lambda x, y: F.when((x == "-") & (y == "-"), 0).when((x == "-") | (y == "-"), 2).otherwise(1))
    return let(kind, lambda kinds: ratio(F.size(F.filter(kinds, lambda k: k == 2)), F.size(F.filter(kinds, lambda k: k > 0))))


def gap_share(seq: Column, n_cols: Column) -> Column:
    return ratio(count_of(seq, "-"), n_cols)


def range_code(seq: Column) -> Column:
    """0 in range; 1 by length (or empty); 2 by base composition; 3 by both."""
    out_of = lambda x: (x < MIN_SHARE) | (x > MAX_SHARE)

    def code(k: Column) -> Column:
        n, a, c, g, u = (k[x] for x in "nacgu")
        by_length = (n < MIN_LENGTH) | (n > MAX_LENGTH)
        by_bases = out_of(ratio(g + c, a + c + g + u)) | out_of(ratio(a, a + u)) | out_of(ratio(c, c + g))
        return F.when(n == 0, 1).otherwise(by_length.cast("int") + 2 * by_bases.cast("int"))

    counts = lambda s: F.struct(F.length(s).alias("n"), *[count_of(s, x).alias(x.lower()) for x in "ACGU"])
    return let(let(as_rna(ungapped(seq)), counts), code)


def dinucleotide_pairs(seq: Column) -> Column:
    """Overlapping pairs of letters of an ungapped sequence."""
    letters = F.split(seq, "")
    pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.greatest(F.size(letters), F.lit(1))), lambda x, y: F.concat(x, y))
    return F.filter(pairs, lambda p: p.isNotNull())


def column_to_position(seq: Column, start: Column, col: Column, *, after: bool = True) -> Column:
    """Genomic position of alignment column ``col`` (from 0).

    A column within leading gaps, or of a row of gaps alone, has the first
    position.  A gap later on has the position after it, or before it.
    """
    upto = F.length(ungapped(F.substring(seq, F.lit(1), col + 1)))
    gap = F.substring(seq, col + 1, F.lit(1)) == "-"
    leading = F.length(seq) - F.length(F.ltrim(F.translate(seq, "-", " ")))
    return F.when((F.length(ungapped(seq)) == 0) | (col < leading), start).otherwise(
        start + upto - 1 + (F.when(gap, 1).otherwise(0) if after else F.lit(0)))


def position_to_column(seq: Column, start: Column, pos: Column) -> Column:
    """Column (from 0) of a genomic position; null if the row doesn't cover it."""
    at = F.transform(F.split(seq, ""), lambda c, i: F.when(c != "-", i))
    return F.get(F.filter(at, lambda i: i.isNotNull()), (pos - start).cast("int"))


def wrap(seq: Column, width: int = 60) -> Column:
    """Lines of ``width`` characters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def track_score(p: Column) -> Column:
    """A probability as an integer score of 0 to 1000."""
    return F.floor(p * 1000).cast("int")
