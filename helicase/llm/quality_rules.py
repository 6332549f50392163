"""Quality rules: base counts and divergence from language references.

A document's histogram of character classes and of its language's common words
is compared with the reference of that language by Jensen-Shannon distance.
References are averages over trusted text, or over the whole corpus.  A document too short for a
histogram to mean anything is not judged by it; one of fewer words than a
histogram of common words needs is judged by both together, with an allowance
for what chance adds.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, row_key, stage, without_rows

#: Common function words of the languages that have references.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he this are".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
}
#: Characters that the base rules count as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ["lower", "upper", "letter", "digit", "space", "stop", "mark", "symbol"]
LOWER, UPPER, LETTER, DIGIT, SPACE, STOP, MARK, SYMBOL = range(8)
TABLE_SIZE = 0x3000

FEATURES = (
    "doc_id long, row_key long, lang string, n_chars long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, chars array<double>, common array<double>"
)

_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Character class of every code point below TABLE_SIZE; those above count as letters."""
    if not _table:
        t = np.full(TABLE_SIZE, MARK, np.uint8)
        for i in range(TABLE_SIZE):
            kind = unicodedata.category(chr(i))
            t[i] = {"Ll": LOWER, "Lu": UPPER, "Lt": UPPER}.get(kind, LETTER if kind[0] in "LM" else DIGIT if kind[0] == "N" else MARK)
        t[[*range(9, 14), 32]] = SPACE
        t[[ord(c) for c in ".,;:?!'\"()-"]] = STOP
        t[[ord(c) for c in SYMBOLS]] = SYMBOL
        _table.append(t)
    return _table[0]


def count_text(raw: bytes, common: list[bytes]) -> tuple[int, int, int, int, int, int, np.ndarray, np.ndarray]:
    """Counts of one text: characters, words, word characters, symbols, repeated lines, words
    in repeated 3-word windows, and shares of the character classes and common words (and the rest)."""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    classes = np.bincount(class_table()[np.minimum(points, TABLE_SIZE - 1)], minlength=len(CLASSES))
    words = raw.split()
    n = len(words)
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip():
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeated = 0
    if n >= 3:
        v = np.int64(len(number) + 1)
        if v < 2_000_000:
            windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:  # pairs are numbered first, so that nothing overflows
            pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
            windows = pair[:-1] * v + ids[2:]
        _, back, often = np.unique(windows, return_inverse=True, return_counts=True)
        hit = often[back] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= hit
        covered[1:-1] |= hit
        covered[2:] |= hit
        repeated = int(covered.sum())
    per_word = np.bincount(ids, minlength=1) if n else np.zeros(1, np.int64)
    hits = np.array([per_word[number[w]] if w in number else 0 for w in common], float)
    shares = np.append(hits, n - hits.sum()) / max(n, 1)
    return (len(points), n, len(points) - int(classes[SPACE]), int(classes[SYMBOL]), dup_lines, repeated,
            classes / max(len(points), 1), shares)


def _features(common: dict[str, list[str]]):
    encoded = {k: [w.encode() for w in ws] for k, ws in common.items()}

    def run(batches):
        for b in batches:
            ids, row_keys, langs = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            raws = b.column(2).cast(pa.binary()).to_pylist()
            rows = [count_text(raw or b"", encoded.get(lang, [])) for raw, lang in zip(raws, langs)]
            cols = [list(c) for c in zip(*rows)] if rows else [[]] * 8
            kinds = [pa.int64()] * 6 + [pa.list_(pa.float64())] * 2
            arrays = [pa.array(ids, pa.int64()), pa.array(row_keys, pa.int64()), pa.array(langs, pa.string())] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            names = ["doc_id", "row_key", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance to base 2 of two histograms given as arrays of shares."""
    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total / 2, F.lit(0.0))))


def references(features: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """One row per language that has common words: mean shares over ``features``."""
    width = max(map(len, common.values())) + 1
    # a language with fewer words has shorter histograms; what is missing stays null
    cells = [F.avg(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    cells += [F.avg(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(width)]
    means = features.where(F.col("lang").isin(list(common))).groupBy("lang").agg(*cells)
    return means.select(
        F.col("lang").alias("ref_lang"),
        F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_chars"),
        F.filter(F.array(*[f"w{i}" for i in range(width)]), lambda x: x.isNotNull()).alias("ref_common"),
    )


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    common: dict[str, list[str]] | None = None,
    trusted: DataFrame | None = None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_chars_for_classes: int = 200,
    min_words_for_common: int = 100,
    max_class_distance: float = 0.25,
    max_common_distance: float = 0.27,
) -> DataFrame:
    """Judge every document: base counts, distances to its language's references, ``kept``.

    Returns one row per document: ``id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, class_distance,
    common_distance, kept, row_key``, the last a hash of text and language that
    tells rows of one id apart.  A distance is null, and judges nothing, below
    its minimum length or without a reference.  From ``min_words`` up to
    ``min_words_for_common`` words, common words judge only together with a
    class distance over half its limit, and their limit is raised by the mean
    divergence of a sample of so many words.

    Defined cases: a null text has no words and fails; a null or unknown
    language has no reference; ties don't arise; repeated rows are judged
    alike, each once; an empty table gives no rows.  Other columns are not
    read.

    Scale: texts are read once; the shuffle holds one row of means per task
    and language.  References (one row per language of ``common``) are made
    from all rows of ``trusted`` (columns as ``docs``) that pass the base
    rules.  Without such text they come from all documents that pass them, then
    once more from those of them within the limits; a corpus of mostly junk
    then takes junk for the norm.  They are broadcast.
    """
    common = COMMON_WORDS if common is None else common

    def counted(table: DataFrame, doc_id: Column) -> DataFrame:
        rows = table.select(
            doc_id.cast("long").alias("doc_id"), row_key(F.col(text_col), F.col(lang_col)).alias("row_key"),
            F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        return in_batches(rows, _features(common), FEATURES).withColumn(
            "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))

    features = stage(counted(docs, F.col(id_col)), name="features")

    # n words over k + 1 bins diverge from their own source by k / (8 n ln 2) on average
    chance = (F.size("ref_common") - 1) / (8 * math.log(2)) * F.greatest(1 / F.col("n_words") - 1 / min_words_for_common, F.lit(0.0))
    enough = (F.col("n_words") >= min_words_for_common) | (F.col("class_distance") > max_class_distance / 2)
    strange = enough & (F.col("common_distance") > F.sqrt(max_common_distance ** 2 + chance))

    def measured(refs: DataFrame) -> DataFrame:
        # at most one row per language of ``common``
        joined = features.join(F.broadcast(refs), F.col("lang") == F.col("ref_lang"), "left")
        return joined.withColumn(
            "class_distance", F.when(F.col("n_chars") >= min_chars_for_classes, js_distance(F.col("chars"), F.col("ref_chars")))
        ).withColumn(
            "common_distance", F.when(F.col("n_words") >= min(min_words, min_words_for_common), js_distance(F.col("common"), F.col("ref_common")))
        ).withColumn(
            "near", (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & ~F.coalesce(strange, F.lit(False)))

    sound = (features if trusted is None else counted(trusted, F.lit(None))).where("NOT base_failed")
    final = stage(references(sound, common), name="references")
    if trusted is None:
        first = final
        within = measured(first).where("NOT base_failed AND near").select("lang", "chars", "common")
        second = references(within, common)
        # a language of which nothing is near its first reference keeps that
        final = stage(second.unionByName(first.join(second.select("ref_lang"), "ref_lang", "left_anti")), name="references")
    return measured(final).select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "class_distance", "common_distance", (~F.col("base_failed") & F.col("near")).alias("kept"), "row_key")


def keep_good(docs: DataFrame, judged: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that were kept, with their columns; rows of one id, or of none, each by their own text and language."""
    gone = judged.where("NOT kept").select(F.col(id_col).cast("long").alias("_id"), F.col("row_key").alias("_key")).distinct()
    return without_rows(docs, stage(gone, name="gone"), id_col, row_key(F.col(text_col), F.col(lang_col)))
