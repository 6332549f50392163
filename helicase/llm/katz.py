"""Scoring text with a Katz back-off model of word pairs.

``p(w | u)`` is the Good-Turing discounted share of ``u w`` among what follows
``u``, if ``u w`` was seen; otherwise it is what the discounts of ``u`` free,
times ``p(w)`` and normalised exactly over the words not seen after ``u``.
``p(w)`` is discounted likewise; what that frees is the probability of one
unknown word.  An end follows every text, and a start precedes it.

The model lies in three tables in the shared folder: words with their counts;
pairs, one row for each block of words (all that precedes a word is in
that word's block, so counts of words and pairs meet there); contexts with
their back-off weights.

A token's probability is the product of three factors that different tables
hold, so texts travel once, as packed messages from batches of documents to
blocks of words:

- seen pairs: the discounted count; unseen ones: ``p(w)`` (the word's block);
- 1 / count of the context, which is the word before: the block of that word
  knows its count, so each token pays for the next one;
- unseen pairs: the context's freed count, normalised (the contexts' table).

Logarithms are summed as integers, so results don't depend on the order.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, row_key, shuffle_partitions, stage
from .words import finish

#: Training tokens for each block of words; a block is held in memory by one task.
BLOCK_TOKENS = 8_000_000
#: Least number of blocks.
LEAST_BLOCKS = 16
#: At most so many words (those that make up at least 1 in so many tokens) may be spread over all blocks.
MOST_SPREAD = 1 << 16
#: Bytes of text that a task turns into messages at a time.
MESSAGE_BYTES = 8_000_000
#: Counts up to this are discounted by Turing's estimate, larger ones by a power law fitted to the counts of counts.
TURING = 5
#: Integer units of summed logarithms.
BASE_UNIT, SCORE_UNIT = 10**10, 10**8

#: Words hold no white space, so these are no word's hash but by chance.
START, END = (xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in (b" start", b" end"))


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discounts by count, from how many types occur 1, 2, ... ``TURING`` + 1 times."""

    types: tuple[int, ...]
    slope: float = field(init=False)

    def __post_init__(self):
        points = [(math.log(r), math.log(n)) for r, n in enumerate(self.types, 1) if n > 0]
        slope = -2.0
        if len(points) > 1:
            mx, my = (sum(c) / len(points) for c in zip(*points))
            slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
        # below -1 every count is discounted, so every context frees something
        object.__setattr__(self, "slope", min(slope, -1.05))

    def of(self, counts: np.ndarray) -> np.ndarray:
        """The factors, in (0, 1), by which counts of 1 or more shrink."""
        r = np.asarray(counts, float)
        out = (1 + 1 / np.maximum(r, 1)) ** (self.slope + 1)
        for k in range(1, TURING + 1):
            now, more = self.types[k - 1:k + 1]
            if 0 < (k + 1) * more < k * now:
                out[r == k] = (k + 1) * more / (k * now)
        return out


@dataclass(frozen=True)
class Facts:
    """What tasks need to know of a whole model."""

    tokens: int
    types: int
    blocks: int
    spread: np.ndarray
    spread_counts: np.ndarray
    words: Discounts
    unknown: float

    def word_share(self, counts: np.ndarray) -> np.ndarray:
        """p(w) of words that occurred so often in training."""
        n = np.asarray(counts, float)
        return np.where(n > 0, self.words.of(n) * n / max(self.tokens, 1), self.unknown)

    def block_of(self, seen: np.ndarray, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Pairs lie by word; those of the commonest words by word and context.  Both are numbers of ``seen``."""
        mixed = seen.view(np.uint64)
        out = (finish(mixed) % np.uint64(self.blocks)).astype(np.uint32)[ids]
        common = np.flatnonzero(_among(seen, self.spread)[1][ids])
        both = finish(mixed[ids[common]] + np.uint64(3) * finish(mixed[before[common]]))
        out[common] = (both % np.uint64(self.blocks)).astype(np.uint32)
        return out.astype(np.uint16) if self.blocks < 1 << 16 else out  # short numbers sort in linear time


@dataclass(frozen=True)
class KatzModel:
    """``words`` (word, n), ``pairs`` (block, payload, ones) and ``contexts`` (word, n, log_alpha); words are hashes."""

    words: DataFrame
    pairs: DataFrame
    contexts: DataFrame
    facts: Facts
    discounts: Discounts


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` in the sorted ``known``, and which of them are there."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 4- or 8-byte integers, byte plane by byte plane, compressed."""
    out = io.BytesIO()
    for a in arrays:
        np.save(out, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T))
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    size = int.from_bytes(payload[:8], "little")
    raw = io.BytesIO(pa.Codec("zstd").decompress(payload[8:], size, asbytes=True))
    out = []
    while raw.tell() < size:
        planes = np.load(raw)
        width = planes.shape[0]
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.int64 if width == 8 else np.uint32))
    return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, number of each token among them, number of its text), in order; a text's last token is its end.

    Words are hashed once for each batch and lower-cased in A-Z alone.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = split.flatten()
    text = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    known = np.fromiter((digest(w) - (1 << 63) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary))
    words, text = coded.indices.to_numpy(zero_copy_only=False)[some], text[some]
    at = np.arange(len(words)) + text  # one end comes before for each text before
    size = len(words) + len(texts)
    ids, number = np.full(size, len(known), np.int32), np.empty(size, np.int32)
    ids[at] = words
    ends = np.bincount(text, minlength=len(texts)).cumsum() + np.arange(len(texts))
    number[at], number[ends] = text, np.arange(len(texts))
    return np.append(known, END), ids, number


def _gathered(batches, columns: list[str]):
    """Of about ``MESSAGE_BYTES`` of text at a time: distinct tokens and the start, the numbers of tokens, of contexts and of texts, other columns."""
    held, size = [], 0

    def done():
        known = [t[0] for t, *_ in held]
        seen, back = np.unique(np.concatenate(known), return_inverse=True)
        offsets = np.cumsum([0, *map(len, known)])
        ids = np.concatenate([back[lo:hi][t[1]] for (t, *_), lo, hi in zip(held, offsets, offsets[1:])]).astype(np.int32)
        ahead = np.cumsum([0, *[rows for _, rows, _ in held]])
        number = np.concatenate([t[2] + n for (t, *_), n in zip(held, ahead)]).astype(np.int32)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.flatnonzero(np.diff(number, prepend=-1))] = len(seen)
        return np.append(seen, START), ids, before, number, *[pa.concat_arrays([rest[j] for *_, rest in held]) for j in range(len(columns))]

    for b in batches:
        if not b.num_rows:
            continue
        text = b.column("text")
        held.append((tokens_of(text), b.num_rows, [b.column(c) for c in columns]))
        size += text.nbytes
        if size >= MESSAGE_BYTES:
            yield done()
            held, size = [], 0
    if held:
        yield done()


def _word_counts(batches):
    for seen, ids, _, _ in _gathered(batches, []):
        n = np.bincount(ids, minlength=len(seen))
        some = np.flatnonzero(n)  # splitting at leading white space leaves an empty word that is no token
        yield pa.RecordBatch.from_arrays([pa.array(seen[some]), pa.array(n[some])], ["word", "n"])


def _sliced(blocks: np.ndarray):
    """(block, places in order) of each block."""
    order = np.argsort(blocks, kind="stable")
    cuts = np.flatnonzero(np.diff(blocks[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        yield int(blocks[some[0]]), some


def _table(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], ["block", "kind", "payload"])


MESSAGE = "block int, kind int, payload binary"


def _pair_counts(facts: Facts):
    """Messages to blocks: the pairs of a batch with their counts."""
    def run(batches):
        for seen, ids, before, _ in _gathered(batches, []):
            code, n = np.unique(ids * np.int64(len(seen)) + before, return_counts=True)
            ids, before = (code // len(seen)).astype(np.int32), (code % len(seen)).astype(np.int32)
            yield _table([
                (block, 1, pack(*_numbered(seen, ids[some]), *_numbered(seen, before[some]), n[some].astype(np.uint32)))
                for block, some in _sliced(facts.block_of(seen, ids, before))])

    return run


def _numbered(seen: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, and the place of each in them."""
    if 8 * len(ids) < len(seen):
        own, places = np.unique(ids, return_inverse=True)
    else:  # marks are cheaper than sorting
        marks = np.zeros(len(seen), np.int32)
        marks[ids] = 1
        own = np.flatnonzero(marks)
        marks[own] = np.arange(len(own))
        places = marks[ids]
    return seen[own], places.astype(np.uint32)


def _merged(batches):
    """Messages sorted by block -> one row a block: its pairs sorted by word and context, with counts."""
    def done(block, held):
        parts = list(zip(*held))
        words, wi = np.unique(np.concatenate(parts[0]), return_inverse=True)
        contexts, ui = np.unique(np.concatenate(parts[2]), return_inverse=True)
        w0, u0 = np.cumsum([0, *map(len, parts[0])]), np.cumsum([0, *map(len, parts[2])])
        code = np.concatenate([wi[w0[i] + parts[1][i]] * len(contexts) + ui[u0[i] + parts[3][i]] for i in range(len(held))])
        n = np.concatenate(parts[4]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        n, code = np.add.reduceat(n[order], first), code[order][first]
        ones = [int((n == r).sum()) for r in range(1, TURING + 2)]
        payload = pack(words, (code // len(contexts)).astype(np.uint32), contexts, (code % len(contexts)).astype(np.uint32), n)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([payload], pa.binary()), pa.array([ones], pa.list_(pa.int64()))], ["block", "payload", "ones"])

    now, held = None, []
    for b in batches:
        for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist()):
            if block != now and held:
                yield done(now, held)
                held = []
            now = block
            held.append(unpack(payload))
    if held:
        yield done(now, held)


@dataclass
class _Block:
    """The pairs of one block, ready to be looked up."""

    words: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    codes: np.ndarray
    n: np.ndarray

    @classmethod
    def read(cls, payload: bytes | None, facts: Facts) -> _Block:
        if payload is None:
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none, none)
        words, wi, contexts, ui, n = unpack(payload)
        own = np.zeros(len(words), np.int64)
        np.add.at(own, wi, n)
        at, common = _among(words, facts.spread)
        if common.any():
            own = np.where(common, facts.spread_counts[at], own)
        return cls(words, own, contexts, wi.astype(np.int64) * len(contexts) + ui, n)

    def count(self, words: np.ndarray, facts: Facts) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words that lie in this block, and their places (-1: none)."""
        at, there = _among(words, self.words)
        n = np.where(there, self.counts[at], 0) if len(self.words) else np.zeros(len(words), np.int64)
        place, common = _among(words, facts.spread)
        if common.any():
            n = np.where(common, facts.spread_counts[place], n)
        return n, np.where(there, at, -1)

    def pairs(self, word_places: np.ndarray, contexts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Training counts of pairs: words by their places, contexts by number ``which``."""
        at, there = _among(contexts, self.contexts)
        at = np.where(there, at, -1)[which]
        both = (word_places >= 0) & (at >= 0)
        place, seen = _among(word_places * max(len(self.contexts), 1) + at, self.codes)
        seen &= both
        return np.where(seen, self.n[place], 0) if len(self.n) else np.zeros(len(which), np.int64)


def _context_sums(facts: Facts, discounts: Discounts):
    """Of each context in a block: its count, what discounts free of it, and p(w) of all that follows it."""
    def run(batches):
        for b in batches:
            for payload in b.column("payload").to_pylist():
                block = _Block.read(payload, facts)
                width = max(len(block.contexts), 1)
                w, u = block.codes // width, block.codes % width
                share = facts.word_share(block.counts)[w]
                freed = (1 - discounts.of(block.n)) * block.n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.contexts)] + [pa.array(np.bincount(u, weights=x, minlength=len(block.contexts)), pa.float64()) for x in (block.n, freed, share)],
                    ["word", "n", "freed", "covered"])

    return run


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "block").sortWithinPartitions("block", "kind")


def train(docs: DataFrame, *, text_col: str = "text") -> KatzModel:
    """Count words and pairs of all of ``docs`` and weigh their contexts.

    Defined cases: a null text is empty and counts as an end after a start;
    repeated rows count each; an empty table makes a model in which
    the unknown word has probability 1.  Other columns are not read.

    Scale: texts are read twice and never shuffled; per batch of documents,
    distinct words and then distinct pairs go to their blocks.  Blocks are
    as many as the counted tokens ask for.  Words that make up
    a quarter of a block or more (at most ``MOST_SPREAD`` of them, which tasks
    are told) lie spread over all blocks.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = in_batches(texts, _word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = stage(counted, name="words", drop_shuffles=True)
    ones = [F.coalesce(F.sum((F.col("n") == r).cast("long")), F.lit(0)).alias(f"r{r}") for r in range(1, TURING + 2)]
    tokens, types, *counts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), *ones).first()
    least = max(BLOCK_TOKENS // 4, tokens // MOST_SPREAD + 1)
    common = sorted((r.word, r.n) for r in words.where(F.col("n") >= least).collect())
    of_words = Discounts(tuple(counts))
    freed = words.groupBy("n").agg(F.count("*").alias("types"))
    unknown = _freed_share(freed, of_words, tokens)
    facts = Facts(
        tokens, types, max(LEAST_BLOCKS, -(-tokens // BLOCK_TOKENS)), np.array([w for w, _ in common], np.int64),
        np.array([n for _, n in common], np.int64), of_words, unknown)

    sent = in_blocks(in_batches(texts, _pair_counts(facts), MESSAGE))
    pairs = stage(in_batches(sent, _merged, "block int, payload binary, ones array<long>"), name="pairs", drop_shuffles=True)
    sums = pairs.agg(*[F.coalesce(F.sum(F.get("ones", F.lit(r))), F.lit(0)) for r in range(TURING + 1)]).first()
    discounts = Discounts(tuple(sums))
    parts = in_batches(pairs.select("payload"), _context_sums(facts, discounts), "word long, n double, freed double, covered double")
    contexts = parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "freed", "covered")]).select(
        "word", F.col("n").cast("long").alias("n"), F.log10(F.col("freed") / F.col("n") / (1 - F.col("covered"))).alias("log_alpha"))
    return KatzModel(words, pairs, stage(contexts, name="contexts", drop_shuffles=True), facts, discounts)


def _freed_share(counts: DataFrame, discounts: Discounts, tokens: int) -> float:
    """The share of tokens that the words' discounts free, from the table (n, types) of counts of counts."""
    if not tokens:
        return 1.0
    factor = F.pow(1 + 1 / F.col("n"), F.lit(discounts.slope + 1))
    small = discounts.of(np.arange(1, TURING + 1))
    for r, d in enumerate(small.tolist(), 1):
        factor = F.when(F.col("n") == r, F.lit(d)).otherwise(factor)
    freed = counts.agg(F.sum((1 - factor) * F.col("n") * F.col("types"))).first()[0]
    return freed / tokens


def _to_score(facts: Facts):
    """Messages to blocks: the tokens of a batch with their contexts and documents, in order of documents."""
    def run(batches):
        for seen, ids, before, number, doc, keys, marks in _gathered(batches, ["id", "key", "mark"]):
            none = doc.is_null().to_numpy(zero_copy_only=False).astype(np.uint32)
            flags = none + 2 * marks.to_numpy(zero_copy_only=False).astype(np.uint32)
            doc, keys = doc.fill_null(0).to_numpy(), keys.to_numpy()
            rows = []
            for block, some in _sliced(facts.block_of(seen, ids, before)):
                first = np.flatnonzero(np.diff(number[some], prepend=-1))  # a document's tokens stay together
                own, runs = number[some[first]], np.diff(first, append=len(some)).astype(np.uint32)
                rows.append((block, 1, pack(doc[own], keys[own], flags[own], runs, *_numbered(seen, ids[some]), *_numbered(seen, before[some]))))
            yield _table(rows)

    return run


SCORED = "id long, key long, mark boolean, copies long, n_tokens long, n_known long, base long, score long, context long, times long"


def _rounded(x: np.ndarray, unit: int) -> np.ndarray:
    return np.rint(np.log10(x) * unit).astype(np.int64)


def _scores(facts: Facts, discounts: Discounts):
    """Blocks with the messages to them -> sums by document, and its unseen pairs by context."""
    kinds = [pa.int64(), pa.int64(), pa.bool_()] + [pa.int64()] * 7
    names = [c.split()[0] for c in SCORED.split(", ")]

    def told(block: _Block, payload: bytes):
        ids, keys, flags, runs, words, wi, contexts, ui = unpack(payload)
        n, places = block.count(words, facts)
        r = block.pairs(places[wi], contexts, ui)
        base = _rounded((n + 1) / (facts.tokens + facts.types + 1), BASE_UNIT)
        # the next token's context is this word; an end pays for its text's start
        next_one = np.where(n > 0, -_rounded(np.maximum(n, 1), SCORE_UNIT), 0)
        alone = _rounded(facts.word_share(n), SCORE_UNIT)
        seen = r > 0
        paired = _rounded(np.where(seen, discounts.of(r) * r, 1), SCORE_UNIT)
        first = np.cumsum(runs, dtype=np.int64) - runs

        def by_document(x):
            return np.add.reduceat(x.astype(np.int64), first)

        sums = [by_document(x) for x in ((words == END)[wi], np.ones(len(wi)), (n > 0)[wi], base[wi], next_one[wi] + np.where(seen, paired, alone[wi]))]
        yield (ids, keys, flags, *sums, None, None)
        number = np.repeat(np.arange(len(runs)), runs)
        code, times = np.unique(number[~seen] * len(contexts) + ui[~seen], return_counts=True)
        own = code // len(contexts)
        none = np.zeros(len(code), np.int64)
        yield (ids[own], keys[own], flags[own], *[none] * 5, contexts[code % len(contexts)], times.astype(np.int64))

    def table(rows):
        out = []
        for ids, keys, flags, *sums in rows:
            cols = [pa.array(ids, mask=(flags & 1).astype(bool)), pa.array(keys), pa.array((flags & 2).astype(bool))]
            cols += [pa.array(x) if x is not None else pa.nulls(len(ids), pa.int64()) for x in sums]
            out.append(pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds)], names))
        return out

    def run(batches):
        now, block = None, None
        for b in batches:
            for number, kind, payload in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "payload"))):
                if number != now:
                    now, block = number, _Block.read(payload if kind == 0 else None, facts)
                if kind == 1:
                    yield from table(told(block, payload))

    return run


def score(docs: DataFrame, model: KatzModel, *, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """Score every document: ``id, mark, n_tokens, n_known, train_tokens, base_score, score``.

    ``score`` is the model's log10 probability of the text with its end,
    ``base_score`` that of words alone with 1 added to each count;
    ``n_known`` counts tokens that occur in training.  ``mark`` is a boolean
    that comes back with its document (null: false).

    Defined cases: a null text is empty and has its end alone; rows that share
    an id, or have none, are told apart by text and mark; rows that also
    agree in these come back each, with equal scores.  An empty table gives
    no rows.  Other columns are not read.

    Scale: texts are read once; tokens go to the blocks of their words in
    packed messages, one for each batch and block, and stream past the block.
    What returns is a row of sums for each document and block and one for
    each unseen pair, which meets its context's weight in a join that splits
    hot keys.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("key"),
        F.coalesce(mark if mark is not None else F.lit(False), F.lit(False)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    facts = model.facts
    messages = in_batches(rows, _to_score(facts), MESSAGE)
    blocks = model.pairs.select("block", F.lit(0).alias("kind"), "payload")
    told = stage(in_batches(in_blocks(blocks.unionByName(messages)), _scores(facts, model.discounts), SCORED), name="scored", drop_shuffles=True)
    key = ["id", "key", "mark"]
    sums = ["copies", "n_tokens", "n_known", "base", "score"]
    # a context never seen in training has no weight: all its mass is the word's own
    weight = F.round((F.col("log_alpha") + F.log10("n")) * SCORE_UNIT).cast("long")
    unseen = told.where("context IS NOT NULL").select(*key, "context", "times").join(
        model.contexts.select(F.col("word").alias("context"), weight.alias("weight")).hint("merge"), "context")
    paid = unseen.select(*key, *[F.lit(0).cast("long").alias(c) for c in sums[:-1]], (F.col("times") * F.col("weight")).alias("score"))
    total = told.where("context IS NULL").select(*key, *sums).unionByName(paid).groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums])
    each = total.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))

    def of_one(c: str) -> Column:
        return F.expr(f"{c} div copies")

    return each.select(
        F.col("id").alias(id_col), "mark", of_one("n_tokens").alias("n_tokens"), of_one("n_known").alias("n_known"), F.lit(facts.tokens).cast("long").alias("train_tokens"),
        (of_one("base") / BASE_UNIT).alias("base_score"), (of_one("score") / SCORE_UNIT).alias("score"))


def katz_scores(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents that aren't held out, score all; ``mark`` comes back as ``held_out``."""
    out = F.coalesce(held_out, F.lit(False))
    model = train(docs.where(~out), text_col=text_col)
    return score(docs, model, id_col=id_col, text_col=text_col, mark=out).withColumnRenamed("mark", "held_out")


def pair_table(model: KatzModel) -> DataFrame:
    """The pairs as rows: ``context, word, n, log_p``, ``log_p`` the log10 of p(word | context)."""
    facts, discounts = model.facts, model.discounts

    def run(batches):
        for b in batches:
            for payload in b.column("payload").to_pylist():
                words, wi, contexts, ui, n = unpack(payload)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(contexts[ui]), pa.array(words[wi]), pa.array(n), pa.array(discounts.of(n) * n)], ["context", "word", "n", "kept"])

    rows = in_batches(model.pairs.select("payload"), run, "context long, word long, n long, kept double")
    totals = model.contexts.select(F.col("word").alias("context"), F.col("n").alias("total"))
    return rows.join(totals, "context").select("context", "word", "n", F.log10(F.col("kept") / F.col("total")).alias("log_p"))
