"""Scores against a plain recursive model on dictionaries, and sums of probabilities against one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helicase.llm import katz
from helicase.llm.katz import END, START, Discounts, katz_scores, pack, pair_table, score, tokens_of, train, unpack

from .conftest import SCHEMA, WORDS, awkward, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(UPPER)), "END "]


class Plain:
    def __init__(self, texts):
        self.one, self.two, self.after = Counter(), Counter(), defaultdict(set)
        for t in texts:
            before = "START "
            for w in tokens(t):
                self.one[w] += 1
                self.two[before, w] += 1
                self.after[before].add(w)
                before = w
        self.n = sum(self.one.values())
        self.total = Counter()
        for (u, _), n in self.two.items():
            self.total[u] += n
        self.d1, self.d2 = self.discounts(self.one), self.discounts(self.two)
        self.unknown = sum((1 - self.d1(n)) * n for n in self.one.values()) / self.n if self.n else 1.0

    @staticmethod
    def discounts(counts):
        types = Counter(counts.values())
        known = [(math.log(r), math.log(types[r])) for r in range(1, 7) if types[r]]
        slope = float(np.polyfit(*zip(*known), 1)[0]) if len(known) > 1 else -2.0
        slope = min(slope, -1.05)

        def of(r):
            if r <= 5 and types[r] and 0 < (r + 1) * types[r + 1] < r * types[r]:
                return (r + 1) * types[r + 1] / (r * types[r])
            return (1 + 1 / r) ** (slope + 1)

        return of

    def word(self, w):
        return self.d1(self.one[w]) * self.one[w] / self.n if self.one[w] else self.unknown

    def alpha(self, u):
        freed = sum((1 - self.d2(self.two[u, w])) * self.two[u, w] for w in self.after[u]) / self.total[u]
        return freed / (1 - sum(self.word(w) for w in self.after[u]))

    def p(self, w, u):
        if self.two[u, w]:
            return self.d2(self.two[u, w]) * self.two[u, w] / self.total[u]
        return (self.alpha(u) if self.total[u] else 1.0) * self.word(w)

    def score(self, text):
        known = tokens(text)
        base = sum(math.log10((self.one[w] + 1) / (self.n + len(self.one) + 1)) for w in known)
        return (len(known), sum(self.one[w] > 0 for w in known), self.n, base,
                sum(math.log10(self.p(w, u)) for w, u in zip(known, ["START ", *known])))


def is_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def corpus(many=60):
    r = random.Random(5)
    texts = [(1000 + i, " ".join(r.choice(WORDS[:12] if i % 2 else WORDS) + (str(r.randrange(50)) if r.random() < 0.1 else "") for _ in range(r.randrange(80)))) for i in range(many)]
    return awkward() + rows_of(texts) + [(None, *r[1:]) for r in rows_of([(1, "again and again")] * 3)]


def compare(got, docs, plain):
    want = sorted(((d[0], is_out(d[0]), *plain.score(d[1])) for d in docs), key=lambda x: (x[0] is None, *[y or 0 for y in x]))
    rows = sorted((tuple(r) for r in got.collect()), key=lambda x: (x[0] is None, *[y or 0 for y in x]))
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert [r[5:] for r in rows] == [pytest.approx(w[5:], rel=1e-9, abs=2e-6) for w in want]


def test_documents(spark):
    docs = corpus()
    got = katz_scores(spark.createDataFrame(docs, SCHEMA).withColumn("word", F.lit(1)).withColumn("mark", F.lit("m")).withColumn("block", F.lit(2)), held_out())
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    compare(got, docs, Plain([d[1] for d in docs if not is_out(d[0])]))


def test_common_words_lie_in_all_blocks(spark, monkeypatch):
    """Small blocks: most words count as common, and batches are many."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(katz, "MESSAGE_BYTES", 500)
    docs = corpus() + rows_of([(5000 + i, "the same words " * 40) for i in range(40)])
    frame = spark.createDataFrame(docs, SCHEMA)
    model = train(frame.where(~F.coalesce(held_out(), F.lit(False))))
    assert len(model.facts.spread) > 5 and model.facts.blocks > 30
    compare(score(frame, model, mark=held_out()), docs, Plain([d[1] for d in docs if not is_out(d[0])]))


def test_probabilities_sum_to_one(spark):
    docs = corpus()
    model = train(spark.createDataFrame(docs, SCHEMA))
    words = {r.word: r.n for r in model.words.collect()}
    share = dict(zip(words, model.facts.word_share(np.array(list(words.values())))))
    assert sum(share.values()) + model.facts.unknown == pytest.approx(1, abs=1e-12)
    after = defaultdict(dict)
    for r in pair_table(model).collect():
        after[r.context][r.word] = 10**r.log_p
    contexts = {r.word: r for r in model.contexts.collect()}
    assert set(contexts) == set(after) == (set(words) - {END}) | {START}
    for u, seen in after.items():
        rest = sum(p for w, p in share.items() if w not in seen) + model.facts.unknown
        assert sum(seen.values()) + 10 ** contexts[u].log_alpha * rest == pytest.approx(1, abs=1e-9)


def test_held_out_text_is_likelier_than_under_words_alone(spark):
    r = random.Random(3)
    follow = {w: r.sample(WORDS, 3) for w in WORDS}

    def walk(n):
        out = [r.choice(WORDS)]
        for _ in range(n):
            out.append(r.choice(follow[out[-1]]))
        return " ".join(out)

    docs = rows_of([(i, walk(150)) for i in range(200)])
    rows = [x for x in katz_scores(spark.createDataFrame(docs, SCHEMA), held_out()).collect() if x.held_out]
    assert len(rows) > 15 and all(x.score > x.base_score + 0.4 * x.n_tokens for x in rows)


def test_reruns_and_partitions_agree(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    one, other = (sorted(map(str, katz_scores(f, held_out()).collect())) for f in (frame, frame.repartition(7, "text")))
    assert one == other


def test_nothing_to_learn_from(spark, empty):
    assert katz_scores(empty, held_out()).count() == 0
    docs = rows_of([(i, t) for i, t in enumerate(["a b", None, ""])])
    got = katz_scores(spark.createDataFrame(docs, SCHEMA), F.lit(True)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [
        (0, True, 3, 0, 0, 0.0, 0.0), (1, True, 1, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert katz_scores(spark.createDataFrame(docs, SCHEMA), F.lit(None).cast("boolean")).count() == 3


def test_a_long_text(spark):
    docs = rows_of([(i, prose(i, 50)) for i in range(20)] + [(2, prose(9, 150_000))])
    compare(katz_scores(spark.createDataFrame(docs, SCHEMA), held_out()), docs, Plain([d[1] for d in docs if not is_out(d[0])]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \t\n\r\v\f\x1c\x85\xa0é日"), max_size=12)), max_size=6))
def test_tokens(texts):
    known, ids, number = tokens_of(pa.array(texts, pa.string()))
    want, own = [], []
    for i, t in enumerate(texts):
        want += [*[xxhash.xxh3_64_intdigest(w.encode()) - (1 << 63) for w in tokens(t)[:-1]], END]
        own += [i] * len(tokens(t))
    assert (known[ids].tolist(), number.tolist()) == (want, own)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.integers(0, 2**32 - 1), max_size=20).map(lambda x: np.array(x, np.uint32)),
    st.lists(st.integers(-(2**63), 2**63 - 1), max_size=20).map(lambda x: np.array(x, np.int64))), max_size=5))
def test_packed_arrays(arrays):
    back = unpack(pack(*arrays))
    assert [a.dtype for a in back] == [a.dtype for a in arrays] and all((a == b).all() for a, b in zip(arrays, back))


@pytest.mark.parametrize("types", [(0,) * 6, (5, 0, 0, 0, 0, 0), (100, 30, 12, 7, 4, 3), (1, 5, 9, 9, 9, 9), (0, 0, 4, 1, 0, 0)])
def test_discounts(types):
    d = Discounts(types).of(np.arange(1, 50))
    assert ((d > 0) & (d < 1)).all()
    if types[0] == 100:
        assert d[0] == pytest.approx(2 * 30 / 100) and d[4] == pytest.approx(6 * 3 / (5 * 4))
