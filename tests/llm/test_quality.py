import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from helicase.llm.importance import BUCKETS, importance_resample, kth_largest, ngram_buckets
from helicase.llm.quality_rules import COMMON_WORDS, keep_good, quality_rules

from .conftest import SCHEMA, awkward, prose, rows_of


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts(documents):
    want = sorted(((r[0], *counts(r[1])) for r in awkward()), key=str)
    got = quality_rules(documents).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_divergence_rejects_junk(spark):
    good = [(i, prose(i, 150)) for i in range(60)]
    junk = [(100, prose(70, 150).upper().replace(" ", "!! ")), (101, " | ".join(f"w{i}x" for i in range(150))), (102, " ".join(f"{w}%%%" for w in prose(71, 150).split()))]
    df = spark.createDataFrame(rows_of(good + junk), SCHEMA)
    judged = quality_rules(df)
    assert {r.doc_id for r in judged.where("NOT kept").collect()} == {100, 101, 102}
    left = keep_good(df, judged)
    assert left.columns == df.columns and left.count() == 60


def test_quality_empty_and_unknown_language(spark, empty):
    assert quality_rules(empty).count() == 0
    df = spark.createDataFrame([(1, "zz " * 3 + prose(1).upper(), "xx", "s", 1, 1, "", ""), (2, prose(2), None, "s", 1, 1, "", "")], SCHEMA)
    assert all(r.kept and r.class_distance is None for r in quality_rules(df).collect())


def test_importance(spark, empty):
    good = [(i, prose(i, 150)) for i in range(80)]
    junk = [(100 + i, " ".join(f"zq{(i * k) % 50}" for k in range(150))) for i in range(20)]
    df = spark.createDataFrame(rows_of(good + junk), SCHEMA)
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0, 0) for i in [*range(30), *range(100, 110)]], "doc_id long, quality int, toxic int")
    out = importance_resample(df, labels)
    assert {r.doc_id for r in out.where("kept").collect()} == set(range(80))
    again = {(r.doc_id, r.key) for r in importance_resample(df.repartition(3), labels).collect()}
    assert again == {(r.doc_id, r.key) for r in out.collect()}
    assert importance_resample(df, labels, share=0.25).where("kept").count() == 25
    assert importance_resample(empty, labels).count() == 0
    unlabelled = importance_resample(df, labels.where("false"))
    assert unlabelled.where("log_weight <> 0").count() == 0


def test_importance_awkward(documents, spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance_resample(documents, labels).count() == len(awkward())


def test_kth_largest(spark):
    values = [(float(i % 7),) for i in range(500)] + [(i / 10,) for i in range(500)]
    df = spark.createDataFrame(values, "v double")
    order = sorted((v for v, in values), reverse=True)
    for k in (1, 2, 10, 499, 1000):
        assert kth_largest(df, "v", k, parts=4, few=3) == order[k - 1]
    assert kth_largest(df, "v", 0) is None


def test_junk_just_over_the_base_rule(spark):
    good = [(1000 + i, prose(i, 150)) for i in range(400)] + [(100 + n, prose(500 + n, n)) for n in range(50, 100)]
    menus = [(200 + n, " | ".join(f"river{'abcdefghij'[k % 10]}{'stone'[:k // 10]}" for k in range(n // 2))) for n in range(54, 100, 6)]
    signs = [(300 + n, " ".join(f"{w}%%%" for w in prose(n, n).split())) for n in range(50, 100, 6)]
    judged = quality_rules(spark.createDataFrame(rows_of(good + menus + signs), SCHEMA)).collect()
    assert not [r for r in judged if r.base_failed]
    assert {r.doc_id for r in judged if r.kept} == {i for i, _ in good}
    assert any(r.class_distance <= 0.25 for r in judged if 200 <= r.doc_id < 300)


def brute_weights(docs, good, smoothing=1.0):
    """Log weights by dictionaries of n-gram counts."""
    grams = {i: [int(x) for x in ngram_buckets((t or "").encode())] for i, t in docs}
    raw = Counter(x for g in grams.values() for x in g)
    target = Counter(x for i in good for x in grams[i])
    unseen = 1e-3
    mass = sum(raw.values()) + unseen * BUCKETS
    whole = sum(target.values()) + smoothing * BUCKETS

    def log_ratio(x):
        share = (raw[x] + unseen) / mass
        return math.log((target[x] + smoothing * BUCKETS * share) / whole) - math.log(share)

    return {i: sum(map(log_ratio, g)) for i, g in grams.items()}


def test_importance_weights_by_brute_force(spark):
    docs = [(i, t) for i, (_, t, *_) in enumerate(awkward())]
    good = [0, 4, 11]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(2, 0, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows_of(docs), SCHEMA)
    got = importance_resample(df, labels, share=0.4).collect()
    want = brute_weights(docs, good)
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        assert r.log_weight == pytest.approx(want[r.doc_id], abs=1e-8)
    largest = sorted((r.key for r in got), reverse=True)[:round(0.4 * len(docs))]
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if r.key >= largest[-1]}


def histograms(text, lang):
    kinds = Counter()
    for c in text:
        category = unicodedata.category(c)
        if c in " \t\n\v\f\r":
            kind = "space"
        elif c in ".,;:?!'\"()-":
            kind = "stop"
        elif c in "#*$%&|<>":
            kind = "symbol"
        else:
            kind = {"Ll": "lower", "Lu": "upper", "Lt": "upper"}.get(category, "letter" if category[0] in "LM" else "digit" if category[0] == "N" else "mark")
        kinds[kind] += 1
    words = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
    n = sum(words.values())
    own = {w: words[w] / n for w in COMMON_WORDS[lang]}
    return {k: v / len(text) for k, v in kinds.items()}, own | {None: 1 - sum(own.values())}


def distance(p, q):
    middle = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in [*p, *q]}
    parts = [x * math.log2(x / middle[k]) for h in (p, q) for k, x in h.items() if x > 0]
    return math.sqrt(max(sum(parts) / 2, 0))


def mean(rows):
    total = defaultdict(float)
    for r in rows:
        for k, x in r.items():
            total[k] += x / len(rows)
    return total


@pytest.mark.parametrize("by_trust", [False, True])
def test_distances_by_brute_force(spark, by_trust):
    texts = {i: prose(i, 120 + i) for i in range(30)}
    texts |= {100: prose(70, 150).upper(), 101: " | ".join(f"w{i}x" for i in range(150)), 102: "Ünï 12 — " * 2 + prose(8, 130), 103: prose(9, 60)}
    trust = {500 + i: prose(500 + i, 110) for i in range(10)}
    table = lambda t: spark.createDataFrame(rows_of(list(t.items())), SCHEMA)
    got = {r.doc_id: r for r in quality_rules(table(texts), trusted=table(trust) if by_trust else None).collect()}
    assert not any(r.base_failed for r in got.values())
    shown = {i: histograms(t, "en") for i, t in texts.items()}

    def judged(refs):
        out = {}
        for i, t in texts.items():
            n = len(t.split())
            classes, words = (distance(a, b) for a, b in zip(shown[i], refs))
            chance = len(COMMON_WORDS["en"]) / (8 * math.log(2)) * max(1 / n - 1 / 100, 0)
            strange = (n >= 100 or classes > 0.125) and words > math.sqrt(0.27**2 + chance)
            out[i] = classes, words, classes <= 0.25 and not strange
        return out

    if by_trust:
        want = judged([mean(h) for h in zip(*[histograms(t, "en") for t in trust.values()])])
    else:
        first = judged([mean(h) for h in zip(*shown.values())])
        want = judged([mean(h) for h in zip(*[shown[i] for i, (_, _, kept) in first.items() if kept])])
    for i, (classes, words, kept) in want.items():
        assert got[i].class_distance == pytest.approx(classes, abs=1e-9)
        assert got[i].common_distance == pytest.approx(words, abs=1e-9)
        assert got[i].kept == kept
    assert not got[100].kept and not got[101].kept


def test_trusted_text_judges_a_corpus_of_junk(spark):
    junk = [(i, " ".join(f"{w}%%%".upper() for w in prose(i, 120).split())) for i in range(40)]
    docs = spark.createDataFrame(rows_of(junk + [(100, prose(100, 150))]), SCHEMA)
    trusted = spark.createDataFrame(rows_of([(i, prose(200 + i, 150)) for i in range(5)]), SCHEMA)
    assert {r.doc_id for r in quality_rules(docs, trusted=trusted).where("kept").collect()} == {100}
    assert quality_rules(docs, trusted=trusted.where("false")).where("class_distance IS NOT NULL").count() == 0
