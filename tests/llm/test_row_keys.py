"""What comes back for rows that share an id or have none: their own texts, over all awkward rows."""

from collections import Counter

from helicase.llm.line_dedup import line_dedup, without_lines
from helicase.llm.mixing import mix_sources, repeat_documents
from helicase.llm.quality_rules import keep_good, quality_rules

from .conftest import SCHEMA, awkward, prose, rows_of


def repeats_of(lines, seen):
    """Which lines repeat an earlier one, or are one word edit away from it (from five words on)."""
    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        x, y = sorted((a, b), key=len)
        i = 0
        while i < len(x) and x[i] == y[i]:
            i += 1
        return x[i + (len(x) == len(y)):] == y[i + 1:]

    for line in lines:
        words = line.split()
        yield bool(words) and any(near(words, s) for s in seen)
        if words:
            seen.append(words)


def test_lines_of_rows_that_share_an_id(spark):
    """Two texts under one id, and two without an id, each keep what only they hold."""
    a, b = "only here in the first one", "only there in the second text"
    common = "a line that both of them hold"
    rows = rows_of([(8, f"{a}\n{common}"), (8, f"{common}\n{b}"), (None, f"{common}\nnothing else has this"), (None, "nor has any other this one")])
    docs = spark.createDataFrame([(r[0] if i < 2 else None, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    left = [r.text for r in without_lines(docs, line_dedup(docs, min_words=1)).collect()]
    lines = Counter(line for t in left for line in t.split("\n") if line)
    assert len(left) == 4 and lines == Counter([a, b, common, "nothing else has this", "nor has any other this one"])


def test_every_line_stays_once(spark, documents):
    """Over all rows with their own ids, the texts left are those of a walk in order."""
    rows = [(i, r[1]) for i, r in enumerate(awkward()) if len(r[1] or "") < 5000]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    got = {r.doc_id: r.text for r in without_lines(docs, line_dedup(docs, min_words=1)).collect()}
    seen: list = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = list(repeats_of([x.replace("\x00", "\x00") for x in lines], seen))
        want = "\n".join(x for x, g in zip(lines, gone) if not g)
        assert (got[i] or "") == want


def test_good_rows_only(spark):
    """A junk row whose id a good row shares goes, and the good one stays."""
    rows = rows_of([(i, prose(i, 140)) for i in range(12)] + [(3, "junk"), (None, prose(50, 140)), (None, "short")])
    rows = [(None if i >= 13 else r[0], *r[1:]) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = Counter(r.text for r in keep_good(docs, quality_rules(docs)).collect())
    assert left == Counter([prose(i, 140) for i in range(12)] + [prose(50, 140)])


def test_mix_takes_rows_by_their_own(spark):
    """Rows of one id, or none, come as often as the mix takes each; equal rows together."""
    rows = rows_of([(1, "a b c"), (1, "d e f g"), (2, "h i"), (2, "h i")])
    rows += [(None, "x y", "en", "src0", 3, None, "x", None), (None, "z", "en", "src1", 1, None, "x", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mix_sources(docs)
    want = Counter()
    keys = {(r.doc_id, r.row_key): 0 for r in mixed.collect()}
    for r in mixed.collect():
        keys[(r.doc_id, r.row_key)] += r.copies
        want[(r.doc_id, r.source, r.size)] += r.copies
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in repeat_documents(docs, mixed).collect())
    assert got == +want
