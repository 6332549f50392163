import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helicase.llm.common import row_key
from helicase.llm.line_dedup import _within_one_edit, half_keys, line_dedup, variant_keys, without_lines

from .conftest import SCHEMA, awkward, near, prose, rows_of


def brute(rows):
    order = lambda r: (r[0] is None, r[0] or 0)
    lines = []
    for r in sorted(rows, key=order):
        for no, line in enumerate((r[1] or "").encode().split(b"\n")):
            words = line.split()
            if len(words) >= 3:
                lines.append(((*order(r), no), r[0], no, b" ".join(words), len(words)))
    gone = set()
    for place, doc, no, line, n in lines:
        for other in lines:
            if other[0] < place and (other[3] == line or min(n, other[4]) >= 5 and _within_one_edit(line, other[3])):
                gone.add((doc, no))
                break
    return gone


def found(df):
    return {(r.doc_id, r.line_no) for r in line_dedup(df).collect()}


def test_awkward_documents(documents):
    assert found(documents) == brute(awkward())


def test_edited_lines(spark):
    r = random.Random(4)
    lines = [" ".join(prose(i, 14).replace("\n", " ").split()) for i in range(12)]
    texts = []
    for i in range(60):
        words = r.choice(lines).split()
        kind, at = r.randrange(5), r.randrange(len(words))
        if kind == 1:
            words[at] = "changed"
        elif kind == 2:
            del words[at]
        elif kind == 3:
            words.insert(at, "added")
        elif kind == 4:
            words[at], words[at - 1] = "two", "edits"
        texts.append((i, " ".join(words) + "\n" + r.choice(lines)))
    rows = rows_of(texts)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), min_size=5, max_size=12)


@settings(max_examples=300)
@given(WORDS, st.integers(0, 2), st.integers(0, 11), st.sampled_from([b"a", b"z"]))
def test_neighbours_share_a_half_and_a_key(words, kind, at, new):
    at = at % len(words)
    other = [*words[:at], new, *words[at + (kind == 0):]] if kind < 2 else words[:at] + words[at + 1:]
    assert set(half_keys(words)) & set(half_keys(other))
    x, y = (set(map(tuple, variant_keys(w).tolist())) for w in (words, other))
    assert x & y


def test_without_lines(spark, documents, empty):
    out = without_lines(documents, line_dedup(documents))
    assert out.columns == [*documents.columns, "_n_lines", "_n_dropped"]
    assert out.count() == len(awkward())
    rows = {r.doc_id: r for r in out.where("doc_id IN (1, 4, 5, 12)").collect()}
    assert rows[1].text.strip() == "" and rows[5].text is None
    assert rows[12].text == "same line of seven words here now" and rows[12]._n_dropped == 4
    assert line_dedup(empty).count() == 0 and without_lines(empty, line_dedup(empty)).count() == 0
    whole = spark.createDataFrame(rows_of([(1, near(prose(9), 1, 0))]), SCHEMA)
    assert line_dedup(whole).count() == 0


SHORT = [
    (1, "Les.\nAnd ornd.\n\none two three"), (2, "Les.\n and  ornd.\nAnd ornd.\n\none two"), (3, " \t\nLes."), (4, "one two three\none two four\nLes"),
    (5, "a b c d\na b c e\na b c d\na b c d e"), (None, "Les.\nAnd\tornd. "),
]


def brute_short(rows):
    """Lines with any word that repeat an earlier one, word for word or, from five words, but for one."""
    lines = [
        ((i is None, i or 0, no), i, no, line.split()) for i, text, *_ in rows for no, line in enumerate((text or "").encode().split(b"\n")) if line.split()]
    same = lambda a, b: a == b or min(len(a), len(b)) >= 5 and _within_one_edit(b" ".join(a), b" ".join(b))
    return {(i, no) for at, i, no, words in lines if any(other[0] < at and same(words, other[3]) for other in lines)}


def test_short_lines_in_op8_and_the_pipeline(spark, tmp_path):
    from corpus_pipeline import lines as stage_of_lines
    from helicase.llm.queries import op8_dedup_lines

    rows = rows_of(SHORT)
    rows = [(i, *r[1:]) for (i, _), r in zip(SHORT, rows)] + [r for r in awkward() if (r[0] or 0) > 5]
    gone = brute_short(rows)
    assert {(2, 0), (2, 2), (3, 1), (4, 0), (5, 2), (None, 0), (None, 1), (9, 0)} <= gone and not gone & {(2, 1), (4, 1), (4, 2), (5, 1), (5, 3)}
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(("\n".join(x for no, x in enumerate((t or "").split("\n")) if (i, no) not in gone) for i, t, *_ in rows))
    assert sorted(r.text or "" for r in op8_dedup_lines(spark, str(tmp_path)).collect()) == want
    left = sorted(r.text or "" for r in stage_of_lines(spark, df, str(tmp_path)).collect())
    assert [x for x in left if x.split()] == [x for x in want if x.split()]


def test_many_lines_of_one_text(spark):
    """A text is cut in time linear in its lines: of 300,000 equal ones the first stays, of 200,000 different ones one goes."""
    import time

    numbered = "\n".join(f"line number {i} of many" for i in range(200_000))
    rows = [(1, "a b c\n" * 300_000), (2, numbered + "\na b c"), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = spark.createDataFrame([(1, i) for i in range(1, 300_000)] + [(2, 200_000), (3, 0)], "doc_id long, line_no int")
    dropped = dropped.join(docs.select("doc_id", row_key(F.col("text")).alias("text_key")), "doc_id")
    start = time.perf_counter()
    got = {r.doc_id: (r.text, r["_n_lines"], r["_n_dropped"]) for r in without_lines(docs, dropped).collect()}
    assert time.perf_counter() - start < 60
    assert got == {1: ("a b c\n", 300_001, 299_999), 2: (numbered, 200_001, 1), 3: ("", 1, 1)}


def test_a_taken_name_is_refused(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, _N_lines int")
    with pytest.raises(ValueError):
        without_lines(docs, docs)
