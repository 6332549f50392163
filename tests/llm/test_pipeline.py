import re
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from helicase.llm.common import stage

from .conftest import SCHEMA, near, prose, rows_of


def test_stages_take_effect(spark):
    texts = [(i, prose(i, 140)) for i in range(40)]
    texts += [(50, prose(3, 140)), (51, near(prose(4, 140), 1, 1)), (52, prose(60, 140).upper().replace(" ", "!! ")), (53, "too short")]
    texts += [(54, prose(5, 140) + "\n" + prose(61, 140))]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    start = docs
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "").cache()
        if name != "packing":
            assert docs.columns == start.columns
            kept[name] = [r.doc_id for r in docs.collect()]
    assert sorted(kept["quality_rules"]) == [*range(40), 50, 51, 54]
    assert 50 not in kept["line_dedup"] and 54 in kept["line_dedup"]
    assert set(kept["jaccard_join"]) >= set(range(40)) - {4} and len(set(kept["jaccard_join"])) == len(kept["jaccard_join"])
    assert set(kept["mix_sources"]) <= set(kept["jaccard_join"]) and len(kept["mix_sources"]) > len(kept["jaccard_join"])
    sequences = defaultdict(int)
    for r in docs.collect():
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024


def test_empty_pipeline(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
    assert docs.count() == 0


def helper_names() -> list[str]:
    """Every name that the operators give a column of their own, as far as their text tells."""
    found = set()
    for p in Path(corpus_pipeline.__file__).parent.joinpath("helicase", "llm").glob("*.py"):
        text = p.read_text()
        found |= set(re.findall(r"""["'](_[A-Za-z_]+)["']""", text)) | set(re.findall(r'\.alias\("([A-Za-z_]+)"\)', text))
        found |= set(re.findall(r'withColumn\(\s*"([A-Za-z_]+)"', text)) | set(re.findall(r"boxed\([^)]*?([a-z_]+)=", text)) | {"row", "own_id", "own_key"}
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


def test_columns_of_any_name_come_through(spark):
    """A column of every helper name, with values of its own, changes nothing and comes back as it was."""
    names = helper_names()
    assert {"_id", "_key", "_piece", "_gone", "_likely", "_bits", "_copies", "_line_id", "_n_dropped", "n_dropped", "row", "own_key"} <= set(names)
    texts = [(i, prose(i, 140)) for i in range(12)]
    texts += [(50, prose(3, 140)), (51, near(prose(4, 140), 1, 1)), (52, prose(60, 140).upper().replace(" ", "!! ")), (53, "too short"), (54, prose(5, 140) + "\n" + prose(61, 140))]
    plain = spark.createDataFrame(rows_of(texts), SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    full = plain.select("*", *[F.concat_ws("-", F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, step in corpus_pipeline.STAGES[:-1]:
        plain, full = stage(step(spark, plain, "")), stage(step(spark, full, ""))
        assert full.columns[5:] == names, name
        rows = full.collect()
        assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, plain.collect())), name
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names), name
