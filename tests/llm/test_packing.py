from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helicase.llm.common import tokenizer_path
from helicase.llm.packing import class_of, cut_lengths, pack_documents, padding
from helicase.llm.token_files import decode_blocks, encode_blocks, token_files_round_trip
from helicase.llm.tokens import Encoder

from .conftest import awkward, prose


def ids_of(name, texts, end):
    tok = Tokenizer.from_file(tokenizer_path(name))
    return [[*e.ids, end] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(name):
    odd = ["", " ", "a", " a b", "a  b", "a\n\nb", "a \nb", "it's he'll.", "a. b, c.", "x\0y z", "\n", "ΑΣ ΑΣ, Σ.", "İ x.", "é á. b", "日本 語. x", "½. x²."]
    texts = odd + [prose(i) for i in range(5)] + [r[1] or "" for r in awkward()]
    enc = Encoder(name)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [x[:-1] for x in ids_of(name, texts, 0)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_every_letter_and_mixed_scripts(name):
    """Every letter of Unicode before a comma and a full stop, mixed scripts, and texts of special tokens, as the library's plain call has them."""
    import random
    import sys

    letters = [chr(c) for c in range(0x80, sys.maxunicode + 1) if chr(c).isalpha() and not 0x3400 <= c < 0xE000 and c < 0x20000]
    texts = [" ".join(f"x{c}, {c}. {c}" for c in letters[i:i + 50]) for i in range(0, len(letters), 50)]
    r = random.Random(3)
    pool = letters + list("abcXYZ019.,;'-!  \n\u0301\u0323") * 400
    texts += ["".join(r.choice(pool) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    special = [t.content for t in Tokenizer.from_file(tokenizer_path(name)).get_added_tokens_decoder().values()]
    texts += [form.format(t=x) for t in special for x in (t, t.upper()) for form in ("{t}", "a {t} b", "a{t}b, c", "x. {t}{t}\ny")]
    enc = Encoder(name)
    want = [x[:-1] for x in ids_of(name, texts, 0)]
    wrong = [t for t, raw, w in zip(texts, enc.encode(texts), want) if np.frombuffer(raw, "<u4").tolist() != w]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_that_boundaries_do_not_tell_apart(name):
    """Where ids at word boundaries can't tell joined words apart, they are encoded otherwise, to the same ids."""
    texts = [prose(i) for i in range(5)] + ["ab cd ef. 10 a0b\nx-y z, \u0958 \u0958x.", "ab cd"]
    want = [x[:-1] for x in ids_of(name, texts, 0)]
    enc = Encoder(name)
    assert enc._encode_marked([" ab", " cd"] if enc.keeps_space else ["ab", "cd"])
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want
    enc = Encoder(name)
    enc.bound = np.zeros_like(enc.bound)
    assert not enc._encode_marked(["ab"])
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == want


@given(st.integers(1, 5000))
def test_cuts_fill_classes(total):
    lengths = cut_lengths(total, 1024, 32)
    assert sum(lengths) == total and all(0 < n <= 1024 for n in lengths)
    assert all(n * class_of(n, 1024) <= 1024 for n in lengths)
    assert all(n == 1024 // class_of(n, 1024) for n in lengths[:-1])


def test_every_token_once(documents):
    rows = awkward()
    want = defaultdict(list)
    for r, ids in zip(rows, ids_of("byte_bpe_50k.json", [r[1] for r in rows], 0)):
        want[r[0]].append(ids)
    pieces = pack_documents(documents).collect()
    per, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        assert any(len(w) == p.doc_tokens and w[p.start:p.start + p.length] == ids for w in want[p.doc_id])
        per[p.doc_id].append(p.length)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {k: sum(v) for k, v in per.items()} == {k: sum(map(len, v)) for k, v in want.items()}
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024


def test_little_padding(spark):
    df = spark.createDataFrame([(i, prose(i, 37 * (i % 40) + 1)) for i in range(400)], "doc_id long, text string").repartition(6)
    pieces = pack_documents(df)
    row = padding(pieces).first()
    assert row.share < 0.01
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pack_empty(empty):
    assert pack_documents(empty).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(0, 3))
def test_blocks_round_trip(values, kind):
    ids = np.array(values, np.uint32) if kind else np.array([v % 300 for v in values], np.uint32)
    raw, starts = encode_blocks(ids)
    assert decode_blocks(raw, starts, len(ids)).tolist() == ids.tolist()


def test_token_files(documents):
    import zlib

    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files_round_trip(documents, segment_ids=500).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    want = defaultdict(list)
    for r, ids in zip(rows, ids_of("word_bpe_49k.json", [r[1] for r in rows], 2)):
        want[r[0]].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens


def test_token_files_empty(empty):
    assert token_files_round_trip(empty).count() == 0
