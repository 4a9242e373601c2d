"""Token ids against the public libraries."""

import os
import random

import pytest

from seriatim.llm import bpe

TEXTS = [
    "Patient's HR was 110/min -- AFib!",
    "<|endoftext|> is ordinary text",
    "",
    " ",
    "\n\n  two   blanks\t\n",
    "患者は安定している 😀😀 naïve ﬁ",
    "it's we'LL I'VE 'tis",
    "x" * 5000,
    "ab" * 3000,
    "___" * 200,
    "﻿History\x00\x01",
    "123456789 " * 50,
]

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.FOLDER, "byte_bpe_50k.json")), reason="no vocabulary files")


def test_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(bpe.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = bpe.encoder()
    assert [e.encode(x) for x in TEXTS] == [x.ids for x in t.encode_batch(TEXTS, add_special_tokens=False)]
    assert e.encode(None) == []


def test_short_and_long_merges_agree():
    rng, rank = random.Random(1), bpe.ranks()
    for _ in range(500):
        w = bytes(rng.choices(b"abcdexxx \xe3\x81\x82 12", k=rng.randint(1, 140)))
        assert bpe.merge_short(w, rank) == bpe.merge_long(w, rank)


def test_round_trip():
    back = {v: k for k, v in bpe.ranks().items()}
    e = bpe.encoder()
    for t in TEXTS:
        assert b"".join(back[i] for i in e.encode(t)).decode() == t


def test_other_vocabulary():
    import tiktoken

    rank = bpe.ranks(bpe.FOLDER, "byte_bpe_multi_50k")
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=rank, special_tokens={})
    e = bpe.encoder(bpe.FOLDER, "byte_bpe_multi_50k")
    assert [e.encode(x) for x in TEXTS] == [enc.encode_ordinary(x) for x in TEXTS]


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "z"), (2, None, "z"), (3, "", "z"), (None, "c", "z")], "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in bpe.encoded(df).collect()), key=str)
    assert got == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (3, []), (None, [66])], key=str)
    assert sorted(r["n_tokens"] for r in bpe.lengths(df).collect()) == [0, 0, 1, 2, 2]
    assert bpe.encoded(df.limit(0)).count() == 0
