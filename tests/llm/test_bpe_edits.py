import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe, edits
from tidemark.llm.registry import masking_edits, rank_file, split_pattern

PIECES = ["ab", " c", "  ", "\n", "\t", "'s", "'", "r", " 12", "é", "漢字", "１２", "!?.", "\r", "\x0b", "\x85", "᠎", "　", "😀", "x", " The", "ing", "@", "0"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.parse_ranks(rank_file()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(rank_file()), special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def some(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


def test_random_texts_as_the_library(encoder, library):
    rng = random.Random(1)
    texts = [some(rng, rng.randrange(0, 40)) for _ in range(3000)] + ["", " ", "a" * 3000, "".join(rng.choice("abcdeth") for _ in range(4000)), "<|endoftext|>"]
    for text, packed in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids(packed) == library.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()


def test_scalar_and_batched_trees_agree(encoder):
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abcdefgh tion") for _ in range(rng.randrange(1, 33))) for _ in range(500)]
    assert [ids(p) for p in encoder.merge_many(words, 32)] == [encoder.merge_one(w) for w in words]


def test_cache_can_be_emptied_at_any_time(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    small = bpe.Encoder(bpe.parse_ranks(rank_file()), public_tokenizers.PATTERN)
    for text in ("one two three four five", "one six seven, eight! nine", "one two"):
        assert ids(small.encode_all([text])[0]) == library.encode_ordinary(text)


def test_tables(spark, sf, library, frame, awkward):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for docs, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (frame(awkward), [r[:2] for r in awkward]), (frame([]), [])):
        coded = bpe.encode(docs, rank_file(), split_pattern(), decode=True)
        got = sorted(((r.doc_id, r.n_tokens, ids(r.ids), bytes(r.decoded)) for r in coded.collect()), key=str)
        assert got == sorted(((i, len(x), x, (t or "").encode()) for i, t in rows for x in [library.encode_ordinary(t or "")]), key=str)
        back = bpe.decode(coded, rank_file()).collect()
        assert sorted((bytes(r.decoded) for r in back)) == sorted((t or "").encode() for _, t in rows)


def test_edits_keep_the_count(encoder):
    rng = random.Random(3)
    count = lambda chunk: len(encoder.encode_all([chunk])[0]) // 4
    for _ in range(400):
        text = some(rng, rng.randrange(0, 25))
        tree = edits.TokenTree(text, count)
        for _ in range(rng.randrange(1, 6)):
            offset, gone, come = rng.randrange(-1, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 50]), some(rng, rng.choice([0, 1, 2]))
            a = min(max(offset, 0), len(text))
            text = text[:a] + come + text[a + gone :]
            tree.edit(offset, gone, come)
            assert tree.text == text
            assert tree.n_tokens == len(encoder.encode_all([text])[0]) // 4


def test_only_touched_regions_are_encoded_again(encoder):
    text = " ".join(f"word{i}" for i in range(5000))
    tree = edits.TokenTree(text, lambda chunk: len(encoder.encode_all([chunk])[0]) // 4)
    tree.edit(20_000, 3, "new")
    assert 0 < tree.encoded < 60


def test_recount_of_tables(spark, sf, frame, awkward, encoder):
    mailed = [*awkward, (20, "write to a.b@example.com or 123456789 or c@d.org now"), (21, "1234567@8901234.com")]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for docs, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (frame(mailed), [r[:2] for r in mailed]), (frame([]), [])):
        got = sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited, r.edited) for r in edits.recount(docs, masking_edits, rank_file(), split_pattern()).collect()), key=str)
        want = []
        for i, t in rows:
            made, text = masking_edits(t or ""), t or ""
            for at, gone, come in made:
                text = text[:at] + come + text[at + gone :]
            before, after = (len(x) // 4 for x in encoder.encode_all([t or "", text]))
            want.append((i, before, len(made), after, text if made else None))
        assert got == sorted(want, key=str)
