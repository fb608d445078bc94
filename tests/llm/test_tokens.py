"""Byte-level BPE against the library that defines its results."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

from clientele.llm import bpe, queries

SF = "/root/testdata/sf0.001"
ALPHABET = "aaabeinst  \n\t\r'sé日本語🙂12!¶<|>́  \x1c_"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(path("byte_bpe_multi_50k.tiktoken"), PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(400)]
    return [*made, "", None, "a" * 50_000, "ab" * 20_000 + " x", " " * 3000 + "y", "<|endoftext|>", "é" * 9999, "tie", "tie"]


def test_the_perfect_hash_numbers_its_keys_without_a_gap(vocabulary):
    for keys in (list(vocabulary.ranks), [b""], [b"a", b"b"], [bytes([b]) * n for b in range(40) for n in range(1, 6)]):
        assert sorted(bpe.PerfectHash.of(keys).places(keys)) == list(range(len(keys)))
    assert len(bpe.PerfectHash.of([]).places([b"x"])) == 1
    with pytest.raises(ValueError):
        bpe.PerfectHash.of([b"a", b"a"])


def test_whole_pre_tokens_come_from_the_hash_and_the_others_from_the_heap(vocabulary, monkeypatch):
    seen, merge = [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda piece, ranks: seen.append(piece) or merge(piece, ranks))
    got = {p: np.frombuffer(b, np.int32).tolist() for p, b in vocabulary.resolve([" the", "qzxqzx"]).items()}
    assert got == {" the": [vocabulary.ranks[b" the"]], "qzxqzx": merge(b"qzxqzx", vocabulary.ranks)}
    assert seen == [b"qzxqzx"]


def test_merges_equal_the_step_by_step_definition(vocabulary):
    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            ranked = [(vocabulary.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in vocabulary.ranks]
            if not ranked:
                return [vocabulary.ranks[p] for p in parts]
            i = min(ranked)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
    rng = random.Random(4)
    for _ in range(500):
        piece = "".join(rng.choice("aabnéth") for _ in range(rng.randrange(1, 30))).encode()
        assert bpe.merged(piece, vocabulary.ranks) == plain(piece)


def test_ids_equal_the_library_and_decode_to_the_text(make, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 1000)
    rows = list(enumerate(texts())) + [(None, "no id")]
    docs = make([(i, t) for i, t in rows]).withColumnRenamed("kept", "ids").withColumnRenamed("source", "bytes")
    got = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(got) == len(rows)
    for row, (i, text) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), rows, strict=True):
        assert row.doc_id == i and row.ids == library.encode_ordinary(text or "") and bytes(row.bytes) == (text or "").encode()
    assert bpe.encode(docs.limit(0), vocabulary).count() == 0


def test_what_is_no_token_has_no_bytes(spark, vocabulary):
    rows = spark.createDataFrame([(1, [10 ** 6]), (2, None), (3, [5, None]), (4, [])], "doc_id long, ids array<int>")
    assert [r.bytes for r in bpe.decode(rows, vocabulary).orderBy("doc_id").collect()] == [None, None, None, b""]


def test_the_query_equals_the_library_on_a_whole_table(spark, library):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for row in table:
        ids = library.encode_ordinary(row.text or "")
        want[row.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.byte_bpe(spark, SF).collect()} == want


def test_slices_cover_all():
    for sizes in ([], [5], [1, 9, 2, 30, 1], [0, 0]):
        cut = list(bpe.slices(sizes, 10))
        assert [i for a, b in cut for i in range(a, b)] == list(range(len(sizes)))
        assert all(b - a == 1 or np.sum(sizes[a:b]) <= 10 for a, b in cut)
