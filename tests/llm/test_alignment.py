"""Token alignment against whole texts encoded by the libraries and compared byte by byte."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers
from public_tokenizers import path

from clientele.llm import alignment, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner.of(alignment.ByteLevel.read(path("byte_bpe_50k.json")), alignment.Pieces.read(path("piece_bpe_32k.model")))


@pytest.fixture(scope="module")
def plain(aligner):
    """Groups of a text, from the definitions."""
    a = tokenizers.Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    shown = {c: bytes([i]) for c, i in alignment._bytes_of_characters().items()}

    def groups(text):
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        bytes_a = [b"".join(shown[c] for c in t) for t in ids_a.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        raw = (" " + text).encode()
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return []
        out, x, y, at_a, at_b, own = [], 0, 0, 0, 0, ([], [])
        while x < len(bytes_a) or y < len(bytes_b):
            if at_a <= at_b:
                own[0].append(ids_a.ids[x])
                at_a, x = at_a + len(bytes_a[x]), x + 1
            else:
                own[1].append(ids_b[y])
                at_b, y = at_b + len(bytes_b[y]), y + 1
            if at_a == at_b:
                out.append(own)
                own = ([], [])
        return out
    return groups


def expected(rows, plain):
    groups = [plain(t) for _, t in rows]
    counts = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for (i, _), g in zip(rows, groups, strict=True):
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(counts[k] == best[k[1]] for k in links),
                    sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def texts(seed=2):
    rng = random.Random(seed)
    some = ["the", "straße", "naïve", "日本語", "🙂", "x" * 40, "<|endoftext|>", "<s>", "don't", "\n\n", "\t", " ", "▁", "1234", "Größe,", "\x00", "ﬁ", "…"]
    made = [" ".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(120)]
    return [*made, None, "", " ", "  ", "a", " a ", "tie tie", "tie tie", "y" * 3000, "▁ a", "a▁ b c"]


@pytest.mark.parametrize("segment, chunk_bits, fan_bits", [(1 << 16, 14, 4), (1, 3, 1), (40, 5, 2), (200, 4, 1)])
def test_equals_the_definitions_whole_and_cut(make, aligner, plain, monkeypatch, segment, chunk_bits, fan_bits):
    for name, value in (("SEGMENT", segment), ("CHUNK_BITS", chunk_bits), ("FAN_BITS", fan_bits)):
        monkeypatch.setattr(alignment, name, value)
    rows = [*enumerate(texts()), (None, "no id here"), (None, "no id here")]
    docs = make(rows).withColumnRenamed("kept", "links").withColumnRenamed("source", "groups").withColumnRenamed("lang", "row")
    got = alignment.with_link_scores(queries.staged(alignment.align(docs, aligner)), aligner).collect()
    key = lambda t: tuple(map(str, t))
    done = [(r.doc_id, r.n_a, r.n_b, r.n_links, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got]
    assert sorted(done, key=key) == sorted(expected(rows, plain), key=key)


def test_empty_tables(make, aligner):
    none = alignment.align(make([(1, "a")]).limit(0), aligner)
    assert alignment.with_link_scores(none, aligner).count() == 0


def test_the_query_equals_the_definitions_on_a_whole_table(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.token_alignment(spark, SF).collect()]
    assert sorted(got) == sorted(expected(rows, plain))


def test_ranks_are_used_only_where_they_build_tokens_as_listed(aligner):
    assert aligner.a.ranked
    text = [" the cat's naïve 日本 <|endoftext|>", " " + "ab" * 500]
    by_library = alignment.ByteLevel(aligner.a.definition)
    by_library.ranked = False
    assert by_library.encoder()(text) == aligner.a.encoder()(text)
    pairs = [tuple(x.encode() for x in p) for p in (("a", "b"), ("b", "c"), ("ab", "c"))]
    made = alignment.ByteLevel.__new__(alignment.ByteLevel)
    made.ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    assert made._built_as_listed(pairs)
    assert not made._built_as_listed([*pairs[:2], (b"a", b"bc")])


def test_composition_is_associative(aligner):
    rng = random.Random(9)
    for _ in range(300):
        parts = []
        for n in range(rng.randrange(1, 7)):
            ids = lambda: ([rng.randrange(9)] * rng.randrange(3), [rng.randrange(9)] * rng.randrange(3))
            closed = rng.random() < .5
            parts.append(alignment.Fragment(closed, ids(), ids() if closed else ([], [])))

        def fold(lo, hi):
            if hi - lo == 1:
                return parts[lo], []
            middle = rng.randrange(lo + 1, hi)
            (x, gx), (y, gy) = fold(lo, middle), fold(middle, hi)
            whole, group = alignment.compose(x, y)
            return whole, gx + ([group] if group else []) + gy
        assert fold(0, len(parts)) == fold(0, len(parts))
        assert alignment.compose(alignment.NONE, parts[0]) == (parts[0], None) == alignment.compose(parts[0], alignment.NONE) \
            or not parts[0].closed or parts[0].tail != ([], [])


def test_every_link_is_possible_and_the_list_is_bounded_by_the_vocabularies(aligner):
    assert len(aligner.links) <= sum(map(len, aligner.a.tokens)) * 2 + sum(map(len, aligner.b.tokens)) * 2
    assert (aligner.links[1:] > aligner.links[:-1]).all()


def test_cuts_keep_all_characters():
    for text in ("a b c d", "a  b c", "  lead", "trail ", "x▁ y z", "", "a\n b c"):
        for most in (1, 3, 100):
            pieces = alignment.cut_text(text, most)
            assert "".join(pieces) == " " + text and all(p[:1] == " " for p in pieces)
