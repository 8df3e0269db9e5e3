import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnflow.llm import packing, tokens
from tarnflow.llm.common import read_table

from .conftest import with_clashes


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_cached_encoder_is_the_tokenizer(tokenizer):
    rng, e = random.Random(9), tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER), chunks=50, pieces=20)
    parts = ["a", "Bc", "'s", "'S", "é", "É", "J̌", "Σ", "ς", "İ", "1", "٣", "²", " ", "\n", "\x1c", "<|endoftext|>", "<|", "ß", "漢", "-", ".", "Ǆ", "ﬁ", "😀", "‍", "\x00", "\xa0", "ª"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(e.encode([t.encode()])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_many_texts_at_once_are_cut_as_the_tokenizer_cuts(tokenizer):
    rng, e = random.Random(4), tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER), pieces=300)
    parts = [chr(c) for c in range(0x260)] + ["'s", "'RE", "'ll", "'Ve", "'", "''s", " ", "  ", "漢", "😀", "’", "́", "İ", "a", "B", "1", "<|endoftext|>", "<|ENDOFTEXT|>"] * 8
    for _ in range(10):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
        got = [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for t in texts])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    broken = [b"abc\xff d\xc3", b"\xe4 x\xc2", b"", b"ok"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(broken)] == [tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in broken]
    assert e.encode([]) == [] and e.encode([b"", b" \n", "\xa0".encode()]) == [b"", b"", b""]


def test_known_words_beside_other_signs_are_not_learned_again(tokenizer):
    e = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    words, signs = ["one", "two", "three", "été"], [".", ",", "(", '"', "--"]
    held = lambda: len(e.chunks.young) + len(e.pieces.young)
    e.encode([" ".join([*words, *signs]).encode()])
    before, text = held(), " ".join(a + w + b + v.title() + a for a in signs for b in signs for w in words for v in words[:3])
    assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert held() == before


def laid_out(slots, histogram):
    """Every piece's place, from the slots: (sequence, offset, length)."""
    rank, places = {k: 0 for k in histogram}, []
    for s in slots:
        assert s.lo == rank[s.length]
        for r in range(s.hi - s.lo):
            places.append((s.first + r // s.each, s.offset + r % s.each * s.length, s.length))
        rank[s.length] = s.hi
    assert rank == histogram
    return places


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_slots_place_each_piece_once_without_gaps(histogram):
    slots, n = packing.best_two_fit(histogram, 64)
    by = {}
    for seq, offset, length in laid_out(slots, histogram):
        by.setdefault(seq, []).append((offset, length))
    assert sorted(by) == list(range(n))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert n >= -(-sum(k * v for k, v in histogram.items()) // 64)


def test_one_out_two_in_fills_a_bin():
    # Greedy takes 6 and 3 of 10; 2 + 2 fill the gap that 3 leaves.
    slots, n = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    first = sorted(x[2] for x in laid_out(slots, {6: 1, 3: 1, 2: 2}) if x[0] == 0)
    assert first == [2, 2, 6] and n == 2


def test_pair_search_is_the_best_pair():
    rng = random.Random(1)
    for _ in range(300):
        lengths = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 10))))
        counts, most = np.array([rng.randint(0, 2) for _ in lengths]), rng.randint(1, 60)
        stock = [int(k) for k, c in zip(lengths, counts) for _ in range(c)]
        sums = [a + b for i, a in enumerate(stock) for b in stock[:i] if a + b <= most]
        got = packing._best_pair(lengths, counts, most)
        assert (sum(got) if got else None) == max(sums, default=None)


def check(rows, docs, tokenizer):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and 0 < length <= packing.CAPACITY
            at += length
        assert at <= packing.CAPACITY
    want = []
    for doc_id, text in docs:
        ids = ids_of(tokenizer, text)
        for p, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = np.array(ids[at : at + packing.CAPACITY], "<u4")
            want.append((doc_id, p, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    return len(by), -(-sum(w[3] for w in want) // packing.CAPACITY)


def test_documents_table(spark, sf_dir, tokenizer):
    docs = read_table(spark, sf_dir, "documents")
    n, least = check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert n <= least + 1


def test_odd_rows_and_empty_table(spark, odd, none, tokenizer):
    check(packing.pack(with_clashes(odd)).collect(), [(r.doc_id, r.text) for r in odd.collect()], tokenizer)
    assert packing.pack(none).count() == 0


def test_sequences_hold_their_pieces(spark, odd, tokenizer):
    packed = packing.pack(odd, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * packing.CAPACITY for r in rows)
    assert sum(r.n_tokens for r in rows) == sum(len(ids_of(tokenizer, r.text)) for r in odd.collect())


def test_lengths_outside_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.best_two_fit({65: 1}, 64)
