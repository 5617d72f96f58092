"""Packing against the tokenizer, and its balance, padding and cuts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import frames, kernel, packing, queries, token_files
from tests.llm.test_operators import corpus, docs_of

PATH = queries.tokenizer_path(queries.PACKED_TOKENIZER)


def packed(spark, docs, **keys):
    return packing.pack(docs, frames.scratch(spark, "packed"), PATH, 2, **keys)


def check(rows, pieces, capacity, padded=0):
    """Every document's ids lie in its pieces once; sequences have no gap, no overlap, and no more padding than this."""
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.length >= 1 and len(p.ids) == 4 * p.length
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, np.frombuffer(p.ids, "<u4").tolist()))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    if len({i for i, _ in rows}) == len(rows):
        got = []
        for (_, tokens), parts in by_doc.items():
            ids, at = [], 0
            for start, length, some in sorted(parts):
                assert start == at
                ids, at = ids + some, at + length
            assert at == tokens
            got.append(ids)
        assert sorted(got) == want
    assert sum(p.length for p in pieces) == sum(map(len, want))
    pad = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    assert pad <= padded
    return by_sequence


def test_encoder_matches_the_tokenizer_with_word_ends():
    encoder = token_files.Encoder(PATH, remember=300)
    r = random.Random(1)
    symbols = [*"ab'sé× \n\t.,!?12 ’ 　\xa0中́\x1c<=>İΣς̸ſﬁ", "<|endoftext|>", "<|startoftext|>", "'re", " the", "Don't", "ΑΣ "]
    texts = ["".join(r.choice(symbols) for _ in range(r.randrange(60))) for _ in range(1500)] + ["", None, " ", "\n\n x"]
    for part in kernel.slices(pa.array(texts), 5000):
        ids, first = encoder.encode(part)
        for i in range(part.n):
            assert ids[first[i] : first[i + 1]].tolist() == encoder.tokenizer.encode(texts[part.first + i] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("keys", [{}, {"capacity": 64, "block": 500, "group": 2}, {"capacity": 48, "block": 100, "group": 3}, {"capacity": 1}])
def test_packing_matches_the_tokenizer(spark, keys):
    rows = corpus(120, 3)
    pieces = packed(spark, docs_of(spark, rows).repartition(13), **keys).collect()
    check(rows, pieces, keys.get("capacity", 4096))


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (None, ""), (None, "word " * 300)]
    pieces = packed(spark, docs_of(spark, rows), capacity=64).collect()
    check(rows, pieces, 64)
    assert sum(p.length for p in pieces if p.doc_id is None) == 1 + 1 + 301
    assert packed(spark, docs_of(spark, rows).where("false")).count() == 0
    assert packed(spark, docs_of(spark, [(7, None)])).drop("ids", "sequence_id").collect() == [(7, 0, 1, 1, 0)]


def test_one_document_of_a_third_of_all_tokens(spark):
    rows = [(0, "alpha beta gamma " * 3000), *((i, f"word{i} " * (i % 90)) for i in range(1, 200))]
    check(rows, packed(spark, docs_of(spark, rows).repartition(5), capacity=256).collect(), 256)


def test_sequences_cost_about_the_same():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 1200, 3000)
    room = np.full(int(lengths.sum()) // 4096, 4096)
    dealt, rest = packing.assign(lengths, room)
    load = np.zeros(len(room))
    np.add.at(load, dealt[:, 3], packing.cost(dealt[:, 2]))
    full = np.bincount(dealt[:, 3], dealt[:, 2], len(room))
    assert (full == 4096).all() and sum(n for *_, n in rest) == lengths.sum() - full.sum()
    order, naive = np.argsort(-lengths, kind="stable"), np.zeros(len(room))  # filled one after the other
    at = np.minimum(np.cumsum(lengths[order]) // 4096, len(room) - 1)
    np.add.at(naive, at, packing.cost(lengths[order]))
    assert load.std() < 0.25 * naive.std() and load.max() < 1.1 * load.mean()
    assert len(dealt) - len(lengths) + len(rest) < 2 * len(room)  # few are cut


def test_descending_documents_go_to_the_least_cost():
    dealt, rest = packing.assign(np.array([5, 9, 3, 9, 4, 2]), np.array([16, 16]))
    assert dealt.tolist() == [[1, 0, 9, 0, 0], [3, 0, 9, 1, 0], [0, 0, 5, 0, 9], [4, 0, 4, 1, 9], [2, 0, 3, 1, 13], [5, 0, 2, 0, 14]] and rest == []


def test_sequences_are_assembled_in_order(spark):
    rows = corpus(40, 8)
    pieces = packed(spark, docs_of(spark, rows), capacity=128)
    by = {}
    for p in sorted(pieces.collect(), key=lambda p: p.offset):
        ids, sizes = by.setdefault(p.sequence_id, (b"", []))
        by[p.sequence_id] = (ids + p.ids, [*sizes, p.length])
    got = packing.sequences(pieces).collect()
    assert {s.sequence_id: (bytes(s.ids), s.piece_lengths) for s in got} == by
    assert all(s.length == sum(s.piece_lengths) == len(s.ids) // 4 for s in got)


def test_query_has_the_contract_columns(spark):
    out = queries.op11_packing(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
