import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frameloom.llm.packing import encoder, fullest, pack, pack_documents, patterns, pieces


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Zé\n\t\r\v'sñ12!. \x85　—中😀Ω")), max_size=40))
def test_ids_are_those_of_the_tokenizer_file(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken").encode(text)
    assert np.frombuffer(own, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(docs, rows, tokenizer):
    got = pack_documents(docs).collect()
    want = Counter()
    for i, text, _, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 2048 or 2048
            want[i, k, at, n, zlib.crc32(ids[at: at + n].tobytes())] += 1
            at, k = at + n, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    inside = defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in inside.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(inside) <= -(-sum(r["length"] for r in got) // 2048) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_fullest_is_the_best_subset(lengths, room):
    use = fullest(room, dict(Counter(lengths)))
    assert all(Counter(lengths)[n] >= k for n, k in use.items())
    best = max(sum(c) for r in range(len(lengths) + 1) for c in combinations(lengths, r) if sum(c) <= room)
    assert sum(n * k for n, k in use.items()) == best


def test_patterns_use_every_piece_once():
    counts = {100: 1_000_003, 2048: 7, 1500: 10, 548: 9, 1: 12}
    used = Counter()
    for times, use in patterns(counts):
        assert sum(n * k for n, k in use.items()) <= 2048
        for n, k in use.items():
            used[n] += times * k
    assert used == counts


def test_common_length_in_blocks(docs, spark):
    parts = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "700L as length", "id as ids_crc32")
    got = pack(parts, block=64)
    assert got.count() == 5000 and got.select("sequence_id", "offset").distinct().count() == 5000
    assert got.select("sequence_id").distinct().count() == 2500


def test_empty_table(none):
    assert pack_documents(none).count() == 0
    assert pieces(none, with_ids=True).columns[-1] == "ids"
