import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import packing
from plumbline.llm.textscan import raw_texts


_HELD: dict = {}


def padding(sequences, capacity):
    return sum(0 if not n & (n - 1) else capacity - n for n in (sum(p[2] for p in s) for s in sequences))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60))
def test_pack_places_each_token_once(lengths):
    got = packing.pack(lengths, 64)
    held = {d: [] for d in range(len(lengths))}
    for s in got:
        assert 0 < sum(p[2] for p in s) <= 64
        for d, start, n in s:
            assert n > 0
            held[d].append((start, n))
    for d, pieces in held.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == lengths[d]
    assert padding(got, 64) == 0


def test_first_fit_by_tournament():
    tree = packing.Tournament(4, 10)
    assert [tree.place(n) for n in (6, 5, 4, 5, 3)] == [0, 1, 0, 1, 2]


def test_ids_equal_the_tokenizers(texts):
    from tokenizers import Tokenizer
    import pyarrow as pa

    odd = ["a<|startoftext|>b <|ENDOFTEXT|>", "It's 12 o'clock don't,,  's", "İI ΟΔΟΣ. \x1c fi", "x\x00y ​ z"]
    own = [t or "" for t in texts] + odd
    encoder = Tokenizer.from_file(packing.tokenizer_path())
    want = [[*e.ids, 2] for e in encoder.encode_batch(own, add_special_tokens=False)]
    got = packing.WordIds(packing.tokenizer_path()).ids(*raw_texts(pa.array(own)), 2)
    assert [x.tolist() for x in got] == want


def test_signs_are_words_of_their_own():
    import pyarrow as pa

    own = packing.WordIds(packing.tokenizer_path())
    own.ids(*raw_texts(pa.array([" ".join(b + w + a for w in ("alpha", "beta", "éta") for b in ("", "(", '"') for a in ("", ",", ".", "!!"))])), 2)
    assert len(own.hash) == 3 + 5  # not 3 * 3 * 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aBsTlz'.,;:!?*&%$#|\"()<>-_09 \t\n\x1c\x85\xa0×÷ßéÀÿİıŉſǅǰǿȀΣ²½漢\u0301\u0307\u0338\u200b😀")), max_size=14), max_size=6))
def test_ids_of_odd_signs(own):
    from tokenizers import Tokenizer
    import pyarrow as pa

    if "encoder" not in _HELD:
        _HELD.update(encoder=Tokenizer.from_file(packing.tokenizer_path()), words=packing.WordIds(packing.tokenizer_path()))
    want = [[*e.ids, 2] for e in _HELD["encoder"].encode_batch(own, add_special_tokens=False)]
    assert [x.tolist() for x in _HELD["words"].ids(*raw_texts(pa.array(own, pa.string())), 2)] == want


def test_pieces_of_documents(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(docs, group_docs=20).collect()
    rows = docs.collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for r in rows:
        ids = np.array([*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        own = by[r["doc_id"]]
        assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own)
        copies = sum(x["doc_id"] == r["doc_id"] for x in rows)
        assert sum(p["length"] for p in own) == copies * len(ids)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_empty(empty):
    assert packing.pack_documents(empty).count() == 0
