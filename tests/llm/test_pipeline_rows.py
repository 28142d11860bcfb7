"""The rows of each pipeline stage but the trained one, against plain Python versions of the stages."""

import zlib

import numpy as np
from test_decontaminate import brute
from test_jaccard import roots, shingles
from test_pii import base, secrets

import corpus_pipeline
from plumbline.llm import packing
from plumbline.llm.common import stored

SF = "/root/testdata/sf0.001"


def masked(text):
    """Each span, from the left, becomes its kind; one that overlaps the last adds only its length."""
    kinds = ["email", "ip", "card", "phone", "secret"]
    spans = sorted((int(start), int(end), kinds.index(kind)) for kind, start, end in (s.split(":") for s in base(text) + secrets(text)))
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kinds[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_rows_of_each_stage(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    stage = dict(corpus_pipeline.STAGES)

    # All documents go through the jaccard stage, so that the copies which the classifier drops are met too.
    rows = docs.collect()
    own = roots([(r["doc_id"], shingles(r["text"], 5)) for r in rows], 80)
    left = sorted((tuple(r) for i, r in enumerate(rows) if own[i] is None or own[i] == r["doc_id"]), key=str)
    docs = stored(stage["jaccard"](spark, docs, SF), "jaccard")
    assert whole(docs) == left and len(left) < len(rows)

    rows = docs.collect()
    clean = {doc for doc, _, hit, _ in brute([(r["doc_id"], r["text"]) for r in rows], bench) if not hit}
    left = sorted((tuple(r) for r in rows if r["doc_id"] in clean), key=str)
    docs = stored(stage["decontamination"](spark, docs, SF), "decontamination")
    assert whole(docs) == left and len(left) < len(rows)

    rows = docs.collect()
    texts = {r["doc_id"]: masked(r["text"]) for r in rows}
    left = sorted((tuple((r.asDict() | {"text": texts[r["doc_id"]], "n_chars": len(texts[r["doc_id"]])}).values()) for r in rows), key=str)
    docs = stored(stage["pii"](spark, docs, SF), "pii")
    assert whole(docs) == left and any(r["text"] != texts[r["doc_id"]] for r in rows)

    encoder = Tokenizer.from_file(packing.tokenizer_path())
    pieces = stage["packing"](spark, docs, SF).collect()
    found, places = {}, {}
    for p in pieces:
        found.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["ids_crc32"]))
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(found) == set(texts)
    for doc, text in texts.items():
        ids, at = np.array([*encoder.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for start, length, crc in sorted(found[doc]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
