import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provenant.llm import packing, queries
from tests.llm.helpers import awkward

PATH = queries.tokenizer_path()
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.sampled_from(["Word, word. WORD's", "<|endoftext|> x<|ENDOFTEXT|>", "a\x01b \x01", "é.E\u0301!", "İstanbul, ΣΑΣ.", "a\u00a0b\u2003c", "don't. 'tis"]), min_size=1, max_size=8))
def test_chunked_tokenising_equals_the_tokenizer(texts):
    flat, offsets = packing.token_expander(PATH)(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=60))
def test_windows_hold_every_id_once_and_are_full(lengths):
    windows, rest = packing.pack_pieces([(i, 0, n) for i, n in enumerate(lengths)])
    seen = defaultdict(list)
    for size, window in windows:
        assert sum(p[2] for p in window) == size
        for doc, start, n in window:
            seen[doc].append((start, n))
    for size, window in packing.close_windows(rest, packing.TIERS):
        assert sum(p[2] for p in window) <= size
        for doc, start, n in window:
            seen[doc].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[i]):
            assert start == at
            at += k
        assert at == n


def test_step_groups_are_balanced():
    sizes = [2048, 256, 256, 512, 1024, 2048, 1024, 1024]
    groups = packing.step_groups(sizes, 2048)
    loads = np.bincount(groups, weights=sizes)
    assert loads.max() - loads.min() <= 2048


def check(docs, pieces):
    """Every document's ids lie in its pieces, windows are gapless and at most 2048 long."""
    want = sorted(tuple(ids_of(t)) for t in docs)
    by_sequence = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p["ids"])) == zlib.crc32(np.frombuffer(bytes(p["ids"]), dtype="<u4").tobytes())
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    return by_doc


def test_awkward_rows(spark):
    docs = awkward(spark)
    pieces = packing.pack_documents(docs, PATH).collect()
    by_doc = check([r["text"] for r in docs.collect()], pieces)
    assert [p["length"] for p in by_doc[3]] == [1] and [p["length"] for p in by_doc[4]] == [1]
    long = sorted(by_doc[5], key=lambda p: p["start"])
    assert b"".join(bytes(p["ids"]) for p in long) == np.array(ids_of("word " * 30_000), dtype="<u4").tobytes()
    assert len(by_doc[1]) >= 2 and len(by_doc[None]) >= 2


def test_empty_table(spark):
    assert packing.pack_documents(awkward(spark).limit(0), PATH).count() == 0


def test_query_against_the_tokenizer(spark, sf_dir):
    got = queries.op1_packing(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array(ids_of(text), dtype="<u4")
        at = 0
        for p in got[got["doc_id"] == doc_id].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    used = got.groupby("sequence_id")["length"].sum()
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding <= 2048 * max(1, spark.sparkContext.defaultParallelism)


@pytest.mark.parametrize("tiers", [(128, 256), (2048,)])
def test_other_tiers(spark, tiers):
    pieces = packing.pack_documents(awkward(spark), PATH, tiers=tiers).collect()
    assert max(sum(q["length"] for q in pieces if q["sequence_id"] == p["sequence_id"]) for p in pieces) <= tiers[-1]
