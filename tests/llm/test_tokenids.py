import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from galley.llm import tokenids
from galley.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_encoder_is_the_library(library, monkeypatch):
    rng = random.Random(5)
    parts = ["a", "b", " ", "\n", "\t", "\r", "é", "1", "!", "  ", "\n\n", "<|endoftext|>", "\xa0", "　", "'s", "\x85", "\x1c", "Word", " the", "᠎", "​"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [""]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for cached in (tokenids.CACHED, 50):
        monkeypatch.setattr(tokenids, "CACHED", cached)
        encoder = tokenids.Encoder(vocabulary())
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_pieces_in_a_row(library, monkeypatch):
    """Words that begin with a blank or a line feed need no border between them; a text that holds the border takes the old way."""
    encoder = tokenids.Encoder(vocabulary())
    pieces = [" one", "\ntwo", " don't", " 日本", " é", " x\ty", " 1,2", " ...", " Grüße"] * 700
    want = [np.array(library.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in pieces]
    assert encoder._in_a_row([*pieces, " a<|endoftext|>b"])[: len(pieces)] == want
    monkeypatch.setattr(encoder, "_pieces", lambda texts: pytest.fail("asked for a border") if texts else [])
    assert encoder._in_a_row(pieces) == want


@pytest.mark.parametrize("bits", [False, True])
def test_round_trip(bits):
    rng = np.random.default_rng(3)
    docs = [(k if k % 5 else None, rng.integers(0, 2 ** rng.integers(1, 33), int(n), dtype=np.uint64).astype("<u4")) for k, n in enumerate(rng.integers(0, 300, 40))]
    sink = io.BytesIO()
    writer = tokenids.Writer(sink, bits, block=128)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    reader = tokenids.Reader(pa.PythonFile(io.BytesIO(sink.getvalue()), mode="r"))
    back = [(d, np.concatenate([np.empty(0, "<u4"), *p])) for d, n, p in reader.documents()]
    assert [d for d, _ in back] == [d for d, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(back, docs))
    whole = np.concatenate([ids for _, ids in docs])
    assert (reader.ids(200, 500) == whole[200:700]).all()
    with pytest.raises(ValueError):
        tokenids.Reader(pa.PythonFile(io.BytesIO(sink.getvalue()[:-3]), mode="r"))


def brute(rows, library):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, tokenids.token_ids(docs, vocabulary()).collect()))
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], library))


def test_awkward(spark, awkward, library):
    got = list(map(tuple, tokenids.token_ids(awkward, vocabulary()).collect()))
    want = brute([(r.doc_id, r.text) for r in awkward.collect()], library)
    key = lambda r: (str(r[0]), r[2], r[3])  # noqa: E731 - rows of one id lie in an order of their own
    assert sorted((key(r) for r in got)) == sorted(key(r) for r in want)
    ordered = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in ordered] == [0, *np.cumsum([r[2] for r in ordered])[:-1]]
    assert [str(r[0]) for r in ordered] == [str(r[0]) for r in want]
    assert tokenids.token_ids(awkward.limit(0), vocabulary()).count() == 0
