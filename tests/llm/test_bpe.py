"""Chunked encoding against the library itself."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from locusflow.llm import bpe
from locusflow.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark, sf_dir, library, small_rows):
    got = {r.doc_id: r for r in QUERIES["op11_chunked_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(small_rows)
    for doc, text, _ in small_rows:
        ids = library.encode_ordinary(text or "")
        r = got[doc]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


TEXTS = [
    None, "", "a", "it's we'll they've 'llama ''ll x'l", "one  two   three \n\n four\t\tfive   ", "   ", "x" * 200, " " * 150 + "y", "ab " * 70,
    "1234567890" * 20, "՘՘a՘ Ᲊᲊ \U000323b0\U00032400b", "größe naïve été 東京都 今日は 🙂🙂 ok ½ ² ①", "a b  c\x1c\x1dd\x85e", "!?" * 100 + "'ll" * 60,
    "<|endoftext|> is text",
]


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 4), (7, 3), (32, 32), (1, 1)])
def test_small_chunks(frame, library, chunk, overlap):
    random.seed(chunk)
    alphabet = ["a", "b", "'", "s", "ll", " ", "  ", "\n", "1", "!", "é", "՘", "🙂"]
    more = ["".join(random.choices(alphabet, k=random.randrange(5, 120))) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(TEXTS + more + more[:5])] + [(None, "no id " * 9), (None, "no id " * 9)]
    df = bpe.decode_ids(bpe.encode_documents(frame(rows).withColumn("ids", F.lit("old")), chunk=chunk, overlap=overlap))
    got = df.collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(d), t or "") for d, t in rows)
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or ""), r.text
        assert bytes(r.bytes) == (r.text or "").encode()


def test_seams_reopen(spark, frame, tmp_path, monkeypatch):
    """A pre-token longer than the overlap makes the text go round again."""
    calls = []
    scanned = bpe._scanned
    monkeypatch.setattr(bpe, "_scanned", lambda t, r, c, o: calls.append(c) or scanned(t, r, c, o))
    rows = [(0, "word " * 30), (1, "a " + "z" * 90 + " b")]
    assert bpe.encode_documents(frame(rows), chunk=16, overlap=4).count() == 2
    assert calls == [16, 128]


def test_more_space_than_the_library_takes(library):
    text = "a" + " " * 1_000_000 + "b"
    with pytest.raises(ValueError):
        library.encode_to_numpy(text, disallowed_special=())
    coder = bpe.coder()
    ids = coder.encode(text)
    assert coder.decode(ids.tolist()) == text.encode()
    assert ids.tolist() == [64, *library._encode_single_piece(" " * 999_999), *library._encode_single_piece(" b")]


def test_classes_of_all_characters(library):
    """Every assigned character that Unicode versions dispute splits as the library splits it."""
    import regex

    coder = bpe.coder()
    late = [c for c in map(chr, range(0x80, 0x110000)) if regex.match(r"\p{L}|\p{N}", c) and not c.isalnum()]
    text = "".join(f"x{c}y1{c}2 " for c in late[::7])
    pieces = [m.group() for m in coder.matcher(text).finditer(text)]
    assert [i for p in pieces for i in library._encode_single_piece(p)] == library.encode_ordinary(text)


def test_empty_table(frame):
    got = bpe.decode_ids(bpe.encode_documents(frame([])))
    assert got.collect() == [] and dict(got.dtypes)["ids"] == "array<int>"
