import random

import public_tokenizers as P
import pytest
import tiktoken

from tabwise.llm.bpe import Encoder, encode_documents, packed_to_list, read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def random_text(rnd, n):
    kinds = [lambda: chr(rnd.randrange(32, 127)), lambda: " ", lambda: "a", lambda: chr(rnd.randrange(9, 14)),
             lambda: chr(rnd.randrange(0x1C, 0x21)), lambda: chr(rnd.randrange(0xA0, 0x3000)), lambda: chr(rnd.randrange(0x1F300, 0x1F700))]
    return "".join(rnd.choice(kinds)() for _ in range(n))


def test_as_the_library(encoder, library, documents):
    rnd = random.Random(3)
    texts = [random_text(rnd, rnd.randrange(1, 80)) for _ in range(3000)]
    texts += [r["text"] for r in documents.select("text").collect()]
    texts += ["", " ", "\n\n  \n x", "<|endoftext|>", "a" * 3000, "ab" * 2000 + " " * 500, "it's they'LL we've"]
    for t in texts:
        ids = packed_to_list(encoder.encode(t))
        assert ids == library.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t.encode()


def test_sections_do_not_change_the_ids(encoder, library, documents, monkeypatch):
    import tabwise.llm.bpe as bpe

    monkeypatch.setattr(bpe, "SECTION", 50)
    for r in documents.select("text").limit(30).collect():
        assert packed_to_list(encoder.encode(r["text"])) == library.encode_ordinary(r["text"])


def test_appending_and_editing(encoder):
    rnd = random.Random(5)
    for _ in range(300):
        data = random_text(rnd, rnd.randrange(1, 60)).encode()
        cut = rnd.randrange(len(data) + 1)
        assert encoder.prefix_tokens(data, encoder.prefix_tokens(data[:cut])) == encoder.prefix_tokens(data)
        a, b = sorted((rnd.randrange(len(data) + 1), rnd.randrange(len(data) + 1)))
        new = random_text(rnd, rnd.randrange(0, 6)).encode()
        out, table = encoder.edited(data, encoder.prefix_tokens(data), a, b, new)
        assert out == data[:a] + new + data[b:] and table == encoder.prefix_tokens(out)


def test_an_edit_reuses_the_table(encoder):
    data = b"the quick brown fox jumps over the lazy dog and on " * 40
    last = encoder.prefix_tokens(data)
    made = []
    real = encoder.prefix_tokens
    encoder.prefix_tokens = lambda *a: made.append(a[2]) or real(*a)
    try:
        out, table = encoder.edited(data, last, 100, 103, b"red")
    finally:
        del encoder.prefix_tokens
    assert table == encoder.prefix_tokens(out) and len(made) < len(data) / 4


def test_defined_cases(spark, library):
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (None, "x y", 7), (3, "word " * 60000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode_documents(df, PATH, P.PATTERN, decode=True).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got[:4]] == [(1, 0), (2, 0), (2, 0), (None, 2)]
    assert packed_to_list(got[4]["ids"]) == library.encode_ordinary("word " * 60000)
    assert bytes(got[4]["decoded"]) == b"word " * 60000
    assert encode_documents(df.limit(0), PATH, P.PATTERN).collect() == []


def test_columns_of_any_name(spark, library):
    df = spark.createDataFrame([(1, "some text", "x"), (2, None, "y")], "doc_id long, text string, __text string")
    got = encode_documents(df, PATH, P.PATTERN, keep=df.columns).collect()
    assert [tuple(r)[:3] for r in got] == [(1, "some text", "x"), (2, None, "y")]
    assert packed_to_list(bytes(got[0]["ids"])) == library.encode_ordinary("some text") and got[1]["n_tokens"] == 0
