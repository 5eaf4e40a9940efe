import base64
import random
import time

import numpy as np
import pytest

from affinis.llm import bpe

SCHEMA = "doc_id long, text string, tokens string"


@pytest.fixture(scope="module")
def content():
    with open(bpe.VOCABULARY, "rb") as file:
        return file.read()


def plain_bpe(ranks, data):
    """Merges of least rank, leftmost first, one at a time."""
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_tree_equals_plain_bpe(content):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    coder = bpe.Coder(content, leaf=16)
    r = random.Random(1)
    for alphabet in (b"ab", b"etaoin", bytes(range(33, 127)), b"a", b"the"):
        for n in (1, 17, 40, 333, 700):
            data = bytes(r.choice(alphabet) for _ in range(n))
            assert coder.tree(data.decode()) == plain_bpe(ranks, data)


def test_characters_of_several_bytes_at_the_joins(content):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    coder = bpe.Coder(content, leaf=8)
    r = random.Random(2)
    for alphabet in ("aé", "漢字", "🙂a", "ßüéñ"):
        text = "".join(r.choice(alphabet) for _ in range(150))
        assert coder.tree(text) == plain_bpe(ranks, text.encode())


def test_leaves_are_encoded_in_parallel(content):
    """Two threads take less time than one; the tokens are the same."""
    r = random.Random(3)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(4 << 20))
    taken, found = {}, {}
    for threads in (1, 2):
        coder = bpe.Coder(content, threads=threads)
        coder.tree(text[:100_000])
        taken[threads] = 9.0
        for _ in range(3):
            began = time.perf_counter()
            found[threads] = coder.tree(text)
            taken[threads] = min(taken[threads], time.perf_counter() - began)
    assert found[1] == found[2] and taken[2] < 0.95 * taken[1], taken


def test_long_unsplit_text_equals_the_library(content):
    text = "words and " + "x1" * 30 + "é" * 9000 + " then " + "=" * 20_000 + " end"
    coder = bpe.Coder(content, leaf=512)
    assert coder.encode(text).tolist() == coder.encoding.encode(text, disallowed_special=())
    assert coder.decode(coder.encode(text)).tobytes().decode() == text


def test_round_trip_and_edge_cases(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "plain <|endoftext|> text", "t"), (3, "plain <|endoftext|> text", "t"), (4, "q" * 300_000, None), (5, "漢字 \x00 \n\n  é", "t"), (None, "ab" * 40_000 + " c", "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = bpe.bpe_encode(docs, keep=["doc_id", "tokens"])
    assert out.columns == ["doc_id", "tokens", "_tokens", "n_tokens", "exact"]
    found = {r.doc_id: r for r in out.collect()}
    assert found[1][2:] == (None, None, None) and found[2][2:] == ([], 0, True)
    assert all(r.exact for i, r in found.items() if i != 1)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, keep=["doc_id"]))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((i, t) for i, t, _ in rows), key=repr)
    assert bpe.bpe_decode(bpe.bpe_encode(docs.limit(0), keep=["doc_id"])).count() == 0


def test_strange_ids_raise(spark):
    for ids in ([10**6], [-1], [None]):
        with pytest.raises(Exception, match="token id"):
            bpe.bpe_decode(spark.createDataFrame([(ids,)], "tokens array<int>")).collect()


def test_decode_of_a_part(spark, content):
    ids = bpe.Coder(content).encode("漢")
    assert len(ids) > 1
    text = bpe.bpe_decode(spark.createDataFrame([(ids[:1].tolist(),)], "tokens array<int>")).collect()[0].text
    assert "�" in text and isinstance(np.array(ids), np.ndarray)
