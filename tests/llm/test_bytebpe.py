import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from opsframe.llm import bytebpe as bb
from opsframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, ids string, BYTES int"


@pytest.fixture(scope="module")
def vocabulary():
    return bb.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def library(tokens, pattern):
    ranks = {t: i for i, t in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_random_vocabularies_equal_the_library():
    """Tokens in random order of rank: merges bring up lower ranks, and some tokens are not reached by merges."""
    for seed in range(60):
        rng = random.Random(seed)
        made = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(60)})
        rng.shuffle(made)
        tokens = [bytes([b]) for b in range(256)] + made
        vocabulary = bb.Vocabulary.of({t: i for i, t in enumerate(tokens)})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
        ids, counts = bb.encoded_pieces(words, vocabulary)
        want = [library(tokens, r"[\s\S]+").encode_ordinary(w.decode()) for w in words]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_texts_equal_the_library(spark, vocabulary):
    rng = random.Random(4)
    texts = ["a" * n for n in range(40)] + [" " * n + "x\n" * n for n in range(20)]
    texts += ["<|endoftext|> it's 12 o'clock", "ééé  中文字 🙂🙂", "the the the", "\x00\x1c\x85  z", "q" * 30_000]
    texts += ["".join(chr(rng.randrange(1, 0xD800)) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += ["".join(rng.choice("abst 1\n'") for _ in range(rng.randrange(200))) for _ in range(150)]
    rows = [(i, t, "no", 1) for i, t in enumerate(texts)] + [(None, "null key", "", 0), (7, texts[7], "", 0), (900, None, "", 0), (901, "", "", 0)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    encoder = library(vocabulary.tokens, public_tokenizers.PATTERN)
    got = bb.decode(bb.encode(frame, vocabulary, public_tokenizers.PATTERN), vocabulary).collect()
    want = sorted(((r[0], encoder.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["ids"], bytes(r["bytes"])) for r in got), key=str) == want
    empty = bb.decode(bb.encode(frame.limit(0), vocabulary, public_tokenizers.PATTERN), vocabulary)
    assert empty.columns == ["doc_id", "ids", "bytes"] and empty.count() == 0


def test_chunks_do_not_matter(spark, vocabulary, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice([0, 3, 400]))) for _ in range(120)]
    want = [library(vocabulary.tokens, public_tokenizers.PATTERN).encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bb, "_BATCH_IDS", 50)
    for size, pieces in ((60, 10**6), (10**6, 25)):
        monkeypatch.setattr(bb, "CHUNK_BYTES", size)
        monkeypatch.setattr(bb, "CHUNK_PIECES", pieces)
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        out = bb.encode(frame, vocabulary, public_tokenizers.PATTERN).orderBy("doc_id").collect()
        assert [r["ids"] for r in out] == want


def test_bad_rank_files_are_refused(tmp_path):
    whole = {bytes([b]): b for b in range(256)}
    for bad in ({**whole, b"ab": 300}, {k: v for k, v in whole.items() if v < 255}):
        lines = tmp_path / "ranks"
        lines.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in bad.items()))
        with pytest.raises(ValueError):
            bb.Vocabulary.load(str(lines))


def test_decode_of_foreign_ids(spark, vocabulary):
    frame = spark.createDataFrame([(1, [0, 1]), (2, []), (3, None)], "Bytes int, ids array<int>").coalesce(1)
    got = bb.decode(frame, vocabulary)
    assert got.columns == ["ids", "bytes"]
    assert [r["bytes"] for r in got.collect()] == [vocabulary.tokens[0] + vocabulary.tokens[1], b"", None]


def test_query(spark, vocabulary):
    sf = "/root/testdata/sf0.001"
    encoder = library(vocabulary.tokens, public_tokenizers.PATTERN)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = encoder.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), digest(" ".join(map(str, ids)).encode()), digest((r["text"] or "").encode())))
    got = QUERIES["op13_merge_replay"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == want
