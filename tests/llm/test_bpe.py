import hashlib
import random
import time

import numpy as np
import pytest
from colloquy.llm import bpe

from .fixtures import awkward, documents

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.public_vocabulary()


@pytest.fixture(scope="module")
def theirs(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=vocabulary[0], special_tokens={})


def strange(rng):
    return "".join(rng.choice(["the ", " and", "é", "日本", "\n\n", "  ", "123", "'s", "!?", "\U0001f600", "ing", "Zz", "\u0000", "<|endoftext|>"]) for _ in range(rng.randrange(60)))


def test_equals_the_reference_encoder_and_round_trips(vocabulary, theirs):
    coder, rng = bpe.TextEncoder(*vocabulary), random.Random(1)
    for text in ["", "a" * 5000, " " * 3000, "ab" * 2000, *(strange(rng) for _ in range(400))]:
        ids = coder.encode(text)
        assert ids == theirs.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_appends_and_edits_equal_encoding_anew(vocabulary):
    coder, rng = bpe.PrefixEncoder(vocabulary[0]), random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdefgh the ing") for _ in range(rng.randrange(1, 700)))
        last = coder.extend(data, [])
        more = bytes(rng.choice(b"ing the") for _ in range(rng.randrange(9)))
        assert coder.append(data, last, more)[1] == coder.extend(data + more, [])
        a = rng.randrange(len(data))
        b = rng.randrange(a, len(data) + 1)
        edited, redone = coder.edit(data, last, a, b, more)
        assert edited == data[:a] + more + data[b:] and redone == coder.extend(edited, [])


def test_memory_stays_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    coder, rng = bpe.TextEncoder(*vocabulary), random.Random(3)
    for _ in range(50):
        text = strange(rng)
        assert coder.decode(coder.encode(text)) == text.encode()
        assert len(coder._known) <= 50 and len(coder.pieces._pairs) <= 50


def test_splits_as_the_regex_package(vocabulary):
    regex, rng = pytest.importorskip("regex"), random.Random(4)
    each = [chr(c) for c in range(0x10100) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" {c}{c}a{c}1{c}  {c}" for c in each[i : i + 4096]) for i in range(0, len(each), 4096)]
    texts += ["".join(rng.choice("'stremvld aZ1\u00e9\u00b2\u0085\u001c\u3000\n\t!\U0001f600\U00010400") for _ in range(rng.randrange(30))) for _ in range(5000)]
    for pattern in (vocabulary[1], r"\S+|\s", r"(?i:'S)|\p{Lu}+|[a-z]"):
        theirs, ours = regex.compile(pattern).findall, bpe.splitter(pattern)
        assert all(ours(t) == theirs(t) for t in texts)


def test_runs_of_texts_equal_the_reference_encoder(vocabulary, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    coder, rng = bpe.TextEncoder(*vocabulary), random.Random(5)
    texts = ["", "", *(strange(rng) + rng.choice(["", "x" * 70, "\u00e9" * 90]) + strange(rng) for _ in range(300)), ""]
    want = [theirs.encode_ordinary(t) for t in texts]
    assert list(coder.encode_many(texts)) == want and list(coder.encode_many([])) == []
    found = [x for ids, bounds in coder.encode_chunks(texts) for x in zip(np.diff(bounds).tolist(), *coder.digests(ids, bounds), strict=True)]
    assert found == [(len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(want, texts, strict=True)]


def test_the_pieces_of_a_task_are_encoded_once(vocabulary):
    coder, seen = bpe.TextEncoder(*vocabulary), []
    coder._batch.encode = lambda pieces, f=coder._batch.encode: seen.extend(pieces) or f(pieces)
    texts = ["".join(f" q{i}" for i in range(a, a + 20_000)).replace("1", "x") for a in range(0, 400_000, 20_000)]
    for _ in range(2):
        for text in texts:
            coder.encode(text)
    assert len(seen) == len(set(seen)) > 150_000
    with pytest.raises(ValueError):
        coder.encode("new \ud800")
    assert coder.decode(coder.encode("new text")) == b"new text"


def test_known_pieces_cost_little_more_than_their_split(vocabulary):
    regex, rng = pytest.importorskip("regex"), random.Random(6)
    words = ["".join(rng.choice("aeinrst\u00e9") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=1000)) for _ in range(400)]
    coder, split = bpe.TextEncoder(*vocabulary), regex.compile(vocabulary[1]).findall

    def cpu(step):
        before = time.process_time()
        step()
        return time.process_time() - before

    coder.encode(" " + " ".join(words))
    ours = min(cpu(lambda: list(coder.encode_many(texts))) for _ in range(5))
    assert ours < 1.35 * min(cpu(lambda: [split(t) for t in texts]) for _ in range(5))


def test_query_on_awkward_rows(spark, tmp_path, vocabulary, theirs):
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r["doc_id"] or -1, len(i := theirs.encode_ordinary(r["text"] or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r[0] or -1, *r[1:]) for r in bpe.op4_byte_bpe(spark, str(tmp_path)).collect()) == want
    stage = bpe.bpe_stage(spark, awkward(docs), "")
    assert bpe.decode(stage, vocabulary[0]).where("sha2(decoded, 256) <> decoded_sha256").count() == 0 and stage.count() == len(want)
    assert bpe.bpe_stage(spark, docs.limit(0), "").count() == 0
