import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import bpe

VOC = bpe.vocabulary(bpe.RANKS)
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANKS), "rb"))}, special_tokens={})
TEXTS = ["", " ", "\n", "a", "don't we'll I'M it's 'tis ''s 'r 're", "x" * 3000, "aaaa" * 700 + "b" * 50, " " * 900 + "word", "a\n\n  b \t c   ", "123456 7890 １２ ½", "日本語テスト " * 40, "é́ ​\u0085 \x1c\x1d", "🙂🙃" * 300, "=-" * 400, "ab" * 500 + "'" + "re" * 300, "<|endoftext|> x", "�\U0010ffff"]


def ids(element):
    return (element >> 1).tolist()


def starts(text):
    """The element by the library: pieces one by one."""
    return [2 * t + (k == 0) for p in VOC.pattern.findall(text) for k, t in enumerate(ORACLE._core_bpe.encode_single_piece(p.encode()))]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_and_every_cut(text):
    want = starts(text)
    assert ids(VOC.encode(text)) == ORACLE.encode_ordinary(text) and VOC.encode(text).tolist() == want
    for at in range(0, len(text) + 1, max(1, len(text) // 60)):
        assert VOC.join_texts(VOC.encode(text[:at]), VOC.encode(text[at:])).tolist() == want, (at, text[:50])


ALPHABET = st.text(st.sampled_from(list("aabbst'reldvm  \n\t .,-1２é日🙂")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=9))
def test_random_segments_join(parts):
    assert VOC.join_all(map(VOC.encode, parts)).tolist() == starts("".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 200))
def test_random_bytes_join(data, at):
    want = ORACLE._core_bpe.encode_single_piece(data) if data else []
    assert VOC.piece(data) == want == VOC.merged(data) == VOC._merged_long(data)
    assert VOC.join(VOC.piece(data[:at]), VOC.piece(data[at:])) == want


def test_long_runs_of_few_letters():
    r = random.Random(5)
    for _ in range(40):
        text = "".join(r.choice(["a", "ab", "th", "e", "ing"]) for _ in range(400))
        assert VOC.encode(text).tolist() == starts(text)
        assert VOC.join_all(VOC.encode(text[i : i + 7]) for i in range(0, len(text), 7)).tolist() == starts(text)


def test_joins_touch_seams_only(monkeypatch):
    """The bytes that a join encodes again don't grow with its sides."""
    text, seen = "the quick brown fox's " * 3000, []
    merged = bpe.Vocabulary.merged
    monkeypatch.setattr(bpe.Vocabulary, "merged", lambda self, data: seen.append(len(data)) or merged(self, data))
    for n in (1000, 30000):
        left, right = VOC.encode(text[:n]), VOC.encode(text[n : 2 * n])
        seen.clear()
        VOC.join_texts(left, right)
        assert sum(seen) < 200


def test_vocabulary_of_unreachable_tokens_is_refused():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError):
        bpe.Vocabulary(ranks, r"\S+|\s+").check()


def expected(rows):
    out = []
    for i, text in rows:
        found = ORACLE.encode_ordinary(text or "")
        out.append((i, len(found), hashlib.sha256(np.asarray(found, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def read(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_document(spark, real_docs):
    got = bpe.op13_byte_bpe(spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert read(got) == expected([(r.doc_id, r.text) for r in real_docs.collect()])


@pytest.mark.parametrize("segment", [1, 7, 100, 32768])
def test_odd_documents_in_segments(spark, odd_docs, no_docs, segment):
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True) if segment > 1 else more.where("length(text) < 200")
    assert read(bpe.encoded(docs, segment=segment, digests=True)) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert bpe.encoded(no_docs, segment=segment).collect() == []


def test_round_trip(spark, odd_docs):
    back = bpe.decoded(bpe.encoded(odd_docs, segment=50))
    assert sorted(((r.doc_id, bytes(r.data)) for r in back.collect()), key=repr) == sorted(((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()), key=repr)
