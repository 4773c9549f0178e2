import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lattica.llm import tokens


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def read(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[1])


def test_every_text_reads_back(spark, real_docs):
    assert read(tokens.op2_token_files(spark, "/root/testdata/sf0.001")) == expected([(r.doc_id, r.text) for r in real_docs.collect()])


def test_odd_documents_and_random_access(spark, odd_docs, no_docs):
    path = tokens.write_token_files(odd_docs)
    want = expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert read(tokens.read_token_files(spark, path)) == want
    files = tokens.TokenFiles(spark, path)
    assert len(files) == len(want) and [zlib.crc32(files.ids(k).astype("<u4").tobytes()) for k in range(len(files))] == [w[3] for w in want]
    assert tokens.read_token_files(spark, tokens.write_token_files(no_docs)).count() == 0


def test_words_remembered_equal_whole_texts(real_docs):
    enc = tokens.encoder(tokens.TOKENIZER)
    texts = [r.text or "" for r in real_docs.collect()] + ["don't I'm we'll 12a3 x_y foo.bar... Ähre İstanbul ǅ ﬁ ½ ²", "a\x1cb\x1db", "<|endoftext|> </w> a</w>b", "日本語 テスト", "́a é ​ x​y", "\u0085a b　c", "A.,B., ...,", "Straße STRASSE ǲ"]
    for text in texts:
        assert enc.encode(text) == np.asarray(enc._ids(text), enc.dtype).tobytes(), text[:80]
