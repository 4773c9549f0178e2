"""Token-ID output: flat files of unsigned integers plus 64-bit document offsets, memory-mapped.

Documents are dealt by ranges of ``doc_id``; each task encodes its range and writes one shard:

* ``NNNNNN.bin``: the ids of its documents, one after another, as little-endian unsigned integers of the
  smallest width that holds the vocabulary (16 or 32 bits),
* ``NNNNNN.off``: ``n + 1`` unsigned 64-bit offsets, counted in ids from the start of the shard,
* ``NNNNNN.doc``: the ``n`` signed 64-bit document ids (the smallest 64-bit integer stands for null).

The number of ids and documents of each shard, one row a shard, gives by prefix sum the global base of each
shard; they are stored in ``manifest``. No task ever holds more than one Arrow batch of texts.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SharedFiles, fresh_path, small_batches, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
NULL_ID = -(2**63)
#: Words that a worker remembers with their ids, in each of two generations.
REMEMBERED = 520_000
#: Control characters at which Python splits words but the tokenizer's pattern doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_encoders: dict[str, WordEncoder] = {}


def tokenizer_file(name: str) -> str:
    """``name`` if that file exists, else the place of the public tokenizer of this name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts with a tokenizer whose pre-tokenizer drops white space, remembering words.

    The ids of a text are then the ids of its words, one after another, so the library only sees words that
    this worker hasn't met lately. A text with control characters that split words differently goes to the
    library as a whole. For a tokenizer of another kind (white space is kept) all texts do.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.by_word = bool(self.ends.any()) and self._ids("a  b\n") == self._ids("a") + self._ids("b")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self._ids(text), self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or _ODD.search(text):
            return self._bytes(text)
        words = text.split()
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:
            new = set(words).difference(self.young)
            if len(self.young) + len(new) > REMEMBERED:
                self.old, self.young, new = self.young, {}, set(words)
            self._learn(new)
            return b"".join(map(self.young.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        """Remembers words that the young generation hasn't."""
        young, old = self.young, self.old
        letters, later = set(), []
        for w in words:
            if (known := old.pop(w, None)) is not None:
                young[w] = known
                continue
            stem = w.rstrip(".,")
            if stem.isalpha() and (stem.isascii() or max(stem) < "ɐ"):  # one pre-token each, and one of marks
                stem = stem.lower() if stem.isascii() else stem
                later.append((w, stem))
                if stem not in young and stem not in old:
                    letters.add(stem)
            else:
                young[w] = self._bytes(w)
        if letters:
            stems = list(letters)
            ids = np.asarray(self._ids(" ".join(stems)), self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(stems):
                data, at = ids.tobytes(), 0
                for stem, end in zip(stems, (cuts * self.dtype.itemsize).tolist()):
                    young[stem] = data[at:end]
                    at = end
            else:
                young.update((s, self._bytes(s)) for s in stems)
        for w, stem in later:
            if w not in young:
                known = young.get(stem) or old[stem]
                marks = w[len(w.rstrip(".,")) :]
                if marks:
                    if marks not in young:
                        young[marks] = self._bytes(marks)
                    known += young[marks]
                young[w] = known


def encoder(name: str) -> WordEncoder:
    if name not in _encoders:
        _encoders[name] = WordEncoder(tokenizer_file(name))
    return _encoders[name]


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, path: str | None = None) -> str:
    """Writes the ids of every row of ``docs`` (doc_id, text) in ascending order of doc_id; returns the path.

    A null text is empty and gives just the end id; a null doc_id comes first; rows of equal doc_id are
    ordered by text. No rows give a manifest without shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")

    def write(batches):
        enc, files = encoder(tokenizer), SharedFiles(path)
        end = np.asarray([end_id], enc.dtype).tobytes()
        ids, lengths = [], []
        shard = TaskContext.get().partitionId()

        def encoded():
            for batch in batches:
                ids.append(np.asarray(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), "<i8"))
                own = np.empty(batch.num_rows, "<i8")
                for k, text in enumerate(batch.column(1)):
                    data = enc.encode(text.as_py() or "")
                    own[k] = len(data) // enc.dtype.itemsize + 1
                    yield data
                    yield end
                lengths.append(own)

        files.write(f"{shard:06d}.bin", encoded())
        n = np.concatenate(lengths) if lengths else np.empty(0, "<i8")
        if not len(n):
            return
        files.write(f"{shard:06d}.off", [np.concatenate([[0], np.cumsum(n)]).astype("<u8").tobytes()])
        files.write(f"{shard:06d}.doc", [np.concatenate(ids).tobytes()])
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(n)], "n_ids": [int(n.sum())], "width": [enc.dtype.itemsize]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(dealt.transform(small_batches).mapInArrow(write, "shard int, n_docs long, n_ids long, width int").collect())  # one row a shard
    rows, base_doc, base_id = [], 0, 0
    for shard, n_docs, n_ids, width in shards:
        rows.append((shard, base_doc, base_id, n_docs, n_ids, width))
        base_doc, base_id = base_doc + n_docs, base_id + n_ids
    spark.createDataFrame(rows, "shard int, base_doc long, base_id long, n_docs long, n_ids long, width int").coalesce(1).write.parquet(f"{path}/manifest")
    return path


def read_token_files(spark: SparkSession, path: str, batch: int = 4096) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32.

    Each shard is memory-mapped by one task; ``start`` is the shard's base plus the stored offset.
    """
    shards = {x.shard: (x.base_id, x.n_docs, x.width) for x in spark.read.parquet(f"{path}/manifest").collect()}
    order = sorted(shards)

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        files = SharedFiles(path)
        for x in batches:
            for k in x.column(0).to_pylist():
                base, n, width = shards[order[k]]
                name = f"{order[k]:06d}"
                ids, off, doc = files.map(f"{name}.bin", f"<u{width}"), files.map(f"{name}.off", "<u8").astype("<i8"), files.map(f"{name}.doc", "<i8")
                for at in range(0, n, batch):
                    to = min(n, at + batch)
                    sums = [zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(at, to)]
                    own = np.asarray(doc[at:to])
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == NULL_ID), pa.array(base + off[at:to]), pa.array(np.diff(off[at : to + 1])), pa.array(sums, pa.int64())], schema=schema)

    return spark.range(0, len(order), 1, max(1, len(order))).transform(small_batches).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


class TokenFiles:
    """Random access by the rank of a document: ``ids(i)`` maps only the shard that holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.files, self.rows = SharedFiles(path), sorted(spark.read.parquet(f"{path}/manifest").collect())
        self.bases = np.asarray([x.base_doc for x in self.rows], "<i8")

    def __len__(self) -> int:
        return sum(x.n_docs for x in self.rows)

    def ids(self, i: int) -> np.ndarray:
        if not 0 <= i < len(self):
            raise IndexError(i)
        x = self.rows[int(np.searchsorted(self.bases, i, "right")) - 1]
        off = self.files.map(f"{x.shard:06d}.off", "<u8")
        k = i - x.base_doc
        return self.files.map(f"{x.shard:06d}.bin", f"<u{x.width}")[int(off[k]) : int(off[k + 1])]


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded, written, and read back from the files."""
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents")))
