"""Byte-level BPE by a tree of joins: halves are encoded on their own and joined by encoding again what lies at the seam.

Two facts make a join local.

* *Within a piece* (a match of the pattern): ids are the encoding of their bytes exactly if each two neighbours are, that
  is, if encoding the two tokens' bytes gives these two tokens. So a window around the seam is encoded anew, and
  grows on the side on which its first or last token and the token outside aren't such neighbours; once they are,
  all ids outside stay. This needs every token to be the encoding of its own bytes (``Vocabulary`` checks it).
* *Between pieces*: the pattern never looks back, and looks at most two characters beyond a match, three beyond its
  beginning. So all pieces of the left text but its last three stand; from there the joined text is matched
  again until a match begins where one of the right text's own matches begins, and from that on theirs stand.

Spark cuts long texts into segments and deals them out, encodes each in a task of its own, and brings a text's segments
together in order; there they are joined as a balanced tree, touching only seams. Decoding concatenates
the bytes of ids up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import tokenizer_file

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a segment; longer texts are cut into several.
SEGMENT = 32_768
#: Bytes up to which a part of a piece is merged at once instead of by halves.
LEAF = 16
#: Pieces that a worker remembers with their ids, in each of two generations.
REMEMBERED = 250_000
#: Last pieces of a text that what follows it may change.
UNSURE = 3
_vocabularies: dict[tuple[str, str], Vocabulary] = {}


class Vocabulary:
    """Ranks of byte strings and the pattern that splits texts; ``ranks`` must hold all single bytes.

    An *element* is an array of unsigned 32-bit numbers, twice the id of each token, plus one where a piece begins.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.neighbours = lru_cache(200_000)(self._neighbours)

    def check(self) -> None:
        """``ValueError`` unless each token is the encoding of its own bytes, which joins rely on."""
        for token, rank in self.ranks.items():
            if self.merged(token) != [rank]:
                raise ValueError(f"token {rank} is not the encoding of its bytes")

    def merged(self, data: bytes) -> list[int]:
        """The ids of a short byte string: the pair of the lowest rank is merged first, the leftmost of equal ones."""
        if len(data) > 64:
            return self._merged_long(data)
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        pairs = [get(a + b) for a, b in zip(parts, parts[1:])]
        while pairs:
            found = [r for r in pairs if r is not None]
            if not found:
                break
            i = pairs.index(min(found))
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i])
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1])
        return [self.ranks[x] for x in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """As ``merged``, with a heap of pairs and links between parts: for windows that have grown large."""
        n, get = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if j == 0 or j >= n or end[j] != to:  # a part of the pair has been merged since
                continue
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
                if (r := get(data[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (h := before[i]) >= 0 and (r := get(data[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return ids

    def _neighbours(self, a: int, b: int) -> bool:
        return self.merged(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two parts of a piece taken together."""
        if not left or not right or self.neighbours(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of either side in the window
        while True:
            window = self.merged(b"".join([self.bytes[t] for t in left[-i:] + right[:j]]))
            grow_left = i < len(left) and not self.neighbours(left[-i - 1], window[0])
            grow_right = j < len(right) and not self.neighbours(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[: max(0, len(left) - i)] + window + right[j:]
            i, j = i * 2 if grow_left else i, j * 2 if grow_right else j
            i, j = min(i, len(left)), min(j, len(right))

    def piece(self, data: bytes) -> list[int]:
        """The ids of a piece: of its halves, joined; up to ``LEAF`` bytes are merged at once."""
        if (known := self.ranks.get(data)) is not None:
            return [known]
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    @staticmethod
    def element(ids: list[int]) -> bytes:
        """A piece's part of an element."""
        out = np.array(ids, "<u4") << 1
        out[:1] |= 1
        return out.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The element of a text; pieces met lately are remembered."""
        pieces = self.pattern.findall(text)
        try:
            found = b"".join(map(self.young.__getitem__, pieces))
        except KeyError:
            new = set(pieces).difference(self.young)
            if len(self.young) + len(new) > REMEMBERED:
                self.old, self.young, new = self.young, {}, set(pieces)
            for p in new:
                known = self.old.get(p)
                self.young[p] = self.element(self.piece(p.encode())) if known is None else known
            found = b"".join(map(self.young.__getitem__, pieces))
        return np.frombuffer(found, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def join_texts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The element of two texts taken together, from those of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        starts = _last_starts(left, UNSURE)
        tail, own = left[starts:], np.flatnonzero(right & 1)
        taken = 4
        while True:  # so many of the right text's pieces are matched again
            whole = taken >= len(own)
            head = right if whole else right[: own[taken]]
            window, end = np.concatenate([tail, head]), len(tail)
            sync, pieces = self._matched(window, end, whole)
            if sync is not None or whole:
                break
            taken *= 2
        parts = [left[:starts], np.frombuffer(b"".join(pieces), "<u4")]
        return np.concatenate([*parts, right[sync:]] if sync is not None else parts)

    def _matched(self, window: np.ndarray, seam: int, whole: bool) -> tuple[int | None, list[bytes]]:
        """Matches the text of ``window`` again, up to a match that begins with a piece after token ``seam``.

        Returns how many tokens after the seam come before that match (None: no such one is certain), and the new
        pieces before it. ``whole``: no text follows the window.
        """
        ids = (window >> 1).tolist()
        data = [self.bytes[i] for i in ids]
        at, own = 0, {}  # where a piece after the seam begins in bytes, and its token
        ends = []
        for k, (x, flagged) in enumerate(zip(data, window.tolist())):
            if k >= seam and flagged & 1:
                own[at] = k - seam
            at += len(x)
            ends.append(at)
        text, pieces, start, token = b"".join(data).decode(), [], 0, 0
        for m in self.pattern.finditer(text):
            if start in own:
                return own[start], pieces
            if not whole and max(m.start() + 3, m.end() + 2) > len(text):
                return None, []
            stop, ids_of = start + len(m[0].encode()), []
            while start < stop:  # whole tokens of what was encoded before are joined, cut ones merged
                first = token
                while token < len(ids) and ends[token] <= stop and ends[token] - len(data[token]) >= start and (token == first or not window[token] & 1):
                    token += 1
                if token > first:
                    part, start = ids[first:token], ends[token - 1]
                else:
                    begin = ends[token] - len(data[token])
                    to = min(stop, ends[token])
                    part, start = self.merged(data[token][start - begin : to - begin]), to
                    token += to == ends[token]
                ids_of = self.join(ids_of, part)
            pieces.append(self.element(ids_of))
        return None, pieces

    def join_all(self, elements: Iterable[np.ndarray]) -> np.ndarray:
        """The element of a text from those of its segments in order, as a balanced tree of joins."""
        stack: list[tuple[int, np.ndarray]] = []
        for x in elements:
            size = 1
            while stack and stack[-1][0] == size:
                x, size = self.join_texts(stack.pop()[1], x), size * 2
            stack.append((size, x))
        out = np.empty(0, "<u4")
        while stack:
            out = self.join_texts(stack.pop()[1], out)
        return out


def _last_starts(element: np.ndarray, n: int) -> int:
    """The token at which the last ``n`` pieces begin."""
    back = 64
    while True:
        found = np.flatnonzero(element[-back:] & 1)
        if len(found) >= n or back >= len(element):
            return int(found[-n] if len(found) >= n else 0) + max(0, len(element) - back)
        back *= 4


def vocabulary(name: str, pattern: str | None = None) -> Vocabulary:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    if (name, pattern) not in _vocabularies:
        with open(tokenizer_file(name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        made = Vocabulary(ranks, pattern)
        made.check()
        _vocabularies[name, pattern] = made
    return _vocabularies[name, pattern]


def encoded(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, segment: int = SEGMENT, digests: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text); ids: little-endian unsigned 32-bit numbers, binary.

    A null text counts as empty and has no ids. Repeated rows and null ids each come back. Texts above ``segment``
    characters are cut, dealt out and joined; a text's ids come together in one row, as its characters did. Other
    columns are ignored, whatever their names. With ``digests``, in place of ids: n_tokens, ids_sha256 and
    decoded_sha256 (of the ids' bytes).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"

    def result(batches: Iterator[tuple[list, list[np.ndarray]]]):
        import pyarrow as pa

        voc = vocabulary(ranks, pattern)
        for keys, elements in batches:
            ids = [e >> 1 for e in elements]
            raw = [x.astype("<u4").tobytes() for x in ids]
            key = pa.array(keys, pa.int64())
            if digests:
                decoded = [hashlib.sha256(voc.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([key, pa.array(map(len, ids), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([key, pa.array(raw, pa.binary())], names=["doc_id", "ids"])

    def short(batches):
        voc = vocabulary(ranks, pattern)
        parts = (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256))
        return result((b.column(0).to_pylist(), [voc.encode(t.as_py()) for t in b.column(1)]) for b in parts)

    def cut(batches):
        import pyarrow as pa

        voc = vocabulary(ranks, pattern)
        for b in batches:
            elements = [voc.encode(t.as_py()).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(elements, pa.binary())], names=["row", "doc_id", "seg", "element"])

    def joined(batches):
        voc = vocabulary(ranks, pattern)
        yield from result(([key], [voc.join_all(elements)]) for key, elements in _texts(batches))

    whole = F.length("text") <= segment
    few = rows.where(whole).transform(small_batches).mapInArrow(short, f"doc_id long, {kind}")
    parts = F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{segment}}}"), F.lit(0))).alias("seg", "part")
    segments = rows.where(~whole).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").select("row", "doc_id", parts)
    elements = segments.repartition("row", "seg").mapInArrow(cut, "row long, doc_id long, seg int, element binary")
    many = elements.repartition("row").sortWithinPartitions("row", "seg").mapInArrow(joined, f"doc_id long, {kind}")
    return few.union(many)


def _texts(batches) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """(doc_id, its elements) of each text, from batches in order of row and seg."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)))
    for (_, key), group in groupby(rows, lambda r: r[:2]):
        yield key, (np.frombuffer(r[2].as_py(), "<u4") for r in group)


def decoded(encodings: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, data) from (doc_id, ids) as ``encoded`` gives it: the bytes that the ids stand for; null ids are none."""

    def run(batches):
        import pyarrow as pa

        voc = vocabulary(ranks)
        for b in batches:
            data = [voc.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encodings.select("doc_id", "ids").transform(small_batches).mapInArrow(run, "doc_id long, data binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text of ``documents``."""
    return encoded(table(spark, sf_dir, "documents"), digests=True)
