"""Benchmark decontamination with a distributed positional inverted index of the training documents.

1. *Index.* One scan of the texts writes the index in segments, as search engines do: a segment is a row that covers a
   batch of documents and holds, for each of their terms in order, the list of (document, position) of its occurrences.
   All terms are stored, so one index serves any number of test sets without reading the texts again. Segments are
   bounded by ``SEGMENT_BYTES`` of text (or one larger text); a term that is common in the corpus has a part of its list
   in each segment, so no list is ever gathered in one task, and the index needs no shuffle.
2. *Statistics.* The corpus frequency of each test term, from the segments' term lists alone, orders the terms of each
   test window from rarest to commonest.
3. *Search.* In each segment, the windows all of whose terms occur there intersect their offset-adjusted lists from the
   rarest term on and stop at the first empty intersection. What is left are the exact phrase matches; with a slop,
   candidates whose terms all lie within that many words of their places are proximity matches.

Test items are cut into blocks of at most ``BLOCK_WORDS`` words; a block is sent to the tasks as arrays of term numbers,
and the index, not the texts, is read once for each. So what a task holds of the test set has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LARGE_VALUES, small_batches, table, text_bytes, text_hash, written

WINDOW = 13
#: Bytes of text in a segment.
SEGMENT_BYTES = 2 << 20
#: Words of test items that are sent to the tasks at once.
BLOCK_WORDS = 200_000
#: A document with at least one hit word in so many words is contaminated.
SHARE = 20
#: Lower-cases A-Z; every other ASCII character but 0-9 and a-z separates words.
_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: A segment: its documents, its terms in order, where each term's list ends, and the lists.
INDEX = "rows array<long>, doc_ids array<long>, n_words array<int>, terms binary, ends binary, docs binary, positions binary"


def packed(x: np.ndarray, starts: np.ndarray) -> bytes:
    """32-bit integers as compressed differences, byte by byte, that begin anew at ``starts`` (ascending, the first
    0): runs between them ascend, so most bytes are zero."""
    import zstandard

    d = np.diff(x.astype("<i4"), prepend=np.int32(0)).astype("<i4")
    d[starts] = x[starts]
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes, starts: np.ndarray | None = None) -> np.ndarray:
    """What ``packed`` packed with the same ``starts`` (None: only the first)."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    d = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()
    total = np.cumsum(d, dtype=np.int64)
    if starts is not None and len(starts):
        total -= np.repeat(total[starts] - d[starts], np.diff(starts, append=len(d)))
    return total.astype(np.int32)


def packed_terms(terms) -> bytes:
    """An Arrow array of words, compressed; words hold no white space."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b" ".join(x.as_buffer() for x in terms))


def unpacked_terms(data: bytes):
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    joined = zstandard.ZstdDecompressor().decompress(data).decode()
    return pc.ascii_split_whitespace(pa.array([joined], pa.large_string())).values if joined else pa.array([], pa.large_string())


def lists_of(ends, docs, positions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment's lists from their packed columns: ``docs`` begin anew with each term, ``positions`` also with each
    document in it."""
    e = unpacked(ends)
    begins = np.concatenate([[0], e[:-1]]) if len(e) else np.empty(0, np.int64)
    d = unpacked(docs, begins)
    return e, d, unpacked(positions, _anew(begins, d))


def _anew(begins: np.ndarray, docs: np.ndarray) -> np.ndarray:
    new = np.diff(docs, prepend=-1) != 0
    new[begins] = True
    return np.flatnonzero(new)


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class Windows:
    """The distinct windows of some items, as arrays: ``terms`` are ``vocabulary`` numbers, ``size`` to a window and -1
    after a shorter one; window ``k`` is in the items ``owners[first[k] : first[k + 1]]``."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.items = [i for i, _ in items]
        numbers: dict[bytes, int] = {}
        rows, owners = [], []
        for k, (_, own) in enumerate(items):
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int32)
            if len(ids) >= size:
                found = np.lib.stride_tricks.sliding_window_view(ids, size)
            else:
                found = np.full((min(1, len(ids)), size), -1, np.int32)
                found[:, : len(ids)] = ids
            rows.append(found)
            owners.append(np.full(len(found), k, np.int32))
        self.vocabulary = [w.decode("utf-8", "replace") for w in numbers]
        every = np.concatenate(rows) if rows else np.empty((0, size), np.int32)
        self.terms, place = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([place.ravel().astype(np.int64), np.concatenate(owners) if owners else np.empty(0, np.int64)], 1), axis=0)
        self.owners = pairs[:, 1].astype(np.int32)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1)).astype(np.int32)
        self.lengths = (self.terms >= 0).sum(axis=1).astype(np.int32)
        self.order = np.empty((0, size), np.int8 if size < 128 else np.int32)

    def rank(self, counts: np.ndarray) -> None:
        """``order``: the places of each window's terms from the corpus's rarest to its commonest."""
        keyed = np.where(self.terms >= 0, np.append(counts, 0)[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(keyed, axis=1, kind="stable").astype(self.order.dtype)


def item_blocks(items: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``limit`` words (one longer item is a block of its own)."""
    block, n = [], 0
    for x in items.select(F.col("item_id").cast("string"), text_bytes()).toLocalIterator():
        own = words(bytes(x[1]))
        if block and n + len(own) > limit:
            yield block
            block, n = [], 0
        block.append((x[0], own))
        n += len(own)
    if block:
        yield block


def _parts(batch):
    """An Arrow batch in parts of about ``SEGMENT_BYTES`` of text; a larger text is a part of its own. What a part took
    goes back to the system before the next one."""
    import pyarrow as pa
    import pyarrow.compute as pc

    upto = np.cumsum(pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + SEGMENT_BYTES, "right")))
        yield batch.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


def segment(texts) -> tuple:
    """(n_words, terms, ends, docs, positions) of a segment over an Arrow array of texts as binary."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(texts)
    data = texts.cast(pa.large_binary())
    if data.offset:
        data = pa.concat_arrays([data])
    _, offsets, values = data.buffers()
    folded = pa.py_buffer((values.to_pybytes() if values is not None else b"").translate(_FOLD))
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), n, [None, offsets, folded]))
    flat, edges = split.values, split.offsets.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges))
    flat = flat.slice(edges[0], edges[-1] - edges[0])
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # splitting leaves empty words at the ends
    coded = flat.filter(pa.array(real)).dictionary_encode()
    of = of[real]
    n_words = np.bincount(of, minlength=n).astype(np.int32)
    positions = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(n_words) - n_words).astype(np.int32), n_words)
    terms = coded.dictionary
    order = pc.sort_indices(terms).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    numbers = place[coded.indices.to_numpy()]
    sort = np.argsort(numbers, kind="stable")
    ends = np.cumsum(np.bincount(numbers, minlength=len(order))).astype(np.int32)
    return n_words, terms.take(pa.array(order)), ends, of[sort], positions[sort]


def build_index(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """The index of all words of ``docs`` (doc_id, text), a segment a row. ``row`` numbers the rows (by default each
    gets a number of its own, which holds once the index is written)."""

    def of(batches):
        import pyarrow as pa

        for batch in (part for b in batches for part in _parts(b)):
            n_words, terms, ends, where, positions = segment(batch.column(2))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x) if isinstance(x, np.ndarray) else x)
            begins = np.concatenate([[0], ends[:-1]]) if len(ends) else np.empty(0, np.int64)
            lists = [pa.array([packed(x, starts)], pa.binary()) for x, starts in ((ends, begins[:1]), (where, begins), (positions, _anew(begins, where)))]
            yield pa.RecordBatch.from_arrays([*map(one, (batch.column(0), batch.column(1), n_words)), pa.array([packed_terms(terms)], pa.binary()), *lists], names=[c.split()[0] for c in INDEX.split(", ")])

    own = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"))
    return own.transform(small_batches).mapInArrow(of, INDEX)


def frequencies(index: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """How often each term of the vocabulary occurs in the whole index; reads the segments' terms only."""

    def of(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known, total = pa.array(vocabulary, pa.large_string()), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1)):
                at = pc.index_in(unpacked_terms(terms.as_py()), value_set=known)
                found = at.is_valid().to_numpy(zero_copy_only=False)
                total[at.drop_null().to_numpy()] += np.diff(unpacked(ends.as_py()), prepend=0)[found]
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["term", "n"])

    counts = np.zeros(len(vocabulary), np.int64)
    if vocabulary:
        for r in index.select("terms", "ends").mapInArrow(of, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
            counts[r.term] = r.n
    return counts


def intersect(lists: dict[int, np.ndarray], order: list[tuple[int, int]], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of exact matches of a window, and starts (by the rarest term) of matches within ``slop``."""
    none = np.empty(0, np.int64)
    if any(t not in lists for t, _ in order):
        return none, none
    exact = near = lists[order[0][0]] - order[0][1]
    for term, offset in order[1:]:
        own = lists[term] - offset
        if len(exact):
            k = np.searchsorted(own, exact)
            exact = exact[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] == exact)]
        if slop and len(near):
            k = np.searchsorted(own, near - slop)
            near = near[(k < len(own)) & (own[np.minimum(k, len(own) - 1)] <= near + slop)]
        if not len(exact) and not (slop and len(near)):
            return none, none
    return exact, near[~np.isin(near, exact)] if slop else none


#: Bits of a list's entries below the document's number; positions are as far from each other there as documents must be.
_SHIFT, _PAD = 33, 1 << 31


def matches(windows: Windows, terms, ends: np.ndarray, docs: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, window) of the exact matches in a segment, and the documents of proximity matches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = pc.index_in(terms, value_set=pa.array(windows.vocabulary, pa.large_string()))
    met = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    numbers = at.drop_null().to_numpy()
    there = np.zeros(len(windows.vocabulary) + 1, bool)
    there[numbers] = True
    there[-1] = True  # after a shorter window's end
    whole = np.flatnonzero(there[windows.terms].all(axis=1))
    lists: dict[int, np.ndarray] = {}
    begins = np.concatenate([[0], ends[:-1]])
    needed = np.zeros_like(there)
    needed[windows.terms[whole].ravel()] = True
    for number, k in zip(numbers.tolist(), met.tolist()):
        if needed[number]:
            a, b = begins[k], ends[k]
            lists[number] = (docs[a:b].astype(np.int64) << _SHIFT) + positions[a:b] + _PAD
    exact_, near_ = [], []
    for k in whole.tolist():
        n = int(windows.lengths[k])
        order = [(int(windows.terms[k, o]), int(o)) for o in windows.order[k, :n]]
        exact, near = intersect(lists, order, slop)
        if len(exact):
            exact_.append(np.stack([exact >> _SHIFT, (exact & ((1 << _SHIFT) - 1)) - _PAD, np.full(len(exact), k)], 1))
        if len(near):
            near_.append(near >> _SHIFT)
    none = np.empty((0, 3), np.int64)
    found = np.concatenate(exact_) if exact_ else none
    return found[:, 0], found[:, 1:], np.concatenate(near_) if near_ else none[:, 0]


def search(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """(row, doc_id, n_words, starts, stops, items, n_near) for each document of the index.

    starts and stops are merged, ascending word ranges that exact matches cover; items are those whose windows
    occur; n_near counts proximity matches that aren't exact.
    """
    names = windows.items

    def of(batches):
        import pyarrow as pa

        ints, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for rows, ids, n_words, terms, ends, docs, positions in zip(*batch.columns):
                n = len(n_words)
                found, pairs, near = matches(windows, unpacked_terms(terms.as_py()), *lists_of(ends.as_py(), docs.as_py(), positions.as_py()), slop)
                starts, stops, items = [[]] * n, [[]] * n, [[]] * n
                for doc in np.unique(found).tolist():
                    own = pairs[found == doc]
                    starts[doc], stops[doc] = merged(zip(own[:, 0].tolist(), (own[:, 0] + windows.lengths[own[:, 1]]).tolist()))
                    of_item = {i for k in np.unique(own[:, 1]).tolist() for i in windows.owners[windows.first[k] : windows.first[k + 1]].tolist()}
                    items[doc] = sorted(names[i] for i in of_item if names[i] is not None)
                n_near = np.bincount(near, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.values, ids.values, n_words.values.cast(pa.int64()), pa.array(starts, ints), pa.array(stops, ints), pa.array(items, strings), pa.array(n_near)], names=["row", "doc_id", "n_words", "starts", "stops", "items", "n_near"])

    return index.transform(small_batches).mapInArrow(of, "row long, doc_id long, n_words long, starts array<long>, stops array<long>, items array<string>, n_near long")


def merged(ranges) -> tuple[list[int], list[int]]:
    starts, stops = [], []
    for a, b in sorted(ranges):
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    return starts, stops


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, limit: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_near) for every row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is ``window``
    consecutive words of an item (item_id, text), or a shorter item's only window. A document's word inside any
    occurrence of a window is hit. Null or blank texts have no words, items without words no window; repeated
    rows each get their own result; no items, no hits. Other columns are ignored.
    """
    return hits(written(build_index(docs), "postings", **LARGE_VALUES), items, window, slop, limit).drop("row")


def hits(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, limit: int = BLOCK_WORDS) -> DataFrame:
    """contamination(), after the row's number, by an index that is already written."""
    found, blocks = None, 0
    for block in item_blocks(items, limit):
        windows = Windows(block, window)
        windows.rank(frequencies(index, windows.vocabulary))
        own = search(index, windows, slop)
        found, blocks = own if found is None else found.unionByName(own), blocks + 1
    if found is None:
        found = search(index, Windows([], window), slop)
    result = _joined(found) if blocks > 1 else found
    hit = F.aggregate(F.zip_with("starts", "stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return result.select("row", "doc_id", "n_words", hit.alias("n_hit"), F.array_distinct("items").alias("items"), "n_near")


def _joined(found: DataFrame) -> DataFrame:
    """Results of several blocks brought together by row number."""
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "stops")))
    grouped = found.groupBy("row", "doc_id", "n_words").agg(F.array_sort(spans).alias("spans"), F.array_sort(F.flatten(F.collect_set("items"))).alias("items"), F.sum("n_near").alias("n_near"))
    join = lambda done, x: F.when((F.size(done) > 0) & (x["starts"] <= F.element_at(done, -1)["stops"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["stops"], x["stops"]).alias("stops"))))).otherwise(F.concat(done, F.array(x)))
    ranges = F.aggregate("spans", F.array().cast("array<struct<starts:bigint,stops:bigint>>"), join)
    return grouped.withColumn("ranges", ranges).select("row", "doc_id", "n_words", F.col("ranges.starts").alias("starts"), F.col("ranges.stops").alias("stops"), "items", "n_near")


def contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't contaminated.

    Rows are told apart by id and text, so null and repeated ids don't take others with them; null and empty texts
    stay. No rows or no items: nothing goes. Other columns, whatever their names, come through.
    """
    found = hits(written(build_index(docs.select("doc_id", "text"), text_hash()), "postings", **LARGE_VALUES), items)
    bad = found.where(contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).distinct()
    left = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("own_row"))
    return left.join(bad, left["own_id"].eqNullSafe(bad["bad_id"]) & (left["own_row"] == bad["bad_row"]), "left_anti").select("whole.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the 13-word windows of ``benchmark`` in every whole document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bs),
ks AS (SELECT DISTINCT k FROM bw),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM ds),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
