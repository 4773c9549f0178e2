"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, padded to words of the perfect binary
Golay code (23, 12, 7). Every word lies within 3 bits of exactly one codeword, its *home*; words at distance 3
from home have five further codewords at distance 4. Home and those are a word's *near* codewords (six or one).
Of two words that differ in at most one bit, each has the other's home among its near codewords.

If two fingerprints differ in at most 3 bits, by the pigeonhole principle either

* one segment is equal and another differs in at most one bit: key (that segment, codeword of the other), or
* every segment differs in exactly one bit: key (codewords of all three segments).

So each distinct fingerprint gives *own* keys (homes) and *other* keys (near codewords in some places), an
equi-join of own with other keys proposes every pair within 3 bits, and ``bit_count(xor) <= 3`` verifies it.
Keys have 33 bits or more, 7 + 36 + 36 at most for each fingerprint.

Documents never meet in this join: only distinct fingerprints do, so exact copies cost nothing. A key that many
*different* near copies share isn't expanded into pairs at first: its fingerprints are linked to the smallest, and
to the smallest that equals them in two segments, where those are within 3 bits. What these links leave apart in
such a key is then joined exactly, fingerprints of different components only, so no link between components is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import small_batches, table, text_bytes, text_hash, written
from .components import connected_components

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: A key with more own-times-other pairs than this is linked in a line first.
CROWDED = 4096
#: Fingerprints of a block in which what shares a crowded key is compared.
FEW, MANY = 512, 8192
#: Fingerprints whose keys one task makes, up to a number of tasks.
TASK_ROWS, MOST_TASKS = 16_384, 50_000
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_tables: list[np.ndarray] = []


def golay_tables() -> np.ndarray:
    """errors[s]: the error patterns of syndrome ``s`` of weight 3 or less, then those of weight 4 if that
    weight is 3; -1 fills up to six."""
    if not _tables:
        patterns = {w: np.array([sum(1 << i for i in c) for c in combinations(range(23), w)], np.int32) for w in range(5)}
        errors = np.full((2048, 6), -1, np.int64)
        filled, leader = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
        for w, own in patterns.items():
            for s, pattern in zip(syndrome(own).tolist(), own.tolist()):
                if w < 4 or leader[s] == 3:
                    errors[s, filled[s]] = pattern
                    leader[s], filled[s] = min(w, 3), filled[s] + 1
        _tables.append(errors)
    return _tables[0]


def syndrome(x: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator."""
    x = np.array(x, dtype=np.int32)
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * np.int32(GENERATOR << (bit - 11))
    return x


def near_codewords(words: np.ndarray) -> np.ndarray:
    """(n, 6) twelve-bit codeword numbers, home first; -1 where a word has none."""
    errors = golay_tables()[syndrome(words)]
    return np.where(errors < 0, -1, (words.astype(np.int64)[:, None] ^ errors) >> 11)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, key, own) of all keys of unsigned 64-bit fingerprints."""
    n = len(fingerprints)
    segments = [((fingerprints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near = [near_codewords(s << (23 - bits)) for s, (_, bits) in zip(segments, SEGMENTS)]
    index, out, own = [], [], []

    def add(key: np.ndarray, ok: np.ndarray, mine: bool) -> None:
        key, ok = key.reshape(n, -1), ok.reshape(n, -1)
        rows = np.nonzero(ok)
        index.append(rows[0])
        out.append(key[rows])
        own.append(np.full(len(rows[0]), mine))

    kind = 1
    for i in range(3):
        for j in range(3):
            if i != j:
                base = (np.int64(kind) << 56) | (segments[i] << 12)
                add(base[:, None] | near[j][:, :1], near[j][:, :1] >= 0, True)
                add(base[:, None] | near[j], near[j] >= 0, False)
                kind += 1
    base = np.int64(kind) << 56
    homes = [x[:, 0] for x in near]
    # own: homes of the first two with each near codeword of the third; other: the reverse
    add((base | (homes[0] << 24) | (homes[1] << 12))[:, None] | near[2], near[2] >= 0, True)
    ok = (near[0][:, :, None] >= 0) & (near[1][:, None, :] >= 0)
    add((base | homes[2])[:, None, None] | (near[0][:, :, None] << 24) | (near[1][:, None, :] << 12), ok, False)
    return np.concatenate(index), np.concatenate(out), np.concatenate(own)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's bytes: A-Z lower-cased, words between white space, hashes of all shingles."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, marked: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer; null and blank texts have 0. ``marked`` adds
    the text's hash, ``mark``."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8")), *batch.columns[2:]], names=["doc_id", "fp", *more])

    more = ["mark"] if marked else []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"), *(text_hash().alias(m) for m in more))
    return own.transform(small_batches).mapInArrow(of, "doc_id long, fp long" + "".join(f", {m} long" for m in more))


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, own, fp) of each row's fp.

    The keys take far more room than the fingerprints, so these are dealt first to as many tasks as the keys need.
    """

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048).column("fp")
                index, key, own = keys(part.to_numpy(zero_copy_only=False).view("<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), part.take(pa.array(index))], names=["key", "own", "fp"])

    tasks = min(MOST_TASKS, fps.count() // TASK_ROWS + 1)
    return fps.select("fp").repartition(tasks, "fp").transform(small_batches).mapInArrow(of, "key long, own boolean, fp long")


def _signed(x: int) -> int:
    """The low 64 bits as a signed integer."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _close(x, y):
    return F.bit_count(x.bitwiseXOR(y)) <= DISTANCE


def links(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct fingerprints: (a, b) of verified pairs, and (key, own, fp) of what shares crowded keys, whose
    fingerprints are linked to the least of their key and to the least that equals them in two segments only."""
    keyed = _keyed(fps)
    sizes = keyed.groupBy("key").agg(F.count_if("own").alias("owns"), F.count_if(~F.col("own")).alias("others"), F.min("fp").alias("least"), F.max("fp").alias("most"))
    # a key of one fingerprint alone proposes nothing; an own and an other key of two may be all that a pair shares
    shared = sizes.where("owns > 0 and others > 0 and least <> most").select("key", "least", (F.col("owns") * F.col("others") > CROWDED).alias("crowded"))
    # both sides grow with the corpus: merged, so that a plan for a small one is that for a large one
    met = written(keyed.join(written(shared, "shared-keys").hint("merge"), "key"), "met")
    calm = met.where("not crowded")
    pairs = calm.where("own").select("key", F.col("fp").alias("a")).join(calm.where("not own").select("key", F.col("fp").alias("b")), "key").where((F.col("a") != F.col("b")) & _close(F.col("a"), F.col("b")))
    crowd = met.where("crowded")
    to_least = crowd.select(F.col("least").alias("a"), F.col("fp").alias("b"))
    masks = F.array(*(F.lit(_signed(~(((1 << bits) - 1) << at))) for at, bits in SEGMENTS))
    masked = crowd.select("fp").distinct().select("fp", F.posexplode(masks).alias("i", "mask")).select("fp", "i", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    least = masked.groupBy("i", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    alike = masked.join(least, ["i", "rest"]).select("a", F.col("fp").alias("b"))
    lined = to_least.union(alike).where((F.col("a") != F.col("b")) & _close(F.col("a"), F.col("b")))
    return pairs.select("a", "b").union(lined), crowd.select("key", "own", "fp")


def _across(crowd: DataFrame, rooted: DataFrame) -> DataFrame:
    """(a, b): roots of verified pairs of different components that share a crowded key.

    Of each key, the component with most of its fingerprints meets only the others, so a key that one component
    fills costs nothing. What is left of a key is dealt to blocks of ``FEW`` by ``MANY`` fingerprints, so that no task
    gets a key as a whole.
    """
    own = written(crowd.join(rooted.select("fp", "root"), "fp"), "crowd")
    counts = own.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.max("n").alias("n_most"))
    parts = lambda n, size: F.ceil(n / size).cast("int").alias
    shares = written(counts.where("roots > 1").select("key", "most", parts(F.col("n") - F.col("n_most"), FEW)("rows"), parts(F.col("n"), MANY)("columns")), "crowded-blocks")
    mixed = own.join(shares, "key")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one_of = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    few = mixed.where("root <> most").select("key", "own", "fp", "root", one_of("rows").alias("i"), all_of("columns").alias("j"))
    many = mixed.select("key", "own", "fp", "root", all_of("rows").alias("i"), one_of("columns").alias("j"))
    of = lambda df, is_own, fp, root: df.where("own" if is_own else "not own").select("key", "i", "j", F.col("fp").alias(fp), F.col("root").alias(root))
    block = ["key", "i", "j"]
    both = of(few, True, "x", "a").join(of(many, False, "y", "b"), block).unionByName(of(many, True, "x", "a").join(of(few, False, "y", "b"), block))
    return both.where((F.col("a") != F.col("b")) & _close(F.col("x"), F.col("y"))).select("a", "b").distinct()


def _rooted(least: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    return written(least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), name)


def _classes(fps: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the written fingerprints (doc_id, fp)."""
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    pairs, crowd = links(least.select("fp"))
    edges = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rooted = _rooted(least, connected_components(edges), "rooted")
    if crowd.limit(1).count():  # what the links leave apart in crowded keys is joined exactly
        again = connected_components(_across(crowd, rooted)).withColumnRenamed("root", "top")
        rooted = rooted.join(again, rooted["root"] == again["node"], "left").select("fp", F.coalesce("top", "root").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Fingerprints link at 3 differing bits or fewer; component_id is the smallest doc_id reachable, itself
    included. A null or blank text has fingerprint zero, linked like any other. Rows with a null doc_id take part
    but are never a component_id unless no other id is there. Repeated rows stay. Other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    return fps.join(_classes(fps).drop("root"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of near-duplicates: that of the smallest doc_id (of rows with equal ids, the
    one whose text comes first; null ids only where the component has no other); all columns of ``docs``.

    Rows are told apart by id and text, so null and repeated ids of different components don't meet. Null and blank
    texts are near-duplicates of each other. No rows, no result. Other columns, whatever their names, come through.
    """
    fps = written(fingerprints(docs, shingle, marked=True), "fingerprints")
    of = fps.join(_classes(fps), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    classes = of.select(F.col("doc_id").alias("kept_id"), "mark", "root").distinct()
    own = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("own_id"), text_hash().alias("own_mark"))
    # ids and marks are unique there, so the build side of no task is more than its share; the texts needn't be sorted for it
    kept = own.join(classes.hint("shuffle_hash"), own["own_id"].eqNullSafe(classes["kept_id"]) & (own["own_mark"] == classes["mark"]))
    first = Window.partitionBy("root").orderBy("whole.text", F.xxhash64("whole"))
    return kept.withColumn("rank", F.row_number().over(first)).where("rank = 1").select("whole.*")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
