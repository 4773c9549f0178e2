"""Media columns: interleaved documents of text and media references, with payloads resolved by digest.

* ``interleave`` parses HTML into an ordered array of parts: text, and references to media with their caption.
  A part's position is its place in the page, so texts, references and captions stay aligned.
* ``image_store`` stores payloads losslessly as 8-bit grey images (PNG, 64 samples a row): a table in the shared
  folder of the payload's digest and the image's bytes. ``descriptions`` reads the stored bytes, decodes and describes
  them; ``payloads`` gives them back.
* ``resolve`` joins references to a table by digest and puts what it finds back into each part's place; a
  reference without a payload stays, unresolved.

Payload bytes never take part in a shuffle: a task stores each payload that it meets once, at the place where it has
read it, and only digests and descriptions are joined. A payload that many tasks meet has a stored form from each,
all of the same bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LARGE_VALUES, small_batches, table, text_bytes, written
from .html import ATTRIBUTE, CLOSE, TOKEN

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PARTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_INLINE = frozenset("a b i u em strong span small sub sup code mark abbr cite q s time wbr font".split())
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source", "embed": "embed"}


def parse_parts(page: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, ref, caption): texts of blocks and media references in page order.

    A caption is the text of the figure's caption, wherever it stands in the figure, else the alternative text.
    """
    parts: list[list] = []
    buffer: list[str] = []
    figure: list[int] | None = None
    caption: list[str] | None = None

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            parts.append([len(parts), "text", text, None, None])

    def close_caption() -> None:
        nonlocal caption
        if caption is not None:
            text = " ".join("".join(caption).split())
            for k in figure or []:
                parts[k][4] = text or parts[k][4]
            pending.append(text)
            caption = None

    pending: list[str] = []
    at = 0
    while True:
        m = TOKEN.search(page, at)
        chunk = unescape(page[at : m.start() if m else len(page)])
        (buffer if caption is None else caption).append(chunk)
        if m is None:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if tag in ("script", "style") and not m[1]:
            end = CLOSE[tag].search(page, at)
            at = end.start() if end else len(page)
        if not tag or tag in _INLINE:
            continue
        if tag == "figcaption":
            if m[1]:
                close_caption()
            else:
                flush()
                caption = []
            continue
        if caption is None:
            flush()
        if tag == "figure":
            close_caption()
            figure = None if m[1] else []
            pending.clear()
        elif tag in _MEDIA and not m[1]:
            found: dict[str, str] = {}
            for name, *values in ATTRIBUTE.findall(m[3]):
                found.setdefault(name.lower(), unescape("".join(values)))
            if ref := found.get("src"):
                said = pending[-1] if figure is not None and pending and pending[-1] else found.get("alt") or None
                parts.append([len(parts), _MEDIA[tag], None, ref, said])
                if figure is not None:
                    figure.append(len(parts) - 1)
    close_caption()
    flush()
    return [tuple(x) for x in parts]


def interleave(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, parts) for every row: see ``parse_parts``. Null and empty pages have no parts."""

    def of(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            rows = [[dict(zip(("position", "kind", "text", "ref", "caption"), p)) for p in parse_parts(x.as_py() or "")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[key, "parts"])

    return pages.select(key, F.col(html).cast("string").alias(html)).transform(small_batches).mapInArrow(of, f"{key} {pages.schema[key].dataType.simpleString()}, parts {PARTS}")


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def encode_image(payload: bytes) -> bytes:
    """A grey 8-bit PNG of 64 samples a row; ``payload`` is a positive multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    raw = b"".join(b"\0" + payload[k : k + WIDTH] for k in range(0, len(payload), WIDTH))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def decode_image(stored: bytes) -> bytes:
    """The samples of an image that ``encode_image`` made; ``ValueError`` if its bytes were damaged."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data = 8, []
    while at < len(stored):
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = zlib.decompress(b"".join(data))
    step = WIDTH + 1
    if any(raw[::step]):
        raise ValueError("filtered rows")
    return b"".join(raw[k + 1 : k + step] for k in range(0, len(raw), step))


def describe(stored: bytes) -> tuple:
    """What a stored image holds: see ``DESCRIPTION``."""
    import numpy as np

    samples = decode_image(stored)
    a = np.frombuffer(samples, np.uint8)
    histogram = np.bincount(a >> 4, minlength=16) * 1000 // len(a)
    # the mean of each of eight bands of rows, against the mean of all
    bands = [int(x.sum(dtype=np.int64)) * len(a) > int(a.sum(dtype=np.int64)) * len(x) for x in np.array_split(a, 8)]
    feature = f"{len(a) // WIDTH}x{WIDTH};bands={''.join(str(int(b)) for b in bands)};h=" + ".".join(map(str, histogram.tolist()))
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


DESCRIPTION = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def image_store(payloads: DataFrame) -> DataFrame:
    """The written store of ``payloads`` (digest, data): (digest, n_bytes, media), media being the stored images.

    A task stores each digest once, so a digest may come once from each task. Null data counts as empty. Rows of a
    null digest are stored each.
    """

    def of(batches):
        import pyarrow as pa

        met: set[str] = set()
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest is None or digest not in met:
                    met.add(digest)
                    own = data.as_py() or b""
                    rows.append((digest, len(own), encode_image(padded(own))))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()))], names=["digest", "n_bytes", "media"])

    return written(payloads.select("digest", "data").transform(small_batches).mapInArrow(of, "digest string, n_bytes long, media binary"), "image-store", **LARGE_VALUES)


def descriptions(store: DataFrame) -> DataFrame:
    """(digest, n_bytes, ...): a row for each digest of a written store, with what its stored bytes hold."""

    def of(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DESCRIPTION.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [describe(x.as_py()) for x in batch.column(2)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["digest", "n_bytes", *names])

    described = store.select("digest", "n_bytes", "media").transform(small_batches).mapInArrow(of, f"digest string, n_bytes long, {DESCRIPTION}")
    return described.dropDuplicates(["digest"])


def payloads(store: DataFrame) -> DataFrame:
    """(digest, data) of a written store: the stored images' samples, without the padding."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            data = [decode_image(x.as_py())[:n] for n, x in zip(batch.column(1).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["digest", "data"])

    return store.select("digest", "n_bytes", "media").transform(small_batches).mapInArrow(of, "digest string, data binary")


#: Digests with more than this share of all references are joined by broadcast; there are fewer than its inverse.
COMMON = 1 / 1024


def resolve(sequences: DataFrame, store: DataFrame, key: str, scheme: str = "sha256:") -> DataFrame:
    """A row for each part of ``sequences`` (key, parts), with the columns of ``store`` (digest, ..., a row for each)
    in references of ``scheme`` followed by a digest; null in texts and in references that nothing resolves.

    A row without parts keeps one row, of nulls. Columns of the store must differ from a part's. Texts don't enter the
    join, and digests that a large share of the references has don't meet in one task.
    """
    parts = sequences.select(key, F.explode_outer("parts").alias("p")).select(key, "p.*")
    digest = F.when(F.startswith("ref", F.lit(scheme)), F.substring("ref", len(scheme) + 1, 1 << 20))
    parts = written(parts.withColumn("digest", digest), "parts")
    plain = parts.where("digest is null")
    for field in store.schema:
        if field.name != "digest":
            plain = plain.withColumn(field.name, F.lit(None).cast(field.dataType))
    referring = parts.where("digest is not null")
    least = int(referring.count() * COMMON)
    common = written(referring.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > least).where(F.lit(least > 0)).select("digest"), "common-digests")
    own = F.broadcast(common)  # fewer than 1 / COMMON rows
    many = referring.join(own, "digest", "left_semi").join(F.broadcast(store.join(own, "digest", "left_semi")), "digest", "left")
    few = referring.join(own, "digest", "left_anti").join(store, "digest", "left")
    return plain.unionByName(many).unionByName(few).drop("digest")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as an interleaved page: a title, and its whole text as an image by
    digest, with a caption. Returns the image's place, caption and what its stored form holds.

    Null texts count as empty, an empty text is one row of zero samples, equal texts share a stored form, repeated
    rows and null ids each keep a row. Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("data"))
    digest = F.sha2("data", 256)
    caption = F.concat(F.lit("text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    page = F.concat(F.lit("<article><h1>Document</h1><figure><img src='sha256:"), digest, F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure></article>"))
    sequences = interleave(own.select("doc_id", page.alias("html")), "doc_id")
    described = written(descriptions(image_store(own.select(digest.alias("digest"), "data"))), "descriptions")
    resolved = resolve(sequences, described, "doc_id").where("kind = 'image'")
    return resolved.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, stored as an image and read back."""
    return documents_as_media(table(spark, sf_dir, "documents"))
