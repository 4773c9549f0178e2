import hashlib
import struct
import zlib

from pyspark.sql import functions as F

from lattica.llm import media

FIELDS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def expected(i, text):
    data = (text or "").encode()
    full = data + bytes(-len(data) % 64 or (0 if data else 64))
    return (i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), *by_hand(full))


def by_hand(full):
    """media_bytes, media_sha256 and feature, from the format's definition."""
    rows = [full[k : k + 64] for k in range(0, len(full), 64)]
    out = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows), 1)), (b"IEND", b"")):
        out += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    counts = [0] * 16
    for c in full:
        counts[c >> 4] += 1
    size, extra = divmod(len(full), 8)
    at, bands = 0, ""
    for k in range(8):
        part = full[at : at + size + (k < extra)]
        at += len(part)
        bands += str(int(sum(part) * len(full) > sum(full) * len(part)))
    return len(out), hashlib.sha256(out).hexdigest(), f"{len(rows)}x64;bands={bands};h=" + ".".join(str(c * 1000 // len(full)) for c in counts)


def test_every_text_reads_back(spark, real_docs):
    got = {tuple(r) for r in media.op1_media(spark, "/root/testdata/sf0.001").select(*FIELDS).collect()}
    assert got == {expected(r.doc_id, r.text) for r in real_docs.collect()}


def test_odd_documents(odd_docs, no_docs):
    rows = media.documents_as_media(odd_docs)
    assert sorted(map(str, (tuple(r) for r in rows.select(*FIELDS).collect()))) == sorted(str(expected(r.doc_id, r.text)) for r in odd_docs.collect())
    assert media.documents_as_media(no_docs).count() == 0
    by_text = odd_docs.select("doc_id", "text").join(rows.select("doc_id", "media_sha256", "feature"), "doc_id")
    assert by_text.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("media_sha256", "feature").alias("n")).where("n <> 1").count() == 0


def test_parts_keep_position_and_caption():
    page = "<h1>A &amp; B</h1><figure><figcaption>first <b>cap</b></figcaption><img src=a.png alt='x'></figure><p>mid</p><img src='b.png' alt='alone'><figure><img src=c.png></figure>end<!-- <img src=no> --><script>'<img src=no>'</script>"
    assert media.parse_parts(page) == [
        (0, "text", "A & B", None, None),
        (1, "image", None, "a.png", "first cap"),
        (2, "text", "mid", None, None),
        (3, "image", None, "b.png", "alone"),
        (4, "image", None, "c.png", None),
        (5, "text", "end", None, None),
    ]
    assert media.parse_parts("") == []


def test_resolve_keeps_what_nothing_resolves(spark):
    pages = spark.createDataFrame([(1, "a<img src='sha256:k'>b<img src='sha256:none'><img src='http://x/y.png'>"), (2, None)], "id long, html string")
    store = spark.createDataFrame([("k", 5)], "digest string, n int")
    got = media.resolve(media.interleave(pages, "id"), store, "id").orderBy("id", "position").select("id", "position", "kind", "ref", "n").collect()
    assert [tuple(r) for r in got] == [(1, 0, "text", None, None), (1, 1, "image", "sha256:k", 5), (1, 2, "text", None, None), (1, 3, "image", "sha256:none", None), (1, 4, "image", "http://x/y.png", None), (2, None, None, None, None)]


def test_damage_is_found():
    stored = bytearray(media.encode_image(bytes(range(64))))
    assert media.decode_image(bytes(stored)) == bytes(range(64))
    stored[-20] ^= 1
    try:
        media.decode_image(bytes(stored))
    except (ValueError, zlib.error):
        return
    raise AssertionError("damage not found")


def test_stored_bytes_are_kept_and_read(spark, real_docs):
    """The store is a table of images; payloads come back from it byte by byte, and a damaged image is noticed."""
    own = real_docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("text").cast("binary").alias("data"))
    store = media.image_store(own)
    assert store.inputFiles() and dict(store.dtypes)["media"] == "binary"
    assert {(r.digest, bytes(r.data)) for r in media.payloads(store).collect()} == {(r.digest, bytes(r.data)) for r in own.where("data is not null").collect()}
    broken = store.withColumn("media", F.concat(F.expr("substring(media, 1, 60)"), F.lit(b"x"), F.expr("substring(media, 62)")))
    try:
        media.descriptions(broken).collect()
    except Exception as e:  # noqa: BLE001
        assert "damaged" in str(e)
        return
    raise AssertionError("damage not found")


def test_common_digests_and_texts(spark):
    """Digests of most references, of few and of none; texts and rows without parts stay."""
    rows = [(k, "a<img src='sha256:hot'>") for k in range(3000)] + [(5000 + k, f"<img src='sha256:d{k}'>") for k in range(40)] + [(9000, ""), (9001, None)]
    store = spark.createDataFrame([("hot", 1), *((f"d{k}", k) for k in range(0, 40, 2))], "digest string, n int")
    got = media.resolve(media.interleave(spark.createDataFrame(rows, "id long, html string"), "id"), store, "id")
    want = [(k, i, (None, 1)[i]) for k in range(3000) for i in (0, 1)] + [(5000 + k, 0, None if k % 2 else k) for k in range(40)] + [(9000, None, None), (9001, None, None)]
    assert sorted(map(str, got.select("id", "position", "n").toLocalIterator())) == sorted(map(str, spark.createDataFrame(want, "id long, position int, n int").toLocalIterator()))


def test_real_pages_interleave(spark):
    """Every generated page: its texts and images in order, as a plain parser finds them."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.refs, self.skip = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            if tag == "img" and dict(attrs).get("src"):
                self.refs.append(dict(attrs)["src"])

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.words += data.split()

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.parts for r in media.interleave(pages, "page_id").collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        parts = got[r.page_id]
        assert [x.position for x in parts] == list(range(len(parts)))
        assert [x.ref for x in parts if x.kind != "text"] == p.refs
        assert "".join(x.text for x in parts if x.kind == "text").replace(" ", "") == "".join(p.words)
