import hashlib
import tarfile
import zlib

from routeloom.llm.media import HEADER_BYTES, decode, encode, header, store_media, to_payload

from .corpus import frame, rows


def test_round_trip(spark, tmp_path):
    data = rows()
    out = store_media(frame(spark, data), f"file://{tmp_path}/media").collect()
    assert len(out) == len(data)
    texts = {r[0]: (r[1] or "").encode() for r in data}
    by_text = {}
    for r in out:
        raw = texts[r.doc_id]
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        with open(r.shard, "rb") as f:
            f.seek(r.offset)
            stored = f.read(r.length)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 == r.digest
        assert header(stored[:HEADER_BYTES]) == (576, len(payload) // 576, 8) == (r.width, r.height, r.bit_depth)
        assert decode(stored).tobytes()[: len(raw)] == raw
        assert by_text.setdefault(raw, (r.digest, r.feature)) == (r.digest, r.feature)
    names = [m.name for s in {r.shard for r in out} for m in tarfile.open(s)]
    assert {n.removesuffix(".png") for n in names} == {r.digest for r in out}


def test_empty_table(spark, tmp_path):
    assert store_media(frame(spark, []), f"file://{tmp_path}/media").collect() == []


def test_padding():
    assert len(to_payload(b"")) == 576 and len(to_payload(b"x" * 576)) == 576 and len(to_payload(b"x" * 577)) == 1152
    assert decode(encode(to_payload(b"abc"))).tobytes()[:3] == b"abc"


def test_features_against_plain_numbers(spark, tmp_path):
    """Size, mean, deviation and histogram of the padded bytes, counted one by one."""
    data = rows()
    got = {r.doc_id: r.feature for r in store_media(frame(spark, data), f"file://{tmp_path}/media").collect()}
    for doc, text, *_ in data:
        payload = list(to_payload((text or "").encode()))
        mean = sum(payload) / len(payload)
        spread = max(0.0, sum(b * b for b in payload) / len(payload) - mean * mean) ** 0.5
        hist = ",".join(str(sum(16 * k <= b < 16 * k + 16 for b in payload)) for k in range(16))
        assert got[doc] == f"576x{len(payload) // 576};mean={mean:.6f};sd={spread:.6f};hist={hist}"


def test_many_equal_rows_fill_more_than_one_shard(spark, tmp_path):
    docs = spark.range(60_000).selectExpr("if(id % 7 = 0, null, id % 100) AS doc_id", "'the same text' AS text").coalesce(1)
    out = store_media(docs, f"file://{tmp_path}/m")
    row = out.selectExpr("count(*) n", "count(doc_id) ids", "count(distinct shard) shards", "count(distinct digest) digests", "count(distinct feature) features").first()
    assert (row.n, row.shards, row.digests, row.features) == (60_000, 1, 1, 1) and row.ids == 60_000 - 8572
    shards = store_media(docs, f"file://{tmp_path}/n", shard_rows=1000).selectExpr("count(*) n", "count(distinct media_sha256) m").first()
    assert tuple(shards) == (60_000, 1)
