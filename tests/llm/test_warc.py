import hashlib

from pyspark.sql import Row

from weftlink.llm import warc

BIG = "<p>" + "x" * 1200 + "</p>"
ROWS = [(1, "http://a/1", BIG), (7, "http://a/2", BIG), (3, None, BIG), (4, "http://b\r\n/x", "small"), (5, "u", "small"), (6, "u", None), (-9, "ü", "é" * 700), (-8, "u", "é" * 700), (7, "http://a/2", BIG), (12, "x", "")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([Row(p, u, h, "clash", 1) for p, u, h in rows], "page_id long, url string, html string, digest string, n int")


def test_round_trip(spark):
    pages = frame(spark).repartition(3)
    manifest = warc.write(pages, archive_bytes=900)
    for split in (64, 1000, 1 << 20):
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(manifest, split).collect())
        want = []
        for p, _, h in ROWS:
            data = (h or "").encode()
            same = [q for q, _, x in ROWS if (x or "").encode() == data] if len(data) >= 1000 else [p]
            first = max(same)
            want.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if p == first else "revisit", None if p == first else first))
        assert sorted(got, key=str) == sorted(want, key=str)
    joined = warc.write(pages, broadcast_groups=0)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(joined).collect()), key=str) == sorted(want, key=str)
    payload = {r.page_id: r.payload for r in warc.read(manifest).where("record_type = 'response'").collect()}
    assert bytes(payload[7]).decode() == BIG and bytes(payload[-8]).decode() == "é" * 700


def test_null_ids_and_empty(spark):
    pages = frame(spark, [(None, "u", BIG), (2, "u", BIG), (None, None, None)])
    rows = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect())
    assert rows == [("2", "response", None), ("None", "response", None), ("None", "revisit", 2)]
    assert warc.read(warc.write(frame(spark).where("false"))).count() == 0


def test_ranges_own_each_member_once(tmp_path):
    """Damaged bytes, false magic and every cut: each whole member is found by exactly one range."""
    members = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, "00", False, None) for i in range(8)]
    data = b"\x1f\x8b\x08junk" + members[0] + members[1] + members[2][:40] + b"\x1f\x8b\x08\x00" + b"".join(members[3:])
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    for size in (50, 97, 300, 10_000):
        found = []
        with path.open("rb") as f:
            for start in range(0, len(data), size):
                found += [warc.parse(c)[0] for _, c in warc.Members(f, start, min(start + size, len(data)), chunk=64)]
        assert found == [0, 1, 3, 4, 5, 6, 7]


def test_candidates_are_decoded(tmp_path):
    """Long gzip headers are read over, headers that are not a record's are refused, and nested archives stay inside."""
    import gzip
    import io
    import random
    import struct
    import zlib

    noise = random.Random(1).randbytes
    inner = b"".join(warc.record(100 + i, "http://in", noise(900), "00", False, None) for i in range(5))
    outer = warc.record(1, "http://x/" + "p" * 9000, inner + noise(3000), "00", False, None)
    plain = zlib.decompress(warc.record(2, "u", b"text", "00", False, None), 31)
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    extra = noise(30_000)
    long = b"\x1f\x8b\x08\x0c" + b"\0" * 6 + struct.pack("<H", len(extra)) + extra + b"name" * 3000 + b"\0" + packed.compress(plain) + packed.flush() + struct.pack("<II", zlib.crc32(plain), len(plain))
    wrong = gzip.compress(b"WARC/1.1\r\nno: record\r\n\r\n") + gzip.compress(b"WARC-like text") + gzip.compress(b"")
    data = outer + wrong + long + wrong + warc.record(3, "u", b"end", "00", False, None)
    assert outer.find(warc.MAGIC, 1) < 0 and warc.parse(zlib.decompress(outer, 31))[2].startswith(inner)
    for size in (700, 5000, 10**6):
        found = []
        for start in range(0, len(data), size):
            found += [warc.parse(c)[0] for _, c in warc.Members(io.BytesIO(data), start, min(start + size, len(data)))]
        assert found == [1, 2, 3]


def test_ids_in_urns():
    for i in (0, 5, -6, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_urn(i)) == i


def test_archives_of_other_writers(spark, tmp_path):
    """Standard revisits, names that are no UUIDs, digests in base 32, several records in a member, other record types."""
    import base64
    import gzip

    def part(kind, body=b"", **fields):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Date: 2020-01-01T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(body)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    digest = hashlib.sha1(b"one").digest()
    named = {"WARC_Record_ID": "<urn:x:1>", "WARC_Target_URI": "http://a/1"}
    revisit = {"WARC_Record_ID": "<urn:x:3>", "WARC_Payload_Digest": f"sha1:{base64.b32encode(digest).decode()}", "WARC_Refers_To": "<urn:x:1>", "WARC_Target_URI": "http://a/3"}
    uuid_named = {"WARC_Record_ID": "<urn:x:4>", "WARC_Refers_To": "<urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8>", "WARC_Payload_Digest": f"sha1:{digest.hex().upper()}"}
    members = [
        part("warcinfo", b"x", WARC_Record_ID="<urn:x:0>"), part("response", http + b"one", **named) + part("request", b"GET", WARC_Record_ID="<urn:x:2>") + part("response", http + b"WARC/1.0 two", **named),
        part("revisit", http, **revisit), part("revisit", **uuid_named), part("response", http, **named),
    ]
    data = b"".join(map(gzip.compress, members))
    (tmp_path / "x.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([Row(f"file://{tmp_path}/x.warc.gz", len(data))], "uri string, bytes long")
    for size in (64, 1 << 20):
        got = sorted((r.url or "", r.record_type, bytes(r.payload) if r.payload is not None else None, r.payload_bytes, r.payload_digest, r.refers_to, r.page_id) for r in warc.read(manifest, size).collect())
        sha = lambda x: hashlib.sha1(x).hexdigest()
        assert got == sorted([
            ("http://a/1", "response", b"one", 3, sha(b"one"), None, None), ("http://a/1", "response", b"WARC/1.0 two", 12, sha(b"WARC/1.0 two"), None, None), ("http://a/1", "response", b"", 0, sha(b""), None, None),
            ("http://a/3", "revisit", None, None, digest.hex(), None, None), ("", "revisit", None, None, digest.hex(), None, None),
        ])
