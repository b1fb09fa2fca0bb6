import gzip
import random
import tempfile

import brute
import pytest

from textmill.llm import warc

SF = "/root/testdata/sf0.01"
COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def expected(pages):
    most = {}
    for p in pages:
        b = (p["html"] or "").encode()
        if p["page_id"] is not None:
            most[b] = max(most.get(b, p["page_id"]), p["page_id"])
    out = []
    for p in pages:
        b = (p["html"] or "").encode()
        again = b in most and most[b] != p["page_id"]
        out.append({"page_id": p["page_id"], "payload_bytes": len(b), "payload_digest": warc.digest(b),
                    "record_type": "revisit" if again else "response", "refers_to": most[b] if again else None})
    return out


def round_trip(spark, pages):
    path = tempfile.mkdtemp(prefix="warc-") + "/a"
    warc.write(pages, path)
    back = warc.read(spark, path)
    got = brute.rows(warc.page_records(back))
    assert brute.key_counts(got, COLS) == brute.key_counts(expected(brute.rows(pages)), COLS)
    assert back.where("kind = 'gap'").count() == 0
    return back


def test_whole_table(spark):
    round_trip(spark, spark.read.parquet(f"{SF}/pages.parquet"))


def test_edges_and_payloads(spark):
    rows = [(1, "u\r\nx y", None, 1), (2, None, "", 2), (3, "a", "same", 3), (4, "b", "same", 4), (4, "b", "same", 4), (None, "c", "same", 5),
            (None, "d", "alone", 6), (7, "e", "é漢😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 70_000, 7), (-8, "f", "\x1f\x8b\x08", 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    back = {(r["record_id"], r["record_type"]): r for r in brute.rows(round_trip(spark, pages).where("kind = 'record'"))}
    assert back["<urn:page:7>", "response"]["payload"] == rows[7][2].encode()
    assert back["<urn:page:1>", "revisit"]["target_uri"] == "u%0D%0Ax%20y"
    round_trip(spark, pages.limit(0))


def test_long_addresses(spark):
    long = "http://h/" + "a b" * 30_000 + "é" * 5_000
    rows = [(1, long, "x", 1), (2, long, "same", 4), (3, "u", "same", 4), (4, "v", None, 0), (5, long + "c" * 60_000, "same", 4)]
    back = brute.rows(round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")))
    uris = {r["record_id"]: r["target_uri"] for r in back}
    assert uris["<urn:page:1>"] == long.replace(" ", "%20") and len(uris["<urn:page:5>"]) > 200_000


def test_heads_without_an_end():
    plain = archive(4, False)
    cut = plain[1][:60] + b"\r\n"
    assert ids(plain[0] + cut + plain[2] + plain[3]) == [f"<urn:page:{i}>" for i in (0, 2, 3)]


def archive(n, packed, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        body = bytes(r.randrange(32, 127) for _ in range(r.randrange(0, 3000)))
        if i % 5 == 0:
            body += warc.record(900 + i, None, b"inner")  # a whole record inside a payload
        rec = warc.record(i, "u", body)
        out.append(gzip.compress(rec, mtime=0) if packed else rec)
    return out


def ids(data):
    return [x[3]["record_id"] for x in warc.salvage(data) if x[0] == "record"]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("how", ["flip", "cut", "insert", "head"])
def test_salvage_recovers_all_other_records(packed, how):
    parts = archive(12, packed)
    names = [f"<urn:page:{i}>" for i in range(12)]
    assert ids(b"".join(parts)) == names and not [x for x in warc.salvage(b"".join(parts)) if x[0] == "gap"]
    for hit in (0, 4, 6, 11):
        bad = list(parts)
        p = bad[hit]
        if how == "flip":
            k = len(p) // 2
            bad[hit] = p[:k] + bytes([p[k] ^ 0x55]) + p[k + 1:]
        elif how == "cut":
            bad[hit] = p[:len(p) - 9]
        elif how == "insert":
            bad[hit] = b"garbage\r\n\x1f\x8b\x08 more WARC/1.1\r\n" + p
        else:
            bad[hit] = b"XXXX" + p[4:]
        data = b"".join(bad)
        got = [x for x in warc.salvage(data)]
        want = [n for i, n in enumerate(names) if i != hit or how == "insert"]
        if not packed and hit % 5 == 0 and how in ("flip", "head", "cut"):
            found = [n for n in ids(data) if n != f"<urn:page:{900 + hit}>"]  # the record inside the damaged payload is one too
        else:
            found = ids(data)
        assert found == want, (how, hit)
        gaps = [x for x in got if x[0] == "gap"]
        assert gaps and all(x[3] for x in gaps)
        # records and gaps cover the file without overlap
        spans = sorted({(x[1], x[2]) for x in got})
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_salvage_whatever_the_file_began_with():
    parts = archive(12, True)
    names = [f"<urn:page:{i}>" for i in range(12)]
    assert ids(b"garbage\r\n\x1f\x8b\x08 more WARC/1.1\r\n" + b"".join(parts)) == names
    assert ids(b"XXXX" + parts[0][4:] + b" WARC/1.1\r\n" + b"".join(parts[1:])) == names[1:]
    plain = archive(12, False)
    bad = plain[3][:60] + b"#" + plain[3][61:-5]
    mixed = b"".join([*plain[:3], bad, *parts[4:8], b"noise", *plain[8:]])
    assert [n for n in ids(mixed)] == names[:3] + names[4:]


def spans_apart(got):
    spans = sorted({(x[1], x[2]) for x in got})
    return all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_salvage_inside_a_member():
    plain, parts = archive(12, False), archive(12, True)
    names = [f"<urn:page:{i}>" for i in range(12)]
    # one wrong digest, also of a record that holds a record; a lost version line
    for hit, change in ((5, lambda p: p[:-200] + b"\x01" + p[-199:]), (6, lambda p: p[:-200] + b"\x01" + p[-199:]), (7, lambda p: b"X" + p[1:])):
        stream = gzip.compress(b"".join(change(p) if i == hit else p for i, p in enumerate(plain[:10])), mtime=0)
        data = stream + b"".join(parts[10:])
        got = list(warc.salvage(data))
        assert ids(data) == [n for i, n in enumerate(names) if i != hit]
        assert [x[1:3] for x in got if x[0] == "gap"] == [(0, len(stream))] and spans_apart(got)


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_of_a_broken_member(level):
    plain, parts = archive(40, False), archive(42, True)[40:]
    stream = gzip.compress(b"".join(plain), level, mtime=0)
    for k in (len(stream) // 3, len(stream) // 2, len(stream) - 2000):
        for broken in (stream[:k], stream[:k] + b"\xff" * 40 + stream[k + 40:]):
            for data in (broken, broken + b"".join(parts)):
                got, found = list(warc.salvage(data)), ids(data)
                whole = sum(len(p) for p in plain) * k // len(stream)
                before = sum(sum(map(len, plain[:i + 2])) < whole * 0.9 for i in range(40))
                assert found[:before] == [f"<urn:page:{i}>" for i in range(before)] and before > 5
                assert len(set(found)) == len(found) and spans_apart(got) and [x for x in got if x[0] == "gap"]
                assert data is broken or found[-2:] == ["<urn:page:40>", "<urn:page:41>"]


def test_gaps_reach_the_log(spark):
    path = tempfile.mkdtemp(prefix="warc-")
    parts = archive(10, True)
    parts[3] = parts[3][:50] + b"\0" * 20 + parts[3][70:]
    with open(path + "/x.warc.gz", "wb") as f:
        f.write(b"".join(parts))
    back = brute.rows(warc.read(spark, path))
    gap, = [r for r in back if r["kind"] == "gap"]
    assert gap["offset"] == sum(map(len, parts[:3])) and gap["length"] == len(parts[3]) and gap["reason"]
    assert sum(r["kind"] == "record" for r in back) == 9


@pytest.mark.parametrize("packed", [False, True])
def test_a_record_cut_anywhere_in_its_head(packed):
    page = warc.record(98, "http://a/98", b"whole")
    cut = warc.record(99, "http://a/99", b"same", refers_to=500, revisit=True)
    after = warc.record(7, "http://a/WARC/1.1", b"same") + warc.record(8, None, b"tail", refers_to=3, revisit=True)
    head = cut.index(b"\r\n\r\n") + 4
    assert [x[0] for x in warc.salvage(page + cut + after)] == ["record"] * 4
    for k in range(1, head + 1):
        data = page + cut[:k] + after
        data = gzip.compress(data, mtime=0) if packed else data
        got = list(warc.salvage(data))
        records = {x[3]["record_id"]: (x[3]["record_type"], x[3]["refers_to"]) for x in got if x[0] == "record"}
        assert records == {"<urn:page:98>": ("response", None), "<urn:page:7>": ("response", None), "<urn:page:8>": ("revisit", "<urn:page:3>")}, k
        gap, = [x for x in got if x[0] == "gap"]
        assert gap[3] and gap[1:3] == ((0, len(data)) if packed else (len(page), k))
