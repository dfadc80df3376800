from __future__ import annotations

import gzip
import random

import pytest

from topicweave.llm import warc

SCHEMA = "page_id long, url string, html string, record string, digest string"


@pytest.fixture
def pages(spark):
    def build(rows):
        return spark.createDataFrame([(i, f"http://e.org/{i} x" if i else None, html, "r", "d") for i, html in rows], SCHEMA)

    return build


def record(text, kind="response", **more):
    block = text.encode()
    fields = {"WARC-Type": kind, "WARC-Block-Digest": "sha1:" + warc._digest(block), "Content-Length": len(block)} | more
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def blocks(data):
    return [b for _, _, _, b, _ in warc.salvage(data) if b is not None]


def gaps(data):
    return [(a, n) for a, n, fields, _, _ in warc.salvage(data) if fields is None]


def test_pages_round_trip(pages):
    rows = [(1, "<a>ü</a>"), (2, None), (3, "<a>ü</a>"), (4, ""), (5, "WARC/1.1\r\n\r\nx\r\n\r\n"), (6, "é" * 300_000),
            (7, "WARC/1.1\r\n\r\nx\r\n\r\n"), (0, "<a>ü</a>"), (0, "<a>ü</a>"), (None, "<a>ü</a>"), (None, "alone")]
    found = warc.archive_pages(pages(rows)).collect()
    by_html = {}
    for i, html in rows:
        if i is not None:
            by_html[html or ""] = min(i, by_html.get(html or "", i))
    assert len(found) == len(rows)
    wanted = []
    for i, html in rows:
        first = by_html.get(html or "")
        again = first is not None and i != first
        wanted.append((i, len((html or "").encode()), warc._digest((html or "").encode()),
                       "revisit" if again else "response", first if again else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in names) for r in found), key=repr) == sorted(wanted, key=repr)
    assert warc.archive_pages(pages([])).count() == 0


def test_archives_are_real_records(spark, pages, tmp_path):
    warc.write_archives(pages([(1, "<p>\r\n\r\n</p>"), (2, "b")]), str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).orderBy("record_id").collect()
    assert [bytes(r["payload"]) for r in found] == [b"<p>\r\n\r\n</p>", b"b"] and not any(r["gap"] for r in found)
    assert found[0]["target_uri"] == "http://e.org/1%20x"


@pytest.mark.parametrize("packed", [False, True])
def test_damage_costs_the_damaged_records_only(packed):
    rng = random.Random(2)
    whole = [record(f"text {i} " * rng.randrange(1, 400)) for i in range(30)]
    members = [gzip.compress(r) if packed else r for r in whole]
    texts = [r.split(b"\r\n\r\n", 1)[1][:-4] for r in whole]
    assert blocks(b"".join(members)) == texts and gaps(b"".join(members)) == []
    starts = [sum(map(len, members[:i])) for i in range(31)]
    for _ in range(20):
        data, hit = bytearray(b"".join(members)), set()
        for i in rng.sample(range(30), 3):
            at = rng.randrange(starts[i] + (10 if packed else 0), starts[i + 1])
            data[at] ^= 0x5A
            hit.add(i)
        found = blocks(bytes(data))
        missing = [t for i, t in enumerate(texts) if i not in hit and t not in found]
        assert not missing
        covered = sum(n for _, n in gaps(bytes(data))) + sum(
            n for _, n in {(a, n) for a, n, fields, _, _ in warc.salvage(bytes(data)) if fields is not None})
        assert covered == len(data)


def test_gaps_at_the_ends_and_false_starts():
    good = record("inner WARC/1.1\r\n text \x1f\x8b\x08 and more")
    assert gaps(b"junk" + good) == [(0, 4)] and blocks(b"junk" + good) == [good.split(b"\r\n\r\n", 1)[1][:-4]]
    assert gaps(good + good[:-9]) == [(len(good), len(good) - 9)]
    assert list(warc.salvage(b"")) == [] and gaps(b"WARC/1.1\r\n") == [(0, 10)]
    assert gaps(gzip.compress(good)[:-3]) == [(0, len(gzip.compress(good)) - 3)]
    assert blocks(gzip.compress(good + good) + good) == [good.split(b"\r\n\r\n", 1)[1][:-4]] * 3


@pytest.mark.parametrize("level", [0, 6])
def test_whole_records_of_a_damaged_member_are_kept(level):
    rng = random.Random(6)
    whole = [record(f"{i} " + "".join(rng.choices("abcdefghij ", k=3000))) for i in range(60)]
    texts = [r.split(b"\r\n\r\n", 1)[1][:-4] for r in whole]
    packed = gzip.compress(b"".join(whole), level)
    cut = packed[:len(packed) * 3 // 4]
    found = blocks(cut)
    assert 40 <= len(found) < 60 and found == texts[:len(found)] and gaps(cut) == [(0, len(cut))]
    assert blocks(cut + whole[0])[:len(found)] == found
    bad = bytearray(whole[5])
    bad[-20] ^= 1
    member = gzip.compress(b"".join([*whole[:5], bytes(bad), *whole[6:]]), level)
    assert blocks(member) == texts[:5] + texts[6:]
    assert gaps(member) == [(0, 0)]


def revisit(i):
    return (f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Refers-To: <urn:page:0>\r\n"
            "Content-Length: 0\r\n\r\n\r\n\r\n").encode()


def ids(data):
    return [f["warc-record-id"] for _, _, f, _, _ in warc.salvage(data) if f is not None]


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("spoilt", [1, 8, 30])
def test_records_behind_a_damaged_member_with_equal_blocks_are_kept(level, spoilt):
    member = bytearray(gzip.compress(revisit(1) + record("two", **{"WARC-Record-ID": "<urn:page:2>"}), level))
    member[-spoilt if spoilt < 30 else -1:] = b""
    if spoilt < 30:
        member += b"\xff" * spoilt
    plain = revisit(3) + revisit(4) + record("five", **{"WARC-Record-ID": "<urn:page:5>"})
    data = bytes(member) + plain
    found = ids(data)
    kept = ids(bytes(member))
    assert kept[0] == "<urn:page:1>" and found == kept + ids(plain)
    assert sum(n for _, n in gaps(data)) == len(member)


def test_records_that_are_stored_twice_are_returned_twice():
    one = revisit(1)
    member = bytearray(gzip.compress(one + one, 0))
    member[-1] ^= 1
    assert ids(bytes(member) + one) == ["<urn:page:1>"] * 3
    assert ids(bytes(member)) == ["<urn:page:1>"] * 2
