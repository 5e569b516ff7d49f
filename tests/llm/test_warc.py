"""Archives against the standard library's reader, exact round trips and damage."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sqltally.llm import warc

PAGES = "page_id bigint, url string, html string, row bigint, mark string, first string, path string"


def page(row, page_id, html, url="http://a.example/x y", first=None):
    found = {"row": row, "page_id": page_id, "url": url, "html": html, "first_row": None, "first_page_id": None, "first_url": None}
    return found | (first and {"first_row": first[0], "first_page_id": first[1], "first_url": first[2]} or {})


def archive(pages):
    return b"".join([warc.info_member("x.warc.gz"), *(warc.page_member(p) for p in pages)])


def payload_sha1(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


NASTY = ["", "a", "\r\n\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\x00\x1f\x8b\x08é😀" * 50, "x" * 300_000]


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_round_trip(piece):
    pages = [page(i, i, html) for i, html in enumerate(NASTY if piece > 1 else NASTY[:-1])]
    made = archive(pages)
    found = list(warc.read_records(io.BytesIO(made), True, piece))
    assert [r.headers["warc-type"] for r in found] == ["warcinfo"] + ["response"] * len(pages)
    for r, p in zip(found[1:], pages):
        assert r.payload == p["html"].encode() and r.payload_bytes == len(r.payload) and r.payload_digest == payload_sha1(p["html"])
        assert r.headers["x-page-id"] == str(p["page_id"])
        # The place of a record is that of a member that stands for itself.
        alone = zlib.decompressobj(wbits=31).decompress(made[r.offset :])
        assert alone.startswith(b"WARC/1.1\r\n") and alone.endswith(r.payload + b"\r\n\r\n")
    whole = gzip.decompress(made)
    assert whole.count(b"WARC-Record-ID") == len(pages) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=80) | st.text("\r\nWARC/1.: ", max_size=40), max_size=5), st.integers(1, 40))
def test_any_text_comes_back(texts, piece):
    made = archive([page(i, i, t) for i, t in enumerate(texts) if not any(0xD800 <= ord(c) < 0xE000 for c in t)])
    found = [r.payload.decode() for r in warc.read_records(io.BytesIO(made), True, piece)][1:]
    assert found == [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]


def test_revisit_has_no_payload():
    made = archive([page(0, 4, "same"), page(1, 9, "same", first=(0, 4, "http://a.example/"))])
    first, again = list(warc.read_records(io.BytesIO(made), True))[1:]
    assert again.payload == b"" and again.headers["warc-profile"] == warc.SAME_PAYLOAD
    assert again.headers["warc-refers-to"] == first.headers["warc-record-id"] != again.headers["warc-record-id"]
    assert again.headers["warc-payload-digest"] == first.headers["warc-payload-digest"] == f"sha1:{payload_sha1('same')}"


def test_addresses_cannot_write_headers():
    made = archive([page(0, 1, "a", url="http://é.example/\r\nWARC-Type: evil"), page(1, 2, "b", url=None)])
    first, second = list(warc.read_records(io.BytesIO(made)))[1:]
    assert first.headers["warc-type"] == "response" and "\n" not in first.headers["warc-target-uri"]
    assert second.headers["warc-target-uri"] == "about:blank"


def record(lines, block):
    packer = zlib.compressobj(wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@pytest.mark.parametrize(
    ("made", "says"),
    [
        (archive([page(0, 1, "text")])[:-5], "ends inside a member"),
        (archive([page(0, 1, "text")])[:-5] + b"\0" * 5, "inflate"),
        (archive([])[:-30] + b"\xff" * 30, "member"),
        (record(["WARC/1.1", "WARC-Type: resource", "Content-Length: 3"], b"abcd"), "does not end"),
        (record(["WARC/1.1", "WARC-Type: resource", "Content-Length: 5"], b"abcd"), "does not end"),
        (record(["WARC/1.1", "WARC-Type: resource", "Content-Length: 50"], b"abcd"), "ends inside a block"),
        (record(["WARC/1.1", "WARC-Type: resource"], b"abcd"), "no content length"),
        (record(["HTTP/1.1 200 OK", "Content-Length: 4"], b"abcd"), "not a record"),
        (record(["WARC/1.1", "Content-Length: 4", "WARC-Block-Digest: sha1:" + payload_sha1("abce")], b"abcd"), "block digest"),
        (record(["WARC/1.1", "Content-Length: 4", "WARC-Payload-Digest: sha1:" + payload_sha1("abce")], b"abcd"), "payload digest"),
        (record(["WARC/1.1", "Content-Length: 4", "Content-Type: application/http"], b"abcd"), "no message head"),
        (record(["WARC/1.1", "X: " + "y" * 200_000], b""), "too long"),
    ],
)
def test_damage_is_told(made, says):
    with pytest.raises(warc.DamagedArchive, match=says):
        list(warc.read_records(io.BytesIO(made)))


def test_sound_records_come_before_the_damage():
    made = archive([page(0, 1, "one"), page(1, 2, "two")])
    reader, found = warc.read_records(io.BytesIO(made[:-3])), []
    with pytest.raises(warc.DamagedArchive, match="at byte [0-9]+"):
        for r in reader:
            found.append(r.headers["warc-type"])
    assert found == ["warcinfo", "response"]


def by_hand(rows, least=0):
    """Rows of (page_id, html); among equal payloads one row of the smallest id responds, null ids last."""
    groups = {}
    for i, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= least
            out.append((i, len(payload), payload_sha1(payload.decode()), "revisit" if again else "response", ids[0] if again else None))
    return out


ODD = [(5, "x"), (2, "x"), (2, "x"), (9, None), (8, ""), (None, "x"), (None, "lonely"), (None, None), (7, "x" * 200_000), (6, "é\r\n\r\n"), (2, "é\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 1, 3])
def test_odd_rows(spark, least):
    rows = [(i, None if k == 3 else f"http://a.example/{k}", html, 3, "m", "f", None) for k, (i, html) in enumerate(ODD)]
    found = warc.archived(spark.createDataFrame(rows, PAGES).repartition(3), least)
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(by_hand(ODD, least), key=order)


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_files_of_a_bounded_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, str(i) * 500) for i in range(60)], "page_id bigint, url string, html string").coalesce(1)
    files = warc.write_archives(pages, str(tmp_path / "a"), file_bytes=2_000)
    listed = files.collect()
    assert len(listed) > 3 and sum(r.n_records for r in listed) == 60 + len(listed)
    for r in listed:
        assert len(open(r.path, "rb").read()) == r.n_bytes
    found = warc.read_archives(files, with_payload=True).where("record_type = 'response'").collect()
    assert {int(r.page_id): bytes(r.payload).decode() for r in found} == {i: str(i) * 500 for i in range(60)}
    # What another attempt left is not read.
    (tmp_path / "a" / "pages-000000-left.warc.gz").write_bytes(b"torn")
    assert warc.read_archives(files).count() == sum(r.n_records for r in listed)


def test_a_revisit_must_name_its_response(spark):
    rows = [(None, None, "i1", "revisit", None, "1", None, "D", "i0", None), (None, None, "i0", "response", None, "0", 3, "E", None, None)]
    with pytest.raises(Exception, match="names no response"):
        warc.page_rows(spark.createDataFrame(rows, warc.READ)).collect()
