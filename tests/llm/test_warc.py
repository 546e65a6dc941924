import base64
import glob
import hashlib

import pytest
import zstandard

from tessella.llm import warc
from tests.conftest import SMALL


def want(pages):
    most = {}
    for i, body in pages:
        if i is not None:
            most[body] = max(most.get(body, i), i)
    for i, body in pages:
        raw = (body or "").encode()
        top = most.get(body, i)
        revisit = i != top
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_query_reads_back_what_was_written(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert rows(warc.query(spark, SMALL)) == sorted(want(pages), key=repr)


def test_odd_rows(spark):
    pages = [(1, "a", "u"), (2, "a", None), (3, "a", "http://x/\r\n y"), (4, "", "u"), (5, None, "u"), (6, "ä" * 200_000, "u"), (6, "ä" * 200_000, "u"), (None, "a", "u"), (9, "x\r\n\r\nContent-Length: 3\r\n", "ü")]
    df = spark.createDataFrame(pages, "page_id long, html string, url string").selectExpr("*", "1 AS refers_to", "2 AS sha")
    got = rows(warc.archived(df))
    assert got == sorted(want([(i, b or "") for i, b, _ in pages]), key=repr)
    assert warc.archived(df.limit(0)).count() == 0


def test_record_ids_are_unique_and_revisits_name_them(spark, tmp_path):
    pages = [(5, "u", "A"), (5, "u", "B"), (9, "u", "A"), (3, "u", "A"), (None, "u", "B"), (3, "v", "A")]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}").collect()
    found = [fields for path in glob.glob(f"{tmp_path}/*.warc.zst") for fields, _ in warc.records(f"file://{path}")]
    ids = [f["WARC-Record-ID"] for f in found]
    assert len(set(ids)) == len(pages)
    of = {f["WARC-Record-ID"]: f for f in found}
    assert all(of[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and of[f["WARC-Refers-To"]]["WARC-Type"] == "response" for f in found if f["WARC-Type"] == "revisit")


def test_records_stand_alone_behind_the_dictionary(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "concat(repeat(concat('<p>Paragraph of ', id, ' with common words</p>'), 40), uuid()) AS html")
    made = warc.write(pages.coalesce(2), f"file://{tmp_path}").collect()
    assert sum(r.records for r in made) == 400
    for path in glob.glob(f"{tmp_path}/*.warc.zst"):
        data = open(path, "rb").read()
        raw, start = warc.read_dictionary(data)
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little") and raw[:4] == zstandard.ZstdCompressionDict(raw).as_bytes()[:4]
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompressobj()
        assert one.decompress(data[start:]).startswith(b"WARC/1.1\r\n") and one.eof
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompressobj().decompress(data[start:])


def test_a_page_id_with_two_payloads_keeps_both(spark):
    schema = "page_id long, url string, html string"
    one_later = [(5, "u", "A"), (5, "u", "B"), (9, "u", "A")]
    both_later = [(5, "u", "A"), (5, "u", "B"), (9, "u", "A"), (8, "u", "B"), (5, "u", "B")]
    for pages in (one_later, both_later):
        got = rows(warc.archived(spark.createDataFrame(pages, schema)))
        assert got == sorted(want([(i, b) for i, _, b in pages]), key=repr)
        assert {r[2] for r in got if r[3] == "response"} == {r[2] for r in got}
