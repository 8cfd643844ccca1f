"""Records whose header is longer than the reader's first look, and records that are lost on reading."""

import io

import pytest

from strataform.llm import warc


def read(data):
    return list(warc.Reader(io.BytesIO(data), len(data)))


@pytest.mark.parametrize("made", [warc.member, bytes])
def test_long_url(made):
    urls = ["http://a/" + "x" * (3 << 20), "http://a/" + "y z" * 400_000, "http://a/"]
    got = read(b"".join(made(warc.record(k, url, b"page", False, None)) for k, url in enumerate(urls)))
    assert [x.headers["warc-target-uri"] for x in got] == [u.replace(" ", "%20") for u in urls]
    assert [x.payload for x in got] == [b"page"] * 3


def test_op4_long_url(spark, tmp_path):
    spark.createDataFrame([(1, "http://a/" + "x" * (2 << 20), "one"), (2, None, "two")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["page_id"] for r in warc.op4(spark, str(tmp_path)).collect()) == [1, 2]


def test_op4_fails_on_lost_records(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "http://a/", "one"), (2, None, "two")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda files, payloads: whole(files, payloads).limit(1))
    with pytest.raises(RuntimeError, match="wrote 2 records and read 1"):
        warc.op4(spark, str(tmp_path))
