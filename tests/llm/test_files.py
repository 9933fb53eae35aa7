import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm import idfiles, warc
from vitrine.llm.common import new_folder
from vitrine.llm.files import open_file


def test_id_files_round_trip(spark, odd_docs, no_docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    for options in ({}, {"shard_rows": 3, "file_bytes": 64}):
        folder = new_folder(spark, "t")
        manifest = idfiles.write_id_files(odd_docs, folder, path, 2, **options)
        got = sorted(idfiles.read_id_files(manifest, folder).collect(), key=lambda r: r["start"])
        source = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in source]
        ids = {}
        for r in source:
            x = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
            ids.setdefault(r["doc_id"], []).append((len(x), zlib.crc32(x.tobytes())))
        seen = {}
        for r in got:
            seen.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
        assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in ids.items()}
        assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    folder = new_folder(spark, "t")
    assert idfiles.read_id_files(idfiles.write_id_files(no_docs, folder, path, 2), folder).collect() == []


def test_dictionary_is_shared_and_checked(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a common beginning of every document number "), "id").alias("text"))
    folder = new_folder(spark, "t")
    files = idfiles.write_id_files(docs, folder, path, 2, shard_rows=100).collect()
    f = idfiles.IdFile(folder, files[0]["file"])
    assert Tokenizer.from_file(path).decode(f.ids(7)[:-1].tolist()).startswith("a common beginning")
    raw = open_file(folder, files[0]["file"]).read()
    digest = idfiles.FOOTER.unpack(raw[-idfiles.FOOTER.size :])[3]
    assert hashlib.sha256(open_file(folder, f"{digest.hex()}.dict").read()).digest() == digest
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(raw[int(f.index["offset"][7]) : int(f.index["offset"][8])])


def test_bundles_round_trip(spark):
    big = "<p>é" + "x" * 1200 + "</p>"
    rows = [(i, f"http://h.example/{i}", big if i in (3, 9, 11) else "small" if i % 2 else f"<p>{i}</p>" * 600) for i in range(14)]
    rows += [(20, None, None), (21, "http://h.example/ \n", ""), (None, "http://h.example/n", big), (9, "http://h.example/9", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS payload", "'clash' AS sha1", "'clash' AS winner")
    for options in ({}, {"file_bytes": 600}):
        folder = new_folder(spark, "t")
        manifest = warc.write_bundles(df, folder, **options)
        got = warc.read_bundles(manifest, folder).collect()
        assert len(got) == len(rows)
        want = sorted(
            (str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and p in (3, 9) else "response", 11 if h == big and p in (3, 9) else None)
            for p, _, h in rows
        )
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
        assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    assert warc.read_bundles(warc.write_bundles(df.filter("1 = 0"), new_folder(spark, "t")), folder).collect() == []


def test_a_record_is_read_by_one_frame_and_the_file_is_plain_zstandard(spark, monkeypatch):
    folder = new_folder(spark, "t")
    w = warc.BundleWriter(folder)
    for k in range(40):
        w.add(k, f"http://h.example/{k}", (f"body {k} " * 20_000).encode(), "0" * 40, None)
    name = w.close()
    b = warc.Bundle(folder, name)
    fields, block = warc.parsed(b.page(33, "0" * 40))
    assert fields["X-Page-ID"] == "33" and block.startswith(b"body 33 ") and len(b.offsets) > 3
    data = open_file(folder, name).read()
    plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 40 and plain == b"".join(b.frame(k) for k in range(len(b.offsets)))


def test_a_revisit_refers_to_its_response_by_identifier(spark):
    body = "<p>" + "x" * 2000
    df = spark.createDataFrame([(k, f"http://h.example/{k}", body) for k in range(9)], "page_id long, url string, html string")
    folder = new_folder(spark, "t")
    bundles = [warc.Bundle(folder, r["file"]) for r in warc.write_bundles(df, folder).collect()]
    fields = [warc.parsed(x)[0] for b in bundles for x in b.records()]
    response = [f["WARC-Record-ID"] for f in fields if f["WARC-Type"] == "response"]
    assert len(response) == 1 and {f.get("WARC-Refers-To") for f in fields if f["WARC-Type"] == "revisit"} == set(response)
    assert len({f["WARC-Record-ID"] for f in fields}) == 9


def test_one_common_payload_is_no_hot_key(spark):
    """Half of all pages share a payload, many more are empty: without a broadcast of the marks, every task still has a like share."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        body = "<p>" + "x" * 2000
        rows = [(k, None, body if k % 2 else "" if k % 4 else f"{k}" * 1000) for k in range(4000)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        folder = new_folder(spark, "t")
        manifest = warc.write_bundles(df, folder)
        got = warc.read_bundles(manifest, folder)
        assert got.filter("record_type = 'revisit'").count() == 1999 and got.filter("refers_to = 3999").count() == 1999
        records = sorted(r["records"] for r in manifest.collect())
        assert sum(records) == 4000 and records[-1] <= 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sql_agrees_on_pages_without_an_id(spark, tmp_path):
    import duckdb

    body = "<p>" + "x" * 2000
    rows = [(1, "http://h.example/1", body), (5, "http://h.example/5", body), (None, "http://h.example/n", body), (None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(warc.OP7_SQL).fetchall()
    assert sorted(map(str, map(tuple, warc.op7_seekable_bundles(spark, str(tmp_path)).collect()))) == sorted(map(str, want))
