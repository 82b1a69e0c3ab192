import json
import os
import random
import zlib
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docsift.config import default, from_dict
from docsift.functions import regexes as R
from docsift.operators import analyze as analysis
from docsift.operators import images
from docsift.operators.analyze import analyze, split_text
from docsift.operators.batches import Segregated
from docsift.operators.components import components
from docsift.operators.extract import EXTRACTORS, run_extractor
from docsift.operators.timestamps import instants, readings, resolve_timestamps
from docsift.plans import catalogue
from docsift.plans.report import classify_buffers, config_frame, report_json, write_report
from docsift.session import hot_keys, join_hot
from docsift.sources.ingest import check_upload, guard_requests, ingest, read_buffers, read_directory, route_text
from docsift.sources.pdf import embedded_text

DATA = "/root/testdata/sf0.001"
FIELDS = {f.name: f for f in default().fields}
# The seven sample documents.
ACME = "Acme Exports Pvt Ltd\n12 Industrial Estate, Andheri East, Mumbai 400069\n"
GOLDEN = [
    (0, "invoice_001.pdf", "text", ACME + "GSTIN: 27ABCDE1234F1Z5\n\nTAX INVOICE\nInvoice No.: INV-2024-001\nInvoice Date: 10/05/2024\nPO Ref: PO-7788\nBill To: Global Traders Inc\nSubtotal: 11,000.00\nGrand Total: 12,500.00"),
    (1, "invoice_orphan.pdf", "text", "Nowhere Trading Co\n9 Nowhere Lane, Nashik 422001\n\nCOMMERCIAL INVOICE\nInvoice Number: INV-2024-999\nInvoice Date: 22/06/2024\nGrand Total: 3,300.00"),
    (2, "po_7788.pdf", "text", ACME + "\nPURCHASE ORDER\nPO No: PO-7788\nOrder Date: 01/05/2024\nVendor: Global Traders Inc"),
    (3, "random_note.pdf", "text", "Meeting notes\nDiscussed quarterly planning and staffing."),
    (4, "receipt_001.pdf", "text", "Zenith Retail LLP\n4 Market Street, Pune 411001\n\nCASH RECEIPT\nReceipt No: RCPT-3341\nDate: 20/06/2024\nPayment Received\nAmount Paid: 990.00"),
    (5, "receipt_scanned.pdf", "ocr", "Sunrise Stores Pvt Ltd\nCASH RECEIPT\nReceipt No: RCPT-7788\nDate: 25/06/2024\nAmount Paid: 1,499.00"),
    (6, "transaction_001.pdf", "text", "HDFC Bank Ltd\nACCOUNT STATEMENT\nTransaction ID: TXN-88213\nTransaction Date: 15/06/2024\nDebit: 450.00"),
]
PLACE = "12 Industrial Estate, Andheri East, Mumbai 400069"
EXPECTED = [
    ("Invoice", "INV-2024-001", "PO-7788", "Acme Exports Pvt Ltd", PLACE, "10/05/2024", "12,500.00"),
    ("Invoice", "INV-2024-999", None, "Nowhere Trading Co", "9 Nowhere Lane, Nashik 422001", "22/06/2024", "3,300.00"),
    ("Purchase Order", None, "PO-7788", "Acme Exports Pvt Ltd", PLACE, "01/05/2024", None),
    ("Unknown", None, None, None, None, None, None),
    ("Receipt", "RCPT-3341", None, "Zenith Retail LLP", "4 Market Street, Pune 411001", "20/06/2024", "990.00"),
    ("Receipt", "RCPT-7788", None, "Sunrise Stores Pvt Ltd", None, "25/06/2024", "1,499.00"),
    ("Transaction Record", "TXN-88213", None, "HDFC Bank Ltd", None, "15/06/2024", "450.00"),
]


def extract(spark, field, text):
    df = split_text(spark.createDataFrame([(text,)], "text string"))
    return df.select(run_extractor(FIELDS[field], F.col("text_c"), F.col("lines")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("field", "text", "expected"),
    [
        ("documentNumber", "Invoice No Date Invoice No: ab-9", "AB-9"), ("documentNumber", "Inv #77A", "77A"), ("documentNumber", "Inv # 77A", None),
        ("documentNumber", "Invoice No -- 100 of 200 --", "100"), ("referenceNumber", "Order No: 01/05/2024", "01/05/2024"),
        ("amount", "Subtotal: 11,000", "11,000"), ("amount", "Grand Total: 9.00\nTotal 5 items", "5"), ("amount", "Total - 500", None), ("amount", "Total: ¥500", None),
        ("amount", "Total: Rs. 500", "500"), ("amount", "01.04.2025", "01.04"), ("amount", "1.234,56", "234,56"), ("amount", "1,2345", None),
        ("date", "192.168.1.1", "168.1.1"), ("date", "152.143.123.131", None), ("date", "Mayor 12, 2020", "Mayor 12, 2020"), ("date", "1 Apr 2025\n01-02-03", "01-02-03"),
        ("companyName", "Tax Solutions Ltd", None), ("companyName", "Acme Ltd,,", "Acme Ltd,"), ("address", "PO No: PO-7788", None), ("address", "", None), ("amount", None, None),
    ],
)
def test_extractor_edges(spark, field, text, expected):
    assert extract(spark, field, text) == expected


def test_analysis_and_report(spark):
    docs = spark.createDataFrame(GOLDEN, "doc_ix bigint, file_name string, source string, text string")
    got = [(r["documentType"], *(r["fields"][f] for f in ("documentNumber", "referenceNumber", "companyName", "address", "date", "amount"))) for r in analyze(docs).orderBy("doc_ix").collect()]
    assert got == EXPECTED
    report = json.loads(report_json(spark, docs, spark.createDataFrame([], "file_name string, reason string")))
    assert report["summary"] == {"totalPdfs": 7, "analyzed": 7, "ocrUsed": 1, "failed": 0, "batches": 1, "unbatchedGroups": 5}
    files = [{"fileName": "invoice_001.pdf", "documentType": "Invoice", "source": "text"}, {"fileName": "po_7788.pdf", "documentType": "Purchase Order", "source": "text"}]
    assert report["batches"] == {"BATCH-INV-2024-001": {"documentNumber": "INV-2024-001", "referenceNumber": "PO-7788", "fileCount": 2, "documents": files}}
    assert list(report["unbatched"]) == ["documentNumber:INV-2024-999", "UNIDENTIFIED", "documentNumber:RCPT-3341", "documentNumber:RCPT-7788", "documentNumber:TXN-88213"]


def test_written_report(spark, tmp_path):
    docs = spark.createDataFrame(GOLDEN, "doc_ix bigint, file_name string, source string, text string")
    write_report(docs, spark.createDataFrame([("bad.pdf", "Invalid PDF structure")], "file_name string, reason string"), str(tmp_path / "report"))
    rows = {n: spark.read.json(str(tmp_path / "report" / n)).collect() for n in ("summary", "batches", "members", "unbatched", "errors")}
    assert rows["summary"][0]["total_pdfs"] == 8 and [r["batch_id"] for r in rows["batches"]] == ["BATCH-INV-2024-001"] and len(rows["unbatched"]) == 5 and len(rows["errors"]) == 1
    assert sorted(r["file_name"] for r in rows["members"]) == ["invoice_001.pdf", "po_7788.pdf"]


def test_a_file_is_read_once(spark, tmp_path):
    from docsift.sources.pdf import text_pdf

    seen = tmp_path / "calls"

    class Counting:
        def pages(self, content):
            with seen.open("a") as f:
                f.write("x")
            return ["a page with more than enough letters to read"]

    docs, errors = ingest(read_buffers(spark, [("x.pdf", text_pdf("short"))]), Counting)
    assert json.loads(report_json(spark, docs, errors))["summary"]["ocrUsed"] == 1 and docs.count() == 1 and errors.count() == 0
    assert seen.read_text() == "x"


def test_requests_are_refused_whole(spark):
    rows = [("ok", "a.PDF", "", 5), ("ok", "b.txt", "application/pdf", 5), ("type", "a.pdf", "", 5), ("type", "b.txt", "text/plain", 5), ("size", "a.pdf", "", 25 * 2**20 + 1), (None, None, None, None), *[("many", f"{i}.pdf", "", 1) for i in range(201)]]
    got = {r["request"]: (r["files"], r["accepted"], r["problem"]) for r in guard_requests(spark.createDataFrame(rows, "request string, name string, media string, size bigint")).collect()}
    assert got == {"ok": (2, True, None), "type": (2, False, "type"), "size": (1, False, "size"), None: (1, False, "type"), "many": (201, False, "count")}


@pytest.mark.parametrize(("hot", "tail"), [(200_000, 0), (30, 0), (30, 50), (200_000, 100_000)])
def test_components_with_hot_values(spark, hot, tail):
    rng = random.Random(hot)
    keys = [(i, "a", f"v{i // 2}") for i in range(120)] + [(i, "b", f"w{(i + 1) // 2}") for i in range(60)] + [(1000 + i, "a", "blanket") for i in range(300)] + [(i, "b", f"x{rng.randrange(40)}") for i in range(2000, 2050)]
    docs = spark.createDataFrame([(i,) for i in sorted({k[0] for k in keys} | {9999})], "doc_ix bigint")
    got = dict(map(tuple, components(docs, spark.createDataFrame(keys + keys[:5], "doc_ix bigint, field string, value string"), hot=hot, tail=tail).collect()))
    low, moved = {i: i for i in got}, True
    while moved:
        moved = False
        least: dict = {}
        for i, f, v in keys:
            least[f, v] = min(least.get((f, v), i), low[i])
        for i, f, v in keys:
            if least[f, v] < low[i]:
                low[i], moved = least[f, v], True
    assert got == low


def test_joining_hot_keys_apart_changes_nothing(spark):
    rows = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 7)], "k string, i int")
    lookup = spark.createDataFrame([("h", 1), ("k3", 2), ("other", 3)], "k string, v int")
    hot = hot_keys(rows, ["k"], 301, hot=50)
    assert [r["k"] for r in hot.collect()] == ["h"]
    for how in ("left", "inner"):
        assert sorted(map(repr, join_hot(rows, lookup, ["k"], hot, how).collect())) == sorted(map(repr, rows.join(lookup, ["k"], how).collect()))


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_ix bigint, text string")
    assert {r["documentType"] for r in analyze(df).collect()} == {"Unknown"}
    assert analyze(df.limit(0)).count() == 0


def test_config_checks_and_unknown_extractor(spark):
    with pytest.raises(ValueError):
        from_dict({"documentTypes": []})
    c = from_dict({"documentTypes": [{"name": "A"}], "fields": [{"name": "x", "extractor": "nothing"}]})
    assert c.types[0].weight == 5 and c.fields[0].applies_to is None and "nothing" not in EXTRACTORS
    assert analyze(spark.createDataFrame([("t",)], "text string"), c).first()["fields"]["x"] is None


def test_boundaries_are_ascii(spark):
    df = spark.createDataFrame([("caféinc",)], "t string")
    assert df.filter(F.col("t").rlike("(?i)" + R.phrase("inc"))).count() == 1


def test_components_of_chains_and_fields(spark):
    docs = spark.range(40).withColumnRenamed("id", "doc_ix")
    chain = [(i, "a", str(i // 2)) for i in range(20)] + [(i, "b", str((i + 1) // 2)) for i in range(20)] + [(30, "a", "X"), (31, "b", "X")]
    got = dict(components(docs, spark.createDataFrame(chain, "doc_ix bigint, field string, value string")).collect())
    assert {got[i] for i in range(20)} == {0} and got[30] == 30 and got[31] == 31 and got[39] == 39


def test_linking_extracts_keys_only(spark, tmp_path, monkeypatch):
    asked = []
    real = analysis.run_extractor
    monkeypatch.setattr(analysis, "run_extractor", lambda f, *a: asked.append(f.name) or real(f, *a))
    spark.createDataFrame([(k, 1, 10.5, datetime(2024, 5, 1)) for k in range(1, 31)], "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "C", 2)], "c_custkey bigint, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(2, "N")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = __spark_entry__.queries()["rendered_batches"](spark, str(tmp_path)).collect()
    assert sorted((r["batch_id"], r["file_count"]) for r in got) == sorted((f"BATCH-INV-{k}", 1 + (k % 5 != 0) + (k % 3 == 0)) for k in range(1, 31) if k % 5 or k % 3 == 0)
    assert asked == ["documentNumber", "referenceNumber"]


def test_white_space_and_labels_in_any_text(spark):
    texts = ["a  b\t\n c\x0b", " x ", "é\u00a0 b", "İİ Invoice No: A-1", "xinvoice no 7 Invoice No: B-22", "a\u2003b", None]
    df = split_text(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i")
    spec = next(f for f in default().fields if f.name == "documentNumber")
    got = df.select("text_c", analysis.run_extractor(spec, F.col("text_c"), F.col("lines"), F.col("text_low"))).collect()
    assert [tuple(r) for r in got] == [("a b c ", None), (" x ", None), ("é b", None), (texts[3], "A-1"), (texts[4], "B-22"), ("a b", None), (None, None)]


def test_conflicts_and_label_collision(spark):
    rows = [(0, "X", "r1"), (1, "Y", "r1"), (2, None, "X"), (3, "", "X")]
    docs = spark.createDataFrame(rows, "doc_ix bigint, dn string, rn string").select("doc_ix", F.lit("f").alias("file_name"), F.lit("t").alias("document_type"), F.lit("text").alias("source"), "dn", "rn")
    seg = Segregated(docs, {"documentNumber": "dn", "referenceNumber": "rn"})
    assert [tuple(r) for r in seg.conflicts().collect()] == [(0, "documentNumber", "X", "Y", 1)]
    assert seg.batches().count() == 2 and [tuple(r) for r in seg.report_map().collect()] == [("BATCH-X", 2, 2)]


def test_route_upload_and_ingest(spark, tmp_path):
    rows = [("a" * 25, "zz"), ("a" * 24, "zz"), ("a", ""), (None, None)]
    got = [r["source"] for r in route_text(spark.createDataFrame(rows, "embedded_text string, ocr_text string")).collect()]
    assert got == ["text", "ocr", "text", "text"]
    with pytest.raises(ValueError):
        check_upload([("a.txt", b"", "text/plain")])
    check_upload([("a.PDF", b"", "text/plain"), ("b.txt", b"", "application/pdf")])
    stream = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Tax Invoice \\(copy\\) of something long enough) Tj 0 -14 Td (Invoice No: A-77) Tj ET")
    pdf = b"%%PDF-1.4\n1 0 obj\n<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(stream), stream)
    assert embedded_text(pdf) == "Tax Invoice (copy) of something long enough\nInvoice No: A-77"
    for name in ("b.pdf", "a.PDF", "c.txt"):
        (tmp_path / name).write_bytes(pdf)
    assert sorted((r["doc_ix"], r["file_name"]) for r in read_directory(spark, str(tmp_path)).collect()) == [(0, "a.PDF"), (1, "b.pdf")]

    class Engine:
        def pages(self, content):
            return ["page one", "page two"]

    docs, errors = ingest(read_buffers(spark, [("x.pdf", pdf), ("y.pdf", b"junk"), ("z.pdf", b"%PDF-1.4 nothing")]), Engine)
    assert sorted((r["file_name"], r["source"]) for r in docs.collect()) == [("x.pdf", "text"), ("z.pdf", "ocr")]
    assert [r["file_name"] for r in errors.collect()] == ["y.pdf"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_ingest_of_whole_tables(spark):
    texts = {(r["doc_ix"], r["file_name"], r["text"]) for r in spark.read.parquet(f"{DATA}/doc_text.parquet").collect() if r["text"] is not None}
    failed = [r["file_name"] for r in spark.read.parquet(f"{DATA}/doc_errors.parquet").collect()]
    rows = __spark_entry__.queries()["ingest_split"](spark, DATA).collect()
    long = {(i, n, t.strip("\n")) for i, n, t in texts if sum(c.isascii() and c.isalnum() for c in t) >= 25}
    docs = [(r["doc_ix"], r["file_name"], r["text"]) for r in rows if r["reason"] is None]
    errors = [r["file_name"] for r in rows if r["reason"] is not None]
    assert set(docs) == long and len(docs) == len(long) > 0
    assert sorted(errors) == sorted(failed + [n for i, n, t in texts if (i, n, t.strip("\n")) not in long])
    assert {r["reason"] for r in rows} >= {None, "no engine for recognition is registered"} and all(r["source"] == "text" for r in rows if r["reason"] is None)


def test_pages_are_drawn_and_preprocessed(spark):
    class Drawer:
        def images(self, content, scale):
            if b"torn" in content:
                raise OSError("page 2 is torn")
            gray = np.full((4 * scale, 6 * scale, 3), 90, "uint8")
            gray[:, 6:] = 200
            return [gray, gray]

    class Engine:
        def page(self, image):
            return f"read {image.shape} {sorted(set(image.ravel().tolist()))}"

    files = [("a.pdf", b"%PDF-1.4 scan"), ("b.pdf", b"%PDF-1.4 torn"), ("c.pdf", b"junk")]
    docs, errors = ingest(read_buffers(spark, files), Engine, rasterizer=Drawer)
    assert [(r["file_name"], r["source"], r["text"]) for r in docs.collect()] == [("a.pdf", "ocr", "read (16, 24) [0, 255]\n\nread (16, 24) [0, 255]")]
    assert sorted((r["file_name"], r["reason"]) for r in errors.collect()) == [("b.pdf", "page 2 is torn"), ("c.pdf", "Invalid PDF structure")]
    report = classify_buffers(spark, [(n, c, "application/pdf") for n, c in files], engine=Engine, rasterizer=Drawer)
    assert {k: report["summary"][k] for k in ("totalPdfs", "analyzed", "ocrUsed", "failed")} == {"totalPdfs": 3, "analyzed": 1, "ocrUsed": 1, "failed": 2}
    with pytest.raises(ValueError):
        classify_buffers(spark, [])


def test_config_frame(spark):
    row = config_frame(spark).first()
    assert row["productName"] and "Invoice" in row["documentTypes"] and "documentNumber" in row["fields"]


def test_image_kernels():
    assert images.otsu(np.full((3, 3), 7, "uint8")) == 0
    assert images.otsu(np.array([[10, 10], [200, 200]], "uint8")) == 10
    speck = np.full((5, 5), 9, "uint8")
    speck[2, 2] = 255
    assert (images.median3x3(speck) == 9).all()
    assert images.preprocess(np.zeros((4, 6, 3), "uint8")).shape == (8, 12)


def test_instants(spark):
    sites = spark.createDataFrame([("P", "FR", "Europe/Paris", True), ("N", "US", "America/New_York", False), ("I", "IN", "Asia/Kolkata", True)], "site_id string, country_code string, zone_name string, day_first boolean")
    rows = [
        (1, "03/04/2025 10:00", "P"), (2, "03/04/2025 10:00", "N"), (3, "2022-11-06T01:30:00", "N"), (4, "2023-03-12 02:30:00", "N"), (5, "1699160969", "N"),
        (6, "2021-08-10T17:04:30.291076845[Europe/Berlin]", "I"), (7, "Q3 2024", "P"), (8, None, "P"), (9, "2024-01-01 10:00", None), (10, "19 May 2025 10:41:43 IST", "I"),
        (11, "31/02/2024", "P"), (12, "19 Apr 2023 17:22:39 GMT+2", None), (13, "2021-01-18T11:21:04 America/Los_Angeles", "P"), (14, "24/06/2025 3:47:53 p.m.", "P"), (1, "03/04/2025 10:00", "P"),
    ]
    docs = spark.createDataFrame([(i, (t,), s) for i, t, s in rows], "doc_ix bigint, doc_fields struct<doc_date: string>, site_id string")
    got = dict(instants(docs, sites).collect())
    z = ".000000Z"
    assert got == {
        1: f"2025-04-03T08:00:00{z}", 2: f"2025-03-04T15:00:00{z}", 3: f"2022-11-06T05:30:00{z}", 4: f"2023-03-12T07:30:00{z}", 5: f"2023-11-05T05:09:29{z}",
        6: "2021-08-10T15:04:30.291076Z", 10: f"2025-05-19T05:11:43{z}", 12: f"2023-04-19T15:22:39{z}", 13: f"2021-01-18T19:21:04{z}", 14: f"2025-06-24T13:47:53{z}",
    }
    status = {r["doc_ix"]: r["status"] for r in resolve_timestamps(docs, sites).collect()}
    assert status[9] == "no_zone" and status[7] == status[8] == status[11] == "no_date"
    assert resolve_timestamps(docs.limit(0), sites).count() == 0
    assert readings("") == [] and len(readings("03/04/25 10:00")) == 2


def test_undeclared_order_is_ambiguous_without_evidence(spark):
    sites = spark.createDataFrame([("U", "XX", "UTC", None)], "site_id string, country_code string, zone_name string, day_first boolean")
    make = lambda texts: spark.createDataFrame([(i, (t,), "U") for i, t in enumerate(texts)], "doc_ix bigint, doc_fields struct<doc_date: string>, site_id string")
    assert resolve_timestamps(make(["03/04/2025"]), sites).first()["status"] == "ambiguous"
    told = resolve_timestamps(make(["03/04/2025"] + ["25/04/2025"] * 40), sites).filter("doc_ix = 0").first()
    assert told["status"] == "resolved" and told["utc_text"].startswith("2025-04-03")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    theirs = sorted(repr(r) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    from docsift.streaming.analyze_stream import analyze_stream, write_batches

    spark.createDataFrame([("TAX INVOICE",)], "text string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = write_batches(analyze_stream(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))), lambda df, n: seen.extend(r["documentType"] for r in df.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == ["Invoice"]


def test_names_need_no_session():
    """The names of the queries and the SQL are known before any session exists."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"], cwd=root, capture_output=True, text=True)
    assert said.stdout.strip() == "True", said.stderr
