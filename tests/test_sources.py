"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from chronovec.functions.handlers import Handlers
from chronovec.sources import excel, feed, files, lookup, reports
from chronovec.streaming import telemetry as streams


def test_feed_goes_on_after_a_restart(spark, tmp_path):
    """Pages are read by executors; what is committed is not read again, and ids may have gaps."""
    path, taken = str(tmp_path / "service"), str(tmp_path / "out")
    ids = [*range(7), 40, 41, 1000]
    told = lambda some: feed.publish(spark.createDataFrame([(k, f"m{k}") for k in some], "id long, text string"), "id", path, 3)

    def run():
        s = spark.readStream.format("polled").load().withColumn("partition", F.spark_partition_id())
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", taken).start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(taken).collect()

    feed.register(spark, "polled", told(ids[:5]), 3)
    first = run()
    assert sorted(r.update_id for r in first) == ids[:5] and len({r.partition for r in first}) == 2
    told(ids[5:])
    found = run()
    assert sorted((r.update_id, json.loads(r.payload)["text"]) for r in found) == [(k, f"m{k}") for k in ids]
    assert sorted(r.update_id for r in run()) == ids
    assert int((tmp_path / "service" / "_offset").read_text()) in (5, 1001)  # told when the batch after it begins, or the next start


def test_ranges_of_a_feed():
    cut = lambda *a: [(r.start, r.end) for r in feed.ranges(*a)]
    assert cut(0, 0, 3) == [] and cut(4, 5, 3) == [(4, 5)] and cut(2, 9, 3) == [(2, 3), (3, 6), (6, 9)]
    far = cut(5, 10**12, 100)
    assert len(far) <= feed.MOST_RANGES + 1 and far[0][0] == 5 and far[-1][1] == 10**12 and all(a[1] == b[0] for a, b in zip(far, far[1:]))


def test_lookup_asks_for_distinct_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string").coalesce(1)
    got = lookup.enrich(df, "k", lambda keys: {k: {"n": len(keys)} for k in keys if k}, "n int").collect()
    assert [r.n for r in got] == [3, 3, 3, None]


def test_files_and_names(spark, tmp_path):
    for n in ("a.MP4", "b.mov", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path), ("mp4", "mov", "avi")).collect()) == ["a.MP4", "b.mov"]
    r = spark.range(1).select(reports.segment_name(F.lit(1), F.lit(2.9)), reports.segment_name(F.lit(1), F.lit(2), F.lit(3))).first()
    assert tuple(r) == ("segment_1_2.mp4", "person_3_segment_1_2.mp4")


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    for _ in range(2):
        reports.append_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6
    reports.write_report(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_handlers_in_priority_order(spark):
    h = Handlers("none").register("late", F.lit(True), 9).register("early", F.col("id") > 1, 1)
    assert [r[0] for r in spark.range(3).select(h.column()).collect()] == ["late", "late", "early"]
    assert spark.range(1).select(h.unregister("late").column()).first()[0] == "none"


def test_expiring_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = [(1, 0.0, 10.0), (1, 20.0, 11.0), (1, 60.0, 12.0), (2, 5.0, 13.0)]
        spark.createDataFrame(rows, "key long, t double, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
        s = streams.expiring(streams.read_stream(spark, str(tmp_path / "in")), "key", 30.0)
        got = sorted(tuple(r) for r in streams.finish(s, str(tmp_path / "out")).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [(1, 0.0, False, None), (1, 20.0, True, 10.0), (1, 60.0, False, None), (2, 5.0, False, None)]


def test_notify(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    seen = []
    streams.notify(streams.read_stream(spark, str(tmp_path / "in"), 10), str(tmp_path / "c"), lambda df, n: seen.append((n, df.count())))
    assert sum(c for _, c in seen) == 4


def test_spreadsheets(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(excel.workbook(["a", "b", "c"], [(1, "x<&>", 1.5), (None, None, None), (20, " y ", None)], "Own"))
    read = excel.read_sheets(spark, str(tmp_path / "s.xlsx"), ["a", "b", "missing", "c"], "Own")
    assert sorted(map(tuple, read.collect()), key=str) == [("1", "x<&>", None, "1.5"), ("20", " y ", None, None)]
    found = excel.inferred(read)
    assert [t for _, t in found.dtypes] == ["bigint", "string", "bigint", "double"]
    assert excel.inferred(read.limit(0)).count() == 0


def test_spreadsheet_of_another_writer(tmp_path):
    """Shared strings, gaps between cells, rich text, an absolute target and a second sheet."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>A</t></r><r><t>B</t></r></si></sst>")
        z.writestr("xl/worksheets/a.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/b.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    content = (tmp_path / "o.xlsx").read_bytes()
    assert excel.sheet_rows(content) == []
    assert excel.sheet_rows(content, "Two") == [["name", *[None] * 26, "7"], ["AB"]] and excel.sheet_rows(content, 1) == excel.sheet_rows(content, "Two")


def test_expired_state_is_dropped(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, rows in enumerate(([(1, 0.0, 1.0), (2, 500.0, 2.0)], [(2, 505.0, 3.0)], [(3, 520.0, 4.0), (1, 521.0, 5.0)])):
            spark.createDataFrame(rows, "key long, t double, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = streams.expiring(streams.read_stream(spark, str(tmp_path / "in")), "key", 30.0)
        got = sorted(tuple(r) for r in streams.finish(s, str(tmp_path / "out")).collect())
        state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "out" / "checkpoint"))
        kept = sorted(r[0] for r in state.select("key.key").collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == [(1, 0.0, False, None), (1, 521.0, False, None), (2, 500.0, False, None), (2, 505.0, True, 2.0), (3, 520.0, False, None)]
    assert kept == [1, 2, 3]


def test_best_fit_and_batches_of_many_rows(spark):
    from chronovec.operators import telemetry

    n = 20000
    blocks = spark.range(n).select(F.lit(1).alias("pool"), (F.col("id") * 3).alias("size"), F.col("id").alias("block_id"))
    requests = spark.range(n).select(F.lit(1).alias("pool"), (F.col("id") * 2 + 1).alias("need"), F.col("id").alias("request_id"))
    got = {r.request_id: r.block_id for r in telemetry.best_fit_block(requests, blocks, ["pool"], "size", "need").collect()}
    assert got == {k: b if (b := -(-(2 * k + 1) // 3)) < n else None for k in range(n)}
    batches = telemetry.in_batches(spark.range(1000).select((999 - F.col("id")).alias("k")), ["k"], 7).collect()
    assert all(r.batch == r.k // 7 for r in batches)


def test_filter_of_boxes_is_the_conditional_mean(spark):
    """The filter against the joint normal distribution of all its steps."""
    import numpy as np

    from chronovec.operators import stateful

    rng = np.random.default_rng(3)
    boxes = [(0, t, *map(float, rng.normal((100, 80, 180, 160), 9))) for t in range(6)]
    got = stateful.kalman_boxes(spark.createDataFrame(boxes, "k int, t int, x1 double, y1 double, x2 double, y2 double"), ["k"], "t").orderBy("t").collect()
    z = np.array([((b[2] + b[4]) / 2, (b[3] + b[5]) / 2, b[4] - b[2], b[5] - b[3]) for b in boxes])
    move, q = np.eye(8), 5.0 * np.array([[0.25, 0.5], [0.5, 1]])
    move[:4, 4:] = np.eye(4)
    noise = np.zeros((8, 8))
    for k, w in enumerate((1, 1, 0.01, 0.01)):
        noise[2 * k : 2 * k + 2, 2 * k : 2 * k + 2] = w * q
    first = np.append(z[0], np.zeros(4))
    for n in range(1, 6):
        cov, power = [100 * np.eye(8)], np.linalg.matrix_power
        for _ in range(n):
            cov.append(move @ cov[-1] @ move.T + noise)
        joint = lambda a, b: power(move, a - b) @ cov[b] if a >= b else (power(move, b - a) @ cov[a]).T  # noqa: E731, B023
        seen = np.block([[joint(a, b)[:4, :4] + (a == b) * np.diag([10, 10, 25, 25]) for b in range(1, n + 1)] for a in range(1, n + 1)])
        cross = np.hstack([joint(n, b)[:, :4] for b in range(1, n + 1)])
        mean = power(move, n) @ first + cross @ np.linalg.solve(seen, np.concatenate([z[b] - (power(move, b) @ first)[:4] for b in range(1, n + 1)]))
        r = got[n]
        assert np.allclose([(r.f_x1 + r.f_x2) / 2, (r.f_y1 + r.f_y2) / 2, r.f_x2 - r.f_x1, r.f_y2 - r.f_y1, r.vx, r.vy], mean[:6])


def test_spreadsheets_hold_what_the_format_can(spark, tmp_path, monkeypatch):
    odd = ["a\x0bb\x00c", "line\rend\r\n", "_x000B_ and _x00g0_", "\uffff\x1f", "tab\tnew\nline", "=1+1", "é & <b>", "x" * excel.MOST_CHARACTERS]
    read = excel.sheet_rows(excel.workbook(["h"], [(v,) for v in odd] + [(float("inf"),)]))
    assert [r[0] for r in read[1:]] == [*odd, "inf"]
    df = spark.createDataFrame([("b", v) for v in odd], "book string, v string")
    assert sorted(r.v for r in excel.parsed(excel.workbooks(df, "book"), ["v"]).collect()) == sorted(odd)
    with pytest.raises(ValueError, match="32767 characters"):
        excel.workbook(["h"], [("x" * (excel.MOST_CHARACTERS + 1),)])
    with pytest.raises(ValueError, match="columns"):
        excel.workbook(["h"] * (excel.MOST_COLUMNS + 1), [])
    monkeypatch.setattr(excel, "MOST_ROWS", 5)
    with pytest.raises(ValueError, match="1 books have more rows"):
        excel.workbooks(df, "book")
    with pytest.raises(ValueError, match="at most 5 rows"):
        excel.workbook(["h"], [(1,)] * 5)
    assert len(excel.sheet_rows(excel.workbook(["h"], [(1,)] * 4))) == 5


def test_pronunciation_is_no_text():
    import io
    import zipfile

    content = excel.workbook(["h"], [("x",)])
    book, out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    main = excel._MAIN[1:-1]
    with zipfile.ZipFile(out, "w") as z:
        for name in book.namelist():
            data = book.read(name)
            if name.endswith("sheet1.xml"):
                data = f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>'.encode()
            z.writestr(name, data)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>To</t></r><r><t>kyo</t></r><rPh sb="0" eb="2"><t>read aloud</t></rPh></si></sst>')
    assert excel.sheet_rows(out.getvalue()) == [["Tokyo"]]
