"""Worked examples of single rules, and whole ways through the library on small inputs."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from payrecon import config
from payrecon.functions import scalars as S
from payrecon.operators import canonical, export, history, layout, ocr, reconcile
from payrecon.plans.statements import carrier_sweep, export_statements, payloads, read_exports, read_large_exports, read_word_statements
from payrecon.sources import files as sources
from payrecon.sources.payload import from_payload
from payrecon.streaming import ingest


def values(spark, texts, rule):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", rule(F.col("t")).alias("v")).orderBy("i").collect()]


def test_amounts(spark):
    texts = ["(75.00)", "$1,234.50", "12.5%", "6/1/26", "26-Jun", "", "12D", "(-5)", "$(75.00)", None, "1f", "nan", " .5 ", "1e3", "5."]
    assert values(spark, texts, S.to_amount) == [-75.0, 1234.5, 12.5, None, None, None, None, 5.0, None, None, None, None, 0.5, 1000.0, 5.0]


def test_dates(spark):
    good = ["20260728", "2026-07-28", "2026/07/28 14:30:00", "07/28/2026 09:15", "7-28-26"]
    assert values(spark, good, S.to_mdy) == ["07/28/2026"] * 5
    assert values(spark, ["20261332", "1/2/69", "1/2/70", "02/31/2026", "13/01/2026", "", " "], S.to_mdy) == [None, "01/02/2069", "01/02/1970", "02/31/2026", None, "", ""]


def test_names(spark):
    files = ["Vertigo -214.80.pdf", "Big Sky 362.10 (1).PDF", "agent_statement.csv"]
    assert values(spark, files, S.filename_amount) == [-214.8, 362.1, None]
    assert values(spark, ["Big Sky 362.10.PDF"], S.carrier_name) == ["Big Sky"]
    assert values(spark, ["( 75.00 )", "150.0 0"], S.repair_text) == ["(75.00)", "150.00"]
    typed = values(spark, ["5.00%", "05/26/26", "05/26/2026", "x"], lambda c: S.typed_cell(c, F.lit("Gross")))
    assert [(t.kind, t.num, t.date) for t in typed] == [("number", 0.05, None), ("text", None, None), ("date", None, datetime.date(2026, 5, 26)), ("text", None, None)]


def test_canonical(spark):
    lists = [["Commission paid YTD", "Commission paid this month"], ["Commission", "Current Pmt"], ["a", "b"]]
    got = {tuple(r.columns): r["Commission Amount"] for r in canonical.infer_canonical(spark.createDataFrame([(x,) for x in lists], "columns array<string>")).collect()}
    assert [got[tuple(x)] for x in lists] == ["Commission paid this month", "Current Pmt", None]


def test_declared_and_verdict(spark):
    lines = [("a", 1, 1, "Producer commissions total 337.65 15.38"), ("b", 1, 1, "PRIOR MONTH Check Total 10.00"), ("c", 1, 1, "Check Total: 124.03")]
    declared = reconcile.declared_totals(spark.createDataFrame(lines, "stmt_id string, page_no int, line_no int, text string"))
    files = spark.createDataFrame([("a", 15.38), ("b", None), ("c", 124.23)], "stmt_id string, filename_total double")
    chosen = {r.stmt_id: (r.statement_label, r.statement_total) for r in reconcile.choose_reference(declared, files).collect()}
    assert chosen == {"a": ("commissions total", 15.38), "c": ("Check Total", 124.03)}
    rows = [("m", 124.03, 124.23, 124.03, "x"), ("n", None, 1.0, None, None), ("o", 5.0, None, None, None), ("p", 5.0, 5.0, None, None)]
    made = reconcile.payout_verdict(spark.createDataFrame(rows, "stmt_id string, exported_total double, filename_total double, statement_total double, statement_label string"))
    got = {r.stmt_id: (r.status, r.references_disagree) for r in made.collect()}
    assert got == {"m": ("mismatch", True), "n": ("no_amounts", False), "o": ("no_reference", False), "p": ("match", False)}
    with pytest.raises(export.FailsafeError):
        export.guard_failsafe(made.withColumn("filename", F.col("stmt_id")))


def test_rotation_stops_at_the_first_good_reading(spark):
    facts = spark.createDataFrame([("s", 1, 1, 0, 80.0, 5, 0), ("s", 1, 2, 90, 76.0, 20, 0), ("s", 1, 3, 180, 99.0, 30, 0)], "stmt_id string, page_no int, try_no int, angle int, mean double, words long, dropped long")
    assert ocr.pick_rotation(facts).first().try_no == 1


def test_lines_are_anchored():
    rng = random.Random(1)
    for _ in range(200):
        at = sorted(rng.uniform(0, 60) for _ in range(30))
        lines = layout.anchor_groups(at, 3.0)
        for n in set(lines):
            mine = [p for p, k in zip(at, lines, strict=True) if k == n]
            later = [p for p, k in zip(at, lines, strict=True) if k == n + 1]
            assert mine[-1] - mine[0] <= 3.0 and (not later or later[0] - mine[0] > 3.0)


def plain_bands(lines, words, gap, ratio):
    """Band numbers of a page's words (`pos, height, alpha, num`), word by word."""
    bands, before = [], None
    for line, w in zip(lines, words, strict=True):
        if not bands or line != bands[-1]["line"]:
            if before is None or w["pos"] - before > gap:
                bands.append({"pos": w["pos"], "words": []})
            bands[-1]["line"], before = line, w["pos"]
        bands[-1]["words"].append(w)
    count = lambda b, k: sum(bool(w[k]) for w in b["words"])
    heads = lambda b: len(b["words"]) >= config.MIN_CELLS <= count(b, "alpha") and count(b, "num") <= len(b["words"]) // 3
    kept, out = [], []
    for b in bands:
        n = len(b["words"])
        if kept and heads(kept[-1]) and heads(b):
            height = sorted(w["height"] for w in kept[-1]["words"])[len(kept[-1]["words"]) // 2]
            if height > 0 and (b["pos"] - kept[-1]["pos"]) / height <= ratio:
                kept[-1]["words"] = kept[-1]["words"] + b["words"]
                out += [len(kept) - 1] * n
                continue
        kept.append(b)
        out += [len(kept) - 1] * n
    return out


def flat_bands(pages, gap, ratio):
    words = [w for page in pages for w in page]
    flat = layout.Pages([w["pos"] for w in words], [w["height"] for w in words], np.array([w["alpha"] for w in words], bool), np.array([w["num"] for w in words], bool))
    out, start = [], 0
    for page in pages:
        lines = layout.anchor_groups([w["pos"] for w in page], config.LINE_TOL)
        out.append(flat.bands(start, start + len(page), lines, gap, ratio))
        start += len(page)
    return out


def test_header_bands_join_a_line_apart():
    word = lambda pos, alpha=True: {"pos": pos, "height": 10.0, "alpha": alpha, "num": not alpha}
    words = [word(0)] * 3 + [word(11.1)] * 3 + [word(40)] * 3 + [word(51, False)] * 3
    assert flat_bands([words], config.BAND_GAP, config.HEADER_MERGE_RATIO) == [[0] * 6 + [1] * 3 + [2] * 3]
    rng = random.Random(3)
    for _ in range(200):
        made = lambda: {"pos": rng.choice((0.0, 0.5, 9.0, 10.0, 11.0, 20.0, 24.0, 33.0, 60.0)), "height": rng.choice((0.0, 8.0, 10.0)), "alpha": rng.random() < 0.8, "num": rng.random() < 0.2}
        pages = [sorted((made() for _ in range(rng.randint(0, 30))), key=lambda w: w["pos"]) for _ in range(4)]
        plain = [plain_bands(layout.anchor_groups([w["pos"] for w in page], config.LINE_TOL), page, config.BAND_GAP, config.HEADER_MERGE_RATIO) for page in pages]
        assert flat_bands(pages, config.BAND_GAP, config.HEADER_MERGE_RATIO) == plain


FILES = {
    "Acme 30.00.csv": b"\xef\xbb\xbfPolicy,Eff Date,Premium,Comm %,Commission\nA1,20260728,0000100.00,100,10.00\nCASH  disbursed,,5.00,,\nA2,20260729,000200.00,100,20.00\n",
    "Tab 3.00.tsv": b"Policy\tInsured\tCommission\tPremium\nA1\tx\t1.00\t10.00\nA2\ty\t2.00\t20.00\nTotals\t\t3.00\t30.00\n",
    "Bad 9.00.txt": b'Policy|Commission\n"a|b\nc"|4.50\xff\n',
    "empty.csv": b"",
    "copy.csv": b"Policy|Commission\nq|1.00\n",
    "copy2.csv": b"Policy|Commission\nq|1.00\n",
}


def write(folder, names):
    for name in names:
        (folder / name).write_bytes(FILES[name])


def test_exports(spark, tmp_path):
    write(tmp_path, FILES)
    statements, cells = read_exports(sources.read_delimited(spark, str(tmp_path)))
    got = {r.filename: r for r in statements.collect()}
    assert set(got) == set(FILES) - {"empty.csv"}  # Spark's reader passes over files of no bytes
    acme, tab = got["Acme 30.00.csv"], got["Tab 3.00.tsv"]
    assert (acme.status, acme.exported_total, acme.n_rows) == ("match", 30.0, 2)
    assert (tab.status, tab.exported_total, tab.n_rows, tab.n_checks, tab.passed, tab.delimiter) == ("match", 3.0, 2, 2, 2, "tab")
    assert [(c.label, c.rows_total, c.ok) for c in tab.checks] == [("Commission", 3.0, True), ("Premium", 30.0, True)] and tab.totals["Policy"] == "Totals"
    assert [(n.column, n.action) for n in tab.cleanup][-1] == ("Totals", "dropped")
    assert [(n.column, n.action) for n in acme.cleanup][-1] == ("CASH DISBURSED", "dropped") and ("Comm %", "rescaled") in [(n.column, n.action) for n in acme.cleanup]
    kept = {r.filename: from_payload_row for r in payloads(statements, cells).select("filename", from_payload(F.col("payload")).alias("p")).collect() for from_payload_row in [r.p]}
    assert [r["Commission"] for r in kept["Acme 30.00.csv"].rows] == ["10.00", "20.00"] and kept["Tab 3.00.tsv"].payout.status == "match"
    assert got["Bad 9.00.txt"].n_rows == 1 and got["Bad 9.00.txt"].status == "no_amounts"
    row = {r.col_name: r.value for r in cells.filter((F.col("stmt_id") == acme.stmt_id) & (F.col("row_no") == 1)).collect()}
    assert row == {"Policy": "A1", "Eff Date": "07/28/2026", "Premium": "100.00", "Comm %": "10.0", "Commission": "10.00"}


def test_exports_keep_a_row_for_what_is_not_read(spark, tmp_path, monkeypatch):
    write(tmp_path, ["Acme 30.00.csv", "copy.csv"])
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "quote.csv").write_bytes(b"a,b\nx," + b"y" * 200_000 + b"\n")  # a field beyond the reader's limit
    files = sources.with_identity(spark.read.format("binaryFile").load(str(tmp_path)))
    files = files.withColumn("length", F.when(F.col("filename") == "copy.csv", 10**9).otherwise(F.col("length")))
    got = {r.filename: r for r in read_exports(files)[0].collect()}
    assert {k: v.status for k, v in got.items()} == {"Acme 30.00.csv": "match", "copy.csv": "too_large", "scan.pdf": "rejected", "quote.csv": "crash"}
    assert got["quote.csv"].warnings[0].startswith("CRASH: ") and "40 MB" in got["copy.csv"].warnings[0]
    assert read_exports(files.limit(0))[0].count() == 0


def test_exports_of_repeated_ids_and_empty_files(spark, tmp_path):
    write(tmp_path, ["Acme 30.00.csv", "copy.csv"])
    files = sources.read_delimited(spark, str(tmp_path))
    empty = files.filter("filename = 'copy.csv'").withColumn("stmt_id", F.lit("none")).withColumn("content", F.lit(b" \n ")).withColumn("filename", F.lit("none.csv"))
    statements, cells = read_exports(files.unionByName(files).unionByName(empty), most=200)
    got = {r.filename: r for r in statements.collect()}
    assert statements.count() == len(got) == 3 and (got["Acme 30.00.csv"].exported_total, got["Acme 30.00.csv"].status) == (30.0, "match")
    assert (got["none.csv"].n_rows, got["none.csv"].warnings) == (0, [config.EMPTY_FILE])
    assert {r.status for r in read_exports(files, most=20)[0].collect()} == {"too_large"}
    out = export_statements(statements, cells)
    rows = {(r.source, r.row_no): r for r in out["all_rows"].collect()}
    assert rows["Acme 30.00.csv", 1]["Policy Number"] == "A1" and rows["Acme 30.00.csv", 3]["Commission Amount"] == "20.00" and len(rows) == 3
    assert {r.status for r in out["report"].filter("section = 0").collect()} == {"FAILSAFE OK (filename: 30.00)", "FAILSAFE N/A"}
    assert out["sheets"].filter("col_name = 'Premium'").count() == 2 and out["typed"].count() == 3
    swept = {r.carrier: (r.bucket, r.verdict) for r in carrier_sweep(statements).collect()}
    assert swept == {"Acme": ("unverified", "PASS"), "copy": ("unverified", "n/a"), "none": ("no-rows", "n/a")}


def test_large_exports_are_those_of_small_ones(spark, tmp_path):
    write(tmp_path, ["Acme 30.00.csv", "Tab 3.00.tsv"])
    (tmp_path / "Long 6.00+1.csv").write_text('Policy,Name,Commission\n' + 'p,"a\nb",0.01\n' * 300)
    keys = ["filename", "status", "n_rows", "exported_total", "delimiter", "columns", "cleanup", "warnings", "template", "n_checks", "passed"]
    seen = lambda s: sorted(map(tuple, s.select(*keys).collect()))
    small, cells = read_exports(sources.read_delimited(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        large, more = read_large_exports(spark, str(tmp_path), over=0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen(large) == seen(small) and len(seen(small)) == 3
    key = lambda c, s: sorted(map(tuple, c.join(s.select("stmt_id", "filename"), "stmt_id").select("filename", "col_name", "value").collect()))
    assert key(more, large) == key(cells, small)
    assert read_large_exports(spark, str(tmp_path))[0].count() == 0


def words_at(stmt, page, rows):
    """Word rows of lines of (text, x0, x1), eleven points apart."""
    made = [(stmt, page, 100 * i + j, t, float(a), float(b), 20.0 + 20.0 * i, 28.0 + 20.0 * i, False) for i, line in enumerate(rows) for j, (t, a, b) in enumerate(line)]
    return made


def test_words_become_statements(spark):
    head = [("Policy", 10, 40), ("Insured", 70, 110), ("Invoice", 130, 160), ("Gross", 230, 260), ("Comm%", 280, 312), ("Comm", 330, 352), ("$", 353, 358)]
    line = lambda p, g, r, c: [(p, 10, 60), ("Ann", 70, 90), ("7", 135, 140), (g, 232, 258), (r, 285, 310), (c, 332, 358)]
    total = [("Totals", 10, 40), ("300.00", 230, 260), ("30.00", 332, 358)]
    rows = words_at("t", 1, [head, line("AB1234", "100.00", "10", "10.00"), line("AB1235", "200.00", "10", "20.00"), total, [("Net", 10, 30), ("Amount:", 32, 60), ("$30.00", 70, 100)]])
    rows += words_at("a", 2, [[("Client", 10, 40), ("Premium", 230, 260), ("Commission", 330, 358)], *[[(n, 10, 40), (g, 232, 258), (c, 335, 355)] for n, g, c in (("Ann", "1.00", "2.00"), ("Bob", "3.00", "4.00"))]])
    rows += words_at("f", 1, [head, line("#1", "5.00", "10", "0.50"), line("#2", "7.00", "10", "0.70")])
    rows += words_at("n", 1, [[("only", 10, 40), ("prose", 50, 80)]])
    rows += words_at("gone", 1, [head])
    files = spark.createDataFrame([("t", "Leef 30.00.pdf"), ("a", "Auto 6.00.pdf"), ("f", "Else 1.30.pdf"), ("n", "None 1.00.pdf"), ("e", "Empty 2.00.pdf"), ("o", "Scan 6.00.pdf")], "stmt_id string, filename string")
    scan = [("o", 1, t, 90 * t, w, x, "90" if t else "30", 100 * w, 100 * (w // 3), 80, 20) for t in (0, 1) for w, x in enumerate(["Name", "Premium", "Commission", "Ann", "1.00", "2.00", "Bob", "3.00", "4.00"])]
    scan = [(a, b, c, d, e, x, k, 400 * (e % 3), i, 300, j) for a, b, c, d, e, x, k, h, i, _, j in scan]
    words = spark.createDataFrame(rows, sources.WORDS)
    readings = spark.createDataFrame(scan, "stmt_id string, page_no int, try_no int, angle int, word_no int, text string, conf string, left int, top int, width int, height int")
    statements, cells = read_word_statements(files, words, readings)
    got = {r.stmt_id: r for r in statements.collect()}
    assert set(got) == {"t", "a", "f", "n", "e", "o"}
    t, a, f = got["t"], got["a"], got["f"]
    assert (t.how, t.status, t.n_rows, t.n_checks, t.passed, t.exported_total, t.statement_total) == ("template", "match", 2, 2, 2, 30.0, 30.0) and t.warnings == []
    assert (a.how, a.template, a.status, a.n_rows) == ("auto-detected", "Auto (auto-detected)", "match", 2) and "unverified" in a.warnings[0]
    assert (f.how, f.status, f.exported_total) == ("auto-detected", "mismatch", 1.2)
    assert (got["n"].how, got["n"].status) == (None, "no_amounts") and "no table" in got["n"].warnings[0] and "No text layer" in got["e"].warnings[0]
    assert (got["o"].how, got["o"].status, got["o"].exported_total) == ("auto-detected", "match", 6.0) and got["o"].warnings[0].startswith("Page 1: Read by OCR")
    assert cells.filter("stmt_id = 't' AND col_name = 'Comm $'").count() == 2
    assert read_word_statements(files.limit(0), words)[0].count() == 0


def test_stream(spark, tmp_path):
    inbox, kept = tmp_path / "in", str(tmp_path / "history")
    inbox.mkdir()
    for names in (["Acme 30.00.csv", "copy.csv"], ["copy2.csv", "Tab 3.00.tsv"], []):
        write(inbox, names)
        ingest.ingest_stream(spark, str(inbox), kept, str(tmp_path / "check")).awaitTermination(240)
    rows = {r.filename: r for r in ingest.read_history(spark, kept).collect()}
    assert set(rows) == {"Acme 30.00.csv", "copy.csv", "copy2.csv", "Tab 3.00.tsv"}
    assert rows["copy2.csv"].first_copy == rows["copy.csv"].id and rows["copy.csv"].first_copy is None
    assert rows["Acme 30.00.csv"].failsafe == "match" and '"exported_total":30.0' in rows["Acme 30.00.csv"].payload
    again = spark.read.format("binaryFile").load(str(inbox / "copy2.csv"))
    ingest.ingest_batch(again, 1, kept)  # a batch that is run again knows the other batches' files only
    assert {r.filename: r for r in ingest.read_history(spark, kept).collect()}["copy2.csv"].first_copy == rows["copy.csv"].id


def test_tsv(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 1), ("s", 1, 2)], "stmt_id string, section int, row_no int")
    cells = spark.createDataFrame([("s", 1, 1, "A", "x"), ("s", 1, 2, "B", "y")], "stmt_id string, section int, row_no int, col_name string, value string")
    lines = sources.statement_lines(rows, cells, spark.createDataFrame([("s", ["A", "B"])], "stmt_id string, columns array<string>"))
    sources.write_statement_tsv(lines, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).select("value").collect()] == ["A\tB", "x\t", "\ty"]


def test_words_are_read_and_rows_written(spark, tmp_path):
    made = words_at("s", 1, [[("Policy", 10, 40)]])
    spark.createDataFrame(made, sources.WORDS).write.parquet(str(tmp_path / "words"))
    spark.createDataFrame(made, sources.WORDS).write.json(str(tmp_path / "json"))
    for fmt, path in (("parquet", "words"), ("json", "json")):
        read = sources.read_words(spark, str(tmp_path / path), fmt)
        assert [tuple(r) for r in read.collect()] == made and read.schema.simpleString() == spark.createDataFrame([], sources.WORDS).schema.simpleString()
    fields = ", ".join(f"`{f}` string" for f in config.CANONICAL_FIELDS)
    rows = spark.createDataFrame([("s", 1, "a.csv", "A", *["x\ty", "", '"q"', "1", "2", "3"])], f"stmt_id string, row_no int, source string, carrier string, {fields}")
    sources.write_all_rows_tsv(rows, str(tmp_path / "rows"))
    back = spark.read.csv(str(tmp_path / "rows"), sep="\t", header=True).collect()
    assert back[0].asDict() == {"Source": "a.csv", "Carrier": "A", **dict(zip(config.CANONICAL_FIELDS, ("x\ty", None, '"q"', "1", "2", "3"), strict=True))}


def test_ids_that_are_there(spark):
    kept = spark.createDataFrame([("a",), ("b",)], "id string")
    asked = spark.createDataFrame([("b",), ("b",), ("c",), (None,)], "id string")
    assert [r.id for r in history.found_ids(kept, asked).collect()] == ["b"] and history.found_ids(kept, asked.limit(0)).count() == 0
    assert [r.id for r in history.delete_statements(kept, asked).collect()] == ["a"]
