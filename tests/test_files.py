"""CSV source, numbering, fingerprints, publishing and reading back."""

import csv
import hashlib
import io
import random

import pytest
from conftest import golden_records, record
from pyspark.sql import functions as F

from ledgerwise.operators import serving
from ledgerwise.plans import publish as publishing
from ledgerwise.plans.publish import import_csv, read_published
from ledgerwise.policies import LEDGER_COLUMNS
from ledgerwise.sources import ledger_csv


def write(path, records, columns=LEDGER_COLUMNS, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as out:
        writer = csv.DictWriter(out, columns)
        writer.writeheader()
        writer.writerows(records)
    return str(path)


def test_columns_in_any_order_bom_quotes_and_line_breaks(spark, tmp_path):
    records = [record("I1", account_name='Al "A" \n Co'), record("I2", region="NA", industry="")]
    path = write(tmp_path / "a.csv", records, LEDGER_COLUMNS[::-1], "utf-8-sig")
    got = ledger_csv.read_ledger(spark, path).orderBy("source_row").collect()
    assert [r["source_row"] for r in got] == [2, 3]
    assert got[0]["account_name"] == 'Al "A" \n Co' and got[1]["industry"] == "" and got[1]["region"] == "NA"


@pytest.mark.parametrize(
    "text",
    [
        "invoice_id,invoice_id\nI1,I2\n", "", ",".join(LEDGER_COLUMNS) + "\n", ",".join(LEDGER_COLUMNS[:-1]) + "\n1\n",
        ",".join(LEDGER_COLUMNS) + "\n" + ",".join("x" * 18) + "\n", ",".join(LEDGER_COLUMNS) + "\n" + ",".join("x" * 20) + "\n",
    ],
)
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "b.csv").write_text(text)
    with pytest.raises(Exception):
        ledger_csv.read_ledger(spark, str(tmp_path / "b.csv")).collect()


def test_invalid_utf8_is_refused(spark, tmp_path):
    path = write(tmp_path / "c.csv", [record("I1", account_name="Caf\u00e9")], encoding="latin-1")
    with pytest.raises(ValueError, match="UTF-8"):
        ledger_csv.read_ledger(spark, path)
    path = write(tmp_path / "d.csv", [record("I1", account_name="Caf\u00e9")])
    assert ledger_csv.read_ledger(spark, path).head()["account_name"] == "Caf\u00e9"


HEADER = ",".join(LEDGER_COLUMNS)
LAST = "," * (len(LEDGER_COLUMNS) - 2)


@pytest.mark.parametrize(
    "lines",
    [
        f'"Al"pha,x{LAST}', "   ", f'x,"open{LAST}', f'"a\nb" ,x{LAST}', f"a\rb,x{LAST}", f'ok,"line\nbreak"{LAST},more', f'"a""b,x{LAST}\nc,d{LAST}',
    ],
)
def test_strict_records(spark, tmp_path, lines):
    """What a strict reader refuses is refused."""
    text = f"{HEADER}\nfine,x{LAST}\n{lines}\nfine,x{LAST}\n"
    (tmp_path / "b.csv").write_text(text, newline="")
    with pytest.raises((csv.Error, AssertionError)):
        rows = [r for r in csv.reader(io.StringIO(text, newline="\n"), strict=True) if r]
        assert {len(r) for r in rows} == {len(LEDGER_COLUMNS)}
    with pytest.raises(ValueError, match="record"):
        ledger_csv.read_ledger(spark, str(tmp_path / "b.csv"))


def test_files_are_split_anywhere(spark, tmp_path):
    """Quotes, commas and line breaks at random, in splits of a few hundred bytes, against the library's strict reader."""
    rng = random.Random(8)
    want = []
    for part, name in enumerate(["a1.csv", "a2.csv", "a10.csv"]):
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig") as out:
            out.write(HEADER + ("\r\n" if part else "\n"))
            for _ in range(150):
                fields = []
                for _ in LEDGER_COLUMNS:
                    text = "".join(rng.choice(["a", "b ", "é", ",", '"', "\n", "\r\n", "x" * 9]) for _ in range(rng.choice([0, 1, 1, 2, 6])))
                    if rng.random() < 0.02:
                        text = '",' * rng.randrange(60) + "\n" * rng.randrange(90)
                    plain = not set(text) & set(',"\n\r')
                    middle = text[:1] != '"' and not set(text) & set(",\n\r")
                    quoted = '"' + text.replace('"', '""') + '"'
                    fields.append(text if (plain or middle) and rng.random() < 0.8 else quoted)
                out.write(",".join(fields) + rng.choice(["\n", "\r\n", "\n\n", "\n\r\n"]))
            out.write(f"last,x{LAST}")
    for name in ["a1.csv", "a2.csv", "a10.csv"]:
        text = (tmp_path / name).read_bytes().decode("utf-8-sig")
        want += [r for r in csv.reader(io.StringIO(text, newline="\n"), strict=True) if r][1:]
    assert len(want) == 453 and {len(r) for r in want} == {len(LEDGER_COLUMNS)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = ledger_csv.read_ledger(spark, str(tmp_path)).orderBy("source_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["source_row"] for r in got] == list(range(2, 455))
    assert [[r[c] for c in LEDGER_COLUMNS] for r in got] == want


def test_numbers_run_over_splits_and_files(spark, tmp_path):
    for part in range(3):
        write(tmp_path / f"p{part}.csv", [record(f"I{part * 5000 + n}") for n in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = ledger_csv.read_ledger(spark, str(tmp_path))
        pairs = {(r["source_row"], r["invoice_id"]) for r in got.select("source_row", "invoice_id").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pairs == {(n + 2, f"I{n}") for n in range(15000)}


def test_fingerprints(spark, tmp_path):
    path = write(tmp_path / "a.csv", golden_records())
    one = ledger_csv.source_sha256(ledger_csv.source_files(spark, path)).head()[0]
    assert one == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()
    write(tmp_path / "b.csv", golden_records()[:3])
    files = ledger_csv.source_files(spark, str(tmp_path))
    assert files.count() == 2 and ledger_csv.source_sha256(files).head()[0] != one


def test_import_and_failed_import(spark, tmp_path):
    good, out = write(tmp_path / "good.csv", golden_records()), str(tmp_path / "out")
    import_csv(spark, good, out)
    before = read_published(spark, out)
    assert before["report"].head()["source_sha256"] == hashlib.sha256((tmp_path / "good.csv").read_bytes()).hexdigest()
    assert before["invoices"].count() == 8 and before["raw_records"].count() == 11
    (tmp_path / "broken.csv").write_text("invoice_id,invoice_id\nI1,I2\n")
    with pytest.raises(ValueError):
        import_csv(spark, str(tmp_path / "broken.csv"), out)
    nothing = write(tmp_path / "nothing.csv", [record("I1", amount="?")])
    with pytest.raises(ValueError, match="no accepted invoices"):
        import_csv(spark, nothing, out)
    with pytest.raises(ValueError, match="overwrite"):
        import_csv(spark, good, good)
    assert read_published(spark, out)["report"].inputFiles() == before["report"].inputFiles()
    import_csv(spark, good, out, as_of="2024-01-31")
    assert read_published(spark, out)["report"].head()["invoices_after_as_of"] == 2
    audit_only = str(tmp_path / "audit")
    import_csv(spark, nothing, audit_only, as_of="2024-01-31")
    assert read_published(spark, audit_only)["accounts"].count() == 0


def test_changed_cells_and_overtaken_imports_are_found(spark, tmp_path, monkeypatch):
    good, out = write(tmp_path / "good.csv", golden_records()), str(tmp_path / "out")
    import_csv(spark, good, out)
    first = publishing.current_run(spark, out)
    assert publishing.read_published(spark, out, verify=True)["invoices"].count() == 8
    check = publishing._check

    def overtaken(ledger, as_of):
        check(ledger, as_of)
        monkeypatch.setattr(publishing, "_check", check)
        import_csv(spark, good, out, as_of="2024-01-31")

    monkeypatch.setattr(publishing, "_check", overtaken)
    with pytest.raises(ValueError, match="another import"):
        import_csv(spark, good, out)
    second = publishing.current_run(spark, out)
    assert second != first and len(list((tmp_path / "out" / "log").glob("0*"))) == 2
    assert len(list((tmp_path / "out" / "runs").iterdir())) == 2
    table = spark.read.parquet(f"{second}/invoices")
    changed = table.withColumn("csat_score", F.when(F.col("invoice_id") == "I2", 5).otherwise(F.col("csat_score")))
    moved = changed.orderBy(F.desc("invoice_id")).collect()
    spark.createDataFrame(moved, table.schema).write.mode("overwrite").parquet(f"{second}/invoices")
    with pytest.raises(ValueError, match="changed: invoices"):
        publishing.read_published(spark, out, verify=True)


def test_manifest_sums_hashes_of_whole_rows(spark, tmp_path):
    """The manifest's digest: one hash a row over typed cells, no text of the row; every cell counts, the order of rows does not."""
    schema = "a string, b string, n bigint, s struct<x: string, y: struct<z: date>>, e array<struct<p: string, q: string>>, m map<string, bigint>"
    rows = [("u", None, i, ("x", (None,)), [("p", None)], {"k": 1, "j": i}) for i in range(300)] + [(None, None, None, None, None, None)]

    def found(rows):
        return publishing.manifest({"t": spark.createDataFrame(rows, schema).repartition(3)}).head()["digest"]

    first = found(rows)
    assert first.startswith("xxh64:") and found(rows[::-1]) == first
    others = [(None, "u", 0, ("x", (None,)), [("p", None)], {"k": 1, "j": 0}), ("u", None, 0, (None, (None,)), [("p", None)], {"k": 1, "j": 0}),
              ("u", None, 0, ("x", None), [("p", None)], {"k": 1, "j": 0}), ("u", None, 0, ("x", (None,)), [(None, "p")], {"k": 1, "j": 0}),
              ("u", None, 0, ("x", (None,)), [], {"k": 1, "j": 0}), ("u", None, 0, ("x", (None,)), None, {"k": 1, "j": 0}),
              ("u", None, 0, ("x", (None,)), [("p", None)], {"k": 1, "j": 5}), ("u", "", 0, ("x", (None,)), [("p", None)], {"k": 1, "j": 0})]
    assert len({first, *[found([other, *rows[1:]]) for other in others]}) == len(others) + 1
    assert found([]) == "xxh64:0"
    text = spark.createDataFrame([(f"t{i}", i) for i in range(500)], "w string, n bigint")
    digest = sum(int(hashlib.md5(f"{i}\x1ft{i}".encode()).hexdigest()[:15], 16) for i in range(500))
    assert text.agg(publishing.digest_of(text)).head()[0] == str(digest)
    # A run published with digests of the former kind can still be verified.
    good, out = write(tmp_path / "good.csv", golden_records()), str(tmp_path / "out")
    import_csv(spark, good, out)
    run = publishing.current_run(spark, out)
    publishing.manifest(read_published(spark, out), publishing.digest_of).write.mode("overwrite").parquet(f"{run}/manifest")
    assert read_published(spark, out, verify=True)["invoices"].count() == 8


def test_manifest_comes_from_the_rows_as_written(spark, tmp_path, monkeypatch):
    """Publishing reads no table again for its manifest; empty tables, nested columns and maps have the entries that a reader finds."""
    good, nothing = write(tmp_path / "good.csv", golden_records()), write(tmp_path / "none.csv", [record("I1", amount="x")])

    def read_again(*_):
        raise AssertionError("the manifest reads the tables")

    for path, as_of in ((good, None), (nothing, "2024-01-31")):
        out = str(tmp_path / f"out-{as_of}")
        with monkeypatch.context() as during:
            during.setattr(publishing, "manifest", read_again)
            import_csv(spark, path, out, as_of)
        given = spark.read.parquet(f"{publishing.current_run(spark, out)}/manifest")
        found = publishing.manifest(read_published(spark, out, verify=True))
        assert given.orderBy("table_name").collect() == found.orderBy("table_name").collect() and given.count() == len(publishing.PUBLISHED)


def test_capped_answers_fail_as_a_whole(spark):
    rows = spark.range(0, 1000, 1, 8)
    assert serving.capped(rows.limit(100)).count() == 100
    assert [r["id"] for r in serving.capped(rows.orderBy(F.desc("id")).limit(3), 3).collect()] == [999, 998, 997]
    assert serving.capped(rows.limit(0)).count() == 0
    for answer in (serving.capped(rows), serving.capped(rows.limit(101)), serving.capped(rows.orderBy("id"), 0)):
        with pytest.raises(Exception, match="ask for fewer"):
            answer.write.format("noop").mode("overwrite").save()


@pytest.fixture(scope="module")
def curated(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("curated")
    ledger = import_csv(spark, write(folder / "g.csv", golden_records()), str(folder / "out"))
    paths = {n: getattr(ledger, n).inputFiles()[0].rsplit("/", 1)[0] for n in ("invoices", "accounts")}
    return serving.isolated_session(spark, paths), ledger


def test_curated_answers(curated):
    session, ledger = curated
    sql = """WITH per_status AS (SELECT status, count(*) AS n, sum(amount_usd_cents) AS cents FROM invoices GROUP BY status),
             waiting AS (SELECT n, cents FROM per_status WHERE status IN ('pending', 'failed'))
             SELECT sum(w.n) AS invoices, sum(w.cents) AS exposure, (SELECT cents FROM per_status WHERE status = 'refunded') AS refunds FROM waiting w"""
    assert serving.bounded_rows(serving.curated_query(session, sql)) == [(2, 24700, -4900)]
    sql = "SELECT strftime('%Y-%m', invoice_date) AS m, count(*) AS n FROM invoices GROUP BY 1 ORDER BY 1"
    assert serving.bounded_rows(serving.curated_query(session, sql)) == [("2024-01", 6), ("2024-02", 1), ("2024-03", 1)]
    evidence = ledger.report.select("as_of", "accepted_invoices")
    got = serving.answer(serving.curated_query(session, "SELECT count(*) AS n FROM accounts"), evidence)
    assert got.rows == [(6,)] and got.coverage["accepted_invoices"] == 8


@pytest.mark.parametrize(
    "sql",
    [
        "WITH reflect AS (SELECT 1 AS a) SELECT reflect('java.lang.Math', 'abs', -5) AS r FROM reflect",
        "SELECT r'\\', java_method('java.lang.Math', 'abs', -7) AS x", "SELECT current_user", "SELECT current_catalog AS c",
        "SELECT * FROM default.invoices", "SELECT * FROM raw_ledger", "SELECT * FROM csv.`/etc/hosts`", "SELECT * FROM range(3)",
        "SELECT (WITH t AS (SELECT 1 AS a) SELECT max(a) FROM t) AS m FROM t", "SELECT * FROM IDENTIFIER('invoices')",
        "TRUNCATE TABLE accounts", "SET spark.sql.ansi.enabled=false", "CACHE TABLE invoices", "EXPLAIN SELECT 1", "SHOW TABLES",
        "INSERT INTO accounts SELECT * FROM accounts", "SELECT contact_email FROM invoices", "SELECT 1; SELECT 2", " ",
        "SELECT '" + "long text " * 1300 + "' AS t", "SELECT transform(array(1), x -> x) AS y", "SELECT total(seats) FROM accounts", "SELECT version()",
        "WITH RECURSIVE chain(account_id, step) AS (SELECT account_id, 0 FROM accounts UNION ALL "
        "SELECT a.account_id, step + 1 FROM chain c JOIN accounts a ON a.account_id > c.account_id) SELECT max(step) AS longest FROM chain",
    ],
)
def test_rejected_statements(curated, sql):
    with pytest.raises(serving.AnswerError):
        serving.curated_query(curated[0], sql).collect()


def test_too_many_rows_is_an_error(curated):
    df = serving.curated_query(curated[0], "SELECT invoice_id FROM invoices")
    assert len(serving.bounded_rows(df, 8)) == 8
    with pytest.raises(serving.AnswerError):
        serving.bounded_rows(df, 2)


def test_display(spark):
    df = spark.createDataFrame(
        [(1234567.5, -49, 33.333, 1234567, 1234.25, "a\x1b[2J‮", None)],
        "a_usd double, b_usd_cents bigint, c_pct double, n int, x double, t string, u string",
    )
    assert tuple(serving.display(df).head()) == (
        "$1,234,567.50", "-49 cents", "33.33%", "1,234,567", "1,234.25", "a\\u001b[2J\\u202e", "Unknown",
    )
    large = spark.createDataFrame([(12345678.5, 0.0001, 1234567892.5)], "a double, b double, c_usd_cents double")
    assert tuple(serving.display(large).head()) == ("12,345,678.5", "0.0001", "1,234,567,892.5 cents")
    assert serving.heading("net_revenue_usd") == "Net Revenue USD" and serving.heading("churn_pct") == "Churn %"


def test_numbers_in_paths_compare_by_value(spark):
    names = ["a/part-100000.csv", "a/part-99999.csv", "a/part-00002.csv", "b/x", "a/part-00010.csv"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r[0] for r in df.orderBy(ledger_csv.natural_order(F.col("path"))).collect()]
    assert got == ["a/part-00002.csv", "a/part-00010.csv", "a/part-99999.csv", "a/part-100000.csv", "b/x"]


@pytest.mark.parametrize("column", LEDGER_COLUMNS)
def test_null_counts_as_blank(spark, make_raw, column):
    from ledgerwise.operators.normalize import normalize

    blank = make_raw([record("I1") | {column: ""}, record("I2")])
    null = blank.withColumn(column, F.when(F.col(column) != "", F.col(column)))
    assert normalize(null).collect() == normalize(blank).collect()
