import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickweave.functions.cells import parse_instant, parse_price, parse_size, tidy, unquote
from tickweave.functions.times import local_date
from tickweave.operators.audit import (
    assign_file_dates, audit_file_dates, audit_summary, coverage, date_spans, missing_by_month,
    row_numbers,
)
from tickweave.operators.trading_calendar import (
    easter_sunday, trading_calendar, trading_day_count, with_prev_trading_day,
)
from tickweave.plans.consolidation import active_once_from_files, consolidated_from_files
from tickweave.sources.daily_files import (
    clean_trades, compressed, damage, file_headers, files_for_days, files_near, header_of, list_files, read_cells, security_names,
    sources_with, unreadable,
)
from tickweave.sources.tables import read_parquet, write_parquet, write_report

HEAD_A = '"isin";"displayName";"tradeTime";"price";"size";"quotation";"currency";"TVTIC";"mic";"publishedTime";"flags"'
HEAD_B = "orderId;size;flags;tradeTime;price;isin;quotation;currency;mic;publishedTime"


@pytest.fixture(scope="module")
def calendar(spark):
    return trading_calendar(spark, dt.date(2023, 1, 1), dt.date(2026, 12, 31)).cache()


def line_a(isin="DE1", name="Foo AG", time="2024-04-03T08:00:00.123456Z", price="1,50", size="100", tid="t1",
           flags="ALGO;", published="2024-04-03T08:00:00.2Z"):
    cells = [isin, name, time, price, size, "MONE", "EUR", tid, "LS", published, flags]
    return ";".join(f'"{c}"' for c in cells)


def write(folder, name, *lines):
    (folder / name).write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")


def test_easter(spark):
    years = spark.createDataFrame([(y,) for y in [2020, 2023, 2024, 2025, 2026, 2049, 2076]], "y int")
    got = [str(r[0]) for r in years.select(easter_sunday(F.col("y"))).collect()]
    assert got == ["2020-04-12", "2023-04-09", "2024-03-31", "2025-04-20", "2026-04-05", "2049-04-18", "2076-04-19"]


def test_calendar(spark, calendar):
    days = {str(r["d"]): r for r in calendar.collect()}
    assert days["2024-03-29"]["holiday"] == "Karfreitag" and days["2024-04-01"]["holiday"] == "Ostermontag"
    assert days["2024-05-09"]["holiday"] == "Christi Himmelfahrt" and days["2024-05-20"]["holiday"] == "Pfingstmontag"
    assert str(days["2024-04-02"]["prev_trading_day"]) == "2024-03-28"
    assert str(days["2023-01-01"]["prev_trading_day"]) == "2022-12-30"
    assert str(days["2025-12-29"]["prev_trading_day"]) == "2025-12-24"
    # 262 weekdays less nine holidays on weekdays.
    assert trading_day_count(calendar, dt.date(2024, 1, 1), dt.date(2024, 12, 31)) == 253
    df = spark.createDataFrame([(dt.date(2024, 1, 2),), (None,)], "day date")
    got = {r["day"]: r["prev_trading_day"] for r in with_prev_trading_day(df, calendar, "day").collect()}
    assert got == {dt.date(2024, 1, 2): dt.date(2023, 12, 29), None: None}


def test_local_day_ignores_the_session_zone(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-03-31 22:30:00' AS a, timestamp_micros(1711924200000000) AS b"
    )
    for zone in ["UTC", "America/New_York", "Asia/Tokyo"]:
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            row = df.select(
                local_date(df, "a").alias("a"), local_date(df, "b").alias("b"),
                local_date(df, "a", None).alias("u"),
            ).first()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [str(x) for x in row] == ["2024-04-01", "2024-04-01", "2024-03-31"]


def test_cells(spark):
    df = spark.createDataFrame(
        [("2024-04-03T08:00:00.1Z", "1,5", "100", '"x"', " \t a b\n"), ("2024-04-03 08:00:00", "1.234,56", "-", "x", None),
         ("2024-04-03", "2.5", "1.0", '""x"', ""), ("garbage", "1.5d", "7", None, "ok")],
        "t string, p string, s string, q string, w string",
    )
    rows = df.select(
        F.unix_micros(parse_instant(F.col("t"))), parse_price(F.col("p")), parse_size(F.col("s")),
        unquote(F.col("q")), tidy(F.col("w")),
    ).collect()
    base = 1712131200000000
    assert [r[0] for r in rows] == [base + 100000, base, None, None]
    assert [r[1] for r in rows] == [1.5, None, 2.5, None]
    assert [r[2] for r in rows] == [100, None, None, 7]
    assert [r[3] for r in rows] == ["x", "x", "x", None]
    assert [r[4] for r in rows] == ["a b", "", "", "ok"]


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    write(
        folder, "trades_20240404.csv", HEAD_A, line_a(), line_a(tid="t2", flags="ALGO;;AMND;", price="2,25"),
        line_a(name='Foo "bar" AG', tid="t3"), line_a(tid="t4", size="-"), line_a(tid="t5", time="soon"),
        line_a(tid="t6") + ';"surplus"', '"DE9";"short"', line_a(tid="t1", published="2024-04-03T09:00:00Z", price="3,0"),
    )
    write(
        folder, "trades_20240405.csv", HEAD_B,
        "t1;7;CANC;2024-04-04T08:00:00Z;1.5;DE1;MONE; EUR ;LS;2024-04-04T08:00:01Z".replace("CANC", '"CANC;"'),
        't9;8;"ALGO;";2024-04-04T08:00:02Z;"4,5";DE2;MONE;EUR;LS;2024-04-04T08:00:03Z',
    )
    write(folder, "trades_20240408.csv", HEAD_A)
    (folder / "trades_20240409.csv").write_text("")
    write(folder, "trades_2024xx10.csv", HEAD_A, line_a(tid="t20"))
    write(folder, "trades_20240411.csv", "isin;price", "DE1;1")
    write(folder, "trades_20240415.csv", HEAD_A, line_a(tid="t30", time="2024-04-12T08:00:00Z", name="New AG"),
          line_a(tid="t31", time="2024-04-11T08:00:00Z"), line_a(tid="t32", time="2024-04-12T09:00:00Z"))
    return str(folder)


def test_listing_and_choice(spark, landing, calendar):
    files = list_files(spark, landing, "trades_*.csv")
    dates = {r["source"]: r["file_date"] for r in files.collect()}
    assert len(dates) == 7 and dates["trades_2024xx10.csv"] is None
    assert dates["trades_20240404.csv"] == dt.date(2024, 4, 4)
    near = files_near(files, dt.date(2024, 4, 10), dt.date(2024, 4, 10))
    assert {r["source"][7:15] for r in near.collect()} == {"20240405", "20240408", "20240409", "20240411", "20240415", "2024xx10"}
    exact = files_for_days(files, calendar, dt.date(2024, 4, 4), dt.date(2024, 4, 5))
    assert {r["source"][7:15] for r in exact.collect()} == {"20240405", "20240408"}


def test_headers(spark, landing):
    got = header_of(spark, [f"{landing}/trades_20240405.csv", f"{landing}/trades_20240409.csv"])
    assert list(got.values()) == [tuple(HEAD_B.split(";")), ()]


def test_quoted_read_binds_by_name(spark, landing):
    files = list_files(spark, landing, "trades_*.csv")
    rows = clean_trades(read_cells(spark, files)).collect()
    by = {(r["source"][7:15], r["TVTIC"], r["price"]): r for r in rows}
    assert len(rows) == len(by) == 11
    assert by["20240404", "t2", 2.25]["flags"] == "ALGO;;AMND;"
    assert by["20240404", "t6", 1.5]["flags"] == "ALGO;"
    cancel = by["20240405", "t1", 1.5]
    assert (cancel["isin"], cancel["size"], cancel["flags"], cancel["currency"]) == ("DE1", 7, "CANC;", "EUR")
    assert by["20240405", "t9", 4.5]["size"] == 8
    assert "displayName" not in rows[0].asDict()


def test_unquoted_read_cuts_at_the_separator(spark, landing):
    files = list_files(spark, landing, "trades_20240404.csv")
    rows = clean_trades(read_cells(spark, files, quoting=False), quoting=False).collect()
    by = {r["TVTIC"]: r for r in rows if r["price"] != 3.0}
    assert by["t2"]["flags"] == "ALGO" and by["t3"]["price"] == 1.5


def test_column_choice_prunes_the_scan(spark, landing):
    files = list_files(spark, landing, "trades_*.csv")
    cells = read_cells(spark, files, ["tradeTime"])
    assert [c for c in cells.columns if c not in ("source", "part", "block", "pos")] == ["tradeTime"]
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tradeTime:string>" in plan


def test_names(spark, landing):
    files = list_files(spark, landing, "trades_*.csv")
    named = security_names(read_cells(spark, files, ["isin", "displayName"]), files)
    got = {r["isin"]: r["displayName"] for r in named.collect()}
    assert got["DE1"] == "Foo AG" and set(got) == {"DE1", "DE9"}


def test_audit(spark, landing, calendar):
    files = list_files(spark, landing, "trades_*.csv")
    cells = read_cells(spark, files, ["tradeTime"])
    headed = sources_with(spark, files, "tradeTime")
    # An empty file has no header either.
    assert headed.count() == 5
    audit = audit_file_dates(files, cells, calendar, with_column=headed)
    got = {r["source"][7:15]: r for r in audit.collect()}
    assert got["20240405"]["matches"] and got["20240405"]["issue"] is None
    assert got["20240415"]["max_date_first_row"] == 0 and got["20240415"]["matches"]
    assert got["20240404"]["issue"] == "date does not match file name"
    assert got["20240408"]["issue"] == got["20240409"]["issue"] == "file is empty"
    assert got["20240411"]["issue"] == "time column not found"
    assert got["2024xx10"]["issue"] == "invalid date in file name"
    assert tuple(audit_summary(audit).first()) == (7, 2, 5)


def test_positions_hold_over_file_splits(spark, tmp_path):
    lines = [line_a(tid=f"t{i}", time=f"2024-04-0{2 if i < 300 else 3}T08:00:00Z") for i in range(500)]
    write(tmp_path, "trades_20240404.csv", HEAD_A, *lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cells = read_cells(spark, list_files(spark, str(tmp_path)), ["tradeTime", "TVTIC"])
        assert cells.select("block").distinct().count() > 5
        row = date_spans(cells).first()
        assert (row["rows"], row["max_date_first_row"]) == (500, 300)
        ordered = cells.orderBy("part", "block", "pos").select("TVTIC").collect()
        assert [r[0] for r in ordered] == [f"t{i}" for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers(spark, small_bins):
    df = spark.createDataFrame([("f", i * 3) for i in range(30)] + [("g", 1)], "source string, at long")
    got = row_numbers(df, "source", "at", spread=small_bins).collect()
    assert sorted((r["source"], r["at"], r["row_num"]) for r in got) == [("f", i * 3, i) for i in range(30)] + [("g", 1, 0)]


def test_majority_and_coverage(spark, landing, calendar):
    files = list_files(spark, landing, "trades_*.csv")
    cells = read_cells(spark, files, ["tradeTime"])
    every = assign_file_dates(files, cells, calendar, min_bytes=1)
    assert {r["issue"] for r in every.collect()} == {None, "no dates", "invalid date in file name", "file too small"}
    found = every.where("issue is null")
    got = {r["source"][7:15]: (str(r["majority_date"]), r["matches"]) for r in found.collect()}
    assert got == {"20240404": ("2024-04-03", True), "20240405": ("2024-04-04", True), "20240415": ("2024-04-12", True)}
    small = assign_file_dates(files, cells, calendar).where("file_date is not null").collect()
    assert len(small) == 6 and {r["issue"] for r in small} == {"file too small"}
    april = calendar.where("d between date'2024-04-01' and date'2024-04-14'")
    extra = spark.createDataFrame(
        [(dt.date(2024, 4, 1), "e1"), (dt.date(2024, 4, 6), "e2"), (dt.date(2024, 4, 6), "e3")], "day date, source string"
    )
    days = found.select(F.col("majority_date").alias("day"), "source").union(extra)
    report = coverage(days, april, "day", "source")
    rows = {str(r["d"]): (r["reason"], r["source"]) for r in report.where("kind <> 'missing'").collect()}
    assert rows == {"2024-04-01": ("Holiday (Ostermontag)", "e1"), "2024-04-06": ("Weekend", "e3")}
    assert [tuple(r) for r in missing_by_month(report).collect()] == [("2024-04", "02, 05, 08, 09, 10, 11")]


def test_majority_tie_takes_the_earliest(spark, calendar):
    files = spark.createDataFrame([("s", "s", "s", 9, dt.date(2024, 4, 4))], "path string, part string, source string, file_size long, file_date date")
    cells = spark.createDataFrame(
        [("s", "s", 0, i, t) for i, t in enumerate(["2024-04-03", "2024-04-02", "2024-04-02", "2024-04-03", None])],
        "source string, part string, block long, pos long, tradeTime string",
    )
    row = assign_file_dates(files, cells, calendar, min_bytes=9, sample_rows=4).first()
    assert str(row["majority_date"]) == "2024-04-02" and row["matches"] is False


def test_files_to_consolidated(spark, landing):
    got = consolidated_from_files(
        spark, landing, dt.date(2024, 4, 3), dt.date(2024, 4, 4), "trades_*.csv", quoting=True, min_volume=1.0
    )
    rows = {(r["isin"], r["price"], r["size"], r["flags"]) for r in got.collect()}
    # Three trades of one second merge; the newest t1 has its own price; the
    # cancellation alone nets below zero.
    assert rows == {("DE1", 1.5, 300, "ALGO;"), ("DE1", 2.25, 100, "ALGO;"), ("DE1", 3.0, 100, "ALGO;"), ("DE2", 4.5, 8, "ALGO;")}


def test_files_to_small_table(spark, landing):
    got = active_once_from_files(
        spark, landing, dt.date(2024, 4, 3), dt.date(2024, 4, 4), "trades_*.csv", min_count=1, min_volume=1.0
    )
    # Over all files t1 is the later cancellation, which nets below zero.
    rows = {(r["isin"], r["price"], r["total_size"]) for r in got.collect()}
    assert rows == {("DE1", 1.5, 200), ("DE1", 2.25, 100), ("DE2", 4.5, 8)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "day int, v string")
    write_parquet(df, str(tmp_path / "p"), "day", sort_by=("v",))
    back = read_parquet(spark, str(tmp_path / "p"))
    assert back.where("day = 1").count() == 2
    write_report(df.withColumnRenamed("v", "Model (F0.5)"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["day", "Model (F0.5)"]


def test_unreadable_and_compressed_files(spark, tmp_path, calendar):
    import gzip

    body = f"{HEAD_A}\n" + "".join(f"{line_a(tid=f't{i}')}\n" for i in range(50))
    (tmp_path / "trades_20240404.csv.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "trades_20240405.csv.gz").write_bytes(b"no gzip stream")
    write(tmp_path, "trades_20350101.csv", HEAD_A, line_a(time="garbage-date"))
    files = list_files(spark, str(tmp_path), "*.csv*")
    cells = read_cells(spark, files, ["tradeTime"])
    assert cells.where(F.col("source").contains("20240404")).count() == 50
    failed = unreadable(spark, files)
    assert [r["source"] for r in failed.collect()] == ["trades_20240405.csv.gz"]
    audit = audit_file_dates(files, cells, calendar, with_column=sources_with(spark, files, "tradeTime"), failed=failed)
    got = {r["source"][7:15]: (r["issue"], r["matches"]) for r in audit.collect()}
    assert got["20240404"] == (None, True)
    assert got["20240405"] == ("failed to read", False)
    assert got["20350101"] == ("day outside the calendar", False)


def test_damaged_file_is_not_cut_in_silence(spark, tmp_path):
    import gzip

    body = f"{HEAD_A}\n" + "".join(f"{line_a(tid=f't{i}')}\n" for i in range(20_000))
    (tmp_path / "trades_20240404.csv.gz").write_bytes(gzip.compress(body.encode())[:20_000])
    with pytest.raises(Exception):
        read_cells(spark, list_files(spark, str(tmp_path), "*.csv*"), ["tradeTime"]).count()


def test_damaged_files_are_named_and_the_others_read(spark, tmp_path, calendar):
    import gzip
    import hashlib

    def stream(n):
        ids = [hashlib.sha256(f"{n}/{i}".encode()).hexdigest() for i in range(3000)]
        return gzip.compress((f"{HEAD_A}\n" + "".join(f"{line_a(tid=i)}\n" for i in ids)).encode())

    for day in range(4, 10):
        (tmp_path / f"trades_2024040{day}.csv.gz").write_bytes(stream(day))
    cut, flipped = stream(5), bytearray(stream(8))
    flipped[len(flipped) // 2] ^= 0xFF
    (tmp_path / "trades_20240405.csv.gz").write_bytes(cut[: len(cut) * 3 // 4])
    (tmp_path / "trades_20240408.csv.gz").write_bytes(bytes(flipped))
    (tmp_path / "trades_20240410.csv.gz").write_bytes(b"")
    write(tmp_path, "trades_20240411.csv", HEAD_A, line_a(tid="plain"))
    files = list_files(spark, str(tmp_path), "*.csv*")
    headed = file_headers(spark, files, whole=True)
    failed = unreadable(spark, headed)
    bad = {"trades_20240405.csv.gz", "trades_20240408.csv.gz"}
    assert {r["source"] for r in failed.collect()} == bad
    cells = read_cells(spark, headed, ["TVTIC", "tradeTime"])
    counts = {r["source"]: r["count"] for r in cells.groupBy("source").count().collect()}
    assert counts == {f"trades_2024040{d}.csv.gz": 3000 for d in (4, 6, 7, 9)} | {"trades_20240411.csv": 1}
    audit = audit_file_dates(files, cells, calendar, with_column=sources_with(spark, headed, "tradeTime"), failed=failed)
    assert bad <= {r["source"] for r in audit.where("issue = 'failed to read'").collect()}
    assert damage(spark, []) == {} and compressed(spark, ["/a/b.csv", "/a/b.csv.gz"]) == ["/a/b.csv.gz"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        damage(spark, [str(tmp_path / "gone.csv.gz")])


def test_flags_with_separators_and_no_quotes(spark, tmp_path):
    one = "DE1;N;2024-04-03T08:00:00Z;1.5;10;MONE;EUR;{};LS;2024-04-03T08:00:01Z;{}"
    write(tmp_path, "trades_20240404.csv", HEAD_A, one.format("t1", "ALGO;;CANC;"), one.format("t2", "ALGO"),
          one.format("t3", '"ALGO;;CANC;"'), one.format("t4", '"ALGO;";surplus'))
    two = "{};7;{};2024-04-03T08:00:00Z;1.5;DE1;MONE;EUR;LS;2024-04-03T08:00:01Z"
    write(tmp_path, "trades_20240405.csv", HEAD_B, two.format("u1", "ALGO;;CANC;"), two.format("u2", "ALGO;"), two.format("u3", "ALGO"))
    files = list_files(spark, str(tmp_path))
    rows = {r["TVTIC"]: r for r in clean_trades(read_cells(spark, files)).collect()}
    assert {k: r["flags"] for k, r in rows.items()} == {
        "t1": "ALGO;;CANC;", "t2": "ALGO", "t3": "ALGO;;CANC;", "t4": "ALGO;", "u1": "ALGO;;CANC;", "u2": "ALGO;", "u3": "ALGO",
    }
    assert all(r["publishedTime"] is not None and r["price"] == 1.5 and r["isin"] == "DE1" for r in rows.values())
    plain = {r["TVTIC"]: r["flags"] for r in clean_trades(read_cells(spark, files, quoting=False), quoting=False).collect()}
    assert plain["t1"] == plain["u1"] == "ALGO;;CANC;" and plain["u2"] == "ALGO;"
    net = consolidated_from_files(spark, str(tmp_path), dt.date(2024, 4, 3), dt.date(2024, 4, 3), min_volume=1.0)
    # 10 and 10 bought, 10 and 10 cancelled; 7 and 7 bought, 7 cancelled: 7 are left.
    assert [(r["isin"], r["size"]) for r in net.collect()] == [("DE1", 7)]
