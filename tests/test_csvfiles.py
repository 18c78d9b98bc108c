from __future__ import annotations

import csv
import hashlib
import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitlab.params import ParameterError
from pitlab.sources import bars as b
from pitlab.sources import csvfiles
from pitlab.sources import universe as u

COLUMNS = ["a", "b", "c"]


def drawn_file(path, seed, rows=300):
    """A file with quoted breaks, doubled quotes, blank lines, short rows and wide letters. Returns its records."""
    drawn = random.Random(seed)
    cell = lambda: drawn.choice(["x", "", "a,b", 'say ""hi""', "two\nlines", "\n\n", "é€𝄞" * drawn.randint(1, 9), "1" * drawn.randint(1, 60)])
    lines = ["﻿" * (seed % 2) + "B, note ,A,c"]
    for _ in range(rows):
        row = [f'"{v}"' if set(v) & set(',\n"') or drawn.random() < 0.2 else v for v in (cell() for _ in range(drawn.choice([4, 4, 4, 5, 2])))]
        lines.append(",".join(row))
        lines += [""] * (drawn.random() < 0.1)
    path.write_text("\n".join(lines) + drawn.choice(["", "\n"]), encoding="utf-8")
    with path.open(newline="", encoding="utf-8-sig") as file:
        read = list(csv.reader(file))
    names = [n.strip().lower() for n in read[0]]
    at = [names.index(c) for c in COLUMNS]
    return [tuple((row[k] or None) if k < len(row) else None for k in at) for row in read[1:] if len(row) > 1 or (row and row[0].strip())]


@pytest.mark.parametrize("width", [7, 64, 1000, 1 << 20])
def test_ranges_give_the_records_of_one_reader(spark, tmp_path, width):
    want = {f"f{k}.csv": drawn_file(tmp_path / f"f{k}.csv", k, 300 if width > 7 else 12) for k in range(3)}
    read = csvfiles.rows(spark, str(tmp_path), COLUMNS, range_bytes=width)
    assert read.rdd.getNumPartitions() >= sum((tmp_path / f).stat().st_size for f in want) // max(width, 1) // 3
    got = {f: [] for f in want}
    for r in sorted(read.collect(), key=lambda r: (r["source"], r["row_number"])):
        got[r["source"].rsplit("/", 1)[1]].append(tuple(r[c] for c in COLUMNS))
    assert got == want


def test_lines_are_counted_over_ranges(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a\n"1\n2"\n\n3\n' + "".join(f"{k}\n" for k in range(100)))
    found = {r["a"]: r["row_number"] for r in csvfiles.rows(spark, str(tmp_path / "x.csv"), ["a"], range_bytes=16).collect()}
    assert found["1\n2"] == 2 and found["99"] == 105


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"two\n3,4\n' * 20 + '5,"')
    for width in (16, 1 << 20):
        with pytest.raises(Exception, match="not closed"):
            csvfiles.rows(spark, str(tmp_path), ["a", "b"], range_bytes=width).collect()


def test_files_of_other_symbols_are_not_opened(spark, tmp_path):
    head = "symbol,timestamp,open,high,low,close,adjusted_close,volume\n"
    (tmp_path / "IBM.csv").write_text(head + "ibm,2020-01-02T14:30:00Z,1,1,1,1,1,1\nOTHER,2020-01-02T14:30:00Z,1,1,1,1,1,1\n")
    (tmp_path / "t_daily.CSV").write_text(head + "T,2020-01-02T14:30:00Z,1,1,1,1,1,1\n")
    (tmp_path / "BROKEN.csv").write_bytes(head.encode() + b'x,"\xff')
    assert [r["symbol"] for r in b.read_symbol_files(spark, str(tmp_path), "ibm", " t ").orderBy("symbol").collect()] == ["T", "ibm"]
    with pytest.raises(Exception):
        b.read_symbol_files(spark, str(tmp_path), "BROKEN").collect()
    with pytest.raises(ParameterError, match="MSFT, NONE"):
        b.read_symbol_files(spark, str(tmp_path), "NONE", "IBM", "MSFT")
    plan = csvfiles.rows(spark, str(tmp_path), b.BAR_TEXT_COLUMNS).filter(F.col("file_symbol") == "IBM")
    assert "Filter (" not in plan._jdf.queryExecution().executedPlan().toString()  # the source answers it alone
    assert csvfiles.heads(spark, str(tmp_path)).count() == 3


def test_symbol_files_are_written_together_or_not_at_all(spark, tmp_path, make_bars):
    bars = make_bars({"B": [(1, 1.5, 5, None), (0, 1, 5, 1)], "A": [(1, 2, 6, 2), (0, 3, 7, 3)]})
    folder = tmp_path / "out"
    b.write_symbol_files(bars, str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["A.csv", "B.csv"]
    read = b.read_bars_csv(spark, str(folder))[0]
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, bars.collect()))
    assert [r["timestamp"] for r in b.read_symbol_files(spark, str(folder), "B").orderBy("row_number").collect()] == sorted(["2020-01-01T14:30:00Z", "2020-01-02T14:30:00Z"])
    with pytest.raises(Exception, match="cannot name a file"):
        b.write_symbol_files(bars.withColumn("symbol", F.when(F.col("symbol") == "A", "../A").otherwise("C")), str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["A.csv", "B.csv"]
    b.write_symbol_files(bars.filter("symbol = 'A'"), str(folder))
    assert sorted(p.name for p in folder.iterdir()) == ["A.csv"]


def test_quoted_breaks_in_bar_files(spark, tmp_path):
    text = 'note,symbol,timestamp,open,high,low,close,adjusted_close,volume\n"a\nb",IBM,2020-01-02T14:30:00Z,1,1,1,1,1,1\n"c",IBM,2020-01-03T14:30:00Z,1,1,1,1,1,-1\n'
    (tmp_path / "x.csv").write_text(text)
    bars, rejects, _ = b.read_bars_csv(spark, str(tmp_path), start=date(2020, 1, 1))
    assert bars.count() == 1 and rejects.first()["row_number"] == 4


def test_memberships_carry_the_version_of_their_own_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,tickers\n2020-01-01,"A,B"\n2020-03-01,A\n')
    (tmp_path / "b.csv").write_text("date,tickers\n2020-02-01,A\n2020-03-01,C\n")
    version = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    got = {(r["symbol"], str(r["start_date"])): r["source_version"] for r in u.read_memberships(spark, str(tmp_path)).collect()}
    assert got == {("A", "2020-01-01"): version["a.csv"], ("B", "2020-01-01"): version["a.csv"], ("C", "2020-03-01"): version["b.csv"]}
    assert {r["source_version"]: r["length"] for r in u.source_version(spark, str(tmp_path)).collect()} == {version[p.name]: p.stat().st_size for p in tmp_path.iterdir()}


def test_large_snapshot_files(spark, tmp_path):
    days = [date(2000, 1, 1).fromordinal(730_000 + k) for k in range(200)]
    body = "".join(f'{d:%m/%d/%Y},"{chr(10).join(f"T{k % 7}, S{k % 11}," for k in range(n % 5, 9))}"\n'.replace("\n", "\r\n") for n, d in enumerate(days))
    (tmp_path / "s.csv").write_text("date,tickers\r\n" + body)
    one = u.read_snapshots(spark, str(tmp_path))
    many = u.read_snapshots(spark, str(tmp_path), range_bytes=100)
    assert {r[0] for r in many.select("symbol").distinct().collect()} == {f"T{k}" for k in range(7)} | {f"S{k}" for k in range(9)}
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    (tmp_path / "s.csv").write_text("date,tickers\n" + '01/02/2020,"A,B\n' * 30 + '01/03/2020,"A')
    with pytest.raises(Exception, match="not closed"):
        u.read_snapshots(spark, str(tmp_path), range_bytes=100).collect()


def test_plain_lines_are_parsed_in_blocks(tmp_path, monkeypatch):
    lines = [f"{k},{'' if k % 7 == 0 else 'é' * (k % 5)}, x{k} ,{k}" for k in range(2000)]
    odd = {700: "", 1200: '"two', 1201: 'lines",b,c,d', 1500: "short,row", 1700: "1,2,3,4,5"}
    text = ["B, note ,A,c", *(odd.get(k, line) for k, line in enumerate(lines))]

    def cells(name, content, width):
        (tmp_path / name).write_text("\n".join(content) + "\n" * (width % 2), encoding="utf-8")
        size = (tmp_path / name).stat().st_size
        reader = csvfiles.CsvReader({"paths": json.dumps([str(tmp_path / name)]), "columns": json.dumps(["a", "b", "c"]), "range_bytes": str(width)})
        breaks = (tmp_path / name).read_bytes()
        reader.marks = {str(tmp_path / name): [[bool(breaks[:at].count(b'"') % 2), 1 + breaks[:at].count(b"\n")] for at in range(0, size, width)]}
        return [tuple(row.values()) for part in reader.partitions() for made in reader.read(part) for row in made.to_pylist()]

    fast = {(name, width): cells(name, content, width) for name, content in (("plain.csv", text[:600]), ("odd.csv", text)) for width in (999, 1 << 20)}
    with monkeypatch.context() as only:
        only.setattr(csvfiles, "_plain_block", lambda *_: None)
        for (name, width), got in fast.items():
            assert got == cells(name, text[:600] if name == "plain.csv" else text, width) and len(got) > 500, (name, width)
    # Lines without quotes do not go through Python's reader.
    monkeypatch.setattr(csvfiles, "_records", lambda *_: iter(()))
    assert cells("plain.csv", text[:600], 1 << 20) == fast["plain.csv", 1 << 20]


@pytest.mark.parametrize("content", ["a,b\n1,2\n\r\n3,4\r\n", "a,b\n1," + "x" * 200_000 + "\n", "a,b\n1,\xff\n", "a\n1\n \n2\n", "a,b\n", "a,b", "", "a,b\n1,2"])
def test_plain_blocks_leave_other_lines_to_the_reader(tmp_path, monkeypatch, content):
    path = tmp_path / "x.csv"
    path.write_bytes(content.encode("latin-1"))
    reader = csvfiles.CsvReader({"paths": json.dumps([str(path)]), "columns": json.dumps(["a"])})

    def outcome():
        try:
            return [row for part in reader.partitions() for made in reader.read(part) for row in made.to_pylist()]
        except Exception as problem:  # noqa: BLE001
            return type(problem), str(problem)

    fast = outcome()
    monkeypatch.setattr(csvfiles, "_plain_block", lambda *_: None)
    assert fast == outcome()
