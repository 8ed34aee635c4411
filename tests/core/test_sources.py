"""Workbooks: layouts of sheets, and tables written and read back."""

import os
import time

import pytest

from ledgerline.sources import ingest, xlsx


def test_layouts_of_header_rows():
    fn = {"C": "IDKH", "G": "LỆNH GỐC NGÂN HÀNG"}
    assert ingest.detect(fn) == ("confirmed", {"customer_id": "C", "raw": "G", "date": "A", "customer_name": "D", "amount": "E", "payer": "H"})
    kind, roles = ingest.detect({"B": "Số tham chiếu", "C": "x", "I": "Mô tả"})
    assert kind == "raw" and roles["raw"] == "I" and roles["reference"] == "B"
    assert ingest.detect({"A": "Mô tả", "B": "Mô tả", "C": "Ngày"}) is None and ingest.detect({"A": "x"}) is None


def test_headers_over_two_lines_and_none():
    two = [(3, {"A": "Ngày", "B": "Mô"}), (4, {"A": "giao dịch", "B": "tả", "C": "Ghi có"}), (5, {"A": "1", "B": "x"})]
    assert ingest.sheet_layout("s", two) == (4, "raw", {"raw": "B", "amount": "C", "date": "A"})
    apart = [(3, two[0][1]), (5, two[1][1])]
    assert ingest.sheet_layout("s", apart) is None
    bare = [(1, {"A": "Sao ke"}), (2, {"C": "FT1", "E": "13/09/2026", "M": "TT tien nuoc", "T": "1000"})]
    assert ingest.sheet_layout("Sacombank", bare) == (0, "raw_unverified", ingest.HEADERLESS)
    assert ingest.sheet_layout("other", bare) is None and ingest.sheet_layout("Sacombank", [(2, bare[1][1] | {"E": "later"})]) is None


def test_layouts_of_many_workbooks(spark, tmp_path):
    xlsx.register(spark)
    for i in range(3):
        xlsx.write_workbook(str(tmp_path / f"{i}.xlsx"), {"BIDV": [["", "", "IDKH", "", "", "", "EBL"], ["", "", "001545", "", "", "", "TT"]], "notes": [["x"]]})
    got = ingest.layouts(spark.read.format("xlsx").option("path", str(tmp_path)).load()).collect()
    assert sorted((os.path.basename(r.file), r.sheet, r.header_row, r.layout) for r in got) == [(f"{i}.xlsx", "BIDV", 1, "confirmed") for i in range(3)]
    assert got[0].roles["payer"] == "H"


def test_written_workbooks(spark, tmp_path):
    xlsx.register(spark)
    rows = [(f"00{i}", "=1+1" if i == 1 else f"a\x01<&{i}", i * 1.5) for i in range(25)] + [(None, "", None)]
    df = spark.createDataFrame(rows, "id string, text string, value double").repartition(3)
    df.write.format("xlsx").option("path", str(tmp_path / "out")).option("rowsPerSheet", "5").mode("append").save()
    files = sorted(os.listdir(tmp_path / "out"))
    assert [f.rsplit("-", 1)[0] for f in files] == [f"part-0000{i}" for i in range(3)] and len({f.rsplit("-", 1)[1] for f in files}) == 1
    back = spark.read.format("xlsx").option("path", str(tmp_path / "out")).load().collect()
    assert max(r.row for r in back) <= 5
    cells = {(r.cells.get("A"), r.cells.get("B"), r.cells.get("C")) for r in back if r.row > 1 and r.cells}
    assert ("001", "=1+1", "1.5") in cells and ("0010", "a<&10", "15.0") in {(a, b, f"{float(c)}") for a, b, c in cells} and len(cells) == 25


def _written(spark, path):
    from ledgerline.sources import xlsx

    xlsx.register(spark)
    cells = spark.read.format("xlsx").option("path", path).load().where("row > 1")
    return sorted(int(r[0]) for r in cells.selectExpr("cells['A']").collect())


def _still(look, seconds: float = 5, most: float = 60) -> None:
    """Waits until nothing has changed for some seconds: a worker may outlive the job that it was part of by a little (Spark
    gives it two seconds), and its attempt is young as long as it is written."""
    end, since, seen = time.monotonic() + most, time.monotonic(), None
    while time.monotonic() < min(end, since + seconds):
        try:
            now = look()
        except FileNotFoundError:  # removed between listing and looking
            now = None
        if now is None or now != seen:
            since, seen = time.monotonic(), now
        time.sleep(0.2)


def test_workbooks_append_overwrite_and_lost_attempts(spark, tmp_path):
    from ledgerline.sources import xlsx

    xlsx.register(spark)
    path = str(tmp_path / "books")
    save = lambda lo, hi, mode, tasks=2: spark.range(lo, hi, 1, tasks).write.format("xlsx").option("path", path).mode(mode).save()
    save(0, 5, "append")
    save(200, 205, "append")
    assert _written(spark, path) == [*range(5), *range(200, 205)]
    (tmp_path / "books" / "_dead-1.part").write_bytes(b"x")  # of a write that never ended
    save(300, 302, "append", 1)
    assert (tmp_path / "books" / "_dead-1.part").exists()
    save(7, 10, "overwrite", 1)
    assert _written(spark, path) == [7, 8, 9] and not list(tmp_path.glob("books/_*.part"))

    def fails(batch):
        for rows in batch:
            if (rows["id"] == 49).any():
                raise ValueError("bad row")
            yield rows

    before = sorted(p.name for p in tmp_path.glob("books/*.xlsx"))
    with pytest.raises(Exception, match="bad row"):
        spark.range(0, 50, 1, 4).mapInPandas(fails, "id long").write.format("xlsx").option("path", path).mode("append").save()
    # tasks that are killed leave their attempts behind; no reader sees them, and they go later
    assert sorted(p.name for p in tmp_path.glob("books/*.xlsx")) == before and _written(spark, path) == [7, 8, 9]
    _still(lambda: sorted((p.name, p.stat().st_size) for p in tmp_path.glob("books/_*.part")))
    for p in tmp_path.glob("books/_*.part"):
        os.utime(p, (0, 0))
    (tmp_path / "books" / "_live-1.part").write_bytes(b"x")
    save(20, 21, "append", 1)
    assert [p.name for p in tmp_path.glob("books/_*.part")] == ["_live-1.part"] and _written(spark, path) == [7, 8, 9, 20]


def test_shared_strings_are_spilled(tmp_path):
    """Two million shared strings are read within 100 MB; a list of them would need some 200 MB."""
    import resource
    import subprocess
    import sys
    import zipfile

    from ledgerline.sources import xlsx

    path, n = str(tmp_path / "big.xlsx"), 2_000_000
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        xlsx._frame(z, ["one"])
        with z.open("xl/sharedStrings.xml", "w") as f:
            f.write(f'<sst xmlns="{xlsx._MAIN[1:-1]}">'.encode())
            for k in range(0, n, 10_000):
                f.write("".join(f"<si><t>a string that is not short at all, number {i}</t></si>" for i in range(k, k + 10_000)).encode())
            f.write(b"</sst>")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{xlsx._MAIN[1:-1]}"><sheetData>'.encode())
            for k in range(1, 1001):
                f.write(f'<row r="{k}"><c r="A{k}" t="s"><v>{(k * 7919) % n}</v></c></row>'.encode())
            f.write(b"</sheetData></worksheet>")
    code = f"""
import resource, sys
sys.path.insert(0, {repr(sys.path[0])})
from ledgerline.sources import xlsx
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = [c["A"].rsplit(" ", 1)[1] for _, c in xlsx.rows({path!r}, "xl/worksheets/sheet1.xml")]
assert found == [str((k * 7919) % {n}) for k in range(1, 1001)]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert grown < 100_000 and resource.getpagesize()
