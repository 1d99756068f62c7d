"""Workbooks written here, inspected together and extracted."""

import datetime as dt
import json

import pytest

import gridloom
from gridloom import ReadPlan, read_plan_to_kwargs
from gridloom import __main__ as cli
from gridloom.errors import CorruptWorkbookError, EncryptedWorkbookError
from gridloom.options import BlockOverride, InspectionOptions, SheetOverride
from gridloom.plans.extraction import extract, guarded, inspect
from gridloom.sources import xlsx
from gridloom.sources.xlsx_writer import Formula, Sheet, workbook_bytes

BOOKS = {
    "offset": [Sheet("S", {1: ["Report"], 2: ["x"], 3: ["y"], 4: ["dept", "item", "month", "amount"], 5: ["A", "i1", 1, 100], 6: ["A", "i2", 1, 90], 7: ["A", "i3", 2, 80], 8: ["Subtotal", None, None, 270], 9: ["B", "i1", 1, 120], 10: ["B", "i2", 1, 110], 11: ["B", "i3", 2, 90], 12: ["Subtotal", None, None, 320], 13: ["Total", None, None, 590]})],
    "levels": [Sheet("S", {1: ["G1", None, "G2", None], 2: ["a", "b", "c", "d"], 3: [10, 20, 30, 40], 4: [11, 21, 31, 41], 5: [12, 22, 32, 42], 6: [13, 23, 33, 43]}, ["A1:B1", "C1:D1"])],
    "stacked": [Sheet("S", {1: ["n", "a", "b"], 2: ["x", 1, 2], 3: ["y", 3, 4], 4: ["z", 5, 6], 7: ["n", "a", "b", "t"], 8: ["x", 1, 2, "q"], 9: ["y", 3, 4, "r"], 10: ["z", 5, 6, "s"]})],
    "cover": [Sheet("C", {2: [None, "t"], 4: [None, None, None, None, "u"], 6: [None, None, "v"]}), Sheet("D", {1: ["n", "a", "t"], 2: ["x", 1, "q"], 3: ["y", 2, "r"]}, state="hidden")],
    "formulas": [Sheet("F", {1: ["n", "p", "q", "t"], 2: ["x", 10, 20, Formula("B2*C2")], 3: ["y", 1, 2, Formula("B3*C3")], 4: ["z", 3, 4, Formula("B4*C4")]})],
    "types": [Sheet("T", {1: ["id", "code", "when", "mix"], 2: [1, "007", dt.date(2020, 1, 2), 1], 3: [2, "008", dt.date(2020, 1, 3), "a"], 4: [3, "009", dt.date(2020, 1, 4), 2]})],
    "interior": [Sheet("S", {1: ["n", "a", "b"], 2: ["x", 1, 2], 3: ["y", 3, 4], 5: ["z", 5, 6], 6: ["w", 7, 8]})],
    "margin": [Sheet("S", {1: [None, None, "n", "a", "b"], 2: ["note", None, "x", 1, 2], 3: [None, None, "y", 3, 4], 4: [None, None, "z", 5, 6], 5: ["note", None, "Subtotal", 9, 12], 6: [None, None, "w", 1, 1]})],
    "merged": [Sheet("S", {1: ["H", None, "C"], 2: ["a", "b", 1], 3: ["c", "d", 2], 4: ["e", "f", 3], 5: ["g", "h", 4], 6: ["i", "j", 5], 7: [None, "k", 6]}, ["A1:B1", "A6:A7"])],
    "loose": [Sheet("S", {1: ["id", "amount", "when"], **{r: [r, r * 10 if r != 190 else "pending", dt.date(2020, 1, 1 + r % 28) if r != 150 else "soon"] for r in range(2, 202)}})],
    "inner": [Sheet("S", {1: [None, None, "G1", None, "G2"], 2: [None, None, "a", "b", "c"], **{r: [None, None, r, r + 1, r + 2] for r in range(3, 9)}, 12: ["x"], 13: ["y"], 14: ["z"]}, ["C1:D1"])],
    "large": [Sheet("L", {1: ["id", "name", "amount", "flag"], **{r: [r, f"n{r}", r * 2, r % 2] for r in range(2, 1202)}, 1202: ["Total", None, 9, None]})],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    for name, sheets in BOOKS.items():
        (d / f"{name}.xlsx").write_bytes(workbook_bytes(sheets))
    return d


@pytest.fixture(scope="module")
def found(spark, folder):
    i = inspect(spark, str(folder / "*.xlsx"))
    key = lambda r: (r["file"].rpartition("/")[2][:-5], r["sheet_idx"])
    blocks, columns = {}, {}
    for r in i.blocks.filter("is_table").orderBy("table_no").collect():
        blocks.setdefault(key(r), []).append(r)
    for r in i.columns.orderBy("col").collect():
        columns.setdefault((*key(r), r["band_no"]), []).append(r)
    return blocks, columns, {key(r): r for r in i.sheets.collect()}


def region(b):
    return b["header_row"], b["data_start"], b["data_end"], list(b["skip_rows"])


def test_regions(found):
    blocks = found[0]
    assert region(blocks[("offset", 0)][0]) == (4, 5, 11, [8, 12, 13])
    assert region(blocks[("interior", 0)][0]) == (1, 2, 6, [4])
    assert region(blocks[("large", 0)][0]) == (1, 2, 1201, [1202])
    assert [region(b) for b in blocks[("stacked", 0)]] == [(1, 2, 4, []), (7, 8, 10, [])]
    assert region(blocks[("levels", 0)][0])[:3] == (2, 3, 6) and blocks[("levels", 0)][0]["top_row"] == 1
    m = blocks[("margin", 0)][0]
    assert region(m) == (1, 2, 6, [5]) and (m["left_col"], m["right_col"]) == (3, 5)
    g = blocks[("merged", 0)][0]
    assert (g["data_start"], g["data_end"], g["clamped"]) == (2, 5, True)


def test_sheets(found):
    sheets = found[2]
    assert not sheets[("cover", 0)]["is_tabular"] and sheets[("cover", 1)]["is_tabular"]
    assert not sheets[("cover", 1)]["is_visible"] and sheets[("offset", 0)]["used_range"] == "A1:D13"


def test_columns(found):
    columns = found[1]
    assert [c["inferred_type"] for c in columns[("types", 0, 1)]] == ["number", "numeric_text", "date", "mixed"]
    assert [(c["has_formula"], c["read_hint"]) for c in columns[("formulas", 0, 1)]][3] == (True, "as_formula")


def test_extract_and_render(spark, folder):
    r = extract(spark, str(folder / "levels.xlsx"))
    t = r.tables[0]
    assert t.dataframe.columns == ["G1 / a", "G1 / b", "G2 / c", "G2 / d"]
    assert [sum(x) for x in zip(*t.dataframe.collect())] == [46, 86, 126, 166]
    d = json.loads(r.to_json())
    assert d["schema_version"] == "1.0" and d["sheets"][0]["tables"][0]["row_count"] == 4
    assert "2 more rows" in t.to_markdown(2)


def test_overrides(spark, folder):
    o = InspectionOptions([SheetOverride("S", blocks=[BlockOverride(8, header_row=None)])])
    r = extract(spark, str(folder / "stacked.xlsx"), o)
    assert [t.dataframe.columns for t in r.tables] == [["n", "a", "b"], ["col_0", "col_1", "col_2", "col_3"]]
    assert r.tables[1].dataframe.count() == 4 and r.tables[1].header_provenance == "manual"


def test_no_value_is_lost(spark, folder):
    with extract(spark, str(folder / "loose.xlsx")) as r:
        t = r.tables[0]
        got = [tuple(x) for x in t.dataframe.collect()]
        assert len(got) == 200 and not any(v is None for x in got for v in x)
        assert got[188][1] == "pending" and got[148][2] == "soon" and got[0] == (2, "20", "2020-01-03 00:00:00")
        assert sum("several types" in n for n in t.notes) == 2
        assert t.read_plan.dtype_map == {"2": "datetime64[ns]"}


def test_rows_without_values_are_rows(spark, folder):
    o = InspectionOptions([SheetOverride("S", skip_rows_remove=[4])])
    with extract(spark, str(folder / "interior.xlsx"), o) as r:
        assert [x[0] for x in r.tables[0].dataframe.collect()] == ["x", "y", None, "z", "w"]
    with extract(spark, str(folder / "interior.xlsx"), InspectionOptions([SheetOverride("S", header_row=None, skip_rows_remove=[4])])) as r:
        assert [x[0] for x in r.tables[0].dataframe.collect()] == ["n", "x", "y", None, "z", "w"]


def test_levels_within_chosen_columns_give_their_last_row(spark, folder):
    with extract(spark, str(folder / "inner.xlsx")) as r:
        t = r.tables[0]
        assert t.dataframe.columns == ["a", "b", "c"] and t.read_plan.usecols == "C:E" and t.read_plan.header == 0
        assert any("several levels" in w for w in r.warnings)
        assert t.read_plan.skiprows[:2] == [0, 1][: len(t.read_plan.skiprows[:2])]


def test_overrides_left_out_are_said(spark, folder):
    o = InspectionOptions([SheetOverride("S", header_row=6, blocks=[BlockOverride(2, header_row=1), BlockOverride(3, header_row=2), BlockOverride(6, header_row=1), BlockOverride(8), BlockOverride(9, header_row=2)])])
    said = [r["message"] for r in inspect(spark, str(folder / "stacked.xlsx"), o).warnings.collect()]
    for row, why in ((3, "is in the band of row 2"), (6, "lies in no table band"), (8, "asks for nothing"), (9, "outside its band")):
        assert sum(f"block override at row {row} " in m and why in m for m in said) == 1
    assert sum("given header row 6 lies in no table band" in m for m in said) == 1


@pytest.mark.parametrize("name", ["offset", "stacked", "levels", "margin", "interior"])
def test_plans_load_what_extraction_loads(spark, folder, name):
    path = str(folder / f"{name}.xlsx")
    with extract(spark, path) as r:
        for t in r.tables:
            again = gridloom.load_dataframe(spark, path, t.read_plan)
            assert again.columns == t.dataframe.columns
            assert [tuple(x) for x in again.collect()] == [tuple(x) for x in t.dataframe.collect()]


def test_plan_arguments():
    plan = ReadPlan("S", 0, None, [0, 1], 5, {}, [])
    assert read_plan_to_kwargs(plan) == {"sheet_name": "S", "engine": "openpyxl", "header": 0, "skiprows": [0, 1], "nrows": 5}
    plan = ReadPlan("S", None, "B:D", [], None, {"0": "string"}, [])
    assert read_plan_to_kwargs(plan) == {"sheet_name": "S", "engine": "openpyxl", "header": None, "skiprows": [], "nrows": None, "usecols": "B:D", "dtype": {0: "string"}}


def test_closed_workbooks_cannot_be_read(spark, folder):
    with gridloom.Workbooks(spark, str(folder / "types.xlsx")) as books:
        assert books.relations()[0].count() == 16
    books.close()
    with pytest.raises(RuntimeError):
        books.relations()


def test_a_failing_step_is_a_warning():
    said = []
    assert guarded(said, "step", lambda: 1 / 0) is None and "ZeroDivisionError" in said[0]
    assert guarded(said, "step", lambda x: x, 3) == 3
    with pytest.raises(EncryptedWorkbookError):
        guarded(said, "step", xlsx.check_container, bytes.fromhex("d0cf11e0a1b11ae1"), "x")


def test_command_line(spark, folder, capsys):
    assert cli.main([str(folder / "levels.xlsx"), "--max-rows", "2"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("### S!T1\n\n| G1 / a | G1 / b |") and out.rstrip().endswith("\n\n… 2 more rows")
    assert cli.main([str(folder / "levels.xlsx"), "--format", "json"]) == 0
    out = capsys.readouterr().out
    assert json.loads(out)["sheets"][0]["tables"][0]["records"][0]["G2 / c"] == 30 and out.startswith("{\n  ")
    assert cli.main([str(folder / "none.xlsx")]) == 1 and "file not found" in capsys.readouterr().err
    assert cli.main([str(folder)]) == 1 and "not a file" in capsys.readouterr().err


def test_errors(spark, tmp_path, capsys):
    (tmp_path / "a.xlsx").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1") + b"x" * 64)
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(BOOKS["types"])[:200])
    with pytest.raises(EncryptedWorkbookError):
        extract(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(CorruptWorkbookError):
        extract(spark, str(tmp_path / "b.xlsx"))
    with pytest.raises(CorruptWorkbookError):
        extract(spark, str(tmp_path / "none.xlsx"))
    assert cli.main([str(tmp_path / "none.xlsx")]) == 1 and cli.main([str(tmp_path)]) == 1
    with pytest.raises(SystemExit) as e:
        cli.main(["x", "--max-rows", "-1"])
    assert e.value.code == 2
