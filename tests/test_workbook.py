import zipfile

import grids as G
from unitwise.operators import prove as P
from unitwise.operators import walk as W
from unitwise.sources.workbook import read_cells

SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Start</t></is></c></row>
<row r="2"><c r="A2"><v>101</v></c><c r="B2" s="1"><v>45000</v></c><c r="AA2"><v>1.5</v></c></row></sheetData></worksheet>"""


def write_book(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://r"><sheets><sheet name="Roll"'
                                      ' sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1"'
                                                 ' Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Unit</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
                                    "</cellXfs></styleSheet>")
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_read_cells(spark, tmp_path):
    write_book(tmp_path / "a.xlsx")
    (tmp_path / "b.txt").write_text("no workbook")
    rows = {(r.row, r.col): r for r in read_cells(spark, str(tmp_path)).collect()}
    assert rows[0, 0].text == "Unit" and rows[0, 1].text == "Start"
    assert rows[1, 0].text == "101" and rows[1, 0].ctype == "n"
    assert rows[1, 1].num == 45000.0 and rows[1, 1].num_fmt == "m/d/yy"
    assert rows[1, 26].text == "1.5"


def test_narrow_fee_codes(spark):
    grid = [["Unit", "Charge", "Amount"]]
    for i in range(4):
        grid += [[f"10{i}", "rent", 1000], [None, "storage", 5 if i == 2 else 0.5],
                 [None, "Total", 1005 if i == 2 else 1000.5]]
    cells = G.cells(spark, G.cell_rows(1, "s", grid))
    summary = (4000.0, None, None, None, None, None)
    plans = G.structures(spark, G.structure(
        1, "s", "block", columns={"unit_number": 0},
        block=(1, 2, ["rent", "storage"], [], [], [], []), stated=4, summary=summary))
    w = W.walk(cells, plans)
    units = W.dedupe_units(w.units)
    assert {str(r.monthly_rent) for r in units.collect()} == {"1000.50", "1005.00"}
    narrowed, dropped = P.narrow_fee_codes(units, w.lines, w.plan, P.sheet_stated(plans))
    assert [r.code for r in dropped.collect()] == ["storage"]
    assert {str(r.monthly_rent) for r in narrowed.collect()} == {"1000.00"}
