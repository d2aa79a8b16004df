"""Hand-made spreadsheets."""

import zipfile
from datetime import date, datetime

import pytest

from leadtide.sources import readers, sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = f'<styleSheet {NS}><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>'
SHARED = f"<sst {NS}><si><t>day</t></si><si><t>city</t></si><si><r><t>Te</t></r><r><t>hran</t></r><rPh><t>hint</t></rPh></si><si><t>n</t></si><si><t></t></si></sst>"
FIRST = f"""<worksheet {NS}><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>3</v></c><c r="D1" t="s"><v>3</v></c><c r="F1" t="inlineStr"><is><t>ok</t></is></c></row>
<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>3</v></c><c r="D2" s="3"><v>0.5</v></c><c r="E2"><v>1</v></c><c r="F2" t="b"><v>1</v></c><c r="G2" s="2"><v>45292.75</v></c></row>
<row r="3"/>
<row r="4"><c r="A4" s="2"><v>45293</v></c><c r="B4" t="s"><v>4</v></c><c r="C4"><f>1+3</f><v>4</v></c><c r="D4"><v>2</v></c><c r="E4" t="str"><v>x</v></c><c r="F4" t="e"><v>#N/A</v></c><c r="G4" s="2"><v>45293</v></c></row>
</sheetData></worksheet>"""
SECOND = f'<worksheet {NS}><sheetData><row><c t="inlineStr"><is><t>a</t></is></c></row><row><c><v>{{}}</v></c></row></sheetData></worksheet>'


def book(path, parts):
    rel = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(parts)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships {rel}>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(parts))) + "</Relationships>")
        z.writestr("xl/styles.xml", STYLES)
        z.writestr("xl/sharedStrings.xml", SHARED)
        for i, x in enumerate(parts.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", x)
    return str(path)


def test_types_dates_and_empty_cells(spark, tmp_path):
    df = readers.read_tabular(spark, book(tmp_path / "a.xlsx", {"One": FIRST}))
    assert [f.simpleString() for f in df.schema] == ["day:date", "city:string", "n:bigint", "n_2:double", "column_5:string", "ok:boolean", "column_7:timestamp_ntz"]
    assert [tuple(r) for r in df.collect()] == [(date(2024, 1, 1), "Tehran", 3, 0.5, "1", True, datetime(2024, 1, 1, 18)), (date(2024, 1, 2), None, 4, 2.0, "x", None, datetime(2024, 1, 2))]
    assert readers.read_tabular(spark, str(tmp_path / "a.xlsx"), 1).count() == 1


def test_sheets_by_name_and_all(spark, tmp_path):
    path = book(tmp_path / "b.xlsx", {"x": SECOND.format(1), "y": SECOND.format(2.5)})
    assert [r.a for r in sheets.read_sheet(spark, path, "y").collect()] == [2.5]
    both = sheets.read_sheet(spark, f"file://{path}", "*")
    assert both.rdd.getNumPartitions() == 2 and sorted(r.a for r in both.collect()) == [1.0, 2.5]
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_sheet(spark, path, "z").count()
    empty = book(tmp_path / "c.xlsx", {"e": f"<worksheet {NS}><sheetData/></worksheet>", "h": f'<worksheet {NS}><sheetData><row><c t="s"><v>0</v></c></row></sheetData></worksheet>'})
    only = sheets.read_sheet(spark, empty, "h")
    assert only.columns == ["day"] and only.count() == 0
