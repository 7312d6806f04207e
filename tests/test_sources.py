"""Archives, sheets, nested state, line merges and promotion, on written files."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from tremorlake.sources import archives, readers, sheets, sinks


def record(start="2010-02-27T06:34:08.000Z", rate=200, samples=(0.5, -1.25, 3.0)):
    head = f"# Tiempo de inicio: {start}\n# Tasa de muestreo: {rate} muestras/s\n# Muestras\n# Cantidad\n# lat -33.4 lon -70.6\n# Aceleracion\n"
    return head + "".join(f"{v}\n" for v in samples)


def packed(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(name, text)


def test_archives_with_channels_times_and_damage(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    packed(tmp_path / "12_A1.zip", {"x/A1-HNE.txt": record(), "A1-HNZ.txt": record(rate=100, samples=[2.0]), "A1-HNN.txt": "no header\n1\n", "A1-HN2.txt": record().replace("3.0", "three"), "d/": ""})
    packed(tmp_path / "sub" / "7_1_B.zip", {"B-080.txt": record(start="yesterday")})
    packed(tmp_path / "9_C.zip", {})
    (tmp_path / "9_D.zip").write_bytes(b"PK no archive")
    whole = (tmp_path / "12_A1.zip").read_bytes()
    at = whole.index(b"A1-HNE.txt") + len("A1-HNE.txt") + 3
    (tmp_path / "12_E.zip").write_bytes(whole[:at] + bytes(b ^ 255 for b in whole[at : at + 40]) + whole[at + 40 :])
    made = archives.read_archives(spark, str(tmp_path))
    rows = {(q.event, q.station, q.channel): q for q in made.withColumn("times", archives.sample_times(F.col("start"), F.col("rate"), F.col("values"))).collect()}
    good = rows["12", "A1", "HNE"]
    begin = datetime.datetime(2010, 2, 27, 6, 34, 8)
    assert (good.start, good.rate, good.latitude, good.longitude, good["values"], good.error) == (begin, 200.0, -33.4, -70.6, [0.5, -1.25, 3.0], None)
    assert good.times == [begin + datetime.timedelta(milliseconds=5 * k) for k in range(3)]
    assert rows["12", "A1", "HNZ"].times == [begin] and rows["12", "A1", "HNZ"].entry == "A1-HNZ.txt"
    for key in (("12", "A1", "HNN"), ("12", "A1", "HN2"), ("9", "D", None), ("12", "E", "HNE")):
        assert rows[key].error and rows[key]["values"] is None and rows[key].times is None
    assert rows["12", "E", "HNZ"].error is None
    odd = rows["7_1", "B", "080"]
    assert odd.start is None and len(odd["values"]) == 3 and odd.times == [None] * 3
    assert not any(k[1] == "C" for k in rows)
    some = archives.read_archives(spark, str(tmp_path), ["B", "D"])
    assert {q.station for q in some.collect()} == {"B", "D"} and len(some.inputFiles()) == 2
    assert archives.read_archives(spark, str(tmp_path), []).count() == 0


def workbook(path, rows, day1904=False):
    """A workbook with shared and inline strings, dates by built-in and own formats, blanks, errors and a second sheet."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    packed(path, {
        "xl/workbook.xml": f'<workbook {main} {link}><workbookPr date1904="{int(day1904)}"/><sheets><sheet name="Values" sheetId="1" r:id="rId2"/><sheet name="Notes" sheetId="2" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId2" Target="worksheets/sheet7.xml"/><Relationship Id="rId1" Target="/xl/worksheets/notes.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>name</t></si><si><r><t>é&amp;</t></r><r><t xml:space='preserve'> two</t></r><rPh><t>hint</t></rPh></si><si><t>day</t></si></sst>",
        "xl/worksheets/sheet7.xml": f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/notes.xml": f'<worksheet {main}><sheetData><row><c t="inlineStr"><is><t>note</t></is></c></row><row><c><v>5</v></c></row></sheetData></worksheet>',
    })


def test_sheets_with_blanks_dates_and_errors(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="s"><v>2</v></c><c r="E1" t="str"><v>ok</v></c></row>'
    body = (
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.5</v></c><c r="C2" s="1"><v>40236.25</v></c><c r="E2" t="b"><v>1</v></c></row>'
        '<row r="4"><c r="B4" s="3"><v>7</v></c><c r="C4" s="2"><v>1</v></c><c r="D4"><v>99</v></c></row>'
        '<row r="5"><c r="A5" t="e"><v>#DIV/0!</v></c><c r="B5" t="str"><v>text</v></c><c r="C5"/></row><row r="6"/>'
    )
    workbook(tmp_path / "a.xlsx", head + body)
    schema = "name string, n double, day timestamp_ntz, ok boolean, absent int"
    day = datetime.datetime
    got = [tuple(q) for q in sheets.read_sheet(spark, str(tmp_path), schema).collect()]
    assert got == [("é& two", 2.5, day(2010, 2, 27, 6), True, None), (None, 7.0, day(1899, 12, 31), None, None), (None, None, None, None, None), (None, None, None, None, None)]
    assert [q.n for q in sheets.read_sheet(spark, str(tmp_path), "n bigint").collect()] == [2, 7, None, None]
    assert [tuple(q) for q in sheets.read_sheet(spark, str(tmp_path), "note int", "Notes").collect()] == [(5,)]
    many = "".join(f'<row><c><v>{k}</v></c><c><v>{k}.5</v></c></row>' for k in range(12_000))
    workbook(tmp_path / "b.xlsm", head + many, day1904=True)
    big = sheets.read_sheet(spark, str(tmp_path), "n double, day timestamp_ntz", suffix=".xlsm")
    assert big.agg(F.count("n"), F.sum("n")).first()[:] == (12_000, 12_000 * 11_999 / 2 + 6_000)
    with pytest.raises(Exception, match="no sheet is named"):
        sheets.read_sheet(spark, str(tmp_path), "n double", "none").collect()


def test_nested_state_and_missing_files(spark, tmp_path):
    none = str(tmp_path / "none.json")
    assert readers.read_picks(spark, none).count() == readers.read_registry(spark, none).count() == readers.read_planes(spark, none).count() == readers.read_station_notes(spark, none).count() == 0
    (tmp_path / "r.json").write_text('{"12": {"A": true, "B": null}, "13": {}}')
    assert {tuple(q) for q in readers.read_registry(spark, str(tmp_path / "r.json")).collect()} == {("12", "A", True), ("12", "B", None)}
    (tmp_path / "f.json").write_text('{"e": [10, 20.5, -90], "short": [1]}')
    assert {tuple(q) for q in readers.read_planes(spark, str(tmp_path / "f.json")).collect()} == {("e", 10.0, 20.5, -90.0), ("short", 1.0, None, None)}
    (tmp_path / "s.json").write_text('{"A": {"name": "x", "Vs30": 300.5, "list": [1, 2]}}')
    assert {tuple(q) for q in readers.read_station_notes(spark, str(tmp_path / "s.json")).collect()} == {("A", "name", "x"), ("A", "Vs30", "300.5"), ("A", "list", "[1,2]")}
    (tmp_path / "p.json").write_text('{"e": {"s": {"pos": 3, "status": "true"}}}')
    assert [q.status for q in readers.read_picks(spark, str(tmp_path / "p.json")).collect()] == ["VALID"]


def test_csv_scans_only_asked_columns(spark, tmp_path):
    """Typed, and all as text: the scan of a CSV file reads the columns that are asked for."""
    (tmp_path / "c.csv").write_text("Station code,Latitude,Longitude,Vs30,Source,Azimuth,Station name\n007,-33.5,-70,,1,0,\"a, b\"\n")
    typed = readers.read_csv(spark, str(tmp_path / "c.csv"), readers.STATIONS).select("Station code", "Latitude")
    plan = typed._jdf.queryExecution().toString()
    assert plan.rstrip().split("ReadSchema: ")[-1].startswith("struct<Station code:string,Latitude:double>")
    text = readers.read_csv(spark, str(tmp_path / "c.csv"), ", ".join(f"`{c.split('` ')[0].strip('` ')}` string" if "`" in c else f"{c.split()[0]} string" for c in readers.STATIONS.split(", ")))
    assert tuple(text.first()) == ("007", "-33.5", "-70", None, "1", "0", "a, b")


def merged(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.glob("part-*")))


def test_line_merge_keeps_old_bytes(spark, tmp_path):
    head = "event,station,n,note"
    old = ['b,A,1,"x, y"', "b,A,01,second of its keys", "b,C, 7 ,tail  ", 'd,"A",1e3,\xe9', "d,B,,", "z,Z,9,last"]
    new = [("b", "B", 5, "q, r"), ("d", "A", 6, None), ("a", "A", 1, "first"), ("zz", "A", 2, 'say "x"')]
    df = spark.createDataFrame(new, "event string, station string, n int, note string")
    for end, name in (("\n", "u"), ("\r\n", "w")):
        (tmp_path / f"{name}.csv").write_bytes("".join(line + end for line in [head, *old]).encode())
        sinks.merge_sorted_lines(str(tmp_path / f"{name}.csv"), df, ["event", "station"], str(tmp_path / name))
        want = [head, "a,A,1,first", *old[:2], 'b,B,5,"q, r"', old[2], "d,A,6,", old[4], old[5], 'zz,A,2,"say \\"x\\""']
        assert merged(tmp_path / name) == "".join(line + end for line in want).encode()
    many = [f"e{k:05d},S,{k}.0," for k in range(20_000)]
    (tmp_path / "m.csv").write_text("\n".join([head, *many]))
    sinks.merge_sorted_lines(str(tmp_path / "m.csv"), spark.createDataFrame([("e00500", "S", 1), ("e00500", "T", 2)], "event string, station string, n int"), ["event", "station"], str(tmp_path / "m"))
    assert merged(tmp_path / "m").decode().splitlines() == [head, *many[:500], "e00500,S,1,", "e00500,T,2,", *many[501:]]


def test_promotion_moves_folders_and_ends_what_was_broken_off(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("a", n), ("b", n)], "event string, n int")
    draft, main = str(tmp_path / "draft"), str(tmp_path / "main")
    sinks.write_records(rows(1), main)
    sinks.write_records(rows(2).where("event = 'a'"), draft)
    assert sinks.promote(spark, draft, main) == ["a"]
    held = lambda: {(q.event, q.n) for q in spark.read.parquet(main).collect()}
    assert held() == {("a", 2), ("b", 1)}
    sinks.write_records(rows(3).where("event = 'b'"), draft)
    (tmp_path / "draft" / "event=b").rename(tmp_path / "main" / "_moved-event@b")
    assert held() == {("a", 2), ("b", 1)}
    assert sinks.promote(spark, draft, main) == ["b"] and held() == {("a", 2), ("b", 3)}
    assert sinks.promote(spark, str(tmp_path / "none"), main) == []
