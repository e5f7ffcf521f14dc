import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from catalog.sources import _with_last
from lucarne.operators import calculated
from lucarne.operators.anomalies import detect_anomalies
from lucarne.operators.cleaning import TableError
from lucarne.operators.inference import infer_delimited, recast
from lucarne.operators.pivot import pivot
from lucarne.plans.ingest import ingest
from lucarne.session import stage, staging_root
from lucarne.sources import detection, sinks, tables, workbook
from lucarne.sources.detection import describe_files


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)
    return write


def test_tsv(spark, put):
    assert tables.read_table(spark, put("a.tsv", "col1\tcol2\nval1\tval2\n")).first().asDict() == {"col1": "val1", "col2": "val2"}


def test_json_array(spark, put):
    df = tables.read_table(spark, put("a.json", '  [{"name":"A","id":1},{"name":"B","id":2}]'))
    assert df.dtypes == [("name", "string"), ("id", "bigint")]
    assert df.count() == 2


@pytest.mark.parametrize("text,error", [
    ('[{"id":1,"data":{"nested":true}}]', tables.JsonStructureError), ('{"data":[{"id":1}]}', tables.JsonStructureError),
    ("[1, 2]", tables.JsonStructureError), ("[]", TableError), ("  ", TableError),
])
def test_json_refusals(spark, put, text, error):
    with pytest.raises(error):
        tables.read_table(spark, put("a.json", text)).collect()


def test_json_lines(spark, put):
    df = tables.read_table(spark, put("a.jsonl", '{"b":1,"a":"x"}\n{"b":2,"a":"y"}\n'))
    assert df.columns == ["b", "a"] and df.count() == 2
    with pytest.raises(tables.JsonStructureError):
        tables.read_table(spark, put("n.ndjson", '{"b":[1]}\n'))


def test_separators(spark, put):
    df = tables.read_table(spark, put("a.csv", "a;b;c\n1;2;3"))
    assert df.first().asDict() == {"a": 1, "b": 2, "c": 3}
    assert detection.detect_separator(spark, put("t.csv", "x\n\ny\n")) == ","
    assert detection.detect_separator(spark, put("p.csv", "a|b,c\n1|2|3\n")) == "|"
    assert detection.detect_separator(spark, put("tie.csv", "a,b;c\n")) == ","


def test_latin1_and_marks(spark, put):
    assert tables.read_table(spark, put("l.csv", "café,thé\n1,é".encode("latin-1"))).first().asDict() == {"café": 1, "thé": "é"}
    assert tables.read_table(spark, put("b.csv", b"\xef\xbb\xbfville,pays,rang\nLyon,fr,3\n")).columns == ["ville", "pays", "rang"]
    for encoding, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        df = tables.read_table(spark, put(f"{encoding}.csv", mark + "nom,âge\nZoé,3\r\nLéa,4\n".encode(encoding)))
        assert [tuple(r) for r in df.collect()] == [("Zoé", 3), ("Léa", 4)] and df.columns == ["nom", "âge"]


def test_encoding_per_file(spark, put):
    folder = put("many/a.csv", "n,v\né,1\n").rsplit("/", 1)[0]
    put("many/b.csv", "n,v\né,2\n".encode("latin-1"))
    seen = {r.path.rsplit("/", 1)[1]: r.encoding for r in detection.detect_encoding(spark, folder).collect()}
    assert seen == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1"}
    assert sorted(tuple(r) for r in tables.read_table(spark, folder, "csv").collect()) == [("é", 1), ("é", 2)]


def test_duplicate_names_and_nulls(spark, put):
    df = tables.read_table(spark, put("a.csv", "id,id,val\n1,NA,3\n2,x,None\n"))
    assert df.columns == ["id", "id_1", "val"]
    assert [tuple(r) for r in df.collect()] == [(1, None, 3), (2, "x", None)]


def test_ragged_and_quoted(spark, put):
    df = tables.read_table(spark, put("a.csv", 'a,b\n"x, ""y""",1\nz\n'))
    assert [tuple(r) for r in df.collect()] == [('x, "y"', 1), ("z", None)]
    df = tables.read_table(spark, put("m.csv", 'a,b\n"x\ny",1\n'), multi_line=True)
    assert df.first().a == "x\ny"


def test_bad_cells(spark, put):
    text = "n\n" + "\n".join(str(i) for i in range(1000)) + "\noops\n"
    got = tables.read_table(spark, put("a.csv", text))
    assert got.dtypes == [("n", "string")] and got.filter("n = 'oops'").count() == 1
    asked = tables.read_table(spark, put("a.csv", text), on_bad_cell="null")
    assert asked.dtypes == [("n", "bigint")] and asked.filter("n IS NULL").count() == 1


def test_refusals(spark, put):
    for name in ("a.exe", "a.txt", "a.py", "a.xls"):
        with pytest.raises(tables.UnsupportedFormat):
            tables.read_table(spark, name)
    with pytest.raises(TableError):
        tables.read_table(spark, put("empty.csv", ""))
    with pytest.raises(TableError, match="no rows"):
        ingest(spark, put("head.csv", "a,b,c\n"))


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "idx int").coalesce(1).write.parquet(path)
    assert tables.read_table(spark, path).count() == 3
    assert sorted(r.row_index for r in tables.read_parquet_rows(spark, path).collect()) == [0, 1, 2]


# --- workbooks -------------------------------------------------------------------------------

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx(sheets, shared=(), styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets>' + "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships>' + "".join(
            f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def cells(*rows):
    def one(v):
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return "<c/>" if v is None else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    return "".join("<row>" + "".join(one(v) for v in row) + "</row>" for row in rows)


def test_workbook_sheets(spark, put):
    path = put("multi.xlsx", xlsx({
        "Main": cells(["A", "B"], [1, 2]), "Hidden": cells(["X", "Y"], ["p", "q"]), "MetaData": cells(["Version", "Author"], ["1", "me"]),
    }))
    assert workbook.sheet_names(spark, path) == ["Main", "Hidden", "MetaData"]
    with pytest.raises(workbook.SheetRequired) as error:
        tables.read_table(spark, path)
    assert error.value.sheets == ["Main", "Hidden", "MetaData"]
    assert tables.read_table(spark, path, sheet="Hidden").first().asDict() == {"X": "p", "Y": "q"}
    assert tables.read_table(spark, path, first_sheet=True).first().asDict() == {"A": 1, "B": 2}
    previews = workbook.sheet_previews(spark, path).orderBy("sheet", "row_idx").collect()
    assert [(p.sheet, p.row_idx, p.is_heading) for p in previews][:2] == [("Hidden", 0, True), ("Hidden", 1, False)]


def test_workbook_cells(spark, put):
    sheet = (
        '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>2</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>44927</v></c><c r="B4" t="b"><v>1</v></c><c r="D4"><v>2.5</v></c></row>'
        '<row r="5"><c r="B5" t="b"><v>0</v></c><c r="D5" t="e"><v>#DIV/0!</v></c></row>'
    )
    styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
    path = put("b.xlsx", xlsx({"S": sheet}, ["Day", "Merged", "Value"], styles))
    raw = workbook.read_sheet(spark, path)
    assert raw.columns == ["Day", "Merged", "Merged_1", "Value"]
    got = ingest(spark, path).table
    assert dict(got.dtypes)["Day"] == "date" and dict(got.dtypes)["Merged"] == "boolean"
    assert [tuple(r) for r in got.collect()] == [(dt.date(2023, 1, 1), True, None, 2.5), (None, False, None, None)]


def test_csv_and_workbook_agree(spark, put):
    rows = [["ID", "Date", "Val"], [1, "2023-01-01", 10], [2, "2023-01-02", 20]]
    a = ingest(spark, put("p.csv", "\n".join(",".join(map(str, r)) for r in rows))).table
    b = ingest(spark, put("p.xlsx", xlsx({"S": cells(*rows)}))).table
    assert a.dtypes == b.dtypes and a.collect() == b.collect()


def test_noise_above_the_header_does_not_fail(spark, put):
    path = put("dirty.csv", "Report,\n,\nTarget,Value\nx,1\n")
    assert ingest(spark, path).table.count() == 3


# --- writers and the whole flow --------------------------------------------------------------


def test_versions_never_overwrite(spark, tmp_path):
    df = spark.range(3).toDF("n")
    first = sinks.save_version(df, str(tmp_path))
    again = sinks.save_version(spark.read.parquet(first).selectExpr("n + 1 AS n"), str(tmp_path))
    assert first != again and spark.read.parquet(first).agg(F.sum("n")).first()[0] == 3
    assert spark.read.parquet(again).agg(F.sum("n")).first()[0] == 6
    text = sinks.save_version(df, str(tmp_path), "csv")
    assert tables.read_table(spark, text).count() == 3


def test_quoted_export(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    sinks.export_csv(spark.createDataFrame([(1, 'say "hi"'), (2, None)], "n int, t string").coalesce(1), path, {"n": [1, 2]}, "")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines == ['"n","t"', '"1","say ""hi"""', '"2",""']


def test_arrow_and_staging(spark):
    df = spark.range(5).toDF("n")
    assert sinks.to_arrow(df, 3).num_rows == 3
    assert stage(df).count() == 5


class _Named:
    """A session that names a shared folder."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder}


def test_staging_uses_the_named_folder(tmp_path):
    assert staging_root(_Named(str(tmp_path))) == str(tmp_path)


def test_anomaly_export(spark, tmp_path):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 2, 1, 2, 900])], "key int, v double")
    path = str(tmp_path / "anomalies.csv")
    sinks.export_anomalies(detect_anomalies(df, "iqr", "strict", ["v"], ["key"]).anomalies, path, ["key"])
    row = tables.read_table(spark, path).first()
    assert (row.key, row.severity, row["columns"], row.deviation) == (6, "Critique", "v", "×450.0 la médiane")


def test_screen_of_a_calculated_ratio_by_group(spark, put):
    """Text dates and amounts with units, one ratio far off, its share by month."""
    lines = "\n".join(f"{d:02d}/0{m}/2024,{100 * d} kg,{d}" for m in (1, 2, 3) for d in range(1, 10))
    table = ingest(spark, put("deliveries.csv", f"day,load,trips\n{lines}\n10/03/2024,90000 kg,1\n"), overrides={"day": "Date", "load": "Float64"}).table
    rated = calculated.add_field(table, "per_trip", "load / trips")
    found = detect_anomalies(rated, "iqr", "standard", ["per_trip"], key=["day"])
    assert [str(r.day) for r in found.ordered(["day"]).collect()] == ["2024-03-10"]
    months = pivot(rated.select(F.month("day").alias("month"), "per_trip"), ["month"], [("per_trip", "max")])
    assert {str(r.month): r.per_trip for r in months.collect()}["3"] == 90000.0


def test_ingest_report(spark, put):
    got = ingest(spark, put("y.csv", "2020,2021\n1,a\n2,b\n"), overrides={"2020": "String"})
    assert got.header_warning and got.suggested_overrides == {"2020": "Int64"}
    assert got.table.dtypes == [("2020", "string"), ("2021", "string")]
    assert got.preview().count() == 2 and got.catalogue().count() == 2


def test_windows_1252_and_blanks_in_paths(spark, tmp_path):
    folder = tmp_path / "two files.csv"
    folder.mkdir()
    (folder / "a b.csv").write_bytes("œuvre,prix\nl’été,5 €\n".encode("windows-1252"))
    (folder / "c d.csv").write_bytes("œuvre,prix\nécole,6 €\n".encode())
    df = tables.read_table(spark, str(folder), format="csv", separator=",")
    assert sorted(tuple(r) for r in df.collect()) == [("l’été", "5 €"), ("école", "6 €")]


def test_header_of_every_file_and_long_rows(spark, tmp_path):
    for name, content in {"a": "x,y\n1,one\n", "b": "y,x\ntwo,2\n", "c": 'x,y\n3,three,more\n"4","a, b"\n5\n', "d": "y,z\nsix,6\n"}.items():
        (tmp_path / f"{name}.csv").write_text(content)
    df = tables.read_table(spark, str(tmp_path), format="csv")
    extra = [c for c in df.columns if c not in ("x", "y", "z")]
    assert df.columns[:2] == ["x", "y"] and len(extra) == 1
    got = {(r.x, r.y, r[extra[0]], r.z) for r in df.collect()}
    assert got == {(1, "one", None, None), (2, "two", None, None), (3, "three", "more", None), (4, "a, b", None, None), (5, None, None, None), (None, "six", None, 6)}


@pytest.mark.parametrize(("cells", "kind", "shown"), [
    (["9223372036854775807", "-9223372036854775808"], "bigint", None),
    (["12345678901234567890", "12345678901234567891"], "decimal(20,0)", ["12345678901234567890", "12345678901234567891"]),
    (["9" * 38, "-" + "9" * 37], "decimal(38,0)", ["9" * 38, "-" + "9" * 37]),
    (["9" * 39, "1"], "string", None),
    (["9" * 38, "1.5"], "string", None),
    (["123456789012345678", "1.5"], "decimal(19,1)", ["123456789012345678.0", "1.5"]),
    (["0.30000000000000004", "1e3", "-2.50", ".5"], "double", None),
    (["1e400"], "string", None),
    (["1234567890123456e1"], "double", None),
    (["12345678901234567e1"], "string", None),
    (["12345678901234567123e1"], "string", None),
    (["007", "8"], "bigint", None),
    (["1", "x"], "string", None),
])
def test_number_types_lose_no_digit(spark, cells, kind, shown):
    df = infer_delimited(spark.createDataFrame([(i, c) for i, c in enumerate([*cells, None])], "i int, v string"))
    assert dict(df.dtypes)["v"] == kind
    if shown:
        assert [str(r.v) for r in df.sort("i").collect()] == [*shown, "None"]


def test_bad_cells_become_null_where_asked(spark):
    cells = ["1.5", "12345678901234567890", "7", "x"]
    df = infer_delimited(spark.createDataFrame([(c,) for c in cells], "v string"), on_bad_cell="null")
    assert dict(df.dtypes)["v"] == "decimal(21,1)" and df.filter("v IS NULL").count() == 1


def test_line_breaks_in_quotes_are_found(spark, put, tmp_path):
    put("a.csv", 'a,b\n"x\ny",1\n"say ""hi""\n\nthere",2\n')
    put("b.csv", 'a,b\n5" nail,3\n"quoted, ""cell""",4\n"",5\n')
    df = tables.read_table(spark, f"{tmp_path}/*.csv", format="csv", separator=",", infer=False)
    assert sorted((r.a, r.b) for r in df.filter("a IS NOT NULL").collect()) == [('5" nail', "3"), ('quoted, "cell"', "4"), ('say "hi"\n\nthere', "2"), ("x\ny", "1")]
    assert df.count() == 5
    found = {r.path.rsplit("/", 1)[1]: r.open_quotes for r in describe_files(spark, f"{tmp_path}/*.csv", ",").collect()}
    assert found == {"a.csv": True, "b.csv": False}
    assert tables.read_table(spark, f"{tmp_path}/a.csv", separator=",", multi_line=False).count() > 2
    wide = put("wide.csv", b"\xff\xfe" + 'a,b\n"x\ny",1\n'.encode("utf-16-le"))
    assert [tuple(r) for r in tables.read_table(spark, wide, separator=",").collect()] == [("x\ny", 1)]


def test_the_last_key_is_found_without_a_window_over_the_table(spark, capsys):
    """Rows stay where they are; equal largest keys are all last, and a null key never is."""
    rows = spark.createDataFrame([(1,), (7,), (None,), (7,)], "k long").repartition(3)
    got = _with_last(rows, "k")
    assert sorted(((r.k, r.last) for r in got.collect()), key=str) == [(1, False), (7, True), (7, True), (None, None)]
    assert _with_last(rows.where("k is null"), "k").collect()[0].last is None
    assert _with_last(rows.limit(0), "k").count() == 0
    got.explain()
    assert "Window" not in capsys.readouterr().out
