"""Readers on files made here, streaming and the command line."""

import io
import zipfile

import pytest

from foliograph import cli
from foliograph.sources import office
from foliograph.streaming import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def para(text, level=None, extra=""):
    lv = f'<w:outlineLvl w:val="{level}"/>' if level is not None else ""
    return f"<w:p><w:pPr>{lv}</w:pPr>{extra}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx():
    body = para("Head", 0, '<w:bookmarkStart w:id="1" w:name="m"/>') + para("Table 1. x") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>" + '<w:sdt><w:sdtContent><w:p><w:hyperlink w:anchor="m"><w:r><w:t>see table 1</w:t></w:r></w:hyperlink></w:p></w:sdtContent></w:sdt>' + para("Sub", 1) + "<w:p/>"
    body += '<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:instrText> TOC \\o</w:instrText><w:t>Contents</w:t></w:r></w:p>' + para("entry") + '<w:p><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>' + para("after")
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return archive({
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL % '<Relationship Id="r1" Target="worksheets/s.xml"/>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>text</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {s}><numFmts><numFmt numFmtId="164" formatCode="0.0%"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" s="1"><v>0.5</v></c><c r="AA2" s="2"><v>46269</v></c><c r="D2"/></row></sheetData></worksheet>',
    })


def pptx():
    shape = lambda x, y, t: f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="100" cy="50"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    tree = shape(500, 500, "low") + f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="100" y="0"/><a:ext cx="200" cy="100"/><a:chOff x="0" y="0"/><a:chExt cx="100" cy="50"/></a:xfrm></p:grpSpPr>{shape(0, 0, "top")}</p:grpSp>'
    return archive({
        "ppt/presentation.xml": f'<p:presentation {W}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": REL % '<Relationship Id="r1" Target="slides/slide1.xml"/>',
        "ppt/slides/slide1.xml": f"<p:sld {W}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>",
    })


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for name, data in (("a.docx", docx()), ("b.XLSX", xlsx()), ("c.pptx", pptx()), ("d.txt", b"x"), ("e.docx", b"broken")):
        (at / name).write_bytes(data)
    return at


def test_readers(spark, folder):
    raw = office.read_files(spark, str(folder)).orderBy("doc", "ord").collect()
    by = lambda d: [r for r in raw if r["doc"] == d]
    assert [(r["kind"], r["text"], r["level"], r["is_toc"]) for r in by("a.docx")] == [("Text", "Head", 0, False), ("Text", "Table 1. x", None, False), ("Table", None, None, None), ("Text", "see table 1", None, False), ("Text", "Sub", 1, False), ("Text", "Contents", None, True), ("Text", "entry", None, True), ("Text", "after", None, False)]
    assert by("a.docx")[2]["grid"] == [["a", ""]]
    assert [(r["row"], r["col"], r["text"]) for r in by("b.XLSX")] == [(2, 2, "text"), (2, 3, "50.0%"), (2, 27, "09-04")]
    assert [(r["text"], r["x0"], r["x1"], r["y1"]) for r in by("c.pptx")] == [("top", 100, 300, 100), ("low", 500, 600, 550)]
    assert "unsupported" in by("d.txt")[0]["text"] and by("e.docx")[0]["kind"] == "error"


def test_graph_of_files(spark, folder, tmp_path):
    nodes, edges = cli.build(spark, str(folder))
    text = {r["id"]: r["text"] for r in nodes.collect()}
    got = {(r["type"], text.get(r["source"], r["source"]), text.get(r["target"]) or "table") for r in edges.where("doc like '%a.docx'").collect()}
    assert {("CAPTION_OF", "Table 1. x", "table"), ("REFERENCES", "see table 1", "table"), ("REFERENCES", "see table 1", "Head"), ("PARENT_OF", "Head", "Sub"), ("PARENT_OF", "Sub", "after")} <= got
    assert cli.main([str(folder), "--format", "cypher", "-o", str(tmp_path / "out"), "--check"]) == 0
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert sum(r[0].startswith("MERGE") for r in lines) == nodes.count()


def test_files_that_arrive(spark, folder, tmp_path):
    run = lambda: files.ingest(spark, str(folder), str(tmp_path / "g"), str(tmp_path / "cp")).awaitTermination()
    run()
    first = spark.read.parquet(str(tmp_path / "g/nodes")).count()
    run()
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == first
    (folder / "f.docx").write_bytes(docx())
    run()
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == first + 8
