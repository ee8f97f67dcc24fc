"""The PDF reader on files made here."""

import json
import zlib

import pytest

from foliograph import cli
from foliograph.operators import graph
from foliograph.sources import pdf


def document(contents, outline=(), packed=False, extra="", rotate=0, objects=()):
    """A file of pages of 200 x 300 points with a font whose glyphs are half its size wide."""
    objs = {1: "<</Type/Catalog/Pages 2 0 R/Outlines 5 0 R>>", 3: "<</Type/Font/Subtype/Type1/BaseFont/ABCDEF+Body/Encoding<</Differences[1/eacute/fi/uni4E2D/alpha]>>/FontDescriptor 4 0 R>>", 4: "<</Ascent 800/Descent -200/Flags 4/MissingWidth 500>>"}
    kids = [20 + 2 * i for i in range(len(contents))]
    objs[2] = f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]/MediaBox[0 0 200 300]/Resources<</Font<</F 3 0 R>>/XObject<</I 6 0 R/X 7 0 R>>>>>>"
    objs[5] = "<</First 100 0 R>>" if outline else "<<>>"
    for i, (level_next, level_first, title, dest) in enumerate(outline):
        links = (f"/Next {100 + level_next} 0 R" if level_next else "") + (f"/First {100 + level_first} 0 R" if level_first else "")
        objs[100 + i] = f"<</Title({title})/Dest{dest}{links}>>"
    objs |= dict(objects)
    streams = {6: ("/Type/XObject/Subtype/Image/Width 2/Height 1/BitsPerComponent 8/ColorSpace/DeviceRGB", b"\xff\0\0\0\xff\0"), 7: ("/Type/XObject/Subtype/Form/Matrix[1 0 0 1 10 0]", b"BT /F 10 Tf 0 50 Td (form) Tj ET")}
    for k, c in zip(kids, contents):
        objs[k] = f"<</Type/Page/Parent 2 0 R/Contents {k + 1} 0 R/Rotate {rotate}>>"
        streams[k + 1] = ("", c.encode("latin-1"))
    out = b"%PDF-1.7\n"
    if packed:
        body, places = b"", []
        for n, x in objs.items():
            places.append(f"{n} {len(body)}")
            body += x.encode() + b" "
        head = (" ".join(places) + " ").encode()
        streams[300] = (f"/Type/ObjStm/N {len(objs)}/First {len(head)}", head + body)
    else:
        for n, x in objs.items():
            out += f"{n} 0 obj {x} endobj\n".encode("latin-1")
    for n, (about, data) in streams.items():
        z = zlib.compress(data)
        out += f"{n} 0 obj <<{about}/Filter/FlateDecode/Length {len(z)}>> stream\n".encode() + z + b"\nendstream endobj\n"
    return out + f"trailer <</Root 1 0 R{extra}>>".encode()


def rows(data, *kinds):
    return [r for r in pdf.file_rows(data) if r["kind"] in kinds]


BODY = "BT /F 10 Tf 12 TL 20 250 Td (One line) Tj T* (and more) Tj ET BT /F 10 Tf 20 200 Td (far) Tj 100 0 Td (side) Tj ET"


@pytest.mark.parametrize("packed", [False, True])
def test_blocks(packed):
    got = [(r["text"], r["x0"], round(r["y0"], 6), r["x1"], round(r["y1"], 6), r["level"]) for r in rows(document([BODY], packed=packed), "Text")]
    assert got == [("One line\nand more", 20, 42, 60, 64, False), ("far", 20, 92, 35, 102, True), ("side", 120, 92, 140, 102, True)]


def test_text_of_glyphs_and_operators():
    data = document(["BT /F 10 Tf 20 250 Td <0102030441> Tj ET", "BT /F 10 Tf 20 250 Td [(a) -400 (b) -30 (c)] TJ ET", r"BT /F 10 Tf 14 TL 20 250 Td (x\(\)\101\n) Tj (y) ' ET", "/X Do", "q 40 0 0 20 10 10 cm /I Do Q BI /W 1 /H 1 ID \x01\x02 EI BT /F 10 Tf 1 1 Td (z) Tj ET"])
    assert [r["text"] for r in rows(data, "Text")] == ["éfi中αA", "a bc", "x()A\n\ny", "form", "z"]
    form = rows(data, "Text")[3]
    assert (form["x0"], form["y1"]) == (10, 252)
    images = rows(data, "Image")
    assert [(r["x0"], r["y0"], r["x1"], r["y1"], r.get("ext")) for r in images if r["x1"] > 1] == [(10, 270, 50, 290, "png")]
    assert images[-1]["image"] is None or images[-1]["image"][:4] == b"\x89PNG"
    assert len(images) == 2
    told = json.loads(rows(data, "Text")[0]["lines"])[0]
    assert told["dir"] == [1, 0] and told["spans"][0]["font"] == "Body" and told["spans"][0]["origin"] == [20, 50]


def test_wide_codes():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0005> <0041> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <D83DDE00>] endbfrange"
    objects = {3: "<</Type/Font/Subtype/Type0/BaseFont/B/Encoding/Identity-H/DescendantFonts[8 0 R]/ToUnicode 9 0 R>>", 8: "<</Subtype/CIDFontType2/DW 1000/W[5[250] 16 18 500]>>", 9: f"<</Length {len(cmap)}>> stream\n{cmap.decode()}\nendstream"}
    r = rows(document(["BT /F 10 Tf 0 100 Td <0005001000120021> Tj ET"], objects=objects), "Text")[0]
    assert r["text"] == "Aac\U0001f600" and r["x1"] == 22.5


def test_turned_pages_and_lines():
    r = rows(document([BODY], rotate=90), "Page", "Text")
    assert (r[0]["width"], r[0]["height"]) == (300, 200)
    assert {x["text"] for x in r[1:]} >= {"far", "side"} and not any(x["level"] for x in r[1:])
    data = document(["10 10 m 100 10 l S 20 20 50 30 re S 0 0 m 50 50 l S 5 5 10 0.5 re f 1 1 m 2 2 l n"])
    assert [(r["orient"], r["lo"], r["hi"], r["at"]) for r in rows(data, "Line")] == [("h", 10, 100, 290), ("h", 20, 70, 250), ("h", 20, 70, 280), ("v", 250, 280, 20), ("v", 250, 280, 70)]
    assert len(rows(data, "Drawing")) == 4


def test_predictors():
    assert pdf.unpredicted(b"\2\1\2\2\1\1", {"Predictor": 12, "Columns": 2}) == b"\1\2\2\3"
    assert pdf.unpredicted(b"\1\1\1", {"Predictor": 2, "Columns": 3}) == b"\1\2\3"
    assert pdf.unpredicted(b"\4\5\1\4\1\1", {"Predictor": 15, "Columns": 2}) == b"\5\6\6\7"


def test_files_that_cannot_be_read(spark, tmp_path):
    loop = "/Kids[2 0 R]"
    for name, data in (("a.pdf", b"nothing"), ("b.pdf", document([BODY], extra="/Encrypt 9 0 R")), ("c.pdf", b"%PDF-1.7"), ("d.pdf", f"%PDF-1.4 1 0 obj <</Pages 2 0 R>> endobj 2 0 obj <<{loop}>> endobj trailer <</Root 1 0 R>>".encode()), ("e.PDF", document([BODY])[:400])):
        (tmp_path / name).write_bytes(data)
    got = {r["doc"]: r["kind"] for r in pdf.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "error", "b.pdf": "error", "c.pdf": "error", "d.pdf": "error", "e.PDF": "error"}


PAGES = [
    "BT /F 10 Tf 20 250 Td (1 Start) Tj ET BT /F 10 Tf 20 220 Td (Start here) Tj ET BT /F 10 Tf 20 180 Td (1.1 Inner part) Tj ET BT /F 10 Tf 20 140 Td (body text) Tj ET",
    "BT /F 10 Tf 120 100 Td (right) Tj ET BT /F 10 Tf 20 102 Td (left) Tj ET q 40 0 0 20 10 30 cm /I Do Q BT /F 10 Tf 20 10 Td (Figure 1. dots) Tj ET",
]
OUTLINE = [(2, 1, "Start", "[20 0 R /XYZ 20 260 null]"), (0, 0, "Inner  part", "[20 0 R /Fit]"), (0, 3, "Nowhere", "[22 0 R /Fit]"), (0, 0, "left", "[22 0 R /Fit]")]


def test_graph(spark, tmp_path):
    (tmp_path / "g.pdf").write_bytes(document(PAGES, OUTLINE))
    nodes, edges = cli.build(spark, str(tmp_path))
    text = {r["id"]: r["text"] or r["type"] for r in nodes.collect()}
    got = {(r["type"], text[r["source"]], text[r["target"]]) for r in edges.collect()}
    top = "Artifact"
    assert got == {("PARENT_OF", "File", top), ("PARENT_OF", top, "1 Start"), ("PARENT_OF", top, "Start here"), ("PARENT_OF", "1 Start", "1.1 Inner part"), ("PARENT_OF", top, "body text"), ("PARENT_OF", top, "left"), ("PARENT_OF", top, "right"), ("PARENT_OF", top, "Image"), ("PARENT_OF", top, "Figure 1. dots"), ("CAPTION_OF", "Figure 1. dots", "Image")}
    inside = nodes.where("type in ('Text', 'Image')").orderBy("ord").collect()
    assert [text[r["id"]] for r in inside] == ["1 Start", "Start here", "1.1 Inner part", "body text", "left", "right", "Image", "Figure 1. dots"]
    assert [r["page_index"] for r in inside] == [0] * 4 + [1] * 4
    assert tuple(inside[0]["bbox"]) == (100, 140, 275, 173)
    assert graph.problems(nodes, edges).count() == 0


def test_pieces_of_a_line_are_joined(spark, tmp_path):
    far = lambda x, t: f"BT /F 10 Tf {x} 100 Td ({t}) Tj ET "
    (tmp_path / "j.pdf").write_bytes(document([far(60, "last") + far(20, "first"), far(60, "tail") + far(38, "head"), far(60, "tail") + "59 90 1 20 re f " + far(38, "head")]))
    got = pdf.nodes_of(pdf.read_files(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r["page_index"], r["text"]) for r in got] == [(0, "first"), (0, "last"), (1, "head tail"), (2, "head"), (2, "tail")]


def test_regions(spark, tmp_path):
    rules = "".join(f"20 {y} m 180 {y} l S " for y in (50, 100, 150))
    dots = "".join(f"{20 + 5 * (i % 11)} {200 + 5 * (i // 11)} 3 3 re f " for i in range(110))
    (tmp_path / "r.pdf").write_bytes(document([rules, dots]))
    raw = pdf.read_files(spark, str(tmp_path))
    assert [(r["page"][-2:], r["mode"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in pdf.table_regions(raw.where("page = 0")).collect()] == [("#0", "ruled_rows", 18, 148, 182, 252)]
    assert [(r["page"][-2:], r["n"], tuple(r["bbox"])) for r in pdf.figure_regions(raw).collect()] == [("#1", 110, (20, 52, 73, 100))]


def test_no_files(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"x")
    raw = pdf.read_files(spark, str(tmp_path))
    assert pdf.nodes_of(raw).count() == 0 and pdf.tree(raw, pdf.nodes_of(raw)).count() == 0
