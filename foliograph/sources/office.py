"""Office files as raw rows: one task reads whole files, everything after is relational.

``read_files`` gives a row for each block, cell or shape, in file order, with what the operators need; ``nodes_of`` makes
graph nodes of them. Only the standard library is used. A file that can't be read is a row of kind
'error' and fails nothing else.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import display
from ..operators import graph, sheets
from ..operators.geometry import box

W_ = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A_ = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P_ = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S_ = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R_ = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SUPPORTED = ("docx", "pptx", "xlsx")

RAW = "path string, doc string, part int, part_name string, ord int, kind string, text string, grid array<array<string>>, level int, is_toc boolean, list_num_id int, list_level int, bookmarks array<string>, links array<string>, image_path string, image binary, x0 double, y0 double, x1 double, y1 double, width double, height double, row int, col int"
COLUMNS = [c.split()[0] for c in re.sub(r"<[^,]*>", "", RAW).split(", ")]


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship ids of a part, as paths in the package."""
    at = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if at not in z.namelist():
        return {}
    base = posixpath.dirname(part)
    return {r.get("Id"): r.get("Target").lstrip("/") if r.get("Target").startswith("/") else posixpath.normpath(posixpath.join(base, r.get("Target"))) for r in ET.fromstring(z.read(at)) if r.get("TargetMode") != "External"}


def _number(e, name: str) -> int | None:
    v = None if e is None else e.get(name)
    return int(v) if v is not None and re.fullmatch(r"-?\d+", v) else None


# Text documents


class Styles:
    """Outline levels of paragraph styles, through what they are based on."""

    def __init__(self, z: zipfile.ZipFile):
        self.base, self.level = {}, {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{W_}style"):
                name = s.get(f"{W_}styleId")
                based = s.find(f"{W_}basedOn")
                self.base[name] = None if based is None else based.get(f"{W_}val")
                own = s.find(f"{W_}pPr/{W_}outlineLvl")
                if own is not None:
                    self.level[name] = _number(own, f"{W_}val")

    def outline(self, name: str | None) -> int | None:
        seen = set()
        while name and name not in seen:
            seen.add(name)
            if name in self.level:
                lv = self.level[name]
                return lv if lv is not None and 0 <= lv <= 8 else None
            name = self.base.get(name)
        return None


def blocks(body) -> Iterator:
    """Paragraphs and tables in order; content controls are entered, tables aren't."""
    for e in body:
        if e.tag in (f"{W_}p", f"{W_}tbl"):
            yield e
        elif e.tag == f"{W_}sdt":
            inner = e.find(f"{W_}sdtContent")
            if inner is not None:
                yield from blocks(inner)


def inline_text(p) -> str:
    """The text of a paragraph's own runs, without that of text boxes in it."""
    out = []

    def walk(e):
        for c in e:
            if c.tag == f"{W_}t":
                out.append(c.text or "")
            elif c.tag == f"{W_}tab":
                out.append("\t")
            elif c.tag in (f"{W_}br", f"{W_}cr"):
                out.append("\n")
            elif c.tag.endswith("}txbxContent") or c.tag == f"{W_}pPr":
                continue
            else:
                walk(c)

    walk(p)
    return "".join(out).strip()


def in_contents(p, fields: list[str]) -> bool:
    """Whether a paragraph lies in a table of contents; fields are those open when it begins, and are kept up to date."""
    toc = lambda: any(re.match(r"(?i)^\s*TOC(\s|$)", f) for f in fields)
    found = toc()
    for e in p.iter():
        if e.tag == f"{W_}fldChar":
            kind = e.get(f"{W_}fldCharType")
            if kind == "begin":
                fields.append("")
            elif kind == "end" and fields:
                fields.pop()
        elif e.tag == f"{W_}instrText" and fields:
            fields[-1] += e.text or ""
        elif e.tag == f"{W_}fldSimple" and re.match(r"(?i)^\s*TOC(\s|$)", e.get(f"{W_}instr") or ""):
            found = True
        found = found or toc()
    return found


def docx_rows(data: bytes) -> Iterator[dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    rels, styles, fields = relations(z, "word/document.xml"), Styles(z), []
    body = ET.fromstring(z.read("word/document.xml")).find(f"{W_}body")
    for e in blocks(body):
        if e.tag == f"{W_}tbl":
            grid = [["\n".join(inline_text(p) for p in c.iter(f"{W_}p")).strip() for c in r.findall(f"{W_}tc")] for r in e.findall(f"{W_}tr")]
            yield {"kind": "Table", "grid": grid}
            continue
        toc = in_contents(e, fields)
        blip = next(e.iter(f"{A_}blip"), None)
        if blip is not None and (target := rels.get(blip.get(f"{R_}embed"))) in z.namelist():
            yield {"kind": "Image", "image_path": target, "image": z.read(target)}
        text = inline_text(e)
        if not text:
            continue
        ppr = e.find(f"{W_}pPr")
        get = lambda path: None if ppr is None else ppr.find(path)  # noqa: B023, E731
        style = get(f"{W_}pStyle")
        own = get(f"{W_}outlineLvl")
        level = styles.outline(None if style is None else style.get(f"{W_}val"))
        if own is not None:
            level = lv if (lv := _number(own, f"{W_}val")) is not None and 0 <= lv <= 8 else None
        num, lvl = _number(get(f"{W_}numPr/{W_}numId"), f"{W_}val"), _number(get(f"{W_}numPr/{W_}ilvl"), f"{W_}val")
        if num is None or lvl is None or num <= 0 or not 0 <= lvl <= 8:
            num = lvl = None
        marks = [b.get(f"{W_}name") for b in e.iter(f"{W_}bookmarkStart")]
        links = [h.get(f"{W_}anchor") for h in e.iter(f"{W_}hyperlink") if h.get(f"{W_}anchor")]
        yield {"kind": "Text", "text": text, "level": level, "is_toc": toc, "list_num_id": num, "list_level": lvl, "bookmarks": list(dict.fromkeys(marks)), "links": list(dict.fromkeys(links))}


# Slides


def pptx_rows(data: bytes) -> Iterator[dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    top, rels = ET.fromstring(z.read("ppt/presentation.xml")), relations(z, "ppt/presentation.xml")
    size = top.find(f"{P_}sldSz")
    width, height = float(size.get("cx")), float(size.get("cy"))
    for i, s in enumerate(top.iter(f"{P_}sldId")):
        part = rels[s.get(f"{R_}id")]
        own = relations(z, part)
        shapes: list[dict] = []

        def walk(tree, sx, sy, dx, dy, own=own, shapes=shapes):
            for e in tree:
                if e.tag == f"{P_}grpSp":
                    f = e.find(f"{P_}grpSpPr/{A_}xfrm")
                    at = lambda n, a, f=f: float(f.find(f"{A_}{n}").get(a)) if f is not None and f.find(f"{A_}{n}") is not None else 0.0
                    gx, gy = (at("ext", "cx") / at("chExt", "cx") if at("chExt", "cx") else 1.0), (at("ext", "cy") / at("chExt", "cy") if at("chExt", "cy") else 1.0)
                    walk(e, sx * gx, sy * gy, dx + sx * (at("off", "x") - gx * at("chOff", "x")), dy + sy * (at("off", "y") - gy * at("chOff", "y")))
                    continue
                f = e.find(f"{P_}spPr/{A_}xfrm") if e.find(f"{P_}spPr/{A_}xfrm") is not None else e.find(f"{P_}xfrm")
                row: dict = {}
                if f is not None and f.find(f"{A_}off") is not None:
                    x, y = float(f.find(f"{A_}off").get("x")), float(f.find(f"{A_}off").get("y"))
                    w, h = float(f.find(f"{A_}ext").get("cx")), float(f.find(f"{A_}ext").get("cy"))
                    row = {"x0": dx + sx * x, "y0": dy + sy * y, "x1": dx + sx * (x + w), "y1": dy + sy * (y + h)}
                table = next(e.iter(f"{A_}tbl"), None)
                paragraphs = lambda t: "\n".join("".join(x.text or "" for x in p.iter(f"{A_}t")) for p in t.iter(f"{A_}p")).strip()
                if table is not None:
                    shapes.append(row | {"kind": "Table", "grid": [[paragraphs(c) for c in r.findall(f"{A_}tc")] for r in table.findall(f"{A_}tr")]})
                elif e.tag == f"{P_}pic":
                    target = own.get(next(e.iter(f"{A_}blip")).get(f"{R_}embed"))
                    shapes.append(row | {"kind": "Image", "image_path": target, "image": z.read(target) if target in z.namelist() else None})
                elif e.find(f"{P_}txBody") is not None and (text := paragraphs(e.find(f"{P_}txBody"))):
                    shapes.append(row | {"kind": "Text", "text": text})

        walk(ET.fromstring(z.read(part)).find(f"{P_}cSld/{P_}spTree"), 1.0, 1.0, 0.0, 0.0)
        shapes.sort(key=lambda r: (r.get("y0") or 0.0, r.get("x0") or 0.0))  # stable: z-order among equals
        for r in shapes or [{"kind": "Empty"}]:
            yield r | {"part": i, "part_name": f"Slide {i + 1}", "width": width, "height": height}


# Sheets

# The number formats that files refer to without stating them.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm"}
BUILT_IN |= {37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@"}


def is_date(fmt: str | None) -> bool:
    """Whether a format shows a date or a time: one of its letters stands outside quotes, escapes and brackets other than of hours."""
    bare = re.sub(r'"[^"]*"?|\\.|_.|\[(?!(?:h+|m+|s+)\])[^\]]*\]', "", (fmt or "").split(";")[0], flags=re.I)
    return bare.lower() != "general" and re.search(r"[dmyhs]", bare, re.I) is not None


def moment(days: float, since_1904: bool):
    """A date, time or both, of a serial number; a number under 1 is a time of day."""
    at = pd.Timestamp("1904-01-01" if since_1904 else "1899-12-30") + pd.Timedelta(days=days).round("ms")
    return at.to_pydatetime().time() if 0 <= days < 1 else at.to_pydatetime()


def place(ref: str) -> tuple[int, int]:
    """(row, column) of 'B3', from 1."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def xlsx_rows(data: bytes) -> Iterator[dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    strings = ["".join(t.text or "" for t in si.iter(f"{S_}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    formats: list[str | None] = []
    if "xl/styles.xml" in names:
        styles = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{S_}numFmt")}
        xfs = styles.find(f"{S_}cellXfs")
        formats = [own.get(i, BUILT_IN.get(i)) for i in (int(x.get("numFmtId") or 0) for x in (xfs if xfs is not None else []))]
    sides: list[str] = []  # of each cell style, the sides that have a border
    if "xl/styles.xml" in names:
        borders = [b for b in (styles.find(f"{S_}borders") or [])]
        drawn = ["".join(side[0] for side in ("top", "left", "bottom", "right") if (e := b.find(f"{S_}{side}")) is not None and e.get("style") not in (None, "none")) for b in borders]
        sides = [drawn[k] if (k := int(x.get("borderId") or 0)) < len(drawn) else "" for x in (xfs if xfs is not None else [])]
    rels = relations(z, "xl/workbook.xml")
    book = ET.fromstring(z.read("xl/workbook.xml"))
    since_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{S_}workbookPr"))
    for i, s in enumerate(book.iter(f"{S_}sheet")):
        base = {"part": i, "part_name": s.get("name")}
        part = rels[s.get(f"{R_}id")]
        sheet = ET.fromstring(z.read(part))
        for c in sheet.iter(f"{S_}c"):
            v, kind = c.find(f"{S_}v"), c.get("t")
            style = int(c.get("s") or 0)
            if style < len(sides) and sides[style]:
                r, col = place(c.get("r"))
                yield base | {"kind": "Border", "text": sides[style], "row": r, "col": col}
            text = "".join(t.text or "" for t in c.iter(f"{S_}t")) if kind == "inlineStr" else None if v is None else v.text
            if text is None or text == "":
                continue
            if kind == "s":
                text = strings[int(text)]
            elif kind == "b":
                text = str(text == "1")
            elif kind in (None, "n"):
                fmt = formats[style] if style < len(formats) else None
                text = display(moment(float(text), since_1904) if is_date(fmt) else float(text), fmt)
            r, col = place(c.get("r"))
            yield base | {"kind": "Cell", "text": text, "row": r, "col": col}
        for m in sheet.iter(f"{S_}mergeCell"):
            (r0, c0), (r1, c1) = (place(x) for x in (m.get("ref").split(":") * 2)[:2])
            yield base | {"kind": "Merge", "text": m.get("ref"), "row": r0, "col": c0, "x0": float(r0), "y0": float(c0), "x1": float(r1), "y1": float(c1)}
        for target in relations(z, part).values():
            if "/tables/" in f"/{target}" and target in names:
                t = ET.fromstring(z.read(target))
                a, b = (place(x) for x in t.get("ref").split(":"))
                yield base | {"kind": "TableRange", "text": t.get("displayName") or t.get("name"), "row": a[0], "col": a[1], "x0": float(a[0]), "y0": float(a[1]), "x1": float(b[0]), "y1": float(b[1])}


READERS = {"docx": docx_rows, "pptx": pptx_rows, "xlsx": xlsx_rows}


def parsed(files: DataFrame) -> DataFrame:
    """Raw rows of files (path, content), by their suffix whatever its case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                suffix = path.rpartition(".")[2].lower()
                base = {"path": path, "doc": posixpath.basename(path), "part": 0, "part_name": "doc"}
                try:
                    if suffix not in READERS:
                        raise ValueError(f"unsupported suffix .{suffix}; supported are {', '.join(SUPPORTED)}")
                    rows = [base | r for r in READERS[suffix](bytes(content))]
                except Exception as e:  # one bad file must not fail the job
                    rows = [base | {"kind": "error", "text": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame([r | {"ord": i} for i, r in enumerate(rows)], columns=COLUMNS).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, RAW)


def read_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw rows of all files under a path; with stream, of files as they arrive."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    return parsed(reader.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def nodes_of(raw: DataFrame) -> DataFrame:
    """Content nodes of text documents and slides, with ids counted by kind in their scope, and normalised boxes."""
    content = raw.where(F.col("kind").isin("Text", "Table", "Image"))
    artifact = F.concat(F.lit("artifact:"), "doc", F.lit(":"), F.when(F.lower("path").endswith(".pptx"), F.concat(F.lit("slide"), F.col("part").cast("string"))).otherwise("doc"))
    number = F.row_number().over(W.partitionBy("path", "part", "kind").orderBy("ord")) - 1
    tag = F.when(F.col("kind") == "Text", "txt").when(F.col("kind") == "Table", "tbl").otherwise("img")
    ident = F.concat(F.lit("content:"), "doc", F.lit(":"), F.col("part").cast("string"), F.lit(":"), tag, number.cast("string"))
    unit = lambda c, side: F.rint(F.col(c) / F.col(side) * 1000)
    bbox = F.when(F.col("x0").isNotNull(), box(unit("x0", "width"), unit("y0", "height"), unit("x1", "width"), unit("y1", "height")))
    return content.select(F.col("path").alias("doc"), artifact.alias("artifact"), "ord", ident.alias("id"), F.col("kind").alias("type"), "text", "grid", "level", F.coalesce("is_toc", F.lit(False)).alias("is_toc"), "list_num_id", "list_level", "bookmarks", "links", "image_path", bbox.alias("bbox"))


def sheet_nodes(raw: DataFrame) -> DataFrame:
    """Nodes of sheets: tables with their grids, and texts of the cells outside them, numbered in each file by sheet and place."""
    cells, ranges = cells_of(raw), sheets.table_ranges(ranges_of(raw, "TableRange"), sheets.border_tables(borders_of(raw)))
    names = raw.where("kind in ('Cell', 'TableRange', 'Border')").select(sheet_key().alias("sheet"), F.col("path").alias("doc"), F.col("doc").alias("file"), "part", "part_name").distinct()
    tables = sheets.table_grids(cells, ranges).select("sheet", F.lit("Table").alias("type"), sheets.range_name(F.col("name")).alias("name"), F.lit(None).cast("string").alias("text"), "grid", F.col("r0").alias("row"), F.col("c0").alias("col"))
    texts = sheets.text_components(cells, ranges).select("sheet", F.lit("Text").alias("type"), F.lit(None).cast("string").alias("name"), "text", F.lit(None).cast("array<array<string>>").alias("grid"), "row", "col")
    out = tables.unionByName(texts).join(names, "sheet")
    number = F.row_number().over(W.partitionBy("doc", "type").orderBy("part", "row", "col"))
    order = F.row_number().over(W.partitionBy("doc", "part").orderBy("row", "col", "type")) - 1
    ident = F.concat(F.lit("content:"), "file", F.lit(":s"), F.col("part").cast("string"), F.lit(":"), F.when(F.col("type") == "Table", "tbl").otherwise("txt"), number.cast("string"))
    artifact = F.concat(F.lit("artifact:"), "file", F.lit(":sheet"), F.col("part").cast("string"))
    return out.select("doc", artifact.alias("artifact"), order.cast("int").alias("ord"), ident.alias("id"), "type", "name", "text", "grid", F.lit(None).cast("int").alias("level"), F.lit(False).alias("is_toc"), "row", "col")


def containers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(File and Artifact nodes, the edges between them): a file over its text, slides or sheets, and slides one after the other."""
    kind = F.lower(F.element_at(F.split("path", "[.]"), -1))
    scope = F.when(kind == "pptx", F.concat(F.lit("slide"), F.col("part").cast("string"))).when(kind == "xlsx", F.concat(F.lit("sheet"), F.col("part").cast("string"))).otherwise("doc")
    parts = raw.where("kind <> 'error'").select(F.col("path").alias("doc"), F.col("doc").alias("file"), "part", "part_name", scope.alias("scope"), kind.alias("kind")).distinct()
    arts = parts.groupBy("doc", "file", "scope", "kind").agg(F.min("part").alias("ord"), F.min("part_name").alias("name"))
    arts = arts.withColumn("id", F.concat(F.lit("artifact:"), "file", F.lit(":"), "scope"))
    files = raw.select(F.col("path").alias("doc"), F.col("doc").alias("file")).distinct().select("doc", F.lit(0).alias("ord"), F.concat(F.lit("file:"), "file").alias("id"), F.lit("File").alias("type"), F.col("file").alias("name"))
    nodes = files.unionByName(arts.select("doc", "ord", "id", F.lit("Artifact").alias("type"), "name"))
    under = arts.select("doc", F.lit("PARENT_OF").alias("type"), F.concat(F.lit("file:"), "file").alias("source"), F.col("id").alias("target"))
    return nodes, under.unionByName(graph.next_edges(arts.where("kind = 'pptx'").select("doc", "ord", "id")))


def bookmark_references(nodes: DataFrame) -> DataFrame:
    """Internal links to bookmarks that one node alone has: rows (doc, type, source, target)."""
    marks = nodes.select("doc", "id", F.explode("bookmarks").alias("mark")).distinct()
    one = marks.groupBy("doc", "mark").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1").drop("n")
    links = nodes.select("doc", F.col("id").alias("source"), F.explode("links").alias("mark"))
    return links.join(one, ["doc", "mark"]).where("source <> target").select("doc", F.lit("REFERENCES").alias("type"), "source", "target").distinct()


def sheet_key() -> Column:
    return F.concat_ws("#", "path", F.col("part").cast("string"))


def cells_of(raw: DataFrame) -> DataFrame:
    return raw.where("kind = 'Cell'").select(sheet_key().alias("sheet"), "row", "col", F.col("text").alias("value"))


def ranges_of(raw: DataFrame, kind: str) -> DataFrame:
    """Declared tables ('TableRange') or merged cells ('Merge') as (sheet, name, r0, c0, r1, c1)."""
    c = lambda n: F.col(n).cast("int")
    return raw.where(F.col("kind") == kind).select(sheet_key().alias("sheet"), F.col("text").alias("name"), c("x0").alias("r0"), c("y0").alias("c0"), c("x1").alias("r1"), c("y1").alias("c1"))


def table_ranges_of(raw: DataFrame) -> DataFrame:
    return ranges_of(raw, "TableRange")


def borders_of(raw: DataFrame) -> DataFrame:
    side = lambda s: F.contains("text", F.lit(s[0])).alias(s)
    return raw.where("kind = 'Border'").select(sheet_key().alias("sheet"), "row", "col", *map(side, ("top", "left", "bottom", "right")))
