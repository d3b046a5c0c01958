"""Slide archives (zip files of XML): shapes in nested groups, tables as cells, speaker notes."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespaces of the file format.
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: What a file raises that is no slide archive, or one with parts missing, damaged or encrypted.
BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, AttributeError, EOFError, IndexError, KeyError, RuntimeError, TypeError, ValueError)
SCHEMA = "path string, slide int, kind string, block_id string, row int, col int, text string, left long, top long, width long, height long"


def read_decks(spark: SparkSession, path: str, pattern: str = "*.pptx") -> DataFrame:
    """The blocks of all slide archives below path, see blocks; deck_id is the file's name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return blocks(files).withColumn("deck_id", F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1))


def blocks(files: DataFrame) -> DataFrame:
    """A row for each block of the archives in files (path, content): kind text, cell (row and col from 0) or notes, in slides counted
    from 1. Blank blocks are left out, a box without a place of its own has nulls. What is no slide archive, or null, is one row of
    kind broken with the reason as its text. An archive is opened alone, and its slides one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                try:
                    rows = list(slide_rows(content.as_py()))
                except BROKEN as e:
                    rows = [{"kind": "broken", "text": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([{"path": path.as_py()} | r for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = files.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)
    return files.select("path", "content").mapInArrow(run, schema)


def links(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """What a part of the archive points to: id -> (last word of the type, part)."""
    folder, name = posixpath.split(part)
    try:
        found = ElementTree.fromstring(archive.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    inner = [x for x in found if x.get("TargetMode") != "External"]
    return {x.get("Id"): (x.get("Type").rsplit("/", 1)[1], posixpath.normpath(posixpath.join("/", folder, x.get("Target"))).lstrip("/")) for x in inner}


def slide_rows(content: bytes) -> Iterator[dict]:
    archive = zipfile.ZipFile(io.BytesIO(content))
    deck = "ppt/presentation.xml"
    targets = links(archive, deck)
    for n, entry in enumerate(ElementTree.fromstring(archive.read(deck)).iter(f"{SLIDES}sldId"), 1):
        part = targets[entry.get(f"{LINKS}id")][1]
        for shape in shapes(ElementTree.fromstring(archive.read(part)).find(f".//{SLIDES}spTree")):
            yield from shape_rows(shape, n)
        for kind, notes in links(archive, part).values():
            if kind == "notesSlide" and (text := notes_text(ElementTree.fromstring(archive.read(notes)))):
                yield {"slide": n, "kind": "notes", "block_id": f"{n}:notes", "text": text}


def shapes(tree: ElementTree.Element | None) -> Iterator[ElementTree.Element]:
    """Boxes and frames in drawing order; a group gives what is in it, however deep."""
    open_groups = [iter(tree if tree is not None else ())]
    while open_groups:
        shape = next(open_groups[-1], None)
        if shape is None:
            open_groups.pop()
        elif shape.tag == f"{SLIDES}grpSp":
            open_groups.append(iter(shape))
        elif shape.tag in (f"{SLIDES}sp", f"{SLIDES}graphicFrame"):
            yield shape


def shape_rows(shape: ElementTree.Element, n: int) -> Iterator[dict]:
    block = f"{n}:{shape.find(f'./*/{SLIDES}cNvPr').get('id')}"
    table = shape.find(f".//{DRAWING}tbl")
    if table is not None:
        for r, row in enumerate(table.findall(f"{DRAWING}tr")):
            for c, cell in enumerate(row.findall(f"{DRAWING}tc")):
                if text := "\n".join(paragraphs(cell.find(f"{DRAWING}txBody"), False)).strip():
                    yield {"slide": n, "kind": "cell", "block_id": block, "row": r, "col": c, "text": text}
    elif text := "\n".join(t for p in paragraphs(shape.find(f"{SLIDES}txBody"), True) if (t := p.strip())):
        yield {"slide": n, "kind": "text", "block_id": block, "text": text} | place(shape)


def place(shape: ElementTree.Element) -> dict:
    frame = shape.find(f"{SLIDES}spPr/{DRAWING}xfrm")
    corner, size = (frame.find(f"{DRAWING}off"), frame.find(f"{DRAWING}ext")) if frame is not None else (None, None)
    if corner is None or size is None:
        return {}
    return {"left": int(corner.get("x")), "top": int(corner.get("y")), "width": int(size.get("cx")), "height": int(size.get("cy"))}


def paragraphs(body: ElementTree.Element | None, runs_only: bool) -> Iterator[str]:
    """The text of each paragraph: that of its runs; with breaks and fields where it has no run, or runs_only is false."""
    for p in body.findall(f"{DRAWING}p") if body is not None else ():
        runs = p.findall(f"{DRAWING}r")
        parts = runs if runs and runs_only else [x for x in p if x.tag in (f"{DRAWING}r", f"{DRAWING}fld", f"{DRAWING}br")]
        yield "".join("\v" if x.tag == f"{DRAWING}br" else x.findtext(f"{DRAWING}t", "") for x in parts)


def notes_text(notes: ElementTree.Element) -> str:
    """The text of the notes' body placeholder."""
    for shape in notes.iter(f"{SLIDES}sp"):
        mark = shape.find(f".//{SLIDES}ph")
        if mark is not None and mark.get("type") == "body":
            return "\n".join(paragraphs(shape.find(f"{SLIDES}txBody"), False)).strip()
    return ""
