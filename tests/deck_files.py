"""Slide archives for tests."""

import io
import zipfile

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def body(*paragraphs: str) -> str:
    return "".join(f"<a:p>{p}</a:p>" for p in paragraphs)


def run(text: str) -> str:
    return f"<a:r><a:t>{text}</a:t></a:r>"


def box(number: int, *paragraphs: str, at: str = "", mark: str = "") -> str:
    return f'<p:sp><p:nvSpPr><p:cNvPr id="{number}" name="b"/><p:cNvSpPr/><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:spPr>{at}</p:spPr><p:txBody><a:bodyPr/>{body(*paragraphs)}</p:txBody></p:sp>'


def place(x: int, y: int, w: int, h: int) -> str:
    return f'<a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{w}" cy="{h}"/></a:xfrm>'


def group(*inner: str) -> str:
    return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="90" name="g"/></p:nvGrpSpPr><p:grpSpPr/>{"".join(inner)}</p:grpSp>'


def table(number: int, rows: list[list[str]]) -> str:
    cells = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody>{body(run(c))}</a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="{number}" name="t"/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl>{cells}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def links(targets: list[tuple[str, str, str]]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{KIND}{kind}" Target="{to}"/>' for i, kind, to in targets)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def archive(slides: list[tuple[str, str | None]]) -> bytes:
    """An archive of (shapes, notes) in this order, its files numbered the other way round."""
    out, n = io.BytesIO(), len(slides)
    with zipfile.ZipFile(out, "w") as z:
        ids = "".join(f'<p:sldId id="{256 + i}" r:id="r{i}"/>' for i in range(n))
        z.writestr("ppt/presentation.xml", f"<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
        z.writestr("ppt/_rels/presentation.xml.rels", links([(f"r{i}", "slide", f"slides/slide{n - i}.xml") for i in range(n)]))
        for i, (shapes, notes) in enumerate(slides):
            z.writestr(f"ppt/slides/slide{n - i}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>")
            if notes is not None:
                z.writestr(f"ppt/slides/_rels/slide{n - i}.xml.rels", links([("r1", "notesSlide", f"../notesSlides/n{i}.xml")]))
                number, text = box(2, run("7"), mark='<p:ph type="sldNum"/>'), box(3, run(notes), mark='<p:ph type="body"/>')
                z.writestr(f"ppt/notesSlides/n{i}.xml", f"<p:notes {NS}><p:cSld><p:spTree>{number}{text}</p:spTree></p:cSld></p:notes>")
    return out.getvalue()
