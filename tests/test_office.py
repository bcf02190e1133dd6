"""Formulas, image marks and tables of office files."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pytest

from studylake.sources import office

NS = "xmlns:w='w' xmlns:m='m' xmlns:a='a' xmlns:p='p' xmlns:v='v' xmlns:d='d' xmlns:r='http://r'"


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def rels(**targets):
    return "<R>" + "".join(f"<Relationship Id='{k}' Target='{t}'/>" for k, t in targets.items()) + "</R>"


def read(spark, tmp_path, **files):
    for name, entries in files.items():
        (tmp_path / name).write_bytes(entries if isinstance(entries, bytes) else _zip(entries))
    return {r["path"].rsplit("/", 1)[1]: r for r in office.read_documents(spark, str(tmp_path)).collect()}


def r(x):
    return f"<m:r><m:t>{x}</m:t></m:r>"


@pytest.mark.parametrize(
    ("xml", "want"),
    [
        (f"<m:f><m:fPr><m:type m:val='lin'/></m:fPr><m:num>{r(1)}</m:num><m:den>{r(2)}</m:den></m:f>", "1/2"),
        (f"<m:f><m:fPr><m:type m:val='noBar'/></m:fPr><m:num>{r('n')}</m:num><m:den>{r('k')}</m:den></m:f>", r"\binom{n}{k}"),
        (f"<m:f><m:num>{r(1)}</m:num><m:den><m:rad><m:deg/><m:e>{r('x')}</m:e></m:rad></m:den></m:f>", r"\frac{1}{\sqrt{x}}"),
        (f"<m:sSubSup><m:e>{r('a')}</m:e><m:sub>{r('i')}</m:sub><m:sup>{r(2)}</m:sup></m:sSubSup>", "{a}_{i}^{2}"),
        (f"<m:nary><m:sub>{r(0)}</m:sub><m:sup/><m:e>{r('x')}</m:e></m:nary>", r"\int_{0}{x}"),
        (f"<m:d><m:dPr><m:begChr m:val='{{'/><m:endChr m:val=''/></m:dPr><m:e>{r('x')}</m:e><m:e>{r('y')}</m:e></m:d>", r"\left\{x|y\right."),
        (f"<m:func><m:fName>{r('sin')}</m:fName><m:e>{r('θ')}</m:e></m:func>", "\\sin \\theta "),
        (f"<m:limLow><m:e>{r('lim')}</m:e><m:lim>{r('x→0')}</m:lim></m:limLow>", r"\lim_{x\to 0}"),
        (f"<m:acc><m:accPr><m:chr m:val='&#x20d7;'/></m:accPr><m:e>{r('v')}</m:e></m:acc>", r"\vec{v}"),
        (f"<m:bar><m:barPr><m:pos m:val='top'/></m:barPr><m:e>{r('AB')}</m:e></m:bar>", r"\overline{AB}"),
        (f"<m:eqArr><m:e>{r('x=1')}</m:e><m:e>{r('y≥2')}</m:e></m:eqArr>", r"\begin{aligned}x=1 \\ y\ge 2\end{aligned}"),
        (f"<m:box><m:e>{r('kept')}</m:e></m:box>", "kept"),
    ],
)
def test_formulas(xml, want):
    assert office.latex(ElementTree.fromstring(f"<m:oMath {NS}>{xml}</m:oMath>")) == want


def test_word_tables_and_marks(spark, tmp_path):
    p = lambda x: f"<w:p><w:r>{x}</w:r></w:p>"
    t = lambda x: f"<w:t>{x}</w:t>"
    inner = f"<w:tbl><w:tr><w:tc>{p(t('in'))}</w:tc></w:tr></w:tbl>"
    both = "<mc:AlternateContent xmlns:mc='mc'><mc:Choice><a:blip r:embed='r1'/></mc:Choice><mc:Fallback><v:imagedata r:id='r2'/></mc:Fallback></mc:AlternateContent>"
    body = p(both + t("x") + "<w:br/>" + t("y")) + p("") + f"<w:tbl><w:tr><w:tc>{p(t('a'))}{inner}{p(t('b'))}</w:tc><w:tc/></w:tr></w:tbl><w:sdt><w:sdtContent>{p(t('held'))}</w:sdtContent></w:sdt>" + p("<a:blip r:embed='gone'/>") + p("<a:blip r:embed='r3'/>")
    doc = {"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(r1="media/i.png", r2="/word/media/i.png", r3="media/f.emf"), "word/media/i.png": b"one", "word/media/f.emf": b"two"}
    got = read(spark, tmp_path, **{"d.docx": doc, "empty.docx": {"word/document.xml": f"<w:document {NS}/>"}, "bad.docx": b"nothing", "broken.docx": {"word/document.xml": "<w"}, "other.docx": {"x": "y"}})
    assert got["d.docx"]["text"] == "[图片1]x\ny\nin\na\nb | \nheld\n[图片2]"
    assert [(i["number"], i["formula"], bytes(i["content"])) for i in got["d.docx"]["images"]] == [(1, False, b"one"), (2, True, b"two")]
    assert got["empty.docx"]["text"] == "" and got["empty.docx"]["images"] == []
    assert all(got[n]["error"] and got[n]["text"] is None for n in ("bad.docx", "broken.docx", "other.docx"))


def test_a_picture_of_two_slides_has_one_mark(spark, tmp_path):
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda words: f"<p:sld {NS}><p:cSld><p:spTree>{shape.format(words)}<p:grpSp><p:pic><p:blipFill><a:blip r:embed='r1'/></p:blipFill></p:pic></p:grpSp></p:spTree></p:cSld></p:sld>"
    deck = {f"ppt/slides/slide{i}.xml": slide(f"slide {i}") for i in (1, 2, 10)}
    targets = {1: "one", 2: "one", 10: "two"}
    deck |= {f"ppt/slides/_rels/slide{i}.xml.rels": rels(r1=f"../media/{m}.png") for i, m in targets.items()} | {"ppt/media/one.png": b"1", "ppt/media/two.png": b"2"}
    got = read(spark, tmp_path, **{"d.pptx": deck})["d.pptx"]
    assert got["text"] == "# 1\nslide 1\n[图片1]\n\n# 2\nslide 2\n\n# 3\nslide 10\n[图片2]" and got["kind"] == "PPTX"


def test_pictures_of_a_sheet_stand_in_their_rows(spark, tmp_path):
    row = lambda n, x: f"<row r='{n}'><c t='inlineStr'><is><t>{x}</t></is></c></row>"
    anchor = lambda n: f"<d:oneCellAnchor><d:from><d:row>{n}</d:row></d:from><a:blip r:embed='r1'/></d:oneCellAnchor>"
    book = {"xl/worksheets/sheet1.xml": f"<worksheet>{row(1, 'first')}{row(2, 'second')}</worksheet>", "xl/worksheets/_rels/sheet1.xml.rels": rels(d="../drawings/drawing1.xml"), "xl/drawings/drawing1.xml": f"<d:wsDr {NS}>{anchor(0)}{anchor(1)}{anchor(7)}</d:wsDr>", "xl/drawings/_rels/drawing1.xml.rels": rels(r1="../media/a.png"), "xl/media/a.png": b"a"}
    got = read(spark, tmp_path, **{"d.xlsx": book})["d.xlsx"]
    assert got["text"] == "# 1\nfirst[图片1]\nsecond[图片2]\n[图片3]" and len(got["images"]) == 3
