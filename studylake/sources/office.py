"""Office files with what stands inside their text: formulas, image marks, tables by rows."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from studylake.shipping import in_pandas
from studylake.sources import files as L

#: Endings of images that are kept, and of drawn formulas (fixed values).
RASTER, DRAWN = ("png", "jpg", "jpeg", "gif", "bmp"), ("wmf", "emf")
#: Operators, accents and marks of formulas in their written form (fixed values).
LARGE = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap"}
ACCENTS = {"\u0302": r"\hat", "\u0303": r"\tilde", "\u0304": r"\bar", "\u0305": r"\overline", "\u0307": r"\dot", "\u0308": r"\ddot", "\u20d7": r"\vec"}
SYMBOLS = {"≤": r"\le ", "≥": r"\ge ", "≠": r"\ne ", "±": r"\pm ", "×": r"\times ", "÷": r"\div ", "·": r"\cdot ", "∞": r"\infty ", "→": r"\to ", "∈": r"\in ", "α": r"\alpha ", "β": r"\beta ", "θ": r"\theta ", "λ": r"\lambda ", "π": r"\pi ", "Δ": r"\Delta "}
FUNCTIONS = ("sin", "cos", "tan", "cot", "log", "ln", "lg", "exp", "max", "min", "lim")
COLUMNS = "path string, kind string, text string, images array<struct<number:int,name:string,formula:boolean,content:binary>>, skipped int, error string"


def _named(e: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((c for c in e if L._local(c.tag) == name), None)


def _value(e: ElementTree.Element, *path: str, default: str = "") -> str:
    """The ``val`` of a property below an element; the default if it isn't there."""
    for name in path:
        e = _named(e, name) if e is not None else None
    return default if e is None else next((v for k, v in e.attrib.items() if L._local(k) == "val"), default)


def latex(e: ElementTree.Element) -> str:
    """A formula's tree as LaTeX; what has no rule of its own gives its parts one after the other."""
    kind = L._local(e.tag)
    part = lambda name: "" if (c := _named(e, name)) is None else inside(c)
    inside = lambda c: "".join(map(latex, c))
    if kind == "t":
        return "".join(SYMBOLS.get(c, c) for c in e.text or "")
    if kind.endswith("Pr"):
        return ""
    if kind == "f":
        form = _value(e, "fPr", "type")
        if form == "lin":
            return f"{part('num')}/{part('den')}"
        return rf"\{'binom' if form == 'noBar' else 'frac'}{{{part('num')}}}{{{part('den')}}}"
    if kind in ("sSup", "sSub", "sSubSup", "sPre"):
        low, high = (f"{mark}{{{part(name)}}}" if _named(e, name) is not None else "" for mark, name in (("_", "sub"), ("^", "sup")))
        base = f"{{{part('e')}}}"
        return f"{{}}{low}{high}{base}" if kind == "sPre" else base + low + high
    if kind == "rad":
        degree = part("deg")
        return rf"\sqrt[{degree}]{{{part('e')}}}" if degree else rf"\sqrt{{{part('e')}}}"
    if kind == "nary":
        sign = _value(e, "naryPr", "chr", default="∫")
        low, high = part("sub"), part("sup")
        return LARGE.get(sign, sign) + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + f"{{{part('e')}}}"
    if kind == "d":
        begin, end, between = (_value(e, "dPr", name, default=d) for name, d in (("begChr", "("), ("endChr", ")"), ("sepChr", "|")))
        fence = lambda c: "." if not c else "\\" + c if c in "{}" else c
        return rf"\left{fence(begin)}{between.join(inside(c) for c in e if L._local(c.tag) == 'e')}\right{fence(end)}"
    if kind == "func":
        name = part("fName")
        return (f"\\{name} " if name in FUNCTIONS else name) + part("e")
    if kind in ("limLow", "limUpp"):
        base = part("e")
        return (f"\\{base}" if base in FUNCTIONS else base) + f"{'_' if kind == 'limLow' else '^'}{{{part('lim')}}}"
    if kind == "acc":
        return f"{ACCENTS.get(_value(e, 'accPr', 'chr', default=chr(0x302)), ACCENTS[chr(0x302)])}{{{part('e')}}}"
    if kind == "bar":
        return rf"\{'overline' if _value(e, 'barPr', 'pos', default='bot') == 'top' else 'underline'}{{{part('e')}}}"
    if kind == "m":
        rows = (" & ".join(inside(c) for c in r if L._local(c.tag) == "e") for r in e if L._local(r.tag) == "mr")
        return r"\begin{matrix}" + r" \\ ".join(rows) + r"\end{matrix}"
    if kind == "eqArr":
        return r"\begin{aligned}" + r" \\ ".join(inside(c) for c in e if L._local(c.tag) == "e") + r"\end{aligned}"
    return inside(e)


class _Reader:
    """One office file: its parts, and its images by number."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.names, self.images, self.numbers, self.skipped = z, set(z.namelist()), [], {}, set()

    def tree(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.z.read(name))

    def related(self, part: str) -> dict[str, str]:
        """Parts that a part names by id."""
        rels = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
        if rels not in self.names:
            return {}
        inner = (r for r in self.tree(rels) if r.get("TargetMode") != "External")
        return {r.get("Id"): posixpath.normpath(posixpath.join("/" + posixpath.dirname(part), r.get("Target", ""))).lstrip("/") for r in inner}

    def mark(self, name: str | None, again: bool = False) -> str:
        """The mark of an image part: once for a file, for each place with ``again``; none for other parts."""
        ending = (name or "").rpartition(".")[2].lower()
        if name not in self.names or (name in self.numbers and not again) or name in self.skipped:
            return ""
        if ending not in RASTER + DRAWN or self.z.getinfo(name).file_size > L.MOST_IMAGE_BYTES:
            self.skipped.add(name)
            return ""
        number = len(self.images) + 1
        self.numbers.setdefault(name, number)
        self.images.append({"number": number, "name": name, "formula": ending in DRAWN, "content": self.z.read(name)})
        return f"[图片{number}]"

    def inline(self, e: ElementTree.Element, rels: dict[str, str]) -> str:
        """An element's text in its order, with formulas and image marks."""
        kind = L._local(e.tag)
        if kind == "t":
            return e.text or ""
        if kind in ("tab", "br", "cr"):
            return " " if kind == "tab" else "\n"
        if kind == "oMath":
            return f"${latex(e).strip()}$"
        if kind in ("blip", "imagedata"):
            return self.mark(rels.get(next((v for k, v in e.attrib.items() if L._local(k) == ("embed" if kind == "blip" else "id") and k != "id"), None)))
        return "" if kind.endswith("Pr") else "".join(self.inline(c, rels) for c in e)

    def blocks(self, e: ElementTree.Element, rels: dict[str, str]) -> list[str]:
        """Lines of paragraphs and table rows; a table inside a cell comes before the cell's row."""
        out = []
        for c in e:
            kind = L._local(c.tag)
            if kind == "p":
                out.append(self.inline(c, rels).strip())
            elif kind == "tbl":
                for row in (r for r in c if L._local(r.tag) == "tr"):
                    cells = []
                    for cell in (x for x in row if L._local(x.tag) == "tc"):
                        own = [self.inline(p, rels).strip() for p in cell if L._local(p.tag) == "p"]
                        for nested in (t for t in cell if L._local(t.tag) == "tbl"):
                            holder = ElementTree.Element("body")
                            holder.append(nested)
                            out += self.blocks(holder, rels)
                        cells.append("\n".join(filter(None, own)))
                    out.append(" | ".join(cells))
            elif kind in ("sdt", "sdtContent"):
                out += self.blocks(c, rels)
        return [x for x in out if x]

    def numbered(self, prefix: str) -> list[str]:
        return sorted((n for n in self.names if re.fullmatch(rf"{prefix}\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))

    def slide(self, name: str) -> list[str]:
        rels = self.related(name)
        tree = next((x for x in self.tree(name).iter() if L._local(x.tag) == "spTree"), None)
        return [x for x in self.shapes(tree, rels) if x] if tree is not None else []

    def shapes(self, group: ElementTree.Element, rels: dict[str, str]) -> list[str]:
        """Paragraphs, table rows and images of a group's shapes."""
        out = []
        for shape in group:
            rows = [x for x in shape.iter() if L._local(x.tag) == "tr"]
            paragraphs = [x for x in shape.iter() if L._local(x.tag) == "p"]
            if L._local(shape.tag) == "grpSp":
                out += self.shapes(shape, rels)
            elif rows:
                out += [" | ".join(self.inline(c, rels).strip() for c in r if L._local(c.tag) == "tc") for r in rows]
            else:
                out += [self.inline(p, rels).strip() for p in paragraphs] if paragraphs else [self.inline(shape, rels).strip()]
        return out

    def sheet(self, name: str, shared: list[str]) -> list[str]:
        """Rows, each followed by the marks of the images that begin in it; images of rows without cells have lines of their own."""
        marks: dict[int, str] = {}
        for drawing in (p for p in self.related(name).values() if "/drawings/" in p and p in self.names):
            rels = self.related(drawing)
            for anchor in self.tree(drawing):
                row = next((int(x.text) for x in anchor.iter() if L._local(x.tag) == "row" and x.text), None)
                ids = [v for b in anchor.iter() if L._local(b.tag) == "blip" for k, v in b.attrib.items() if L._local(k) == "embed"]
                marks[row if row is not None else -1] = marks.get(row if row is not None else -1, "") + "".join(self.mark(rels.get(i), again=True) for i in ids)
        rows: dict[int, str] = {}
        for at, row in enumerate(x for x in self.tree(name).iter() if L._local(x.tag) == "row"):
            cells = []
            for c in row:
                value = next((v.text or "" for v in c.iter() if L._local(v.tag) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(cells):
                rows[int(row.get("r", at + 1)) - 1] = " | ".join(cells)
        return [rows.get(r, "") + marks.get(r, "") for r in sorted({*rows, *marks}) if rows.get(r) or marks.get(r)]

    def read(self) -> tuple[str, str]:
        """(kind, text)."""
        if "word/document.xml" in self.names:
            body = next((x for x in self.tree("word/document.xml").iter() if L._local(x.tag) == "body"), None)
            return "DOCX", "\n".join(self.blocks(body, self.related("word/document.xml")) if body is not None else [])
        if slides := self.numbered("ppt/slides/slide"):
            return "PPTX", "\n\n".join("\n".join([f"# {i}", *self.slide(n)]) for i, n in enumerate(slides, 1))
        if sheets := self.numbered("xl/worksheets/sheet"):
            shared = L._paragraphs(self.z.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in self.names else []
            return "XLSX", "\n\n".join("\n".join([f"# {i}", *self.sheet(n, shared)]) for i, n in enumerate(sheets, 1))
        raise ValueError("not an office file")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text, images, skipped, error of docx, pptx and xlsx files.

    Word files: paragraphs, tables by rows (cells joined by bars), formulas as
    LaTeX in dollar signs, a mark for each image at its place, once for a part.
    Presentations: slides with headings, likewise.  Workbooks: rows, each with
    the marks of its images, one for each place.  ``images`` are numbered by
    their marks; ``formula``: a drawn one (its bytes are kept as they are).
    ``skipped`` counts images of other kinds or above the size limit.  A file
    that can't be read has an error and nothing else.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "text", "images", "skipped", "error"]
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    L._entries(content)
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        reader = _Reader(z)
                        kind, text = reader.read()
                    row = (p, kind, text, reader.images, len(reader.skipped), None)
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    row = (p, None, None, None, None, str(e) or type(e).__name__)
                yield pd.DataFrame([row], columns=names).astype({"skipped": "Int64"})

    return in_pandas(L._binary(spark, path), run, COLUMNS)
