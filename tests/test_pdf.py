"""The PDF reader on files made here."""

import zlib

import pytest

from quire.sources import markdown, pdf, pdf_reader


def made(pages, fonts=None, extra=None, packed=True, rotate=0, objstm=False, resources=""):
    """A file of pages, each a content stream."""
    fonts = fonts or {"F1": "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    objects, kids = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}, []
    number = 10
    own = " ".join(f"/{k} {v}" for k, v in fonts.items())
    for content in pages:
        body = content.encode("latin-1") if isinstance(content, str) else content
        data = zlib.compress(body) if packed else body
        filters = "/Filter /FlateDecode " if packed else ""
        objects[number] = f"<< /Type /Page /Parent 2 0 R /Rotate {rotate} /Contents {number + 1} 0 R /Resources << /Font << {own} >> {resources} >> >>".encode()
        objects[number + 1] = f"<< {filters}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"
        kids.append(f"{number} 0 R")
        number += 2
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /MediaBox [0 0 400 600] >>".encode()
    objects |= extra or {}
    out = b"%PDF-1.5\n"
    if objstm:
        held = {k: v for k, v in objects.items() if b"stream" not in v}
        heads, body = [], b""
        for k, v in held.items():
            heads.append(f"{k} {len(body)}")
            body += v + b" "
        head = " ".join(heads).encode() + b" "
        data = zlib.compress(head + body)
        objects = {k: v for k, v in objects.items() if k not in held} | {900: f"<< /Type /ObjStm /N {len(held)} /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"}
        objects[901] = b"<< /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream"
    for k, v in objects.items():
        out += f"{k} 0 obj\n".encode() + v + b"\nendobj\n"
    return out + (b"" if objstm else b"trailer\n<< /Root 1 0 R >>\n%%EOF")


def shown(x, y, text, size=10):
    return f"BT /F1 {size} Tf {x} {y} Td ({text}) Tj ET\n"


PROSE = "".join(shown(50, 560 - 12 * i, f"line {i} of the text on this page, all of one size") for i in range(6))


@pytest.mark.parametrize("how", [{}, {"packed": False}, {"objstm": True}])
def test_texts(how):
    first = shown(50, 580, "A Title", 24) + PROSE + shown(50, 400, r"caf\351 \(and\) more")
    assert pdf_reader.read(made([first, ""], **how)) == ["# A Title\n\n" + "\n".join(f"line {i} of the text on this page, all of one size" for i in range(6)) + "\n\ncafé (and) more", ""]


def test_operators_and_fonts():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0416> endbfchar 2 beginbfrange <0002> <0004> <0061> <0005> <0006> [<0031> <00320033>] endbfrange"
    extra = {
        50: f"<< /Length {len(cmap)} >>\nstream\n".encode() + cmap + b"\nendstream",
        51: b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [1 [500 500] 3 6 700] >>",
    }
    fonts = {
        "F1": "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [51 0 R] /ToUnicode 50 0 R >>",
        "F2": "<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [700 700] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni0416 /fi] >> >>",
    }
    content = "q 1 0 0 1 10 0 cm BT /F1 10 Tf 1 0 0 1 40 500 Tm <00010002> Tj [<0003> -300 <0004> 10 <00050006>] TJ T* ET Q BT /F2 11 Tf 14 TL 50 300 Td (ABC) Tj (A) ' 1 2 (B) \" ET"
    assert pdf_reader.read(made([content], fonts, extra)) == ["Жab c123\n\néЖfi\né\nЖ"]
    assert (pdf_reader.glyph("Ntilde"), pdf_reader.glyph("udieresis"), pdf_reader.glyph("aring"), pdf_reader.glyph("quotedblleft"), pdf_reader.glyph("g123")) == ("Ñ", "ü", "å", "“", "")


def test_places_and_drawings():
    form = b"0 0 10 20 re f"
    extra = {
        60: b"<< /Subtype /Image /Width 640 /Height 480 /Length 1 >>\nstream\nx\nendstream",
        61: f"<< /Subtype /Form /Matrix [2 0 0 2 0 0] /Length {len(form)} >>\nstream\n".encode() + form + b"\nendstream",
    }
    content = "10 20 m 110 70 l S 0 0 5 5 re W n q 200 0 0 100 50 400 cm /Im Do Q q 1 0 0 1 300 100 cm /Fm Do Q q 30 0 0 40 0 0 cm BI /W 8 /H 9 /BPC 8 ID abc EI Q " + shown(100, 300, "here")
    use = "/XObject << /Im 60 0 R /Fm 61 0 R >>"
    page = pdf_reader.read_pages(made([content], extra=extra, resources=use))[0]
    assert (page.width, page.height) == (400, 600)
    assert page.draws == [(10, 530, 110, 580), (300, 460, 320, 500)] and page.rasters == [((50, 100, 250, 200), 640, 480), ((0, 560, 30, 600), 8, 9)]
    (box, size, text), = pdf_reader.blocks(page)
    assert text == "here" and size == 10 and box[0] == 100 and box[1] == 292 and box[3] == 302.5
    turned = pdf_reader.read_pages(made([content], extra=extra, resources=use, rotate=90))[0]
    assert (turned.width, turned.height) == (600, 400) and turned.draws[0] == (20, 10, 70, 110) and turned.rasters[0][0] == (400, 50, 500, 250)


def test_columns_stay_apart():
    content = "".join(shown(40, 500 - 12 * i, f"left {i}") + shown(250, 500 - 12 * i, f"right {i}") for i in range(3))
    assert pdf_reader.read(made([content])) == ["left 0\nleft 1\nleft 2\n\nright 0\nright 1\nright 2"]


def test_damaged_files():
    good = made([PROSE])
    with pytest.raises(ValueError, match="encrypted"):
        pdf_reader.read(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 5 0 R"))
    with pytest.raises(ValueError, match="no PDF"):
        pdf_reader.read(b"hello")
    import random

    rnd = random.Random(1)
    for _ in range(200):
        data = bytearray(made([PROSE], packed=rnd.random() < 0.5))
        for _ in range(4):
            data[rnd.randrange(8, len(data))] = rnd.randrange(256)
        try:
            pdf_reader.read(bytes(data))
        except ValueError:
            pass


def test_books_with_figures(spark):
    grid = "".join(f"{60 + 8 * c} {150 + 8 * r} m {66 + 8 * c} {156 + 8 * r} l S\n" for c in range(20) for r in range(14))
    pages = [PROSE + grid + shown(80, 200, "Alpha"), PROSE + "0 0 400 600 re f", shown(50, 500, "no figure")]
    files = spark.createDataFrame([("b", made(pages))], "book_id string, content binary")
    assert [r.text for r in pdf.pages(files, pdf_reader.read).orderBy("page").collect()][2] == "no figure"
    texts, figs, inside = pdf.with_figures(files)
    assert [(r.page, r.k, r.file_name) for r in figs.collect()] == [(0, 0, "fig-0001-00.png")] and [(r.text, r.kind) for r in inside.collect()] == [("Alpha", "label")]
    got = {r.page: r.text for r in texts.collect()}
    assert "Alpha" not in got[0] and got[0] == got[1] and got[2] == "no figure"
    (book,) = markdown.pages_with_figures(texts, figs).collect()
    assert book.text == f"{got[0]}\n\n![](images/fig-0001-00.png)\n\n{got[1]}\n\n{got[2]}"
