"""Small artificial files, built with the standard library."""

from __future__ import annotations

import zipfile
import zlib

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

MBOX = b"""From a@x Tue Aug  4 12:00:00 2026
From: =?utf-8?q?Nils_=C3=98sterg=C3=A5rd?= <nils@fjord.test>
To: Harbour crew <crew@fjord.test>
Cc: "D'Arcy" <darcy@fjord.test>
Subject: =?utf-8?q?S=C3=B8_og_vind?=
Date: Fri, 09 May 2031 06:15:00 +0200
Message-ID: <tide-7@fjord.test>
X-Gmail-Labels: Boats,"Nets, ropes"
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: quoted-printable

Low=C2=A0tide=E2=80=8B.
From here it is a new message by the rule
From b@x Tue Aug  4 13:00:00 2026
From: pier@fjord.test
Subject: two
Date: nonsense
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="B"

--B
Content-Type: text/html; charset=utf-8

<p>Rich <b>text</b></p>
--B
Content-Type: application/pdf
Content-Disposition: attachment; filename="a.pdf"
Content-Transfer-Encoding: base64

QUJDREVG
--B--
"""


def workbook(path: str) -> None:
    rel = lambda i, kind, target: f'<Relationship Id="rId{i}" Type="{R}/{kind}" Target="{target}"/>'
    s = lambda ref, n: f'<c r="{ref}" t="s"><v>{n}</v></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {M}><sheets><sheet name="Vendas" sheetId="1" r:id="rId1"/><sheet name="Resumo" sheetId="2" state="hidden" r:id="rId2"/><sheet name="Vazia" sheetId="3" r:id="rId3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(rel(i, "worksheet", f"worksheets/sheet{i}.xml") for i in (1, 2, 3)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {M}>" + "".join(f"<si><t>{t}</t></si>" for t in ("Produto", "Qtd", "Total", "Caneta", "Lápis")) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {M}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        rows = f'<row r="1">{s("A1", 0)}{s("B1", 1)}{s("C1", 2)}</row><row r="2">{s("A2", 3)}<c r="B2"><v>2</v></c><c r="C2"><f>B2*2</f><v>4.5</v></c></row><row r="3" hidden="1">{s("A3", 4)}<c r="B3"><v>3</v></c><c r="C3"><f>B3*2</f></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {M}><cols><col min="5" max="5" hidden="1"/></cols><sheetData>{rows}</sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", "<Relationships>" + rel(1, "table", "../tables/table1.xml") + "</Relationships>")
        z.writestr("xl/tables/table1.xml", f'<table {M} displayName="TabVendas" ref="A1:C3"/>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {M}><sheetData><row r="2"><c r="B2" t="inlineStr"><is><t>x</t></is></c><c r="C2" s="1"><v>46000</v></c></row><row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4"><v>9</v></c></row></sheetData><mergeCells><mergeCell ref="A4:B4"/></mergeCells></worksheet>')
        z.writestr("xl/worksheets/sheet3.xml", f"<worksheet {M}><sheetData/></worksheet>")


def word(path: str) -> None:
    def p(text: str, style: str = "", extra: str = "", run: str = "") -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"

    num = lambda n, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>'
    cell = lambda t: f"<w:tc><w:tcPr/>{p(t)}</w:tc>"
    table = '<w:tbl><w:tblPr><w:tblLook w:firstRow="1"/></w:tblPr>' + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Nome", "Valor"), ("a|b", "1"))) + "</w:tbl>"
    guess = "<w:tbl><w:tblPr/>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("Item", "Descrição"), ("x", "um texto bastante longo que passa do limite de palavras"))) + "</w:tbl>"
    body = [
        p("Título geral", "Title"), p("Escopo", "Heading1"), p("Um parágrafo Ã\u00a9 estranho."), p("ponto", "", num(1)), p("sub", "", num(1, 1)), p("um", "", num(2)), p("Parte", "Heading2"), table,
        p("2.1. Negrito numerado", "", "", "<w:b/>"), p("Grande", "", "", '<w:b/><w:sz w:val="36"/>'), p("  "), guess, p("Fim", "Heading1"),
    ]
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"{d}><w:name w:val="{n}"/></w:style>' for i, n, d in (("Normal", "Normal", ' w:default="1"'), ("Title", "Title", ""), ("Heading1", "heading 1", ""), ("Heading2", "heading 2", "")))
    level = lambda i, f: f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{f}"/></w:lvl>'
    numbering = f'<w:abstractNum w:abstractNumId="0">{level(0, "bullet")}{level(1, "bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{level(0, "decimal")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        z.writestr("word/numbering.xml", f"<w:numbering {W}>{numbering}</w:numbering>")
        z.writestr("word/media/i.png", b"x")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('topo')}</w:hdr>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}/>")


def pdf(path: str, encrypted: bool = False) -> None:
    stream = lambda fields, data: b"<< " + fields + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"
    text = lambda s: stream(b"/Filter /FlateDecode", zlib.compress(s))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R /Outlines 10 0 R /Names << /EmbeddedFiles << /Names [(n.txt) 13 0 R] >> >> >>",
        b"<< /Type /Pages /Kids [3 0 R 4 0 R 5 0 R] /Count 3 >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R /Resources << >> >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 8 0 R /Resources << /XObject << /I 9 0 R >> >> >>",
        text(b"BT /F1 12 Tf 72 700 Td (Primeira \\(linha\\)) Tj 0 -14 Td [(seg) -20 (unda) -300 (parte)] TJ ET"), text(b"BT 1 0 0 1 72 700 Tm <48656C6C6F> Tj 1 0 0 1 72 680 Tm (mundo) Tj ET"), text(b"q /I Do Q"),
        stream(b"/Type /XObject /Subtype /Image /Width 1200 /Height 1600 /Filter /FlateDecode", zlib.compress(b"0")),
        b"<< /First 11 0 R >>", b"<< /Title (Um) /Dest [3 0 R /Fit] /First 12 0 R >>", b"<< /Title (Controles) /Dest [4 0 R /Fit] >>",
        b"<< /Type /Filespec /F (n.txt) /EF << /F 14 0 R >> >>", stream(b"/Type /EmbeddedFile /Subtype /text#2Fplain /Params << /Size 49 >>", b"x" * 49), b"<< /Title (Doc) /Author (Ana) >>",
    ]
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    out += b"trailer << /Root 1 0 R /Info 15 0 R " + (b"/Encrypt 99 0 R " if encrypted else b"") + b">>\n%%EOF"
    with open(path, "wb") as f:
        f.write(out)
