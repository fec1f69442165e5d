"""Sources on artificial files."""

from pathlib import Path

import fixtures
import pytest

from docmill.sources import csv, docx, mbox, pdf, text, xlsx


@pytest.mark.parametrize("split", [11, 300, 1 << 20])
def test_mailbox_whatever_the_ranges(spark, tmp_path, split):
    (tmp_path / "a.mbox").write_bytes(fixtures.MBOX)
    rows = mbox.read(spark, str(tmp_path / "a.mbox"), include_html=True, split=split).orderBy("offset").collect()
    assert len(rows) == 3 and all(r.error is None for r in rows)
    one, cut, two = (r.data for r in rows)
    assert one.message_id == "<tide-7@fjord.test>" and one.subject == "Sø og vind" and one.date == "2031-05-09T06:15:00+02:00" and one.gmail_labels == ["Boats", "Nets, ropes"]
    assert one["from"][0].asDict() == {"name": "Nils Østergård", "email": "nils@fjord.test"} and one.cc[0].name == "D'Arcy"
    assert one.body_text == "Low tide.\n"
    assert cut.message_id.startswith("generated:") and two.message_id.startswith("generated:")
    assert two.body_text == "Rich text" and two.attachments[0].asDict() == {"file_name": "a.pdf", "media_type": "application/pdf", "size_bytes": 6, "content_extracted": False}
    assert rows[2].processing.warnings == ["date_unparseable", "message_id_generated"]
    assert rows[0].record_id.startswith("email_") and rows[0].source.file_name == "a.mbox"


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Berth;Ship;Depth;Moored;Since\n007;Sea Lark;12,5;sim;2031-05-01\n;;;;\n008;Gull\u200b;3;não\n009;Tern;4,5;true;2031-05-02\n")
    (tmp_path / "b.csv").write_text("1;10\n2;20\n3;30\n")
    (tmp_path / "c.csv").write_text("Lock,Opened\nUpper,1871\n44,1902\n45,1903\nNew,1950\n")
    (tmp_path / "d.csv").write_text("Only,heads\n")
    r = csv.read(spark, str(tmp_path), per_segment=2)
    files = {f.dataset: f for f in r["files"].collect()}
    assert (files["a.csv"].delimiter, files["a.csv"].has_header, files["a.csv"].ragged_rows, files["a.csv"].blank_rows_skipped, files["a.csv"].total_rows) == (";", True, 1, 1, 3)
    assert not files["b.csv"].has_header and files["d.csv"].total_rows == 0
    columns = {(c.dataset, c["index"]): c for c in r["columns"].collect()}
    assert [columns["a.csv", i].name for i in range(1, 6)] == ["berth", "ship", "depth", "moored", "since"]
    assert [columns["a.csv", i].inferred_type for i in range(1, 6)] == ["string", "string", "number", "boolean", "date"]
    assert columns["b.csv", 2].name == "coluna_2" and columns["c.csv", 1].inferred_type == "string" and columns["c.csv", 2].inferred_type == "integer"
    segments = {(s.dataset, s.segment): s for s in r["segments"].collect()}
    assert segments["a.csv", 1].rows == ['["007","Sea Lark",12.5,true,"2031-05-01"]', '["008","Gull",3,false,null]']
    assert (segments["a.csv", 2].row_start, segments["a.csv", 2].row_end, segments["a.csv", 2].total_rows) == (3, 3, 3)
    assert segments["c.csv", 1].rows[1] == '["44",1902]' and segments["d.csv", 1].row_start is None and segments["d.csv", 1].rows == []


def test_text_and_markdown(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("TÍTULO DO TEXTO\n\nOlá mundo​ fim\n".encode())
    (tmp_path / "m.md").write_text("# One\n\n```\n# no\n```\nTwo\n---\nx\n")
    (tmp_path / "w.txt").write_bytes("Descrição é ação, não\r\nlinha".encode("cp1252"))
    rows = {r.source.file_name: r for r in text.read(spark, str(tmp_path)).collect()}
    assert rows["t.txt"].data.title == "TÍTULO DO TEXTO" and rows["t.txt"].data.content.endswith("Olá mundo\nfim\n")
    assert [(h.level, h.text, h.line_number) for h in rows["m.md"].data.headings] == [(1, "One", 1), (2, "Two", 6)]
    assert rows["w.txt"].data.encoding == "cp1252" and rows["w.txt"].data.content.startswith("Descrição é ação")


def test_workbook(spark, tmp_path):
    fixtures.workbook(str(tmp_path / "v.xlsx"))
    (tmp_path / "bad.xlsx").write_text("nope")
    r = xlsx.read(spark, str(tmp_path))
    sets = {d.dataset: d for d in r["datasets"].collect()}
    assert (sets["TabVendas"].source_kind, sets["TabVendas"].total_rows, sets["TabVendas"].formula_cells, sets["TabVendas"].without_cache, sets["TabVendas"].hidden_columns) == ("excel_table", 2, 2, 1, 1)
    assert sets["Resumo"].visibility == "hidden" and sets["Resumo"].merged_ranges == 1 and sets["Vazia"].warnings == ["xlsx_empty_sheet"]
    rows = {s.dataset: s.rows for s in r["segments"].collect()}
    assert rows["TabVendas"] == ['["Caneta",2,4.5]', '["Lápis",3,null]']
    assert rows["Resumo"] == ['[null,"x","2025-12-09T00:00:00"]', "[null,null,null]", "[true,null,null]"]
    assert {f.cell_reference: (f.formula, f.cached_value) for f in r["formulas"].collect()} == {"C2": ("=B2*2", "4.5"), "C3": ("=B3*2", None)}
    assert [(e.file_name, e.error) for e in r["errors"].collect()] == [("bad.xlsx", "InvalidPackage")]


def test_word(spark, tmp_path):
    fixtures.word(str(tmp_path / "w.docx"))
    (tmp_path / "bad.docx").write_text("nope")
    r = docx.read(spark, str(tmp_path))
    found = r["blocks"].orderBy("block").collect()
    assert [b.type for b in found] == ["paragraph", "heading", "paragraph", "list_item", "list_item", "list_item", "heading", "table", "heading", "heading", "table", "heading"]
    assert [(b.level, b.ordered) for b in found if b.type == "list_item"] == [(0, False), (1, False), (0, True)]
    assert [(b.level, b.inferred) for b in found if b.type == "heading"] == [(1, False), (2, False), (2, True), (1, True), (1, False)]
    assert [(b.has_header, b.header_inferred) for b in found if b.type == "table"] == [(True, False), (True, True)]
    doc = r["documents"].first()
    assert doc.title == "Título geral" and doc.images == 1 and doc.headers_footers and doc.suspicious_text_sequences >= 1
    assert doc.warnings[:3] == ["word_images_omitted:1", "word_headers_footers_omitted", "word_feature_omitted:footnotes"]
    units = docx.markdown(r["blocks"]).orderBy("block_start").collect()
    assert next(u for u in units if u.kind == "list").text == "- ponto\n    - sub\n1. um" and "a\\|b" in next(u for u in units if u.kind == "table").text
    sections = {s.title: (s.start_block, s.end_block) for s in r["sections"].collect()}
    assert sections["Escopo"] == (1, 8) and sections["Parte"] == (6, 7)


def test_pdf(spark, tmp_path):
    fixtures.pdf(str(tmp_path / "d.pdf"))
    fixtures.pdf(str(tmp_path / "locked.pdf"), encrypted=True)
    r = pdf.read(spark, str(tmp_path))
    doc = r["documents"].first()
    assert (doc.title, doc.author, doc.page_count, doc.pages_with_text, doc.images, doc.outline_items, doc.embedded_files) == ("Doc", "Ana", 3, 2, 1, 2, 1)
    assert doc.warnings == ["page_0003_no_extractable_text"]
    pages = {p.page_number: p for p in r["pages"].collect()}
    assert pages[1].text == "Primeira (linha)\nsegunda parte" and pages[2].text == "Hello\nmundo" and pages[3].extraction_method == "none"
    assert [(i.page_number, i.width, i.height, i.media_type) for i in r["images"].collect()] == [(3, 1200, 1600, "application/octet-stream")]
    assert [(o.node, o.parent, o.title, o.page_number) for o in r["outline"].orderBy("node").collect()] == [(1, None, "Um", 1), (2, 1, "Controles", 2)]
    assert [(f.name, f.media_type, f.size_bytes) for f in r["files"].collect()] == [("n.txt", "text/plain", 49)]
    assert [e.file_name for e in r["errors"].collect()] == ["locked.pdf"]
    assert Path(tmp_path / "d.pdf").exists()
