"""Readers end to end: bytes of a file to Markdown."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirestream.api import ConversionError, convert, main
from quirestream.config import DEFAULT
from quirestream.plans.convert import convert as convert_files
from quirestream.plans.convert import convert_pages
from quirestream.sources.files import audit, exit_code, output_names, write_markdown, zip_requests

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def packed(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("DOT", "."), text)
    return out.getvalue()


def files(names: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in names.items():
            z.writestr(name, text)
    return out.getvalue()


def html(spark, text: str) -> str:
    return convert(spark, text.encode(), filename="p.html")


def test_text_and_markdown(spark):
    assert convert(spark, b"uno\r\ndos\r\n\r\n \r\nesto *no* es", filename="a.TXT") == "uno dos\n\nesto \\*no\\* es\n"
    assert convert(spark, b"\n# T\n\n*x*\n", filename="a.md") == "# T\n\n*x*\n"
    assert convert(spark, b"", filename="a.txt") == "\n"


def test_delimited(spark):
    assert convert(spark, 'a;b\n"x;1";#N/A\n'.encode(), filename="a.csv") == "| a | b |\n| --- | --- |\n| x;1 |  |\n"
    assert "a\\|b" in convert(spark, b"h\tk\na|b\tc\n", filename="a.tsv")
    out = convert(spark, "\n".join(["n,v", *(f"fila{i},x" for i in range(50))]).encode(), DEFAULT.but(xlsx_max_rows=10), filename="a.csv")
    assert "fila8" in out and "fila40" not in out
    assert "(Filas recortadas a 2 columnas.)" in convert(spark, b"a,b,c\n1,2,3\n", DEFAULT.but(xlsx_max_cols=2), filename="a.csv")


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<h1>Uno</h1><p>a <b>b</b> <i>c</i> <a href='https://x.y'>d</a></p>", "# Uno\n\na **b**  *c*  [d](https://x.y)\n"),
        ("<ul><li>Uno</li><li>Dos<ul><li>Dos-A</li></ul></li></ul>", "- Uno\n- Dos\n  - Dos-A\n"), ("<ol><li>a</li><li>b</li></ol>", "1. a\n1. b\n"),
        ("<table><thead><tr><th>a</th></tr></thead><tr><td>b|c</td></tr></table>", "| a |\n| --- |\n| b\\|c |\n"),
        ("<b style='font-weight:normal'><span style='font-weight:700'>x</span> y</b>", "**x** y\n"), ("<blockquote>cita\nlarga</blockquote><hr>", "> cita larga\n\n---\n"),
        ("<pre>a\n  b</pre>", "```\na\n  b\n```\n"), ("<script>x</script><p>y<img alt='foto'></p>", "y[Imagen: foto]\n"), ("a<br>b", "a\n\nb\n"), ("<p>t</p><input><p>lost</p>", "t\n"),
        ("<html><body><h1>a</h1><p>b</p></body></html>", "ab\n"), ("<h2>ESTE ES UN DOCUMENTO EN ESPAÑOL</h2>", "## Este Es un Documento en Español\n"),
        ("<h2>THIS SYLLABUS DESCRIBES THE COURSE</h2><p>this is the text of a page and it is in the language</p>", "## This Syllabus Describes the Course\n\nthis is the text of a page and it is in the language\n"),
    ],
)
def test_html(spark, page, expected):
    assert html(spark, page) == expected


def test_deep_html(spark):
    assert html(spark, "<div>" * 3000 + "x" + "</div>" * 3000) == "x\n"


DOCX = files({
    "word/document.xml": f"""<w:document {W}><w:body>
      <w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Título</w:t></w:r></w:p>
      <w:p><w:r><w:t xml:space="preserve">Texto </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>negrita</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>sitio</w:t></w:r></w:hyperlink></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>uno</w:t></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>dos</w:t></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="2"/></w:numPr></w:pPr><w:r><w:t>tres</w:t></w:r></w:p>
      <w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>""",
    "word/styles.xml": f"""<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 9"/></w:style></w:styles>""",
    "word/numbering.xml": f"""<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
      <w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>""",
    "word/_rels/document.xml.rels": REL.format('<Relationship Id="r1" Type="x/hyperlink" Target="https://x.y" TargetMode="External"/>'),
})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def xlsx(cells: str) -> bytes:
    return files({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Ventas" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="r1" Type="x/worksheet" Target="worksheets/sheet1.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Mes</t></si><si><r><t>To</t></r><r><t>tal</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>",
    })


A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHAPE = '<p:sp><p:nvSpPr><p:cNvPr id="{0}" name="s"/><p:nvPr>{1}</p:nvPr></p:nvSpPr><p:txBody>{2}</p:txBody></p:sp>'
PARA = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
PPTX = files({
    "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": REL.format('<Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/>'),
    "ppt/slides/slide1.xml": f"<p:sld {A}><p:cSld><p:spTree>{SHAPE.format(2, '<p:ph type=\"title\"/>', PARA.format('Portada'))}{SHAPE.format(3, '', PARA.format('uno') + PARA.format('dos'))}{SHAPE.format(4, '', PARA.format('solo'))}</p:spTree></p:cSld></p:sld>",
    "ppt/slides/_rels/slide1.xml.rels": REL.format('<Relationship Id="r1" Type="x/notesSlide" Target="../notesSlides/notes1.xml"/>'),
    "ppt/notesSlides/notes1.xml": f"<p:notes {A}><p:cSld><p:spTree>{SHAPE.format(2, '<p:ph type=\"body\"/>', PARA.format('recordar'))}</p:spTree></p:cSld></p:notes>",
})


def test_word(spark):
    assert convert(spark, DOCX, filename="a.docx") == "#### Título\n\nTexto **negrita**[sitio](https://x.y)\n\n- uno\n  - dos\n\n1. tres\n\n| a | b |\n| --- | --- |\n"


def test_slides(spark):
    assert convert(spark, PPTX, filename="a.pptx") == "# Portada\n\n- uno\n- dos\n\nsolo\n\n## Notas\n\nrecordar\n"


def test_sheets(spark):
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45292</v></c><c r="C3"><v>1.5</v></c></row>'
    assert convert(spark, xlsx(cells), filename="a.xlsx") == "# Ventas\n\n| Mes | Total |\n| --- | --- |\n| 2024-01-01 00:00:00 | 1.5 |\n"
    assert convert(spark, xlsx(""), filename="a.xlsx") == "# Ventas\n"
    wide = '<row r="1">' + "".join(f"<c t='inlineStr'><is><t>c{i}</t></is></c>" for i in range(30)) + "</row>"
    assert "recortada a 20 de 30 columnas" in convert(spark, xlsx(wide), DEFAULT.but(xlsx_max_cols=20), filename="a.xlsx")


def test_refused(spark):
    for data, name, code in ((b"x", "a.exe", "INFRA_UNSUPPORTED_FORMAT"), (b"<html>", "a.pdf", "INFRA_UNSUPPORTED_FORMAT"), (b"nope", "a.docx", "INFRA_CORRUPT_FILE"), (files({"x": "0" * 8_000_000}), "a.xlsx", "INFRA_CORRUPT_FILE")):
        with pytest.raises(ConversionError) as e:
            convert(spark, data, filename=name)
        assert e.value.code == code
    with pytest.raises(ConversionError) as e:
        convert(spark, b"12345", DEFAULT.but(max_file_size_bytes=4), filename="a.txt")
    assert e.value.code == "INFRA_FILE_TOO_LARGE"
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "0" * 8_000_000)
    with pytest.raises(ConversionError) as e:
        convert(spark, bomb.getvalue(), filename="a.xlsx")
    assert e.value.code == "INFRA_FILE_TOO_LARGE"
    with pytest.raises(ValueError):
        convert(spark, b"x")


def test_batch_isolated_and_written(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("hola")
    (src / "b.docx").write_bytes(b"broken")
    done = output_names(convert_files(spark.read.format("binaryFile").load(str(src))), F.col("path"))
    assert {(r.output, r.error_code) for r in done.collect()} == {("a.md", None), ("b.md", "INFRA_CORRUPT_FILE")}
    assert exit_code(done) == 0 and exit_code(done.where("error_code is not null")) == 2 and exit_code(done.limit(0)) == 1
    out = tmp_path / "out"
    good = done.where("error_code is null")
    assert [r.status for r in write_markdown(good, str(out)).collect()] == ["written"]
    assert [r.status for r in write_markdown(good, str(out)).collect()] == ["skipped"]
    assert (out / "a.md").read_text() == "hola\n"
    line = audit(done.select("*", F.lit("t").alias("timestamp"), F.lit(1).alias("duration_ms"))).where(F.col("line").contains("CORRUPT")).first()[0]
    assert '"resultado":"error"' in line and "hola" not in line


def test_one_output_for_several_inputs(spark, tmp_path):
    """One stem twice: the first by path is written, the last with overwrite; far stores get the same files."""
    rows = [("/x/a.txt", "a.md", "A\n"), ("/y/a.txt", "a.md", "B\n"), ("/y/c d.txt", "sub/c d.md", "C\n\nC\n")]
    done = spark.createDataFrame(rows, "path string, output string, markdown string")
    for folder in (tmp_path / "near", tmp_path / "far"):
        if folder.name == "far":
            import quirestream.sources.files as S

            fs = spark._jvm.org.apache.hadoop.fs.Path(str(folder)).getFileSystem(spark._jsc.hadoopConfiguration())
            assert {tuple(r) for r in S._save_far(done.where("path <> '/y/a.txt'").select("output", "markdown"), str(folder), fs).collect()} == {("a.md", "written"), ("sub/c d.md", "written")}
        else:
            got = write_markdown(done, str(folder)).collect()
            assert sorted(r.status for r in got) == ["skipped", "written", "written"]
        assert (folder / "a.md").read_text() == "A\n" and (folder / "sub" / "c d.md").read_text() == "C\n\nC\n"
    got = write_markdown(done, str(tmp_path / "near"), overwrite=True).collect()
    assert sorted(r.status for r in got) == ["skipped", "written", "written"] and (tmp_path / "near" / "a.md").read_text() == "B\n"


def test_command_line(spark, tmp_path, capsys):
    src = tmp_path / "in"
    (src / "b").mkdir(parents=True)
    (src / "x.txt").write_text("uno")
    (src / "b" / "x.txt").write_text("dos")
    out = tmp_path / "out"
    assert main([str(src), "-r", "-o", str(out)]) == 0
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(".")) == ["x.md"] and (out / "x.md").read_text() == "dos\n"
    assert main([str(src), "-r", "-v"]) == 0 and (src / "x.md").read_text() == "uno\n" and (src / "b" / "x.md").read_text() == "dos\n"
    assert main([str(src / "x.txt"), "-o", str(tmp_path / "named.md"), "--keep-repeated", "--no-join"]) == 0 and (tmp_path / "named.md").read_text() == "uno\n"
    capsys.readouterr()
    assert main([str(src / "x.txt"), "--stdout"]) == 0 and capsys.readouterr().out == "uno\n"
    assert main([str(tmp_path / "none")]) == 1
    with pytest.raises(SystemExit):
        main(["--version"])


def test_pages(spark):
    words = [(1, 1, i, t, 10.0 + 50 * i, 50.0 + 50 * i, 10.0, 20.0, 18.0, "Arial") for i, t in enumerate("INFORME ANUAL".split())]
    words += [(1, 1, 10 + 5 * k + i, t, 10.0 + 50 * i, 50.0 + 50 * i, 40.0 + 14 * k, 50.0 + 14 * k, 10.0, "Arial") for k, line in enumerate(["una frase que se cor-", "ta aquí y sigue", "• viñeta uno", "• viñeta dos"]) for i, t in enumerate(line.split())]
    w = spark.createDataFrame(words, "doc_id long, page int, word_ord int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    grid = [["a", "b", "c", "d"], ["1", "2", "3", "4"]]
    b = spark.createDataFrame([(1, 1, 0, 0.0, 300.0, 500.0, 400.0, grid)], "doc_id long, page int, tbl_ord int, x0 double, top double, x1 double, bottom double, rows array<array<string>>")
    assert convert_pages(w, b, w.select("doc_id", "page").distinct()).first()["markdown"] == "# INFORME ANUAL\n\nuna frase que se corta aquí y sigue\n\n- viñeta uno\n- viñeta dos\n\n| a | b | c | d |\n| --- | --- | --- | --- |\n| 1 | 2 | 3 | 4 |\n"


def test_pages_with_images(spark):
    """Notices, recognised images and pages, the budget, and documents of too many pages."""
    words = spark.createDataFrame([*((1, 1, k, "hola", 10.0, 60.0, 2.0 + 6 * k, 7.0 + 6 * k, 10.0, "Arial") for k in range(4)), (9, 1, 0, "no", 10.0, 60.0, 10.0, 20.0, 10.0, "Arial")], "doc_id long, page int, word_ord int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    boxes = spark.createDataFrame([], "doc_id long, page int, tbl_ord int, x0 double, top double, x1 double, bottom double, rows array<array<string>>")
    pages = spark.createDataFrame([(1, 1), (2, 1), *((9, p) for p in range(1, 5))], "doc_id long, page int").withColumn("width", F.lit(100.0)).withColumn("height", F.lit(100.0))
    images = spark.createDataFrame([(1, 1, 0, 0.0, 30.0, 100.0, 95.0, 5.0), (1, 1, 1, 0.0, 31.0, 100.0, 96.0, 1.0), (1, 1, 2, 0.0, 40.0, 40.0, 80.0, 1.0), (2, 1, 0, 0.0, 0.0, 100.0, 100.0, 1.0)], "doc_id long, page int, img_ord int, x0 double, top double, x1 double, bottom double, seconds double")
    config = DEFAULT.but(pdf_max_pages=3)
    notice = "[Imagen en la página 1: su contenido no se pudo extraer — {}]"
    got = {r.doc_id: r for r in convert_pages(words, boxes, pages, config, images=images.drop("seconds")).collect()}
    missing = notice.format("instala Tesseract para activar el OCR")
    assert got[1].markdown == f"hola hola hola hola\n\n{missing}\n\n{missing}\n" and got[2].markdown == f"# {missing}\n"  # without other text, its size is the body's
    assert got[9].markdown is None and got[9].error_code == "INFRA_FILE_TOO_LARGE" and got[1].error_code is None
    seen = spark.createDataFrame([(1, 1, 0, 0, "leído", 90.0, 1, 1, 1), (1, 1, 0, 1, "bien", 90.0, 1, 1, 1), (1, 1, 1, 0, "tarde", 90.0, 1, 1, 1), (2, 1, None, 0, "toda", 90.0, 1, 1, 1), (2, 1, 0, 0, "imagen", 90.0, 1, 1, 1)], "doc_id long, page int, img_ord int, ord int, text string, conf double, block_num int, par_num int, line_num int")
    got = {r.doc_id: r.markdown for r in convert_pages(words, boxes, pages, config, images=images, recognised=seen).collect()}
    assert got[1] == f"hola hola hola hola\n\nleído bien\n\n{notice.format('presupuesto de tiempo de OCR agotado')}\n" and got[2] == "# imagen\n"
    got = {r.doc_id: r.markdown for r in convert_pages(words, boxes, pages, config.but(ocr=True), images=images, recognised=seen).collect()}
    assert got[2] == "# toda\n"


def test_zip_requests(spark):
    rows = [(1, "b.md", "B\n", None), (1, "a.md", "A\n", None), (1, "a.md", "A2\n", None), (2, "c.md", None, "INFRA_CORRUPT_FILE"), (2, "d.md", "D\n", None)]
    got = {r.req: r for r in zip_requests(spark.createDataFrame(rows, "req long, output string, markdown string, error_code string"), "req").collect()}
    with zipfile.ZipFile(io.BytesIO(got[1].zip)) as z:
        assert z.namelist() == ["a.md", "a.md", "b.md"] and z.read("b.md") == b"B\n"
    assert got[2].zip is None and got[2].error_code == "INFRA_CORRUPT_FILE"
