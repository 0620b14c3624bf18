"""Files in and out: scans, office files, sidecars, JSON lines, vectors."""

import io
import json
import zipfile

from gleaner.sources import corpus

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def office(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in names.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = office({"word/document.xml": f'<d xmlns:w="{W}"><w:p><w:t>Uno</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></d>'})
PPTX = office({f"ppt/slides/slide{i}.xml": f'<s xmlns:a="{A}"><a:p><a:t>Lámina {i}</a:t></a:p></s>' for i in (2, 10, 1)})


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "Unidad 1").mkdir()
    (tmp_path / "Unidad 1" / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.pptx").write_bytes(PPTX)
    (tmp_path / "c.txt").write_text("no")
    files = corpus.scan_files(spark, str(tmp_path))
    assert {(r.name, r.ext) for r in files.collect()} == {("a.docx", "docx"), ("b.pptx", "pptx")}
    assert all(len(r.hash) == 16 for r in files.collect())
    units = sorted((r.path[-6:], r.n, r.text) for r in corpus.extract_units(files, corpus.office_text).collect())
    assert units == [("a.docx", 1, "Uno\na | b"), ("b.pptx", 1, "Lámina 1"), ("b.pptx", 2, "Lámina 2"), ("b.pptx", 10, "Lámina 10")]


def test_sidecars(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"paginas": [{"pagina": 1, "texto": "Scanned with CamScanner\nhola mundo"}]}))
    assert [tuple(r) for r in corpus.ocr_sidecars(spark, str(tmp_path)).collect()] == [("s", 1, "hola mundo")]


def test_blocks_and_manifest(spark, tmp_path):
    row = ("d#p1", "d", "texto", 1, ("a.pdf", "pdf", 1, None, None, False), "c", 1, None, "lectura", "academica", 0, None)
    df = spark.createDataFrame([row], corpus.BLOCK)
    corpus.write_blocks(df, str(tmp_path / "b"))
    assert corpus.read_blocks(spark, str(tmp_path / "b")).collect() == df.collect()
    (tmp_path / "m.json").write_text(json.dumps({"curso": {}, "documentos": [{"doc_id": "d", "tokens": 3}]}, indent=1))
    assert [r.doc_id for r in corpus.read_manifest(spark, str(tmp_path / "m.json")).collect()] == ["d"]


def test_vectors_resume_by_provider(spark, tmp_path):
    path = str(tmp_path / "v")
    corpus.write_vectors(spark.createDataFrame([("a", [3.0, 4.0])], "id string, vector array<double>"), path, "p", "m")
    got = corpus.read_vectors(spark, path, "p").first()
    assert [round(x, 3) for x in got.vector] == [0.6, 0.8] and corpus.read_vectors(spark, path, "q").count() == 0
    rows = spark.createDataFrame([("a", "x"), ("b", "yy")], "id string, text string")
    new = corpus.embed_missing(rows, spark.read.parquet(path), lambda texts: [[len(t), 0.0] for t in texts], "p").collect()
    assert [(r.id, r.vector) for r in new] == [("b", [2.0, 0.0])]


def test_slides_with_notes_tables_and_pictures(spark):
    rels = '<Relationships><Relationship Target="../slideLayouts/slideLayout1.xml"/><Relationship Target="../notesSlides/notesSlide4.xml"/></Relationships>'
    table = "<a:tbl><a:tr><a:tc><a:p><a:t>x</a:t></a:p></a:tc><a:tc><a:p><a:t>y</a:t></a:p></a:tc></a:tr></a:tbl>"
    deck = office({
        "ppt/slides/slide1.xml": f'<s xmlns:a="{A}" xmlns:p="urn:p"><a:p><a:t>Uno</a:t></a:p>{table}<p:pic/></s>', "ppt/slides/slide2.xml": f'<s xmlns:a="{A}"><a:p><a:t>Dos</a:t></a:p></s>',
        "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/notesSlides/notesSlide4.xml": f'<s xmlns:a="{A}"><a:p><a:t>decir </a:t><a:t>esto</a:t></a:p><a:p><a:t>y esto</a:t></a:p></s>',
    })
    assert corpus.office_text("pptx", deck) == [(1, "Uno\nx | y", 1, 1, "decir esto\ny esto"), (2, "Dos", 0, 0, None)]
    files = spark.createDataFrame([("d.pptx", "pptx", bytearray(deck))], "path string, ext string, content binary")
    assert [(r.n, r.tables, r.notes) for r in corpus.extract_units(files, corpus.office_text).orderBy("n").collect()] == [(1, 1, "decir esto\ny esto"), (2, 0, None)]
    plain = corpus.extract_units(files, lambda ext, content: [(1, "t", 2)]).first()
    assert (plain.pictures, plain.tables, plain.notes) == (2, 0, None)
