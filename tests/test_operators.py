import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from inkmill.operators import passes as P
from inkmill.operators.blocks import FIELDS, records
from inkmill.operators.layout import assets, layout, specifications
from inkmill.operators.render import pipe_table, render
from inkmill.operators.names import first_free, free_names
from inkmill.operators.report import hazards, reports
from inkmill.options import Options, from_choices
from inkmill.plans import samples as G
from inkmill.plans.archive import archive_reports, convert_archives, member_errors
from inkmill.plans.convert import block_rows, convert, convert_files, read_documents
from inkmill.sources import formats
from inkmill.sources.sinks import free_paths, published_paths, zip_bytes, zips


def H(level, text):
    return {"kind": "heading", "level": level, "text": text}


def T(text, kind="para", **more):
    return {"kind": kind, "text": text, **more}


@pytest.fixture
def blocks(spark):
    def make(*docs):
        names = [f.split()[0] for f in FIELDS.split(", ")]
        rows = [(i, *(b[n] for n in names)) for i, doc in enumerate(docs) for b in records(doc)]
        return spark.createDataFrame(rows, f"doc_id int, {FIELDS}")

    return make


def shown(df, *cols):
    return [tuple(r) for r in df.orderBy("doc_id", "pos").select(*cols).collect()]


def test_sections_and_cover(blocks):
    doc = [T("intro"), H(1, "A"), H(2, "1. Contents:"), T("x"), H(3, "deep"), T("y"), H(2, "B"), {"kind": "toc"}, T("z"), H(1, "Índice"), T("w")]
    out = P.drop_cover(P.drop_toc_and_sections(blocks(doc, [T("only")])))
    assert shown(out, "doc_id", "text") == [(0, "A"), (0, "B"), (0, "z"), (1, "only")]


def test_nested_drop_does_not_reopen(blocks):
    doc = [H(1, "Contents"), H(2, "Changelog"), T("a"), H(2, "Other"), T("b"), H(1, "End")]
    assert shown(P.drop_toc_and_sections(blocks(doc)), "text") == [("End",)]


def test_code_merge(blocks):
    blank = {"kind": "blank"}
    doc = [T("p"), blank, T("  a “q”", "code"), blank, T("  b", "code"), blank, T("q"), T("c", "code", lang="py")]
    assert shown(P.merge_code(blocks(doc)), "kind", "text") == [("para", "p"), ("blank", None), ("code", 'a "q"\n\nb'), ("para", "q"), ("code", "c")]


def test_callouts_labels_levels(blocks):
    doc = [H(2, "Response <200>"), H(2, "Parameters (HTTP 200)"), T("Nota: x"), T("Nota:"), H(5, "2. Real"), H(9, " . ")]
    out = P.remap_levels(P.demote_labels(P.convert_callouts(blocks(doc))), 2, 3)
    assert shown(out, "kind", "text", "level", "emoji") == [
        ("heading", "Response <200>", 2, None), ("para", "**Parameters (HTTP 200)**", None, None), ("callout", "x", None, "📘"), ("para", "Nota:", None, None), ("heading", "Real", 3, None),
    ]


def test_split(blocks):
    doc = [T("pre"), H(2, "A"), T("x"), H(2, "B"), H(2, "C"), {"kind": "blank"}]
    out = P.split_sections(blocks(doc), 2).groupBy("section").agg(F.max("section_title").alias("t"), F.count(F.when(F.col("kind") != "blank", 1)).alias("n"))
    assert sorted(map(tuple, out.collect())) == [(0, None, 1), (1, "A", 1), (2, "B", 0), (3, "C", 0)]


def test_render(blocks):
    doc = [
        H(2, "T {x}"), T("curl x\n```", "code"), T("a\nb", "list", level=0, ordered=True), T("c", "list", level=3, ordered=False), T("d", "list", level=1, ordered=False), T(" ", "para"),
        T("e", "list", level=1, ordered=False), T("body", "callout", emoji="📘"), {"kind": "table", "rows": [["**h**", "k"], ["x"]]}, T("<Table/>", "mdxtable"),
    ]
    body = render(blocks(doc)).first().body
    assert body == (
        "## T \\{x\\}\n\n````bash\ncurl x\n```\n````\n\n1. a<br />b\n   - c\n   - d\n- e\n\n"
        '<Callout icon="📘" theme="info">\nbody\n</Callout>\n\n| h | k |\n| --- | --- |\n| x |   |\n\n<Table/>\n'
    )
    assert render(blocks([T("x", "callout", emoji="🚧")]), "blockquote").first().body == "> 🚧 x\n"


def test_pipe_table_edges(spark):
    df = spark.createDataFrame([([["**a** and **b**", ""]],)], "rows array<array<string>>")
    assert df.select(pipe_table(F.col("rows"))).first()[0] == "| **a** and **b** |   |\n| --- | --- |\n|   |   |"


def test_convert(spark):
    files = spark.createDataFrame(
        [
            (1, "my-doc.md", "markdown", bytearray(b"---\ntitle: X\nslug: keep\nexcerpt: e\nmetadata:\n  a: 1\nhidden: false\n---\n# One\n\ntext <T>\n")), (2, "w.docx", "docx", bytearray(G.Word().add("Head", style="Part").add("b").packed())),
            (3, "bad.docx", "docx", bytearray(b"PK")), (4, "p.html", "html", bytearray("<title>Ü</title><h1>Z</h1><p>q".encode())), (5, "e.md", "markdown", None),
        ],
        "doc_id int, filename string, fmt string, content binary",
    )
    out = {r.doc_id: r for r in convert(files).collect()}
    assert out[1].path == "keep.md" and out[1].text == '---\ntitle: "X"\nhidden: true\nexcerpt: e\nmetadata:\n  a: 1\n---\n\n## One\n\ntext \\<T\\>\n'
    assert out[2].text == '---\ntitle: "w"\nhidden: true\n---\n\n## Head\n\nb\n' and out[4].title == "Ü"
    assert out[3].error and out[5].error and out[3].text is None


def test_convert_split(spark):
    files = spark.createDataFrame([(1, "d.md", "markdown", "# A\n\nx\n\n# A\n\ny\n\n# A 2\n"), (2, "s.md", "markdown", "plain")], "doc_id int, filename string, fmt string, content string")
    rows = {(r.doc_id, r.path): r.text for r in convert(files, Options(split=1, category="c", no_frontmatter=True)).collect()}
    assert rows == {(1, "c/a.md"): "x\n", (1, "c/a-2.md"): "y\n", (1, "c/a-2-2.md"): "\n", (1, "c/_order.yaml"): "- a\n- a-2\n- a-2-2\n", (2, "c/s.md"): "plain\n", (2, "c/_order.yaml"): "- s\n"}


def test_formats(spark):
    def z(*names):
        return bytearray(zip_bytes([(n, b"x") for n in names]))

    rows = [("a.zip", z("b.md")), ("b", z("word/document.xml")), ("c.docx", z("q")), ("d", bytearray(b"\xef\xbb\xbf <!DOCTYPE html>")), ("e.md", bytearray(b"<html>")), ("f", bytearray(b"junk%PDF-1")), ("g", bytearray(b"\xd0\xcf")), ("h", bytearray(b"a\0b")), ("i.html", bytearray(b"x")), ("j", bytearray(b"text"))]
    df = spark.createDataFrame(rows, "filename string, content binary")
    got = {r.filename: r.fmt for r in formats.format_of(df).collect()}
    assert got == {"a.zip": "archive", "b": "docx", "c.docx": "docx", "d": "html", "e.md": "html", "f": "pdf", "g": "docx", "h": "docx", "i.html": "html", "j": "markdown"}


def test_layout(spark):
    docs = [
        ("01-Guide/02-b.md", "b", "B"), ("01-Guide/10-a.md", "a", "A"), ("01-Guide/B.md", "B", "B2"), ("01-Guide/sub/index.md", "index", "I"), ("01-Guide/sub/x.md", "x", "X"),
        ("01-Guide/sub/d3/y.md", "y", "Y"), ("01-Guide/sub/d3/d4/d5/z.md", "z", "Z"), ("loose.md", "loose", "L"),
    ]
    out = {r.path: r.text for r in layout(spark.createDataFrame(docs, "src_path string, slug string, body string")).collect()}
    assert out == {
        "docs/_order.yaml": "- Guide\n- Documentation\n", "docs/Guide/_order.yaml": "- b\n- a\n- B-2\n- sub\n", "docs/Guide/b.md": "B", "docs/Guide/a.md": "A", "docs/Guide/B-2.md": "B2",
        "docs/Guide/sub/index.md": "I", "docs/Guide/sub/_order.yaml": "- d3\n- x\n", "docs/Guide/sub/x.md": "X", "docs/Guide/sub/d3/index.md": '---\ntitle: "d3"\nhidden: true\n---\n',
        "docs/Guide/sub/d3/_order.yaml": "- d4\n- y\n", "docs/Guide/sub/d3/y.md": "Y", "docs/Guide/sub/d3/d4-d5-z.md": "Z", "docs/Documentation/_order.yaml": "- loose\n", "docs/Documentation/loose.md": "L",
    }
    specs = spark.createDataFrame([("s/pet.yaml", bytearray(b"openapi: 3"))], "name string, content binary")
    assert {r.path: bytes(r.data) for r in specifications(specs).collect()} == {"reference/pet.yaml": b"openapi: 3", "reference/_order.yaml": b"- pet\n"}


def test_archive_and_zip(spark):
    data = zip_bytes([("g/01-a.md", b"# A\n\nx"), ("g/bad.docx", b"PK"), (".hidden.md", b"x"), ("__MACOSX/g/a.md", b"x"), ("s.json", b'{"openapi": 1}'), ("c.yml", b"a: 1")])
    archive = spark.createDataFrame([("a.zip", bytearray(data)), ], "path string, content binary")
    out = {r.path for r in convert_archives(archive).where("error is null").collect()}
    assert out == {"docs/_order.yaml", "docs/g/_order.yaml", "docs/g/a.md", "reference/s.json", "reference/_order.yaml"}
    assert [tuple(r)[:2] for r in member_errors(archive).collect()] == [("a.zip", "g/bad.docx")]
    files = spark.createDataFrame([("z", "b.md", "B", None), ("z", "a.bin", None, bytearray(b"\1"))], "archive string, path string, text string, data binary")
    content = zips(files).first().content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert {i.filename: z.read(i) for i in z.infolist()} == {"a.bin": b"\1", "b.md": b"B"} and z.infolist()[0].date_time[0] == 1980
    assert {r.path for r in published_paths(files).collect()} == {"docs/a.bin", "docs/b.md"}
    many = spark.createDataFrame([(0, i, p) for i, p in enumerate(["a.md", "a.md", "a-2.md", "a.md"])], "batch int, pos int, path string")
    assert [r.path for r in free_paths(many).orderBy("pos").collect()] == ["a.md", "a-2.md", "a-2-2.md", "a-3.md"]


HOSTILE = "Send <YOUR_TOKEN> and {\"a\": 1} if a < b and c > d"


def test_hostile_text_is_safe_in_every_format(spark):
    text = HOSTILE.replace("&", "&amp;")
    xml = text.replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    word = G.Word().add(HOSTILE, style="Part").add(HOSTILE).add(HOSTILE, list_of="dots")
    files = [
        ("m", "m.md", "markdown", f"# {text}\n\n{text}\n\n- {text}\n\n| {text} |\n|--|--|\n| x |\n\n```\n{text}\n```\n".encode()), ("h", "h.html", "html", f"<h1>{xml}</h1><p>{xml}<ul><li>{xml}</ul><table><tr><td>{xml}</table>".encode()),
        ("d", "d.docx", "docx", word.packed()), ("p", "p.pdf", "pdf", G.pdf(G.Sheet().put(HOSTILE, 60, 90, 18).put(HOSTILE + " in the body of it.", 60, 140))),
    ]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in files], "doc_id string, filename string, fmt string, content binary")
    for r in convert(df).select("doc_id", "error", hazards(F.col("text")).alias("n")).collect():
        assert r.error is None and r.n == 0, r
    assert spark.range(1).select(hazards(F.lit("a {b} <TOKEN>"))).first()[0] > 0


def test_readers_keep_failures_apart(spark):
    files = spark.createDataFrame([(1, "a.pdf", "pdf", bytearray(b"%PDF-1")), (2, "b.md", "markdown", bytearray(b"x"))], "doc_id int, filename string, fmt string, content binary")
    read = read_documents(files)
    assert [r.doc_id for r in read.where("error is null").collect()] == [2] and block_rows(read).count() == 1


def test_options():
    assert from_choices("keep", True) == Options(keep_cover=True, labels=(), drop_sections=())
    assert from_choices(extra_labels=("Ñandú: ",)).labels[-1] == "nandu"
    with pytest.raises(ValueError):
        Options(split=5)


def test_streaming(spark, tmp_path):
    from inkmill.streaming.ingest import incoming, write_pages

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nx")
    for _ in range(2):
        write_pages(incoming(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
        (tmp_path / "in" / "b.html").write_text("<h1>B</h1>")
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.md", "b.md"]


def test_arrivals(spark, tmp_path):
    from inkmill.streaming.ingest import arrivals, incoming

    (tmp_path / "in").mkdir()
    for name in ("a.md", "b.MD", "c.html"):
        (tmp_path / "in" / name).write_text("x" * 5)
    query = arrivals(incoming(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("arrived").groupBy("ext").agg(F.sum("files").alias("n"), F.sum("bytes").alias("b")).collect()
    assert {(r.ext, r.n, r.b) for r in rows} == {("md", 2, 10), ("html", 1, 5)}


def test_refused_files_are_errors(spark):
    files = spark.createDataFrame([("p/a.doc", "a.doc", 1, bytearray(b"x")), ("p/b.md", "b.md", 1, bytearray(b"x"))], "path string, filename string, length long, content binary")
    rows = {r.doc_id: r for r in convert_files(files).collect()}
    assert "save this one as .docx" in rows["p/a.doc"].error and rows["p/b.md"].path == "b.md" and rows["p/b.md"].error is None


def picture_doc():
    word = G.Word()
    pictures = {n: word.picture(f"media/{n}", n.encode()) for n in ("p1.PNG", "p2.PNG", "p3", "p4.PNG")}
    pictures["p5.gif"] = word.picture("word/media/p5.gif", b"p5.gif", "word/media/p5.gif")
    missing = word.picture("media/p9.png")
    word.add(pictures["p1.PNG"]).add("One", style="Part").add("seen", pictures["p2.PNG"]).add(missing, pictures["p3"]).add(word.same_picture("k2"))
    word.add("Contents", style="Part").add(pictures["p4.PNG"]).add("Two", style="Part").add(pictures["p5.gif"])
    return word.packed()


def test_images_of_word_documents(spark):
    """The cover's image and that of a dropped section have no file and no number; a missing one has a number."""
    files = spark.createDataFrame([(1, "My Doc.docx", "docx", bytearray(picture_doc())), (2, "bad.docx", "docx", bytearray(b"PK")), (3, "m.md", "markdown", bytearray(b"x"))], "doc_id int, filename string, fmt string, content binary")
    rows = convert(files, Options(category="c", image_dir="pics", no_frontmatter=True)).collect()
    assert [r.text for r in rows if r.doc_id == 1 and r.data is None] == ["## One\n\nseen\n![](pics/my-doc-01.PNG)\n\n![](pics/my-doc-03.png)\n\n![](pics/my-doc-01.PNG)\n\n## Two\n\n![](pics/my-doc-04.gif)\n"]
    images = {r.path: bytes(r.data) for r in rows if r.data is not None}
    assert images == {"c/pics/my-doc-01.PNG": b"p2.PNG", "c/pics/my-doc-03.png": b"p3", "c/pics/my-doc-04.gif": b"p5.gif"}
    assert len([r for r in rows if r.error]) == 1
    split = {r.path: r.text for r in convert(files.where("doc_id = 1"), Options(split=1, no_frontmatter=True)).collect()}
    assert split["two.md"] == "![](images/my-doc-04.gif)\n" and "images/my-doc-04.gif" in split


def test_assets_beside_pages(spark):
    """Of equal paths the page written first wins: in a flattened folder pages come before folders."""
    names = ["g/s/01-a.docx", "g/a.docx", "g/s/t/u/v/a.docx", "g/s/t/u/z/a.docx", "g/s/t/u/a.docx", "g/s/index.docx"]
    docs = spark.createDataFrame([(n, "index" if "index" in n else "a", n) for n in names], "src_path string, slug string, body string")
    files = spark.createDataFrame([(n, "images/" + n.rsplit("/", 1)[-1][:-5] + "-01.png", bytearray(n.encode())) for n in names], "src_path string, path string, data binary")
    assert {r.path: bytes(r.data).decode() for r in assets(docs, files).collect()} == {
        "docs/g/images/a-01.png": "g/a.docx", "docs/g/s/images/01-a-01.png": "g/s/01-a.docx", "docs/g/s/images/index-01.png": "g/s/index.docx", "docs/g/s/t/images/a-01.png": "g/s/t/u/a.docx",
    }


def test_archives_apart(spark):
    """A run's title, splitting and folder are not a member's; archives don't meet; one without documents is an error."""
    word = G.Word().add("W", style="Part")
    word.add(word.picture("media/x.png", b"png"))
    one = bytearray(zip_bytes([("g/01-a.md", b"# A\n\n# B\n\nx"), ("g/w.docx", word.packed()), ("g/keep.md", b"---\nslug: kept\n---\ny")]))
    two = bytearray(zip_bytes([("g/01-a.md", b"# Other\n\nx"), ("api.json", b'{"openapi": 1}')]))
    none = bytearray(zip_bytes([("notes.csv", b"x"), ("api.json", b'{"openapi": 1}')]))
    df = spark.createDataFrame([("1.zip", one), ("2.zip", two), ("3.zip", none), ("4.zip", bytearray(b"PK"))], "path string, content binary")
    rows = convert_archives(df, Options(title="Run title", split=1, category=" Cat ", no_frontmatter=True)).collect()
    got = {(r.archive, r.path): r.text for r in rows if r.text is not None}
    assert got["1.zip", "docs/g/a.md"] == '---\ntitle: "01 a"\nhidden: true\n---\n\n## A\n\n## B\n\nx\n' and "## Other" in got["2.zip", "docs/g/a.md"]
    assert got["1.zip", "docs/g/_order.yaml"] == "- a\n- kept\n- w\n" and got["1.zip", "docs/_order.yaml"] == "- g\n"
    assert "![](images/w-01.png)" in got["1.zip", "docs/g/w.md"] and [bytes(r.data) for r in rows if r.path == "docs/g/images/w-01.png"] == [b"png"]
    assert {(r.archive, r.path) for r in rows if r.data is not None and r.path.startswith("reference")} == {("2.zip", "reference/_order.yaml"), ("2.zip", "reference/api.json")}
    assert {r.archive: r.path for r in rows if r.error} == {"3.zip": None, "4.zip": None} and len([r for r in rows if r.error]) == 2


def test_archive_report(spark):
    data = zip_bytes([("g/a.md", b"# A\n\n```\nx\n```\n\nNota: y\n\n<T>"), ("g/A.md", b"# A\n\n```\nz\n```"), ("g/h/i/j/k.md", b"k"), ("loose.md", b"q"), ("bad.pdf", b"%PDF-")])
    rows = [(r.metric, r.value) for r in archive_reports(spark.createDataFrame([("a.zip", bytearray(data))], "path string, content binary")).collect()]
    found = dict(rows)
    assert found["codeBlocks"] == "2" and found["callouts"] == "1" and found["mdEscapedTags"] == "1" and found["categories"] == "2" and found["pages"] == "4" and found["parents"] == "2" and found["stubs"] == "2"
    assert found["failed"].startswith("bad.pdf: ") and "loose documents" in found["note"]
    assert sorted(v for k, v in rows if k == "warning") == ['"a" is taken in "g": the later one is "a-2"', '"g/h/i/j" is deeper than 3 page levels: its pages are in "g/h/i"']


def test_reports_of_passes(spark):
    text = "cover line\n\n# One\n\n## Contents\n\n### Changelog\n\ngone\n\n## ...\n\n## Parameters:\n\nNota: x\n\n```\ncurl “a”\n```\n\n#### Deep\n\n###### Deeper\n\n# Changelog\n"
    files = spark.createDataFrame([(1, "d.md", "markdown", text)], "doc_id int, filename string, fmt string, content string")
    got = {r.metric: r.value for r in reports(read_documents(files), Options()).collect()}
    assert got == {
        "blocksIn": "12", "droppedSections": "Contents, Changelog", "coverLines": "cover line", "codeBlocks": "1", "autocorrectFixes": "2", "callouts": "1", "emptyHeadings": "1", "demoted": "Parameters:",
        "headingMap": "h1→h2, h4→h3, h6→h3", "collapsedLevels": "h4, h6", "mdCodeBlocks": "1",
    }


def test_free_names(spark):
    names = ["page", "page", "Page", "page-2", "a", "a", "a-2-2", "a-2", "b-1", "b-2", "a"]
    rows = spark.createDataFrame([(d, i, n) for d in ("x", "y") for i, n in enumerate(names)], "d string, i int, n string")
    for fold in (True, False):
        got = {(r.d, r.i): r.n for r in free_names(rows, ["d"], [F.col("i")], "n", fold).collect()}
        assert got == {(d, i): n for d in ("x", "y") for i, n in enumerate(first_free(names, fold))}
    assert first_free(["a", "a", "a-2", "a"]) == ["a", "a-2", "a-2-2", "a-3"]


def test_kept_frames_are_cleared(spark):
    from pathlib import Path

    from inkmill.operators.kept import _folder, clear, kept

    assert kept(spark.range(3), "three").count() == 3
    folder = Path(_folder(spark).removeprefix("file:"))
    assert folder.exists()
    clear(spark)
    assert not folder.exists()


def test_documents_are_read_once(spark):
    """One pass over the documents, whatever becomes of them."""
    files = spark.createDataFrame([(1, "d.md", "markdown", "# A\n\nx")], "doc_id int, filename string, fmt string, content string")
    for options in (Options(), Options(split=1), Options(no_callouts=True, no_frontmatter=True)):
        plan = convert(files, options)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1 and plan.count("Exchange hashpartitioning") == 2 + (options.split > 0), plan


def test_split_keeps_documents_without_blocks(spark):
    files = spark.createDataFrame([(1, "gone.md", "markdown", "# Contents\n\nx\n")], "doc_id int, filename string, fmt string, content string")
    rows = {r.path: r.text for r in convert(files, Options(split=1, no_frontmatter=True)).collect()}
    assert rows == {"gone.md": "\n", "_order.yaml": "- gone\n"}


def test_pdf_cover_is_kept(spark):
    pages = [G.Sheet().put("Open API", 120, 300, 28).put("Guide", 130, 350, 22), G.Sheet().put("Intro", 60, 90, 16).put("Ordinary body copy on the second page of it.", 60, 130)]
    files = spark.createDataFrame([(1, "a.pdf", "pdf", bytearray(G.pdf(*pages)))], "doc_id int, filename string, fmt string, content binary")
    assert ["Open API" in r.text for r in convert(files, Options(keep_cover=True)).collect()] == [True]


def _write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_documents_of_blanks_alone_have_no_page(spark, tmp_path):
    """render_blocks against its SQL, where passes leave one customer nothing but a blank."""
    import duckdb

    from inkmill.plans.registry import ORACLE, QUERIES

    day = datetime(2000, 1, 1)
    _write(spark, tmp_path, "orders", [(4, 1, day, "1-URGENT"), (5, 2, day, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string")
    lines = [(4, 9, 9, 2, 1.0, 1.0, "N"), (5, 8, 9, 1, 1.0, 1.0, "A")]
    _write(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLE["render_blocks"]).fetchall()
    assert [tuple(r) for r in QUERIES["render_blocks"](spark, str(tmp_path)).collect()] == want and [w[0] for w in want] == [2]
