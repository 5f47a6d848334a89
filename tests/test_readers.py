import pytest

from inkmill.functions.mdx_table import clean_tables
from inkmill.plans import samples as G
from inkmill.sources.docx import docx_document, docx_to_blocks
from inkmill.sources.html import html_to_blocks
from inkmill.sources.markdown import markdown_to_blocks, split_row
from inkmill.sources.pdf import Glyph, group_lines, lines_to_blocks, pdf_to_blocks


def kinds(blocks):
    return [(b["kind"], b.get("text")) for b in blocks]


def test_html_formatting_reopens_in_later_paragraphs():
    blocks, report = html_to_blocks("<title>T</title><body><h1>A</h1><p><b>one<p>two <b>x<p>three")
    assert report["htmlTitle"] == "T"
    assert kinds(blocks) == [("heading", "A"), ("para", "**one**"), ("para", "**two **x****"), ("para", "****three****")]


def test_html_noahs_ark():
    blocks, _ = html_to_blocks("<body>" + "<p><b>a" * 6)
    assert blocks[-1]["text"].count("*") == 2 * 2 * 4  # three reopened and its own


def test_html_structure():
    page = (
        "<body><nav><a href=1>x</a></nav><main><h2>T&amp;c</h2><div class=sidebar><a href=a>1</a><a href=b>2</a><a href=c>3</a></div>"
        "<ul><li>a<ol><li>b</ol><li>c<pre class=language-py>x\n</pre></ul><table><tr><th colspan=2>h|1<td>z<tr><td>q</table>"
        "<p>see <a href='https://x/a (b)'>it</a> <code>a`b</code><br>n <em> e </em><img src=i.png alt='[q]'>" + "words " * 60 + "</main><footer>f</footer>"
    )
    blocks, report = html_to_blocks(page)
    assert report["htmlRoot"] == "main" and report["htmlChromeDropped"] == 1 and report["htmlRelativeImages"] == 1
    assert kinds(blocks)[:4] == [("heading", "T&c"), ("list", "a"), ("list", "b"), ("list", "c")]
    assert (blocks[2]["level"], blocks[2]["ordered"]) == (1, True)
    assert blocks[4] == {"kind": "code", "text": "x", "lang": "py"}
    assert blocks[5]["rows"] == [["h\\|1", "", "z"], ["q"]]
    assert blocks[6]["text"].startswith("see [it](https://x/a%20%28b%29) ``a`b``\nn *e* ![q](i.png)words")


def test_html_word_export():
    blocks, report = html_to_blocks("<p class=MsoHeading2>H</p><p class=MsoToc1>t</p><p class=MsoListParagraph>· item</p><p>x<o:p>y</o:p></p>")
    assert kinds(blocks) == [("heading", "H"), ("list", "item"), ("para", "x")] and report["htmlWordLists"] == 1


def test_html_empty():
    with pytest.raises(ValueError):
        html_to_blocks("<body> </body>")
    with pytest.raises(ValueError):
        html_to_blocks(None)


def test_html_misnested():
    blocks, _ = html_to_blocks("<p>t <i>a<b>x</i>y</b> z")
    assert blocks[0]["text"] == "t *a**x*****y** z"


def test_markdown_blocks():
    blocks, report = markdown_to_blocks(
        "---\ntitle: \"X\"\nslug: s\n---\nIntro <T>\n# A #\npara\nline\n\n- a\n    - b\n  cont\n\n1) n\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n\n> 📘 note\n\n> plain\n> two\n\n"
        "~~~py\n```\n~~~\nSet\n===\n***\n<Callout icon=\"⚠️\">\n## hi\n</Callout>\n</li></ul>\n````\nopen"
    )
    assert kinds(blocks) == [
        ("para", "Intro \\<T\\>"), ("heading", "A"), ("para", "para line"), ("list", "a"), ("list", "b cont"), ("list", "n"), ("table", None), ("callout", "note"),
        ("para", "plain\ntwo"), ("code", "```"), ("heading", "Set"), ("callout", "hi"), ("code", "open"),
    ]
    assert blocks[6]["rows"] == [["a", "b"], ["1", "x\\|y"]] and blocks[5]["ordered"] and blocks[4]["level"] == 1
    assert report["mdTitle"] == "X" and report["mdSlug"] == "s" and report["mdOrphanClosers"] == 1
    assert markdown_to_blocks(None)[0] == [] and split_row("| a \\| b | c") == ["a \\| b", "c"]


def table(cell):
    return f"<Table><thead><tr><th>H</th></tr></thead><tbody><tr><td>{cell}</td></tr></tbody></Table>"


@pytest.mark.parametrize(
    ("cell", "inside"),
    [
        ("<b>x</st", "**x**"), ("a<br>b", "a\n\n        b"), ("<ul><li>a<li>b</ul>", "- a\n        - b"), ("<ul><li>a</li><ul>", "- a"), ("<li>a", "- a"),
        ("- a\n- b", "- a\n        - b"), ("<ol><li>a</li><li>b</ol>", "1. a\n        2. b"), ("x {y} <Z>", "x \\{y\\} \\<Z\\>"), ("`<a>`", "`<a>`"), ("<a href=\"u\">t</a>", "[t](u)"), ("</b>x</b>", "**x**"),
    ],
)
def test_broken_cells(cell, inside):
    out, _ = clean_tables(table(cell))
    assert inside in out
    assert clean_tables(out)[0] == out  # what is repaired stays as it is


def test_tables_around():
    assert clean_tables("a <Table> b")[0] == "a <Table> b"
    text, report = clean_tables(f"p {table('x')}</li></ul> q {table('y|z')}")
    assert text == "p | H |\n| --- |\n| x | q | H |\n| --- |\n| y\\|z |" and report == {"mdxTables": 2, "mdxTablesRepaired": 1, "mdxTablesToPipe": 2}
    assert "colSpan={2}" in clean_tables(table("x").replace("<td>", '<td colspan="2"><ul><li>').replace("x", "i"))[0]


def test_docx():
    word = G.Word("Core")
    word.add("Contents", style="Index").add("One", style="Part").add("Sub one", style="SubTopic")
    word.add(word.text("a ", "b"), word.text("b", "b"), word.text(" hid", "vanish"), word.text(" {c}", "i", "b=0"), word.text("x", "strike"))
    word.add("let x", style="Listing").add().add("i", list_of="dots").add("n", list_of="steps", depth=1)
    word.add(word.link("go", "http://a/b (c)"), word.link("up", "#top"), word.picture("media/p.png", b"png"), word.picture("media/gone.png"))
    word.table([([word.paragraph("h|"), word.paragraph("k")], 2)])
    word.add(G.node("smartTag", G.Word.text("in")), G.node("del", G.Word.text("out")), G.node("ins", G.Word.text("to\nit")))
    data = word.packed()
    blocks, report = docx_to_blocks(data)
    assert report["docxTitle"] == "Core"
    assert kinds(blocks) == [
        ("toc", None), ("heading", "One"), ("heading", "Sub one"), ("para", "**a b** *\\{c\\}*~~x~~"), ("code", "let x"), ("blank", None), ("list", "i"), ("list", "n"),
        ("para", "[go](http://a/b%20%28c%29)up"), ("table", None), ("para", "into\nit"),
    ]
    assert blocks[2]["level"] == 2 and [(b["ordered"], b["level"]) for b in blocks[6:8]] == [(False, 0), (True, 1)]
    assert blocks[9]["rows"] == [["h\\|<br />k", ""]] and blocks[8]["images"] == ["k3", "k4"]
    assert docx_document(data)[2] == [("k3", b"png")] and blocks[8]["exts"] == [".png", None]
    with pytest.raises(ValueError, match="older Word"):
        docx_to_blocks(b"\xd0\xcf" + b"\0" * 600)


def lines(*items):
    return group_lines([Glyph(t, x, y, w or len(t) * s * 0.5, s, f) for t, x, y, s, f, w in items])


def item(text, x, y, size=10, font="Helvetica", width=0):
    return (text, x, y, size, font, width)


def test_pdf_lines():
    assert [x.text for x in lines(item("world", 150, 100), item("Hello", 100, 100))] == ["Hello world"]
    blocks, _ = lines_to_blocks([lines(item("Chapter One", 72, 100, 20), item("Ordinary body copy that runs on for a while.", 72, 130), item("More ordinary body copy here.", 72, 150))], True)
    assert blocks[0] == {"kind": "heading", "level": 1, "text": "Chapter One"} and all(b["kind"] == "para" for b in blocks[1:])
    rows = [item(t, x, y) for y, r in ((100, "Field Type Req"), (120, "id string yes"), (140, "name <x> no")) for t, x in zip(r.split(), (72, 220, 380), strict=True)]
    blocks, report = lines_to_blocks([lines(*rows)], True)
    assert blocks[0]["rows"] == [["Field", "Type", "Req"], ["id", "string", "yes"], ["name", "\\<x\\>", "no"]] and report["pdfTables"] == 1
    blocks, _ = lines_to_blocks([lines(item("The authorization proce-", 72, 100, width=400), item("dure requires {x}.", 72, 114, width=300))], True)
    assert kinds(blocks) == [("para", "The authorization procedure requires \\{x\\}.")]
    assert [b["kind"] for b in lines_to_blocks([lines(item("curl \\", 72, 100, font="CourierNew"), item("  -d", 72, 116, font="CourierNew"))], True)[0]] == ["code", "code"]
    assert kinds(lines_to_blocks([lines(item("• First", 72, 100), item("• Second", 72, 120))], True)[0]) == [("list", "First"), ("list", "Second")]


def test_pdf_furniture_and_cover():
    pages = [lines(item("Acme — Confidential", 72, 40), item(f"Content of page {n} is unique.", 72, 200), item(str(n), 300, 760)) for n in (1, 2, 3)]
    blocks, report = lines_to_blocks(pages, True)
    assert all("Confidential" not in b["text"] for b in blocks) and len(blocks) == 3 and report["pdfFurnitureDropped"] == 6
    cover = lines(item("Open API", 120, 300, 28), item("Guide", 130, 350, 22))
    blocks, report = lines_to_blocks([cover, lines(item("Intro", 72, 100, 16), item("Ordinary body copy on the second page.", 72, 130))])
    assert report["coverLines"] == ["Open API", "Guide"] and kinds(blocks)[0] == ("heading", "Intro")


def test_pdf_file():
    sheet = G.Sheet().put("Head", 60, 90, 18).put("Body copy (one) of this page \\ here.", 60, 130).put("let x", 60, 170, 10, fixed=True)
    assert kinds(pdf_to_blocks(G.pdf(sheet))[0]) == [("heading", "Head"), ("para", "Body copy (one) of this page \\\\ here."), ("code", "let x")]
    with pytest.raises(ValueError, match="scanned"):
        pdf_to_blocks(G.pdf(G.Sheet()))


def test_word_files_are_generated_by_all_cores(spark, tmp_path):
    from pyspark.sql import functions as F

    from inkmill.plans import registry

    rows = [(i, f"ring {i}", "SMALL", "Brand#1") for i in range(64)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = registry._files(spark, str(tmp_path), registry._word, "docx")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert len({r.task for r in files.select(F.spark_partition_id().alias("task")).collect()}) > 1
