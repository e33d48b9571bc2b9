import io
import zipfile

import pytest

from tessera.sources import files
from tessera.sources.text_formats import docx_text, html_text, plain_text


def test_plain_and_html():
    assert plain_text("é".encode()) == "é" and plain_text("é".encode("latin-1")) == "é"
    page = b"<html><head><style>x</style></head><body><header>H</header><nav><a>N</a></nav><p>One &amp; two<br>three</p><script>s()</script><footer>F</footer></body></html>"
    assert html_text(page) == "One & two\nthree"


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {w}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_text(buf.getvalue()) == "One line\n\nTwo"


def test_html_main_content_and_tables():
    page = b"<body><div>Menu</div><article><h1>T</h1><!-- no --><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><b>x</b> y</td></tr></table><p>Body text.</p></article><aside>More</aside></body>"
    assert html_text(page) == "T\na | b\n1 | x y\nBody text."
    assert html_text(b"<main></main><p>only</p>") == "only" and html_text(b"<article>open<p>end") == "open\nend"


def test_csv_modes(spark, tmp_path):
    contents = {
        "narrative": b"id,Text\n1,a\n2,\n3,b\n", "entities": b"name,type,x\nA,T,1\n,T,2\nB,,\n", "table": b"a,b\n" + b"".join(b"%d,x\n" % i for i in range(250)), "nothing": b"\n", "head": b"a,b\n",
        "numbers": b"a,b,c\n1.50,True,\"x,  y\"\n,False,NA\n", "long": b"a\n1,2\n", "short": b"\xef\xbb\xbfa,b\n\n1\n",
    }
    for name, content in contents.items():
        (tmp_path / f"{name}.csv").write_bytes(content)
    rows = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["filename"].removesuffix(".csv"): r for r in files.parse_files(rows).collect()}
    assert got["narrative"]["text"] == "a\n\n---\n\nb" and got["narrative"]["extra"] == {"row_count": "3", "csv_mode": "narrative"}
    assert got["entities"]["text"] == "## A\n- **Type:** T\n- **x:** 1.0\n\n## B\n- **Type:** unspecified" and got["entities"]["extra"]["csv_mode"] == "entity_per_row"
    assert got["table"]["text"].startswith("Schema: a (int64), b (object)\n\nRows (200 of 250):\n- a=0; b=x\n") and got["table"]["extra"]["truncated_to"] == "200" and got["table"]["text"].endswith("- a=199; b=x")
    assert got["nothing"]["extra"]["csv_mode"] == got["head"]["extra"]["csv_mode"] == "empty" and got["nothing"]["text"] == ""
    assert got["numbers"]["text"] == "Schema: a (float64), b (bool), c (object)\n\nRows (2 of 2):\n- a=1.5; b=True; c=x, y\n- b=False"
    assert got["long"]["text"] is None and "line 2" in got["long"]["error"] and got["short"]["text"].endswith("- a=1")


def test_parse_topic(spark, tmp_path):
    (tmp_path / "a.md").write_text("  hello \n")
    (tmp_path / "b.xyz").write_text("no")
    (tmp_path / "c.txt").write_text("  ")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.md").write_text("deeper")
    docs = files.parse_topic(spark, str(tmp_path)).collect()
    assert [(r["filename"], r["text"]) for r in docs] == [("a.md", "hello")] and docs[0]["mtime"] > 1e9
    bad = [r for r in files.parse_topic(spark, str(tmp_path), with_errors=True).collect() if r["error"]]
    assert [r["filename"] for r in bad] == ["d.docx"]
    with pytest.raises(FileNotFoundError):
        files.parse_topic(spark, str(tmp_path / "none"))


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text('{"a": ')
    read = lambda n: [r["a"] for r in files.tolerant_json(spark, str(tmp_path / n), "a long").collect()]
    assert read("good.json") == [1] and read("bad.json") == [] and read("none.json") == []
