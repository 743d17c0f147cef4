import pytest
from pyspark.sql import functions as F

from docloom import config
from docloom.functions import chunking, tokens, urls
from docloom.functions.context import compact
from docloom.functions.html_md import html_to_markdown, links_of


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_addresses(spark):
    x = F.col("x")
    rows = [("HTTPS://Docs.Example.com:443/doc/sdk/#anchor",), ("http://a.b/x/?q=1#f",), ("ftp://a.b/",), (None,), ("https://a.b",), ("http://a.b:8080/x?",)]
    assert values(spark, rows, urls.canonicalize(x)) == ["https://docs.example.com/doc/sdk", "http://a.b/x?q=1", None, None, "https://a.b/", "http://a.b:8080/x"]
    assert values(spark, [("https://a.b/doc/x",), ("https://a.b/qa",), ("https://c.d/doc",), ("https://A.B/doc",)], urls.in_scope(x, "a.b", "/doc")) == [True, False, False, True]
    scoped = [("https://a.b/doc/5.2.1/x",), ("https://a.b/doc/x",)]
    assert values(spark, scoped, urls.matches_scope(x, "a.b", "/doc", "5.2.1")) == [True, False]
    assert values(spark, scoped, urls.matches_scope(x, "a.b", "/doc", None)) == [False, True]
    assert values(spark, [("/doc/5.2.1/sdk",), ("/doc/sdk",), ("/doc/5",)], urls.version_of(x)) == ["5.2.1", None, None]
    paths = values(spark, [("https://a.b/doc/sdk/tools",), ("https://a.b/",), ("https://a.b/x?a=1",), ("https://a.b/x?a=2",)], urls.html_file_path(x))
    assert paths[:2] == ["doc/sdk/tools/index.html", "root/index.html"] and paths[2] != paths[3] and "/__q_" in paths[2]


def test_flat_names(spark):
    x = F.col("x")
    got = values(spark, [("doc/5.2.1/software_development/index.html",), ("doc/index.html",), ("doc/a/foo__bar/index.html",), ("x/index.html",)], urls.output_of(x))
    assert [tuple(r) if r else None for r in got] == [("5.2.1", "software_development.md"), ("default", "index.md"), ("default", "a__foo____bar.md"), None]
    assert values(spark, [("software_development__foo____bar__baz",)], urls.flat_decode(x)) == [["software_development", "foo__bar", "baz"]]
    made = urls.source_url("https://a.b", F.lit("5.2"), x)
    assert values(spark, [("index.md",), ("a__b.md",), ("a.txt",)], made) == ["https://a.b/doc/5.2", "https://a.b/doc/5.2/a/b", None]
    assert values(spark, [("x/chunks-00012.jsonl",), ("y",)], urls.shard_index(x, "chunks-")) == [12, None]
    assert values(spark, [("a/b",), ("/a",), ("a/../b",)], urls.safe_relative(x)) == [True, False, False]


def test_tokens(spark):
    x = F.col("x")
    got = values(spark, [("Как установить RPM пакет? mb2 rpmsign the to",)], tokens.canonical(x))
    assert got == [["install", "rpm", "build", "sign"]]
    assert values(spark, [("Install rpm",)], tokens.expand(x)) == ["Install rpm рпм установка установить"]
    assert values(spark, [(["sign", "record"],), (["video", "screenshot"],), ([],)], tokens.required_action(x), "x array<string>") == ["sign", "screenshot", None]
    assert values(spark, [("abcdef",), ("abc",)], tokens.shorten(x, 5)) == ["ab...", "abc"]
    assert values(spark, [("how to",), ("plain",)], tokens.is_howto(x)) == [True, False]


def test_markdown():
    assert html_to_markdown('<h2><span id="setup" style="left:0; position: absolute;"></span>Setup</h2>') == "## Setup {#setup}\n"
    assert html_to_markdown('<pre><code class="language-rust">fn x(){}</code></pre>') == "```rust\nfn x(){}\n```\n"
    assert html_to_markdown('<dl><dt id="t">Term</dt><dd>Definition A</dd><dd>Definition B</dd></dl>') == "Term {#t}\n: Definition A\n: Definition B\n"
    assert html_to_markdown('<table><tr><th align="left">A</th><th align="right">B</th></tr><tr><td>x</td><td>y</td></tr></table>') == "| A | B |\n| :-- | --: |\n| x | y |\n"
    page = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"content":"<p>own</p>"}}}</script><article><div class="prose"><p>prose</p></div></article>'
    assert html_to_markdown(page) == "own\n"
    assert html_to_markdown('<body><nav>no</nav><article><div class="prose"><p>prose</p></div></article></body>') == "prose\n"
    assert html_to_markdown("<p>a<p><b>x<br><p>y</b> z") == "a\n\n**x<br/>**\n\n**y** z\n"
    assert html_to_markdown("<ul><li>a<ul><li>b</ul><li>c</ul>") == "* a\n  * b\n\n* c\n"
    assert html_to_markdown("") == "\n"
    assert links_of('<a href="/x">1</a><a href="#y">2</a><a href="mailto:z">3</a><a href="/x">4</a>', "http://a.b/c") == ["http://a.b/x"]


def test_html_rules_at_the_edges():
    from docloom.functions.html_md import html_to_markdown, normalize_ws

    md = lambda inner: html_to_markdown(f"<html><body>{inner}</body></html>")
    assert md("<p>a <a>b</a> <a href=' /c '></a></p>") == "a [b]() [/c](/c)\n"
    assert md("<p>x<b> </b>y<i></i>z<code> </code></p>") == "x****y**z``\n"
    assert md("<p><code>a   b\nc</code> <code>`d</code></p>") == "`a   b c` `` `d ``\n"
    assert md("<a href='/x'>top</a><strong>s</strong><img src='i'><center>c</center>") == "top\n\ns\n\nc\n"
    assert md("<pre class='language-py'>plain</pre><pre><code class='a language-c'></code>own</pre>") == "```\nplain\n```\n\n```c\nown\n```\n"
    assert md("<pre>a\n  \nb\n\n\n\n\nc</pre>") == "```\na\n\nb\n\n\nc\n```\n"
    assert md("<blockquote><pre>a\n\n\n\n\nb</pre></blockquote>") == "> ```\n> a\n>\n>\n> b\n> ```\n"
    assert md("<table><tr><td>a<br> b<p>c <br> d</p>e|</td></tr></table>") == "| a<br/>b<br/>c <br/> d e\\| |\n| --- |\n"
    assert normalize_ws("a\u00a0\u2003\u3000\tb\u200bc") == "a b\u200bc"


def test_chunk_rules_at_the_edges():
    assert chunking.heading(" ## Indented") is None and chunking.heading("## Kept {# }") == (2, "Kept {# }", None)
    assert chunking.heading("### Closed ###") == (3, "Closed", None) and chunking.heading("####### Seven") is None
    assert [k for k, _ in chunking.blocks("text\n  ```py\n\n  | x |\n  ```\n| a |\n* b\n  c\nd")] == ["text", "code", "table", "list", "text"]
    assert chunking.split_code("```\n```") == ["```\n```"] and chunking.split_text("   ") == []
    rows = [f"| {k} {'y' * 200} |" for k in range(12)]
    whole = [x for p in chunking.split_table("\n".join([*rows[:6], "| --- |", *rows[6:]])) for x in p["text"].split("\n")]
    assert whole == [*rows[:6], "| --- |", *rows[6:]]  # a separator that isn't the second line is a row
    assert chunking.split_cell("<br/>" * 400, 1200) == ["<br/>" * 400]
    made = chunking.chunks("# T\n\n| a |\n| - |\n| b |\n\ntext\n\n|  k   l | " + "word " * 500 + "|", "s")
    parts = [c for c in made if c.cell_part_total]
    assert [c.cell_part_index for c in parts] == list(range(len(parts))) and {(c.table_ordinal, c.row_ordinal, c.row_key) for c in parts} == {(1, 0, "k l")}
    assert all(c.table_id is None and c.column_headers is None for c in made if not c.cell_part_total) and made[0].has_table


def test_chunks():
    assert chunking.heading("## Methods {#methods}") == (2, "Methods", "methods")
    pieces = chunking.split_text("This is a sentence for the test. " * 150)
    assert len(pieces) > 1 and pieces[0].endswith(".") and max(map(len, pieces)) <= chunking.HARD
    code = "```rust\n" + "\n".join(f"let value_{i} = {i};" for i in range(400)) + "\n```"
    assert all(p.startswith("```rust\n") and p.endswith("\n```") and len(p) <= chunking.HARD for p in chunking.split_code(code))
    table = "| A | B |\n| --- | --- |\n" + "\n".join(f"| row{i} | value {i} |" for i in range(500))
    parts = chunking.split_table(table)
    assert all(p["text"].startswith("| A | B |\n| --- | --- |\n") for p in parts)
    assert sum(p["text"].count("\n") - 1 for p in parts) == 500
    wide = "| Name | Values |\n| --- | --- |\n| big | " + "<br/>".join(f"entry {i}" for i in range(1500)) + " |"
    parts = chunking.split_table(wide)
    assert all(len(p["text"]) <= chunking.HARD and p["cell_part_total"] == len(parts) > 1 for p in parts)
    members = "* " + " * ".join(f"[member{i}](x/{i})" for i in range(320))
    assert all(p.startswith("*") and len(p) <= chunking.HARD for p in chunking.split_list(members))
    later = chunking.split_cell(" , ".join(f"entry number {i}" for i in range(300)), 1200)[1:]
    assert later and not any(p.startswith((",", ";", ":")) for p in later)
    made = chunking.chunks("# T\n\nintro\n\n### A\n\n" + "word " * 1000 + "\n\n### B\n\n* a\n* b\n")
    assert [c.path for c in made][-1][:1] == ["T"] and all(c.text.strip() and len(c.text) <= chunking.HARD for c in made)
    assert chunking.chunks("") == [] and chunking.chunks("x")[0].title == "Document"


def test_context():
    assert compact("`application_id`\n: Unique app id\n\n\nnext") == "application_id — Unique app id\n\nnext"
    assert compact("term\n:\n") == "term"


def test_settings(tmp_path):
    s = config.Settings(top_k=5, top_n=3, dense_weight=-1, rrf_k=0, doc_version="  ").sane()
    assert (s.top_n, s.bm25_top_n, s.dense_weight, s.rrf_k, s.doc_version) == (5, 300, 1.0, 1, None)
    assert config.Settings(top_k=1, top_n=0).sane().top_n == 1
    assert config.use_rerank(True, True, True) is False and config.use_rerank(True) and not config.use_rerank(False)
    path = tmp_path / "c.toml"
    path.write_text('[search]\ntop_k = 3\nretrieval_mode = "DENSE"\n[rag]\ntop_k = 4\ntop_n = 9\n')
    s = config.load(str(path), top_n=None)
    assert (s.top_k, s.top_n, s.retrieval_mode) == (3, 9, "dense")
    assert config.load().top_k == 10
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none"))
    assert config.user_path("~/x", "/h") == "/h/x" and config.user_path("~", "/h") == "/h" and config.user_path("/a", "/h") == "/a"
