import pytest

from millrace.errors import EngineError
from millrace.functions.hashing import versioned_hash
from millrace.sources import maps, markdown, symbols, tsv, walk


def test_markdown_sections_lines_and_identity():
    raw = "﻿---\r\nalignment: CURRENT\r\n# note\r\nrelations: a, b\r\n---\r\nlost\r\n# One\r\n\r\n### Deep ##\r\n\r\nbody\r\n\r\nmore\r\n# Two\r\ntext".encode()
    source, records = markdown.parse("g/a.md", raw, "docs")
    assert source["included"] and source["file_hash"].startswith("sha256:v1:")
    assert [r["selector"]["parts"] for r in records] == [["One", "Deep"], ["Two"]]
    assert records[0]["id"] == "named-root-v1:docs:g/a.md:markdown:3:One4:Deep"
    assert records[0]["metadata"]["_millrace_source_start_line"] == "11" and records[0]["metadata"]["_millrace_source_end_line"] == "13"
    assert records[0]["relations"] == ["a", "b"] and records[0]["content"] == "body\n\nmore"
    assert markdown.parse("g/a.md", raw.replace(b"body", b"bodi"), "docs")[1][1]["content_hash"] == records[1]["content_hash"]


@pytest.mark.parametrize("text", ["---\nno end", "---\nkey:\n---\n", "---\na: 1\na: 2\n---\n", "---\nk: |\n---\n", "---\nk: [1, 2\n---\n", "# \nx"])
def test_markdown_rejects(text):
    with pytest.raises(EngineError):
        markdown.parse("a.md", text.encode())


def test_markdown_admission_and_empty():
    rule = ("index", "yes")
    assert markdown.parse("a.md", b"---\nINDEX: Yes\n---\n# A\nx", None, rule)[0]["included"]
    assert markdown.parse("a.md", b"# A\nx", None, rule) [0]["reason"] == "property index is absent"
    assert markdown.parse("a.md", b"")[1] == []
    with pytest.raises(EngineError):
        markdown.parse("a.md", b"\xff")


def test_versioned_hash_is_framed():
    assert versioned_hash("s", ["ab", "c"]) != versioned_hash("s", ["a", "bc"])


def test_tsv():
    _, records = tsv.parse("r.tsv", b"id\ttitle\tstatus\nA\tx\tok\n\nB\ty\tno\n")
    assert [(r["id"], r["title"]) for r in records] == [("registry:r.tsv#row=2", "A"), ("registry:r.tsv#row=4", "B")]
    for bad in (b"", b"id\n", b"id\tx\tx\n", b"id\tformat\n", b"id\tx\nA\n", b"id\tx\n\tv\n"):
        with pytest.raises(EngineError):
            tsv.parse("r.tsv", bad)


def test_scans_hold_few_records_of_a_large_registry_at_once(spark):
    from millrace.sources import scan

    files = spark.createDataFrame([("a.tsv", b"name\tn\n" + b"".join(b"x\t%d\n" % i for i in range(2500))), ("b.tsv", b"name\tn\n"), ("c.tsv", b"name\tn\ny\t1\n")], "path string, content binary").coalesce(1)
    found = scan.parse_files(files, tsv.read).collect()
    assert max(len(r["records"]) for r in found) <= scan.PIECE
    sources, records = scan.checked(scan.parse_files(files, tsv.read))
    assert sorted(r["path"] for r in sources.collect()) == ["a.tsv", "b.tsv", "c.tsv"]
    assert sorted(int(r["metadata"]["n"]) for r in records.where("path = 'a.tsv'").collect()) == list(range(2500)) and records.count() == 2501
    assert next(tsv.read("a.tsv", b"name\tn\nx\t1\nbad\n")[1])["title"] == "x"  # made one by one
    with pytest.raises(EngineError, match="row 3"):
        scan.checked(scan.parse_files(spark.createDataFrame([("a.tsv", b"name\tn\nx\t1\nbad\n")], "path string, content binary"), tsv.read))


def test_maps(tmp_path):
    text = b"---\ncfmap: v1\nmode: AUTO\nsource: src/a.rs#x\ngeneration: 3\n---\n# Map\n@related id-1\n"
    _, (record,) = maps.parse("m.cfmap.md", text, None, tmp_path)
    assert record["metadata"]["state"] == "STALE" and record["relations"] == ["id-1"] and record["id"] == "cfmap-v1:m.cfmap.md"
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("x")
    assert maps.parse("m.cfmap.md", text, None, tmp_path)[1][0]["metadata"]["state"] == "CURRENT"
    for bad in (b"# Map", b"---\nmode: AUTO\n---\n# M\n", b"---\ncfmap: v1\nmode: CURATED\nsource: a\n---\n# M\n", b"---\ncfmap: v1\nmode: AUTO\nsource: ../a\n---\n# M\n", b"---\ncfmap: v1\nmode: CURATED\n---\n@related\n# M\n", b"---\ncfmap: v1\nmode: CURATED\nstate: X\n---\n# M\n", b"---\ncfmap: v1\nmode: CURATED\n---\nno title\n"):
        with pytest.raises(EngineError):
            maps.parse("m.cfmap.md", bad, None, tmp_path)


def test_rust_symbols():
    code = "/* fn no() {} /* nested */ */\npub fn a<'x>(s: &'x str) -> [u8; 2] { \"fn b() {\"; r#\"}\"#; '{' }\ntrait T { fn d(&self); fn e(&self) {} }\npub(crate) struct S<T>(T);\n"
    assert [(k, n) for k, n, _ in symbols.rust_symbols(code)] == [("function", "a"), ("function", "e"), ("struct", "S")]
    with pytest.raises(EngineError):
        symbols.rust_symbols("fn a() {")


def test_python_symbols_and_identity():
    one = symbols.parse("t.py", "# é\nclass A:\n    async def f(self): ...\n".encode())[1]
    two = symbols.parse("t.py", "# é!\nclass A:\n    async def f(self): ...\n".encode())[1]
    assert sorted(r["title"] for r in one) == ["A", "f"]
    assert {r["id"] for r in one} != {r["id"] for r in two}
    assert {r["content_hash"] for r in one} == {r["content_hash"] for r in two}
    with pytest.raises(EngineError):
        symbols.parse("t.py", b"def (")


def test_large_python_is_parsed_in_pieces(monkeypatch):
    code = "import a\n@wrap\ndef f():\n    pass\nx = \"\"\"é\ndef no(): pass\n\"\"\"\ny = [\n1]\ntry:\n    pass\nfinally:\n    class In: ...\n@wrap\nclass C:\n    def g(self): ...\nasync def h(): ...\nz = 1 + \\\n2\n"
    text = "".join(code.replace("def f", f"def f{i}") for i in range(6000))
    import ast

    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line.encode()))
    want = sorted(("class" if isinstance(x, ast.ClassDef) else "function", x.name, starts[x.lineno - 1] + x.col_offset) for x in ast.walk(ast.parse(text)) if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef))
    with pytest.raises(EngineError, match="too large"):
        symbols.parse("t.py", text.encode())
    for size in (1, 100, symbols.PIECE):
        monkeypatch.setattr(symbols, "PIECE", size)
        assert sorted(symbols.python_symbols(text, None)) == want
    with pytest.raises(EngineError, match=f"line {text.count(chr(10)) + 2}"):
        list(symbols.python_symbols(text + "x = 1\ndef (\n", None))
    assert len(list(symbols.read("t.py", text.encode())[1])) == len(want)


def test_walk_ignores(tmp_path):
    for name in ("a.md", ".hidden.md", "skip.md", "keep/b.md", "keep/x.cfmap.md", "target/c.md", "logs/d.md", "keep/in/e.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("# A\nx")
    (tmp_path / ".gitignore").write_text("skip.md\n/logs/\nkeep/in/*\n!keep/in/e.md\n")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    assert walk.markdown_files(tmp_path) == [".hidden.md", "a.md", "keep/b.md", "keep/in/e.md"]
    assert walk.map_files(tmp_path) == ["keep/x.cfmap.md"]
