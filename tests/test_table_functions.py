import pytest

from millrace.plans import catalogue_engine, shared, table_functions


def test_sections_and_blocks_from_sql(spark):
    table_functions.register(spark)
    files = spark.createDataFrame([("a.md", "# A\nfirst\n## B\n- x\n- y\n"), ("b.md", "# C\nsecond\n"), ("n.md", None)], "path string, content string")
    found = spark.sql("SELECT s.path, s.title, s.selector.parts AS parts FROM markdown_sections(TABLE({files}) PARTITION BY (path), 'docs') s ORDER BY path, title", files=files).collect()
    assert [(r["path"], r["title"], r["parts"]) for r in found] == [("a.md", "A", ["A"]), ("a.md", "B", ["A", "B"]), ("b.md", "C", ["C"])]
    both = "SELECT s.title, b.ordinal, b.kind, b.shown FROM markdown_sections(TABLE({files}) PARTITION BY (path)) s, LATERAL markdown_blocks(s.content) b WHERE s.title = 'B'"
    assert [tuple(r) for r in spark.sql(both, files=files).collect()] == [("B", 0, "unordered_list", "x; y")]
    assert spark.sql("SELECT * FROM markdown_blocks(CAST(NULL AS STRING))").count() == 0


def test_wrong_arguments_fail_the_query(spark):
    table_functions.register(spark)
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM markdown_sections('a')").collect()
    with pytest.raises(Exception, match="a path and a content"):
        spark.sql("SELECT * FROM markdown_sections(TABLE({files}))", files=spark.range(1)).collect()
    broken = spark.createDataFrame([("a.md", "---\nno end")], "path string, content string")
    with pytest.raises(Exception, match="rontmatter|end"):
        spark.sql("SELECT * FROM markdown_sections(TABLE({files}))", files=broken).collect()


def test_release_removes_stores_too(spark):
    engine = catalogue_engine._engine(spark)
    engine.put([])
    fs, where = engine.store._fs(engine.store.root)
    assert fs.exists(where)
    shared.release(spark)
    assert not fs.exists(where)
