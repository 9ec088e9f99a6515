"""Queries of parsers, block splitting, and the engine's own calls, over files and records made of the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.operators import chunking
from millrace.plans import table_functions
from millrace.plans.catalogue import ASCII, TOKENS, documents, query
from millrace.plans.shared import new_path, table
from millrace.sources import maps, markdown, scan, symbols, tsv


def _records(files: DataFrame, parser) -> DataFrame:
    return scan.checked(scan.parse_files(files, parser))[1]


def _file(parts, order: str, head) -> F.Column:
    """The bytes of a file: a head, then its parts in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), parts.alias("p")))), lambda x: x["p"])
    return F.concat(head, F.array_join(ordered, "")).cast("binary").alias("content")


_SECTIONS = """
    WITH t AS (SELECT conv_id, turn, 'Turn ' || turn || ' ' || role AS title, translate(text, '#', ' ') AS text FROM conversations),
    c AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM t)
    SELECT 'named-root-v1:conv:' || conv_id || '.md:markdown:' || strlen('Conversation ' || conv_id) || ':Conversation ' || conv_id || strlen(title) || ':' || title AS id,
        title, sha256(content) AS content_sha, CASE conv_id % 2 WHEN 0 THEN 'CURRENT' ELSE 'DESIGN' END AS alignment, conv_id || '.md' AS path
    FROM c WHERE content <> ''
    """


def _conversation_files(spark: SparkSession, sf: str) -> DataFrame:
    """A Markdown file for each conversation."""
    part = F.concat(F.lit("## Turn "), F.col("turn"), F.lit(" "), F.col("role"), F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), "#", " "), F.lit("\n"))
    alignment = F.when(F.col("conv_id") % 2 == 0, "CURRENT").otherwise("DESIGN")
    head = F.concat(F.lit("---\nalignment: "), alignment, F.lit("\n---\n# Conversation "), F.col("conv_id"), F.lit("\n"))
    files = table(spark, sf, "conversations").groupBy("conv_id").agg(_file(part, "turn", F.lit("")).alias("parts"))
    return files.select(F.concat("conv_id", F.lit(".md")).alias("path"), F.concat(head.cast("binary"), "parts").alias("content"))


@query(_SECTIONS)
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Frontmatter, headings and sections of a Markdown file for each conversation."""
    found = _records(_conversation_files(spark, sf), partial(markdown.parse, root="conv"))
    return found.select("id", "title", F.sha2("content", 256).alias("content_sha"), F.col("metadata")["alignment"].alias("alignment"), "path")


@query(_SECTIONS)
def sections_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same sections from SQL, by a table function over the files' partitions."""
    table_functions.register(spark)
    found = "SELECT id, title, sha2(content, 256) AS content_sha, metadata['alignment'] AS alignment, path FROM markdown_sections(TABLE({files}) PARTITION BY (path), 'conv')"
    return spark.sql(found, files=_conversation_files(spark, sf))


@query(
    """
    SELECT c_nationkey || '.tsv' AS path, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS VARCHAR) AS number, c_name AS title, c_mktsegment AS segment,
        c_name || chr(9) || c_mktsegment || chr(9) || c_custkey AS content FROM customer
    """
)
def registry_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a registry file for each nation's customers."""
    line = F.concat(F.concat_ws("\t", "c_name", "c_mktsegment", F.col("c_custkey").cast("string")), F.lit("\n"))
    files = table(spark, sf, "customer").groupBy("c_nationkey").agg(_file(line, "c_custkey", F.lit("name\tsegment\tkey\n")))
    found = _records(files.select(F.concat("c_nationkey", F.lit(".tsv")).alias("path"), "content"), partial(tsv.read, root="reg"))
    return found.select("path", F.col("selector.parts")[0].alias("number"), "title", F.col("metadata")["segment"].alias("segment"), "content")


@query(
    """
    WITH d AS (SELECT p_partkey % 20 AS f, p_partkey, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'function' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'C_' ELSE 'f_' END || p_partkey AS name FROM part),
    s AS (SELECT *, CASE kind WHEN 'class' THEN 'class ' || name || ':' ELSE 'def ' || name || '(x):' END || chr(10) || '    pass  # é' || chr(10) AS code FROM d)
    SELECT f || '.py' AS path, name AS title, kind, CAST(coalesce(sum(strlen(code)) OVER (PARTITION BY f ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS VARCHAR) AS start_byte FROM s
    """
)
def python_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Functions and classes of Python files made of parts."""
    part = table(spark, sf, "part")
    even = F.col("p_size") % 2 == 0
    code = F.concat(F.when(even, F.concat(F.lit("class C_"), "p_partkey", F.lit(":"))).otherwise(F.concat(F.lit("def f_"), "p_partkey", F.lit("(x):"))), F.lit("\n    pass  # é\n"))
    files = part.groupBy((F.col("p_partkey") % 20).alias("f")).agg(_file(code, "p_partkey", F.lit("")))
    found = _records(files.select(F.concat("f", F.lit(".py")).alias("path"), "content"), symbols.read)
    return found.select("path", "title", F.col("metadata")["structural_kind"].alias("kind"), F.col("metadata")["start_byte"].alias("start_byte"))


def _maps(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("@related n"), F.col("n_nationkey"), F.lit("\n"))
    head = F.concat(F.lit("---\ncfmap: v1\nmode: CURATED\n---\n# "), F.first("r_name"), F.lit("\n"))
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = both.groupBy("r_regionkey").agg(_file(line, "n_nationkey", head))
    return _records(files.select(F.concat("r_regionkey", F.lit(".cfmap.md")).alias("path"), "content"), partial(maps.parse, root="maps"))


@query(
    """
    SELECT 'named-root-v1:maps:' || r_regionkey || '.cfmap.md:file' AS id, r_name AS title, string_agg('n' || n_nationkey, ',' ORDER BY n_nationkey) AS relations, 'CURRENT' AS state
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
    """
)
def code_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Records of curated code maps, one for each region, that relate to its nations."""
    return _maps(spark, sf).select("id", "title", F.array_join("relations", ",").alias("relations"), F.col("metadata")["state"].alias("state"))


_BLOCKS = """
    WITH c AS (SELECT conv_id, turn, trim(regexp_replace(translate(text, '#|`*_[]()-+.', '            '), '\\s+', ' ', 'g')) AS w FROM conversations),
    ok AS (SELECT * FROM c WHERE regexp_matches(w, '^[A-Za-z]'))
    SELECT conv_id || '/' || turn AS id, o AS ordinal, kind, text, a AS start_line, b AS end_line FROM (
        SELECT conv_id, turn, 0 AS o, 'paragraph' AS kind, w AS text, 0 AS a, 0 AS b FROM ok
        UNION ALL SELECT conv_id, turn, 1, 'unordered_list', '- ' || w || chr(10) || '- two', 2, 3 FROM ok
        UNION ALL SELECT conv_id, turn, 2, 'code_block', '```' || chr(10) || w || chr(10) || '```', 5, 7 FROM ok
        UNION ALL SELECT conv_id, turn, 3, 'paragraph', 'end', 9, 9 FROM ok)
    """


def _turn_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(id, content): paragraphs, a list and a fence around each turn's words."""
    plain = F.trim(F.regexp_replace(F.translate("text", "#|`*_[]()-+.", "            "), "\\s+", " "))
    rows = table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), plain.alias("w")).where(F.col("w").rlike("^[A-Za-z]"))
    return rows.select("id", F.concat("w", F.lit("\n\n- "), "w", F.lit("\n- two\n\n```\n"), "w", F.lit("\n```\n\nend")).alias("content"))


@query(_BLOCKS)
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every turn's text."""
    return chunking.blocks(_turn_texts(spark, sf)).select("id", "ordinal", "kind", "text", "start_line", "end_line")


@query(_BLOCKS)
def blocks_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same blocks from SQL, by lateral calls of a table function."""
    table_functions.register(spark)
    return spark.sql("SELECT t.id, b.ordinal, b.kind, b.text, b.start_line, b.end_line FROM {turns} t, LATERAL markdown_blocks(t.content) b", turns=_turn_texts(spark, sf))


# The engine


def _engine(spark: SparkSession, chunked: bool = False):
    from millrace.engine import Engine

    return Engine(spark, new_path(spark, "engine"), chunked=chunked)


def _document_records(spark: SparkSession, sf: str, **other) -> DataFrame:
    """Documents as records; ``other`` columns in place of the usual."""
    d = documents(spark, sf).where(F.trim("text") != "")
    key = F.concat(F.lit("doc"), F.col("doc_id"))
    none = F.array().cast("array<string>")
    facts = {"id": key, "kind": F.lit("MarkdownSection"), "root_id": F.lit("docs"), "source_key": key, "path": F.concat(key, F.lit(".md")), "selector": F.struct(F.lit("file").alias("kind"), none.alias("parts")), "title": F.col("lang"), "content": F.col("text"), "metadata": F.map_from_arrays(none, none), "relations": none, "content_hash": F.sha2("text", 256)} | other
    return d.select([facts[c].alias(c) for c in S.COLUMNS])


@query(
    f"""
    WITH d AS (SELECT 'doc' || doc_id AS id, lang, text FROM documents WHERE trim(text) <> ''),
    i AS (SELECT id, list_concat({ASCII.format("id")}, list_concat({ASCII.format("lang")}, {ASCII.format("lang || chr(10) || text")})) AS w FROM d),
    q AS (SELECT item_id AS query_id, {ASCII.format("text")}[1] AS term FROM benchmark WHERE len({ASCII.format("text")}) > 0),
    r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY len(w), id) AS rank FROM i, q WHERE list_contains(w, term))
    SELECT query_id, id, 'Exact' AS channel, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 100
    """
)
def engine_exact_search(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's batch search: the first token of every benchmark item as an exact term."""
    from millrace.functions import text as T

    engine = _engine(spark)
    engine.put(_document_records(spark, sf))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.get(T.ascii_tokens(F.col("text")), F.lit(0)).alias("text")).where("text IS NOT NULL")
    return engine.search_batch(asked).select("query_id", "id", "channel", "rank")


def _tokens(text: str) -> str:
    return TOKENS.replace("lower(text)", f"lower({text})")


_PHRASES = f"""
    WITH d AS (SELECT 'doc' || doc_id AS id, 0 AS o, {_tokens("source || ': ' || text")} AS w FROM documents WHERE trim(text) <> ''
        UNION ALL SELECT 'doc' || doc_id, 1, {_tokens("source || ': language ' || lang")} FROM documents WHERE trim(text) <> ''),
    s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
    t AS (SELECT item_id AS query_id, {TOKENS} AS w FROM benchmark UNION ALL VALUES (-1, ['language', 'en'])),
    q AS (SELECT query_id, w[1] AS a, w[2] AS b FROM t WHERE len(w) >= 2),
    f AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT id, o, unnest(w) AS word FROM d) GROUP BY word),
    h AS (SELECT query_id, id, o, a, b, len(w) AS dl, len(list_filter(range(1, len(w)), lambda i: w[i] = a AND w[i + 1] = b)) AS tf FROM d JOIN q ON list_contains(w, a) AND list_contains(w, b)),
    scored AS (SELECT query_id, id, o, round((ln(1 + (n - x.df + 0.5) / (x.df + 0.5)) + ln(1 + (n - y.df + 0.5) / (y.df + 0.5))) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean)), 6) AS score
        FROM h JOIN f x ON a = x.word JOIN f y ON b = y.word, s WHERE tf > 0),
    top AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id || ':' || o) <= 100),
    best AS (SELECT query_id, id, max(score) AS score FROM top GROUP BY query_id, id)
    SELECT query_id, id, 'Lexical' AS channel, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM best
"""


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sections under their source, with a list after the text, so each has two chunks."""
    named = F.struct(F.lit("markdown").alias("kind"), F.array("source").alias("parts"))
    # Documents are plain: with its lines escaped and no bracket to open a link, a text is one paragraph of the same words.
    escaped = F.array_join(F.transform(F.split(F.translate("text", "[", "("), "\n", -1), lambda x: F.concat(F.lit("\\"), x)), "\n")
    return _document_records(spark, sf, selector=named, content=F.concat(escaped, F.lit("\n\n- language "), "lang"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The first two words of each benchmark item as a phrase, and one that half of all chunks may have."""
    from millrace.functions import text as T

    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(T.unicode_tokens(F.col("text")), 1, 2).alias("w")).where(F.size("w") == 2)
    words = words.unionByName(spark.range(1).select(F.lit(-1).cast(words.schema["query_id"].dataType).alias("query_id"), F.array(F.lit("language"), F.lit("en")).alias("w")))
    return words.select("query_id", F.concat(F.lit('"'), F.array_join("w", " "), F.lit('"')).alias("text"))


@query(_PHRASES)
def engine_phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's batch search of phrases over chunked sections, by the positional index."""
    engine = _engine(spark, chunked=True)
    engine.put(_sections(spark, sf))
    return engine.search_batch(_asked(spark, sf)).select("query_id", "id", "channel", "rank")


@query(_PHRASES)
def engine_phrases_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows from an index that came about by changes: wrong texts put right, and others removed."""
    engine, rows = _engine(spark, chunked=True), _sections(spark, sf)
    number = F.expr("cast(substring(id, 4) AS long)")
    wrong = rows.withColumns({"content": F.concat(F.lit("language en language "), "content"), "content_hash": F.lit("wrong")})
    more = rows.where(number % 5 == 1).withColumns({c: F.concat(F.lit("more-"), c) for c in ("id", "source_key")})
    engine.put(rows.where(number % 4 > 0).unionByName(wrong.where(number % 4 == 0)).unionByName(more))
    engine.put(rows.where(number % 8 == 0))
    engine.remove(more.select("id"))
    engine.put(rows.where(number % 8 == 4))
    return engine.search_batch(_asked(spark, sf)).select("query_id", "id", "channel", "rank")


class _Numbers:
    """A model for texts that are whole numbers: the vector that they make."""

    def __call__(self, texts: list[str]):
        import re

        import numpy as np

        out = np.zeros((len(texts), 384))
        for row, text in zip(out, texts, strict=True):
            numbers = [int(x) for x in re.findall(r"-?\d+", text)]
            row[: len(numbers)] = numbers
        return out


@query(
    """
    WITH v AS (SELECT vec_id, 'vec' || vec_id AS id, list_transform(embedding, lambda x: CAST(floor(1000 * CAST(x AS DOUBLE)) AS INTEGER)) AS w FROM embeddings),
    u AS (SELECT vec_id, id, list_transform(w, lambda x: CAST(CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(w, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT) AS DOUBLE)) AS w FROM v),
    s AS (SELECT q.vec_id AS query_id, q.id = u.id AS own, u.id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.w, u.w), 6) DESC, u.id) AS pos FROM u q, u WHERE q.vec_id % 100 = 0),
    f AS (SELECT query_id, id, own, round(CASE WHEN own THEN 1.0 / 61 ELSE 0 END + 0.95 / (60 + pos), 9) AS score FROM s)
    SELECT query_id, id, CASE WHEN own THEN 'Lexical' ELSE 'Vector' END AS channel, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 50
    """
)
def engine_fused_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's batch search with phrases and vectors fused: of the complete fusion the first 50 of each query."""
    engine = _engine(spark)
    engine.provider, engine.top = _Numbers(), 50
    numbers = F.array_join(F.transform("embedding", lambda x: F.floor(1000 * x.cast("double")).cast("string")), " ")
    rows = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("vec"), "vec_id").alias("id"), numbers.alias("content"))
    none = F.array().cast("array<string>")
    facts = {"id": "id", "kind": F.lit("MarkdownSection"), "root_id": F.lit("vectors"), "source_key": "id", "path": "id", "selector": F.struct(F.lit("file").alias("kind"), none.alias("parts")), "title": F.lit("numbers"), "content": "content", "metadata": F.map_from_arrays(none, none), "relations": none, "content_hash": F.sha2("content", 256)}
    engine.put(rows.select([(F.col(x) if isinstance(x, str) else x).alias(c) for c, x in facts.items()]))
    engine.embed()
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit('"'), "content", F.lit('"')).alias("text"))
    return engine.search_batch(asked).select("query_id", "id", "channel", "score", "rank")


@query(
    """
    SELECT 'named-root-v1:maps:' || n_regionkey || '.cfmap.md:file' AS map_id, 'n' || n_nationkey AS id, n_name AS title, 'CodeSymbol' AS record_kind FROM nation
    """
)
def engine_related(spark: SparkSession, sf: str) -> DataFrame:
    """The engine's related call for every map."""
    engine = _engine(spark)
    none = F.array().cast("array<string>")
    key = F.concat(F.lit("n"), F.col("n_nationkey"))
    facts = {"id": key, "kind": F.lit("CodeSymbol"), "root_id": F.lit("src"), "source_key": key, "path": F.lit("n.py"), "selector": F.struct(F.lit("file").alias("kind"), none.alias("parts")), "title": F.col("n_name"), "content": F.col("n_name"), "metadata": F.map_from_arrays(none, none), "relations": none, "content_hash": F.sha2("n_name", 256)}
    engine.put(_maps(spark, sf).unionByName(table(spark, sf, "nation").select([facts[c].alias(c) for c in S.COLUMNS])))
    maps_ = engine.store.read("records", S.RECORDS).where("kind = 'CodeMap'")
    return engine.related_batch(maps_).select(F.col("src_id").alias("map_id"), "id", "title", "record_kind")


@query(
    """
    WITH d AS (SELECT doc_id FROM documents WHERE trim(text) <> ''), n AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS c, count(*) FILTER (doc_id % 10 = 1) AS g FROM d)
    SELECT 1 AS step, 1 AS generation, 'add' AS change, n AS rows FROM n
    UNION ALL SELECT 2, 1, 'unchanged', n FROM n
    UNION ALL SELECT 3, 2, 'change', c FROM n UNION ALL SELECT 3, 2, 'unchanged', n - c FROM n
    UNION ALL SELECT 4, 3, 'delete', g FROM n UNION ALL SELECT 4, 3, 'unchanged', n - g FROM n
    """
)
def engine_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Putting, putting again, changing and removing records: the engine's generations and counts."""
    engine, rows = _engine(spark), _document_records(spark, sf)
    number = F.expr("cast(substring(id, 4) AS long)")
    gone = rows.where(number % 10 == 1).select("id")
    steps = [lambda: engine.put(rows), lambda: engine.put(rows), lambda: engine.put(rows.where(number % 3 == 0).withColumn("content_hash", F.lit("new"))), lambda: engine.remove(gone)]
    out = [(n, done["generation"], change, count) for n, step in enumerate(steps, 1) for done in [step()] for change, count in done["changes"].items()]
    return spark.createDataFrame(out, "step int, generation int, change string, rows long")
