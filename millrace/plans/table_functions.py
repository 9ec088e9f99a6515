"""Table functions for SQL: a file's sections from a table argument, a text's blocks by lateral calls.

    SELECT s.* FROM markdown_sections(TABLE(files) PARTITION BY (path), 'docs') s
    SELECT r.id, b.kind, b.shown FROM records r, LATERAL markdown_blocks(r.content) b

``markdown_sections`` takes a table with the columns path and content (binary or text) and, if files are to have ids under a
named root, its name; a file that is not well formed fails the query. ``markdown_blocks`` takes a text; null has no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace import schema as S
from millrace.errors import EngineError
from millrace.operators import chunking
from millrace.sources import markdown


def _records() -> StructType:
    """The type of records; it is made in workers too, where no session reads it from text."""
    text, texts = StringType(), ArrayType(StringType())
    kinds = {"selector": StructType().add("kind", text).add("parts", texts), "metadata": MapType(text, text), "relations": texts}
    out = StructType()
    for name in S.COLUMNS:
        out.add(name, kinds.get(name, text))
    return out


class Blocks:
    """ordinal, kind, text, shown, start_line and end_line of each block of a text."""

    def eval(self, content: str) -> Iterator[tuple]:
        for ordinal, (kind, text, start, end) in enumerate(chunking.split_blocks(content or "")):
            yield ordinal, kind, text, chunking.shown(kind, text), start, end


class Sections:
    """The records of Markdown files' sections."""

    @staticmethod
    def analyze(files: AnalyzeArgument, root: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not files.isTable:
            raise EngineError("InvalidQuery", "markdown_sections takes a table of files")
        kinds = {f.name: f.dataType for f in files.dataType.fields}
        if not isinstance(kinds.get("path"), StringType) or not isinstance(kinds.get("content"), (BinaryType, StringType)):
            raise EngineError("InvalidQuery", "a table of files has a path and a content")
        if root is not None and root.value is not None:
            S.logical_root(root.value)
        return AnalyzeResult(schema=_records())

    def eval(self, files, root: str | None = None) -> Iterator[tuple]:
        content = files["content"]
        if files["path"] is None or content is None:
            return
        raw = content.encode() if isinstance(content, str) else bytes(content)
        for record in markdown.parse(files["path"], raw, root)[1]:
            yield tuple(tuple(record[c].values()) if c == "selector" else record[c] for c in S.COLUMNS)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.udtf.register("markdown_blocks", udtf(Blocks, returnType=", ".join(chunking.BLOCKS.split(", ")[1:]), useArrow=False))
    spark.udtf.register("markdown_sections", udtf(Sections, useArrow=False))
