"""Markdown files as canonical records: frontmatter, sections by heading, one record a section.

A frontmatter block is flat ``key: value`` lines between ``---`` lines. Sections are found by ATX headings
wherever they stand, also in code fences; what is before the first heading is not kept, and a section
without a body of its own gives no record.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import schema as S
from millrace.errors import EngineError
from millrace.functions.hashing import versioned_hash

FILE_SCOPE = "file:markdown-v2"
#: This property rules admission and is never searched.
ADMISSION_PROPERTY = "Индексация"
_HEADING = re.compile(r"(#{1,6})(?=\s)(.*)")


def admitted(metadata: Column, name: str, value: str) -> Column:
    """Whether a frontmatter property says so; names and values without regard to ASCII case."""
    from millrace.functions.text import ascii_lower

    return F.exists(F.map_entries(metadata), lambda e: (ascii_lower(e["key"]) == name.lower()) & (ascii_lower(F.trim(e["value"])) == value.lower()))


def normalize(text: str) -> str:
    """Without a byte-order mark, lines ended by line feeds."""
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


def decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise EngineError("SourceFailure", "source file is not UTF-8") from e


def ascii_fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def frontmatter(text: str) -> tuple[dict[str, str], list[str], str, int]:
    """(metadata, relations, body, the body's first line number)."""
    if not text.startswith("---\n"):
        return {}, [], text, 1
    rest = text[4:]
    if rest.startswith("---\n"):
        head, body = "", rest[4:]
    elif rest == "---":
        head, body = "", ""
    elif (at := rest.find("\n---\n")) >= 0:
        head, body = rest[: at + 1], rest[at + 5 :]
    elif rest.endswith("\n---"):
        head, body = rest[:-3], ""
    else:
        raise EngineError("SourceFailure", "frontmatter does not end")
    metadata: dict[str, str] = {}
    relations: list[str] = []
    for line in map(str.strip, head.split("\n")):
        if not line or line.startswith("#"):
            continue
        key, found, value = (x.strip() for x in line.partition(":"))
        if not found or not key or not value:
            raise EngineError("SourceFailure", f"frontmatter needs key: value, not {line!r}")
        if value[0] in "|>" or (value[0], value[-1]) in {("[", x) for x in value[-1:] if x != "]"} | {("{", x) for x in value[-1:] if x != "}"}:
            raise EngineError("SourceFailure", f"unsupported frontmatter value of {key!r}")
        if key == "relations":
            relations += [S.stable_id(x.strip()) for x in value.split(",")]
        elif key in metadata:
            raise EngineError("SourceFailure", f"frontmatter has {key!r} twice")
        else:
            metadata[key] = value
    return metadata, relations, body, text[: len(text) - len(body)].count("\n") + 1


def admission_value(metadata: dict[str, str], name: str) -> str | None:
    return next((v for k, v in metadata.items() if ascii_fold(k) == ascii_fold(name)), None)


def sections(body: str, first_line: int) -> list[tuple[list[str], list[str], int]]:
    """(heading path, body lines, the body's first line number) by heading, in order."""
    out: list[tuple[list[str], list[str], int]] = []
    stack: list[str] = []
    for number, line in enumerate(body.split("\n"), first_line):
        found = _HEADING.match(line)
        if found:
            title = found[2].strip().rstrip("#").strip()
            if not title:
                raise EngineError("SourceFailure", f"blank heading at line {number}")
            stack = [*stack[: len(found[1]) - 1], title]
            out.append((stack, [], number + 1))
        elif out:
            out[-1][1].append(line)
    return out


def record_hash(path: str, headings: list[str], title: str, content: str, metadata: dict[str, str], relations: list[str]) -> str:
    pairs = [x for k in sorted(metadata) for x in (k, metadata[k])]
    return versioned_hash("record", ["markdown", path, str(len(headings)), *headings, title, content, str(len(metadata)), *pairs, str(len(relations)), *relations])


def parse(path: str, raw: bytes, root: str | None = None, rule: tuple[str, str] | None = None) -> tuple[dict, list[dict]]:
    """(source row, records) of one file. ``rule``: the property and value that admit a file."""
    text = normalize(decode(raw))
    metadata, relations, body, first = frontmatter(text)
    file_hash = versioned_hash(FILE_SCOPE, [text])
    source = {"source_key": S.source_key(root, path), "root_id": root, "path": path, "file_hash": file_hash, "included": True, "reason": "admitted"}
    if rule:
        value = admission_value(metadata, rule[0])
        if value is None or ascii_fold(value) != ascii_fold(rule[1]):
            return source | {"included": False, "reason": f"property {rule[0]} is absent" if value is None else f"property {rule[0]} is {value}"}, []
    records = []
    for headings, lines, number in sections(body, first):
        full = [i for i, x in enumerate(lines) if x.strip()]
        content = "\n".join(lines).strip()
        if not content:
            continue
        chosen = S.selector("markdown", *headings)
        own = {k: v for k, v in metadata.items() if k != ADMISSION_PROPERTY}
        own |= {S.START_LINE: str(number + full[0]), S.END_LINE: str(number + full[-1])} | ({S.ROOT_ID: root} if root else {})
        rid = S.rooted_id(root, path, chosen) if root else f"markdown:{path}#{'/'.join(headings)}"
        records.append(S.record("MarkdownSection", root, path, chosen, rid, headings[-1], content, own, relations, record_hash(path, headings, headings[-1], content, own, relations)))
    return source, records
