"""Registries of tab-separated rows; scans do not admit them, callers may."""

from __future__ import annotations

from collections.abc import Iterator

from millrace import schema as S
from millrace.errors import EngineError
from millrace.functions.hashing import versioned_hash
from millrace.sources.markdown import decode, normalize


def parse(path: str, raw: bytes, root: str | None = None) -> tuple[dict, list[dict]]:
    """(source row, records); a file with a row that does not fit gives no record at all."""
    source, records = read(path, raw, root)
    return source, list(records)


def read(path: str, raw: bytes, root: str | None = None) -> tuple[dict, Iterator[dict]]:
    """(source row, records as they are read): the first column is the title, the others are metadata; rows are file lines."""
    text = normalize(decode(raw))
    lines = text.removesuffix("\n").split("\n") if text else []
    if not lines:
        raise EngineError("SourceFailure", "a registry needs a header")
    head = [x.strip() for x in lines[0].split("\t")]
    if len(head) < 2 or not all(head):
        raise EngineError("SourceFailure", "a registry's header needs a title and metadata columns that are not blank")
    if len(set(head[1:])) < len(head) - 1 or "format" in head[1:]:
        raise EngineError("SourceFailure", "metadata columns must differ and must not be named format")
    source = {"source_key": S.source_key(root, path), "root_id": root, "path": path, "file_hash": versioned_hash("file", [text]), "included": True, "reason": "requested"}
    return source, _records(path, root, head, lines)


def _records(path: str, root: str | None, head: list[str], lines: list[str]) -> Iterator[dict]:
    for number, line in enumerate(lines[1:], 2):
        if not line.strip():
            continue
        values = [x.strip() for x in line.split("\t")]
        if len(values) != len(head) or not values[0]:
            raise EngineError("SourceFailure", f"row {number} does not fit the header")
        content, metadata = "\t".join(values), {"format": "tsv"} | dict(zip(head[1:], values[1:], strict=True))
        pairs = [x for k in sorted(metadata) for x in (k, metadata[k])]
        digest = versioned_hash("record", ["registry", path, str(number), values[0], content, str(len(metadata)), *pairs, "0"])
        chosen = S.selector("registry", str(number))
        rid = S.rooted_id(root, path, chosen) if root else f"registry:{path}#row={number}"
        yield S.record("RegistryRow", root, path, chosen, rid, values[0], content, metadata, [], digest)
