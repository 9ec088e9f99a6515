"""Results as text: technical, human and JSON."""

from __future__ import annotations

import json
import math

PAGE = 5


def render(response: dict, form: str = "technical", number: int = 1) -> str:
    """A search response; the human form shows one page."""
    if form == "json":
        return json.dumps(response, ensure_ascii=False, sort_keys=True)
    hits = response["hits"]
    if form == "technical":
        lines = [f"hits={len(hits)}", f"freshness={response['freshness']}"]
        lines += [f"{h['channel']}\t{h['score']:.9f}\t{h['record_kind']}\t{h['id']}\t{h['title']}\t{h['path']}" for h in hits]
        return "\n".join(lines)
    pages = max(1, math.ceil(len(hits) / PAGE))
    number = min(max(1, number), pages)
    best = hits[0]["score"] if hits else 0
    lines = [f"Page {number} of {pages}, {len(hits)} hits, {response['freshness']}"]
    for i, h in list(enumerate(hits, 1))[(number - 1) * PAGE : number * PAGE]:
        percent = round(max(h["score"], 0) / best * 100) if best > 0 else 0
        lines.append(f"{i}. {h['title']} — {h['path']} ({percent}%)")
    return "\n".join(lines)


class Pager:
    """Pages of one response: next, prev, page N, repeat; a page out of range leaves the place."""

    def __init__(self, response: dict):
        self.response, self.number = response, 1
        self.pages = max(1, math.ceil(len(response["hits"]) / PAGE))

    def do(self, command: str) -> str:
        word, _, rest = command.strip().partition(" ")
        wanted = {"next": self.number + 1, "prev": self.number - 1, "repeat": self.number}.get(word)
        if word == "page":
            wanted = int(rest) if rest.strip().isdigit() else None
        if wanted is None:
            return f"unknown command: {command}"
        if not 1 <= wanted <= self.pages:
            return f"no page {wanted}; there are {self.pages}"
        self.number = wanted
        return render(self.response, "human", wanted)
