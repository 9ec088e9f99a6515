import json

from millrace.operators import models
from millrace.plans import present

HITS = [{"id": f"i{n}", "title": f"T{n}", "path": "p.md", "record_kind": "MarkdownSection", "channel": "Exact", "score": 1 / n} for n in range(1, 13)]
RESPONSE = {"schema_version": 1, "kind": "search", "freshness": "Current", "hit_count": 12, "hits": HITS}
NONE = RESPONSE | {"hits": [], "hit_count": 0}


def test_forms():
    assert present.render(RESPONSE).splitlines()[:2] == ["hits=12", "freshness=Current"]
    assert json.loads(present.render(RESPONSE, "json"))["hit_count"] == 12
    page = present.render(RESPONSE, "human", 2).splitlines()
    assert page[0] == "Page 2 of 3, 12 hits, Current" and page[1] == "6. T6 — p.md (17%)" and len(page) == 6
    assert present.render(NONE, "human") == "Page 1 of 1, 0 hits, Current"


def test_pager():
    pager = present.Pager(RESPONSE)
    assert pager.do("prev") == "no page 0; there are 3"
    assert pager.do("next").startswith("Page 2") and pager.do("page 3").startswith("Page 3")
    assert pager.do("next") == "no page 4; there are 3" and pager.do("repeat").startswith("Page 3")
    assert pager.do("jump").startswith("unknown") and pager.do("page x").startswith("unknown")


def test_batch_benchmark():
    out = models.batch_benchmark(models.HashingProvider(16), ["a b", "c"], sizes=(1, 2))
    assert [r["batch"] for r in out] == [1, 2] and all(r["texts_per_second"] > 0 for r in out)
