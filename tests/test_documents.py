"""Documents to dotted keys against a plain walk."""

import json

from gridlight.sources.documents import flat_documents

DOCS = ['{"a": {"b": 1, "c": {"d": "x", "e": [1, {"f": 2}]}}, "g": null, "h": {}, "i": true, "j": 1.5}', '{"a.b": 3, "a": {"b": 4}}', "{}", "[1]", "7", "not json", "", None, json.dumps({"v": "long " * 20000}), '{"a": {"b": 1}}']


def walk(doc, prefix=""):
    for k, v in doc.items():
        if isinstance(v, dict):
            yield from walk(v, f"{prefix}{k}.")
        else:
            yield prefix + k, v


def test_flat_documents(spark):
    deep = {"x": 1}
    for i in range(12):
        deep = {f"k{i}": deep}
    docs = [*DOCS, json.dumps(deep)]
    rows = spark.createDataFrame([(i, d, "path") for i, d in enumerate(docs)] + [(0, docs[-2], "path")], "id int, doc string, value string")
    found = sorted((r.id, r.path, r.value) for r in flat_documents(rows, ["id"], "doc").collect() if r.value is not None)
    want, nulls = [], []
    for i, d in [*enumerate(docs), (0, docs[-2])]:
        try:
            doc = json.loads(d or "")
        except json.JSONDecodeError:
            continue
        for k, v in walk(doc) if isinstance(doc, dict) else ():
            (nulls if v is None else want).append((i, k, v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))))
    assert found == sorted(want)
    empty = flat_documents(rows.where("id < 0"), ["id"], "doc")
    assert empty.columns == ["id", "path", "value"] and empty.isEmpty()
    assert [(r.id, r.path) for r in flat_documents(rows, ["id"], "doc").where("value is null").collect()] == [(i, k) for i, k, _ in nulls]
