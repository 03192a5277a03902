"""JSON documents that are read in splits give the same rows for any number of splits."""

import json
import random

import pytest

from lumenrisk.sources import json_parts as J
from lumenrisk.sources import readers

FIELDS = "struct<id:long,name:string,nested:array<struct<x:long>>>"


def document(seed: int, n: int) -> dict:
    """Arrays of objects with brackets, quotes and backslashes in their texts, beside values that must not be taken."""
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice('{}[]":,\\ aé\n') for _ in range(rng.randrange(30)))
    one = lambda i: {"id": i, "name": text(), "nested": [{"x": rng.randrange(9)} for _ in range(rng.randrange(4))]}
    return {
        "info": {"images": [{"id": -1, "name": "not at the top"}], "text": text()},
        "images": [one(i) for i in range(n)],
        "licence": [[{"id": -2}], text(), 5, None],
        "other": [one(-3) for _ in range(n // 4)],
        "mixed": [7, "}{", [{"id": -4}], *[one(i) for i in range(n // 3)], None],
        "empty": [],
        "none": None,
    }


def splits_of(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return {r.start for r in J._pieces(spark, path).select("start").distinct().collect()}


@pytest.fixture
def part_size(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_for_any_number_of_splits(spark, tmp_path, part_size, indent):
    doc = document(1, 120)
    path = str(tmp_path / "doc.json")
    size = (tmp_path / "doc.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    for parts in (1, 3, 50):
        assert len(splits_of(spark, path, size // parts + 1)) >= parts * 0.8
        got = J.array_elements(spark, path, {n: FIELDS for n in ("images", "mixed", "empty", "none", "absent")})
        for name, rows in got.items():
            found = [(r.id, r.name, [x.x for x in r.nested]) for r in sorted(rows.collect(), key=lambda r: r.ord)]
            want = [(e["id"], e["name"], [x["x"] for x in e["nested"]]) for e in doc.get(name) or () if isinstance(e, dict)]
            assert found == want, (parts, name)


def test_splits_inside_long_strings(spark, tmp_path, part_size):
    """An element of many splits, whose text looks like a document of its own."""
    inner = json.dumps({"images": [{"id": 9, "name": "no"}] * 400})
    doc = {"images": [{"id": 0, "name": "a"}, {"id": 1, "name": inner}, {"id": 2, "name": "}" * 900}, {"id": 3, "name": ""}]}
    path = str(tmp_path / "doc.json")
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    assert len(splits_of(spark, path, 500)) > 10
    rows = J.array_elements(spark, path, {"images": "struct<id:long,name:string>"})["images"].collect()
    assert sorted((r.id, r.name) for r in rows) == [(e["id"], e["name"]) for e in doc["images"]]


def test_maps_for_any_number_of_splits(spark, tmp_path, part_size):
    doc = {str(100 + i): {"n": i, "t": '"}{' * (i % 5), "deep": {"a": [{}]}} for i in range(300)} | {"7": 3, "8": [{"n": 1}], "9": None, "word": {"n": -1}}
    path = str(tmp_path / "map.json")
    size = (tmp_path / "map.json").write_text(json.dumps(doc, indent=1))
    want = sorted([(100 + i, i, '"}{' * (i % 5)) for i in range(300)])
    for parts in (1, 3, 50):
        splits_of(spark, path, size // parts + 1)
        got = readers.json_map(spark, path, "n:long,t:string", whole=True).collect()
        assert sorted((r.image_id, r.n, r.t) for r in got if r.image_id) == want
        assert [r.n for r in got if r.image_id is None] == [-1]


def test_empty_and_odd_documents(spark, tmp_path):
    for text in ("", "{}", "[]", '{"images": {}}', '{"images": 5}', '{"images": [{"id": 1}', "[[{}]]"):
        (tmp_path / "odd.json").write_text(text)
        assert J.array_elements(spark, str(tmp_path / "odd.json"), {"images": "struct<id:long>"})["images"].count() == (1 if "1}" in text else 0)
    (tmp_path / "list.json").write_text('[{"n": 1}, {"n": 2}] ')
    assert sorted(r.n for r in J.map_entries(spark, str(tmp_path / "list.json"), "struct<n:long>").collect()) == [1, 2]


def test_elements_are_cut_once(spark, tmp_path):
    """The rows of all arrays come out of one table; none of them walks the document again."""
    path = tmp_path / "doc.json"
    path.write_text('{"a": [{"id": 1}, {"id": 2}], "b": [{"id": 3}]}')
    found = J.array_elements(spark, str(path), {"a": "struct<id:long>", "b": "struct<id:long>"})
    assert [sorted(r.id for r in found[n].collect()) for n in "ab"] == [[1, 2], [3]]
    assert all("MapInArrow" not in t._jdf.queryExecution().toString() for t in found.values())
