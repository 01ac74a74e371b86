"""JSON arrays split between tasks: whatever the split, the rows are those of a plain parser."""

import json
import random

import pytest

from brindle.sources import arrays, readers


def value(rnd, depth=0):
    kinds = ["text", "number", "null", "list", "object"] if depth < 3 else ["text", "number"]
    match rnd.choice(kinds):
        case "text":
            return "".join(rnd.choice('ab{}[]",:\\\né中 ') for _ in range(rnd.randint(0, 30)))
        case "number":
            return rnd.randint(-99, 99)
        case "null":
            return None
        case "list":
            return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
        case _:
            return {f"k{i}}}": value(rnd, depth + 1) for i in range(rnd.randint(0, 3))}


@pytest.fixture
def small_splits(spark):
    def use(size):
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, str(size))

    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(spark, path):
    return sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in arrays.elements(spark, str(path)).collect())


@pytest.mark.parametrize("size, indent, mark", [(97, None, ""), (400, 2, "﻿"), (5000, 1, "")])
def test_any_split_gives_the_parsers_rows(spark, small_splits, tmp_path, size, indent, mark):
    rnd = random.Random(size)
    made = [{"id": i, "v": value(rnd)} for i in range(60)] + [{}, {"long": "}{\\\"" * 700}, {"id": -1}]
    mixed = [7, *made[:20], "x{y}", None, -1.5e3, *made[20:], True]
    path = tmp_path / "a.json"
    path.write_text(mark + json.dumps(mixed, indent=indent, ensure_ascii=False), encoding="utf-8")
    small_splits(size)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 1
    assert rows(spark, path) == sorted(json.dumps(m, sort_keys=True) for m in made)


def test_folder_of_arrays_and_of_parts(spark, small_splits, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"a": i, "b": ["}"]}] * i) + "\n" * i)
    small_splits(8)
    assert rows(spark, tmp_path) == sorted(json.dumps({"a": i, "b": ["}"]}) for i in range(4) for _ in range(i))


def test_array_sink_is_one_array_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, concat('}', id, '\"')) as t").repartitionByRange(7, "id").sortWithinPartitions("id")
    arrays.write_array(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and whole == [{"id": i, "t": None if i % 3 == 0 else f'}}{i}"'} for i in range(1000)]
    back = readers.read_json_array(spark, str(tmp_path / "out"), infer=False)
    assert back.exceptAll(df).count() == 0 and back.count() == 1000
    arrays.write_array(df.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []
    assert arrays.elements(spark, str(tmp_path / "none")).count() == 0
