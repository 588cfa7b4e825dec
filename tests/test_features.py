"""GeoJSON features read by many tasks are those a whole parse finds."""

import json
import random

import pytest

from geodemand.sources.features import feature_texts, scan


def collection(n, seed, **dump):
    r = random.Random(seed)
    odd = ["plain", 'a "quoted" }', "{[", "]}", "\\", 'x\\"', "", "é } ñ", "\n}\n", '"type": "Feature"']
    features = []
    for i in range(n):
        ring = [[r.random() * 90, r.randint(0, 9)] for _ in range(r.choice([0, 3, 3, 40]))]
        nested = {"a": {"b": [{"c": r.choice(odd)}]}} if r.random() < 0.3 else r.choice(odd)
        f = {"type": "Feature", "properties": {"id": i, "name": r.choice(odd), r.choice(odd) + "k": nested}, "geometry": r.choice([{"type": "Polygon", "coordinates": [ring]}, None])}
        features.append(dict(r.sample(list(f.items()), 3)))
    head = [{}, {"crs": {"type": "name", "properties": {"name": "urn:} x"}}}, {"a": [1, {"b": {"c": 2}}]}][seed % 3]
    tail = [{}, {"bbox": [1, 2]}, {"crs": {"type": "name", "properties": {"name": "y"}}}][seed // 3 % 3]
    return features, json.dumps({"type": "FeatureCollection", **head, "features": features, **tail}, **dump)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("dump", [{}, {"indent": 2, "ensure_ascii": False}])
def test_features_of_one_file_in_many_tasks(spark, tmp_path, seed, dump):
    features, text = collection(120, seed, **dump)
    (tmp_path / "f.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "30")
    try:
        df = feature_texts(spark, str(tmp_path / "f.json"))
        assert spark.read.text(str(tmp_path / "f.json"), lineSep="}").rdd.getNumPartitions() > 20
        got = [json.loads(r.feature) for r in df.orderBy("number").collect()]
    finally:
        for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{c}")
    assert got == features


def test_several_files_and_no_features(spark, tmp_path):
    want = 0
    for i in range(3):
        features, text = collection(5 * i, i)
        (tmp_path / f"{i}.json").write_text(text)
        want += len(features)
    assert feature_texts(spark, str(tmp_path)).count() == want


def test_a_broken_feature_is_an_error(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"features": [{"geometry": null, "properties": {}}, {"geometry" null, "properties": {}}]}')
    with pytest.raises(Exception, match="not a feature"):
        feature_texts(spark, str(tmp_path)).collect()


def test_scan_knows_strings():
    assert scan('{"a": "}', False) == (1, True)
    assert scan('x\\"}", "b": [1', True) == (0, False)
    assert scan('{"a": "\\\\"', False) == (0, False)
