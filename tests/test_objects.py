"""Splitting, filling and labelling of objects (E17, E18, E32), and the names that the catalogs call."""

import ast
import importlib
import pathlib

import pytest

from gridtally import plans
from gridtally.operators import points as P

BOX = "uid long, obj_id long, cy double, cx double, y1 int, x1 int, y2 int, x2 int, area long"


def test_split_one_square_per_held_centroid(spark):
    pred = spark.createDataFrame([(1, 1, 10.0, 10.0, 0, 0, 20, 20, 400), (1, 2, 50.0, 50.0, 40, 40, 60, 60, 400), (2, 1, 10.0, 10.0, 0, 0, 20, 20, 400)], BOX)
    gt = spark.createDataFrame([(1, 1, 0.0, 20.0, 0, 0, 0, 0, 1), (1, 2, 7.0, 8.0, 0, 0, 0, 0, 1), (1, 3, 50.0, 50.0, 0, 0, 0, 0, 1)], BOX)
    got = sorted((r["uid"], r["cy"], r["cx"], r["y1"], r["x2"], r["area"], r["is_split"], r["split_from"]) for r in P.split_large_predictions(pred, gt, ["uid"]).collect())
    assert got == [(1, 0, 20, -5, 25, 100.0, True, 1), (1, 7, 8, 2, 13, 100.0, True, 1), (1, 50.0, 50.0, 40, 60, 400.0, False, None), (2, 10.0, 10.0, 0, 20, 400.0, False, None)]


def test_own_pixels_else_the_clipped_box(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, -1, 2, 2, 9, 0), (1, 2, 0.0, 0.0, 0, 0, 4, 4, 0)], BOX)
    own = spark.createDataFrame([(1, 2, 3, 3), (1, 2, 0, 2)], "uid long, obj_id long, y int, x int")
    got = sorted((r["y"], r["x"]) for r in P.objects_to_pixels(boxes, (4, 4), own).collect())
    assert got == [(0, 2), (0, 3), (1, 2), (1, 3), (3, 3)]


def test_labels_by_mean(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 0, 0, 2, 2, 0), (1, 2, 0.0, 0.0, 4, 4, 6, 6, 0), (1, 3, 0.0, 0.0, 8, 8, 9, 9, 0)], BOX)
    cells = spark.createDataFrame([(1, 0, 0, 200.0, 10.0), (1, 1, 1, 160.0, 20.0), (1, 2, 2, 0.0, 0.0), (1, 4, 4, 200.0, 50.0)], "uid long, y int, x int, v double, s double")
    got = P.classify_by_region_mean(boxes, cells, ["uid"])
    assert {r["obj_id"]: (r["mean_v"], r["label"]) for r in got.collect()} == {1: (180.0, "bright"), 2: (200.0, "coloured"), 3: (None, "coloured")}
    assert [tuple(r) for r in P.label_counts(got, ["uid"]).collect()] == [(1, 1, 2)]


@pytest.mark.parametrize("path", sorted(pathlib.Path(plans.__file__).parent.glob("*.py")), ids=lambda p: p.stem)
def test_every_called_name_exists(path):
    module = importlib.import_module(f"gridtally.plans.{path.stem}")
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            owner = getattr(module, node.value.id, None)
            if getattr(owner, "__name__", "").startswith("gridtally."):
                assert hasattr(owner, node.attr), f"{node.value.id}.{node.attr} in line {node.lineno}"
