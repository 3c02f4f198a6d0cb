import json
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


WORLD = {"type": "Polygon", "coordinates": [[[-180, -90], [180, -90], [180, 90], [-180, 90], [-180, -90]]]}


@pytest.fixture
def settings(tmp_path):
    (tmp_path / "demo").mkdir()
    (tmp_path / "demo/world.geojson").write_text(json.dumps(WORLD))
    (tmp_path / "demo/tags.json").write_text(json.dumps([{"select": ["[a]"], "interest": {"name": None}, "sources": ["s"]}]))
    (tmp_path / "common.yaml").write_text("description: {en: d}\nmain_contacts: [me]\n")
    (tmp_path / "demo/config.yaml").write_text(
        "extends: ../common.yaml\ntitle: {en: Demo}\nlocal_srid: 4326\nlocha_cluster_distance: 1\nuser_groups:\n  all: {title: All, polygon: world.geojson, osm_tags: tags.json, users: [me]}\n"
        "validators:\n  deleted: {}\n  tags_changes: {}\n"
    )
    return tmp_path
