"""The command line, against a folder of samples."""

import json

from tidewatch import schemas
from tidewatch.__main__ import main
from tidewatch.config import Source
from tidewatch.plans.lock import EX_TEMPFAIL, single_instance
from tidewatch.sources.jdbc import JdbcSource


def write(spark, tmp_path, **more):
    samples = [(i, k * 600, float(i)) for i in (1, 2) for k in range(144 * 3)]
    hours = [(i, k * 3600, i - 0.5, float(i), i + 0.5) for i in (1, 2) for k in range(72)]
    for name, rows, schema in (("history", samples, schemas.HISTORY), ("trends", hours, schemas.TRENDS), ("items", [("g", 1, "h", i, f"n{i}", "", f"k{i}") for i in (1, 2)], schemas.ITEMS)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "data" / name))
    cfg = {"warehouse": str(tmp_path / "tables"), "lock_dir": str(tmp_path / "locks"), "data_sources": {"one": {"type": "parquet", "data_dir": str(tmp_path / "data")}, **more}}
    path = tmp_path / "settings.yaml"
    path.write_text(json.dumps(cfg))  # JSON is YAML
    return ["--config", str(path), "--endep", str(72 * 3600)]


def test_commands(spark, tmp_path, capsys):
    args = write(spark, tmp_path)
    assert main(["stats", *args]) == 0 and main(["detect", *args]) == 0
    assert main(["health", *args]) == 0
    said = capsys.readouterr().out
    assert said.startswith("one {") and "health" not in said
    counts = eval(said[4:])  # noqa: S307  what was just printed
    assert counts and set(map(type, counts.values())) == {int} and max(counts.values()) > 0
    assert main(["health", "--init", *args]) == 0
    assert max(eval(capsys.readouterr().out[4:]).values()) == 0  # noqa: S307


def test_one_failing_source_stops_no_other(spark, tmp_path, capsys):
    args = write(spark, tmp_path, gone={"type": "parquet", "data_dir": str(tmp_path / "nowhere")})
    assert main(["health", *args]) == 1
    assert capsys.readouterr().out.startswith("one {")


def test_second_run_of_a_kind(spark, tmp_path):
    args = write(spark, tmp_path)
    with single_instance("health", str(tmp_path / "locks"), 0):
        assert main(["health", *args]) == EX_TEMPFAIL == 75


def test_link_of_an_item(spark):
    src = JdbcSource(spark, Source(type="jdbc"))
    link = spark.createDataFrame([(7,)], "itemid long").select(src.item_link("https://example.org/monitor/")).first()[0]
    assert link == "https://example.org/monitor/history.php?itemids%5B0%5D=7&period=now-730h"
