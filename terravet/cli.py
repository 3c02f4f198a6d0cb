"""python -m terravet.cli PROJECT_FOLDER CONFIG --import-changes FILE ... in the order of the stages."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terravet.plans.project import Project
from terravet.sources import config, osc, replication


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("config")
    p.add_argument("--import-base", nargs="+", metavar="PBF")
    p.add_argument("--fetch-changes", metavar="SERVER", help="import what a replication folder has after the project's state; exit code 3 if nothing")
    p.add_argument("--size", type=int, default=replication.SIZE, help="bytes that --fetch-changes takes at most")
    p.add_argument("--import-changes", nargs="+", metavar="OSC")
    p.add_argument("--changes-prune", action="store_true")
    p.add_argument("--apply-untargeted-changes", action="store_true")
    p.add_argument("--fetch-changesets", metavar="PARQUET")
    p.add_argument("--validate", action="store_true")
    p.add_argument("--export-osm", metavar="PATH")
    p.add_argument("--export-osm-update", action="store_true")
    p.add_argument("--export-retained-diff", metavar="PATH")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    project, now = Project(spark, o.folder, config.load(o.config)), datetime.now(UTC)
    if o.import_base:
        project.import_base(*o.import_base)
    if o.fetch_changes:
        code = project.fetch_changes(o.fetch_changes, o.size)
        if code != replication.FETCHED:
            raise SystemExit(code)
    if o.import_changes:
        project.import_changes(osc.merged_diffs(spark, o.import_changes).withColumn("insert_order", F.lit(0)))
    if o.changes_prune:
        project.prune()
    if o.apply_untargeted_changes:
        project.release()
    if o.fetch_changesets:
        project.fetch_changesets(lambda ids: spark.read.parquet(o.fetch_changesets).join(ids, "id", "left_semi"), now)
    if o.validate:
        project.validate(now)
    if o.export_osm:
        project.export(o.export_osm)
    if o.export_osm_update:
        project.export_update(now)
    if o.export_retained_diff:
        project.export_retained(o.export_retained_diff)


if __name__ == "__main__":
    main()
