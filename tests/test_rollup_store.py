import re
from datetime import date, datetime

from fieldtally.functions.predicates import where_buckets
from fieldtally.operators.retention import expire_rollup
from fieldtally.plans.derived import daily_series
from fieldtally.plans.selection import Selection, where_areas
from fieldtally.sources.tables import read_rollup, write_rollup

NOW = datetime(2024, 1, 20, 12)


def filters(frame) -> str:
    """Partition filters of all scans; empty ones leave nothing."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return "".join(re.findall(r"PartitionFilters: \[([^\]]*)", plan))


def test_windows_prune_days(spark, tmp_path, rows):
    hours = spark.sql(
        """SELECT if(id % 2 = 0, 'A', 'B') AS area, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS bucket,
                  'total' AS metric, id AS cnt FROM range(600)"""
    )
    path = str(tmp_path / "rollup")
    write_rollup(hours, path)
    stored = read_rollup(spark, path)
    assert ("day", "date") in stored.dtypes
    areas = spark.createDataFrame([("A", 2), ("B", 20)], "area string, offset_hours int")
    for make in (
        lambda r: where_buckets(r, datetime(2024, 1, 5, 3), datetime(2024, 1, 6, 4)),
        lambda r: where_areas(r, Selection(areas, "2024-01-03T00:00:00", "2024-01-05T00:00:00", NOW)),
        lambda r: where_areas(r, Selection(areas, "3 days", "now", NOW)),
        lambda r: expire_rollup(r, NOW, 100),
        lambda r: daily_series(r, "sightings", "a", date(2024, 1, 4), date(2024, 1, 9)),
    ):
        got, want = make(stored), make(hours)
        assert "day" in filters(got)
        assert rows(got.select(want.columns)) == rows(want)
