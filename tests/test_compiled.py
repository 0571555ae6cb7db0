"""Hot steps stay below 8000 bytes a generated method, from where on the JVM only interprets it."""

import pytest
from pyspark.sql import functions as F

from checks import payload_files as P
from checks.base import Frames
from fieldtally.functions import scalars as S
from fieldtally.operators import audit as A
from fieldtally.sources.payloads import may_be_object

#: bytes of a method above which the JVM does not compile it
HUGE = 8000


def largest_method(df):
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "nation": ["CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name"],
        "lineitem": ["id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "CAST(1 + id AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity"],
        "orders": ["id AS o_orderkey", "id AS o_custkey"],
        "events": ["id AS event_id", "id AS user_id"],
    }
    for name, columns in tables.items():
        spark.range(5).selectExpr(*columns).write.parquet(f"{path}/{name}.parquet")
    return Frames(spark, path)


def test_lines_are_made_by_compiled_methods(frames):
    rows = P.payload_rows(frames)
    assert largest_method(P.lines_of(rows.repartition(2))) < HUGE


def test_the_audit_runs_in_compiled_methods(spark):
    payloads = spark.createDataFrame([("raid", "{}")], "type string, message string").repartition(2)
    assert largest_method(A.reject_counts(A.audited(payloads))) < HUGE


def test_flags_of_json_booleans_need_no_failing_cast(spark):
    texts = ["true", " TRUE ", "false", " False", "1", "0", "-3", " 2 ", "1.5", "x", "", None, "truefalse"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in rows.select(S.text_flag(F.col("x"))).collect()] == [1, 1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0]
    told = rows.where("lower(btrim(x)) = 'false'").select(S.text_flag(F.col("x")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert told.index("= false") < told.index("try_cast")


def test_texts_without_a_closing_brace_are_not_parsed(spark):
    """They have the outcome that a failed parse has."""
    texts = ['{"gym_id":"g"', "cut", "", " ", "[1]", '{"a":1} x', '{"a":1}', "}", "[{}]", None]
    rows = spark.createDataFrame([(x,) for x in texts], "message string")
    told = rows.select(may_be_object(F.col("message")).alias("may"), F.json_object_keys("message").isNotNull().alias("is")).collect()
    assert [r["may"] for r in told] == [False] * 5 + [True] * 4 + [None]
    assert not [r for r in told if r["is"] and not r["may"]]
    payloads = rows.selectExpr("'raid' AS type", "message")
    assert [r["reason"] for r in A.audited(payloads).collect()] == ["unreadable"] * 5 + ["missing:gym"] * 2 + ["unreadable"] * 2 + ["no_message"]


def test_edges_of_areas_are_not_copied_into_events(frames):
    events = frames.index.contained_in(frames.raw("sightings"), "lat", "lon", first_only=True)
    assert events.schema["hit"].dataType.names == ["area_id", "area", "offset_hours"]
