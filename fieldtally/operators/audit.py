"""What becomes of each payload: taken, taken without giving a fact, or refused, with the reason.

One pass: a payload is parsed once, and the checks of its family are told in order, so a row has the reason of the first
check that it fails. Payloads are neither dropped nor repeated: rows in are rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldtally import schemas as M
from fieldtally.functions import scalars as S
from fieldtally.functions.predicates import Checks, first_failed, message_checks, valid_coords
from fieldtally.operators.derive import first_reward, quest_labels
from fieldtally.sources.payloads import SHAPES, family_of, may_be_object, messages, parsed_once

FAMILIES = tuple(family for family, _ in M.MESSAGES.values())


def fact_checks(family: str) -> Checks:
    """What a valid row still needs to give a row of a fact table."""
    if family == "sightings":
        return {"spawnpoint_over_64_bits": S.hex_to_id(F.col("spawnpoint_hex")).isNotNull()}
    place = {"strict_coordinates": valid_coords(F.col("lat"), F.col("lon"), strict=True)}
    if family == "raids":
        return {**place, "blank:gym": F.col("gym") != ""}
    stop = {**place, "blank:pokestop": S.clean_text(F.col("pokestop")) != ""}
    if family == "invasions":
        return stop
    return {
        "no_task": F.col("task_type") > 0,
        "no_target": F.coalesce(F.col("creature_id") > 0, F.lit(False)) | F.coalesce(F.col("item_id") > 0, F.lit(False)),
        **stop,
    }


def _told(rows: DataFrame, family: str) -> DataFrame:
    """Adds ``r_<family>``: the failed checks of a message and of its fact."""
    keys = ["keys"] if family == "quests" else []
    shaped = SHAPES[family](rows.select(F.col(f"m_{family}").alias("m"), *keys, F.struct(*rows.columns).alias("audit_row")))
    refused = first_failed(message_checks(shaped, family))
    if family == "quests":
        shaped = quest_labels(first_reward(shaped))
    told = F.struct(refused.alias("message"), first_failed(fact_checks(family)).alias("fact"))
    own = F.when(F.col("audit_row.family") == family, told)
    return parsed_once(shaped, **{f"r_{family}": own}).select("audit_row.*", f"r_{family}").drop(f"m_{family}", *keys)


def audited(payloads: DataFrame) -> DataFrame:
    """The payloads with ``family``, ``level`` and ``reason``.

    ``level`` is null for a payload that is taken, ``message`` if it is refused, ``fact`` if it counts in the rollups but gives
    no fact. Reasons beside those of the checks: ``unknown_type`` (family null), ``no_message`` and ``unreadable`` (not a
    JSON object).
    """
    kind = F.col("type")
    rows = parsed_once(payloads.withColumn("family", family_of(kind)), **messages(kind), keys=F.when(kind == "quest", F.json_object_keys("message")))
    for family in FAMILIES:
        rows = _told(rows, family)
    rows = parsed_once(rows, told=F.coalesce(*[F.col(f"r_{family}") for family in FAMILIES]))
    told = F.col("told")
    refused = (
        F.when(F.col("family").isNull(), "unknown_type").when(F.col("message").isNull(), "no_message")
        .when(~may_be_object(F.col("message")), "unreadable")
        .when(told["message"].isNotNull() & F.json_object_keys("message").isNull(), "unreadable").otherwise(told["message"])
    )
    rows = rows.select(*payloads.columns, "family", refused.alias("refused"), told["fact"].alias("fact"))
    return rows.select(
        *payloads.columns, "family",
        F.when(F.col("refused").isNotNull(), "message").when(F.col("fact").isNotNull(), "fact").alias("level"),
        F.coalesce("refused", "fact").alias("reason"),
    )


def rejects(rows: DataFrame) -> DataFrame:
    """Of :func:`audited` the payloads that are refused or give no fact, with their text."""
    return rows.where("reason IS NOT NULL")


def reject_counts(rows: DataFrame) -> DataFrame:
    """Payloads per family, level and reason; those that are taken have null level and reason."""
    return rows.groupBy("family", "level", "reason").agg(F.count("*").alias("n"))


def _counters() -> list[Column]:
    counts = [F.count(F.lit(1)).alias("payloads"), F.count_if(F.col("family").isNull()).alias("unknown")]
    for family in FAMILIES:
        own = F.col("family") == family
        counts += [
            F.count_if(own & F.col("level").isNull()).alias(f"{family}_taken"),
            F.count_if(own & (F.col("level") == "fact")).alias(f"{family}_without_fact"),
            F.count_if(own & (F.col("level") == "message")).alias(f"{family}_refused"),
        ]
    return counts


def write_rejects(payloads: DataFrame, path: str) -> dict[str, int]:
    """Write the rejects by family and level below the new folder ``path`` and return how many payloads came to what.

    The counts are observed while writing, so the payloads are read once. Unknown types are in the folder of no family.
    """
    seen = Observation("payload_audit")
    rejects(audited(payloads).observe(seen, *_counters())).write.partitionBy("family", "level").parquet(path)
    return seen.get
