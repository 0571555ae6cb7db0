"""Raw payloads ``{type, message}``: batch and streaming readers, routing into typed families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldtally import schemas as M
from fieldtally.functions import scalars as S
from fieldtally.functions.predicates import valid_invasions, valid_quests, valid_raids, valid_sightings
from fieldtally.operators.derive import first_reward, quest_labels
from fieldtally.session import scratch_dir


def _file_info() -> Column:
    meta = F.col("_metadata")
    return F.struct(
        meta["file_modification_time"].alias("at"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block")
    ).alias("source")


def read_payloads(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Payload files: one object or array per line, or with ``multi_line`` one per file.

    Arrays become one row per element. ``arrival`` orders rows by file time, file, split and line.
    """
    rows = spark.read.schema(M.ENVELOPE).json(path, multiLine=multi_line).select("type", "message", _file_info())
    return with_arrival(rows)


def with_arrival(rows: DataFrame) -> DataFrame:
    """Total order of arrival from the file position. Within one split the row ids ascend."""
    return rows.withColumn(
        "arrival", F.struct("source.at", "source.file", "source.block", F.monotonically_increasing_id().alias("row"))
    ).drop("source")


def stream_payloads(spark: SparkSession, path: str, max_files: int = 1000, max_bytes: str | None = None) -> DataFrame:
    """The same files as they arrive; ``max_files``, or else ``max_bytes`` (as ``"1g"``), bounds a micro-batch.

    A file source has no bound by rows; bytes are the nearest to it.
    """
    limit = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
    reader = spark.readStream.schema(M.ENVELOPE).option(*limit)
    return reader.json(path).select("type", "message", _file_info())


#: what :func:`stream_payloads` gives and :func:`buffer_rows` holds
BUFFERED = "type string, message string, source struct<at: timestamp, file: string, block: bigint>"


def buffer_rows(stream: DataFrame, path: str, checkpoint: str, rows: int, every: str | None = None) -> StreamingQuery:
    """Copy a payload stream into files of at most ``rows`` payloads each, so that another stream can flush by rows.

    The file sink logs each micro-batch when it is whole: a restart from the checkpoint loses and repeats nothing.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.option("maxRecordsPerFile", rows).option("compression", "zstd")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: where in the name of a buffer's file (``part-00000-<uuid>``) a random digit stands, and its values
_DIGIT_AT, _DIGITS = 11, "0123456789abcdef"


def _lane_names(lane: int, lanes: int) -> str:
    """Names of the files of a lane as a glob. Lane 0 has all names that no other has, so that any name is in one lane."""
    start, others = "?" * _DIGIT_AT, "".join(_DIGITS[n::lanes] for n in range(1, lanes))
    if lane:
        return f"{start}[{_DIGITS[lane::lanes]}]*"
    return "{" + ",".join("?" * n for n in range(1, _DIGIT_AT + 1)) + f",{start}[!{others}]*" + "}"


def stream_buffered(spark: SparkSession, path: str, max_files: int = 1, lane: int = 0, lanes: int = 1) -> DataFrame:
    """The payloads of :func:`buffer_rows`; a micro-batch has at most ``max_files`` times the rows of a file.

    Files come in the order in which they were written. Those that tasks write side by side have no order among each other, so
    which row of a key is first depends on it, as on any other chunking. With ``lanes`` (16 at most) each file belongs to one lane,
    told by its name; the lanes can be flushed side by side, and then only files of the same lane are in order.
    """
    if not 0 <= lane < lanes <= len(_DIGITS):
        raise ValueError(f"lane must be below lanes, and these at most {len(_DIGITS)}")
    reader = spark.readStream.schema(BUFFERED).option("maxFilesPerTrigger", max_files)
    return (reader if lanes == 1 else reader.option("pathGlobFilter", _lane_names(lane, lanes))).parquet(path)


def parsed_once(payloads: DataFrame, **parsed: Column) -> DataFrame:
    """Adds columns that are costly to parse. As rows of a generator they are parsed once: filters on a plain column are moved
    below it, where each check would parse the text again."""
    one = F.array(F.struct(*[value.alias(name) for name, value in parsed.items()]))
    return payloads.select(*payloads.columns, F.inline(one))


def route(payloads: DataFrame) -> dict[str, DataFrame]:
    """One typed frame per family. Unknown types and unreadable messages are dropped."""
    out = {}
    for kind, (family, schema) in M.MESSAGES.items():
        keys = {"keys": F.json_object_keys("message")} if family == "quests" else {}
        parsed = parsed_once(payloads.where(F.col("type") == kind), m=F.from_json("message", schema), **keys)
        out[family] = SHAPES[family](parsed.where(F.col("m").isNotNull()))
    return out


#: columns that rows may already carry beside their message
_CARRIED = ("arrival", "area_id", "area", "offset_hours", "audit_row")


def _extra(parsed: DataFrame) -> list[str]:
    return [c for c in ("keys", *_CARRIED) if c in parsed.columns]


def _flag(name: str) -> Column:
    """Missing stays missing, so that the required-field check can see it."""
    return F.when(F.col(name).isNotNull(), S.text_flag(F.col(name)))


def _number(name: str, kind: str) -> Column:
    return S.strip(F.col(name)).try_cast(kind)


def _sightings(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        F.col("m.pokemon_id").alias("species"), F.col("m.form").alias("form"),
        F.col("m.individual_attack").alias("atk"), F.col("m.individual_defense").alias("dfn"),
        F.col("m.individual_stamina").alias("sta"), F.col("m.pokemon_level").alias("lvl"),
        F.col("m.spawnpoint_id").alias("spawnpoint_hex"),
        F.col("m.latitude").alias("lat"), F.col("m.longitude").alias("lon"),
        "m.first_seen", "m.disappear_time", F.col("m.disappear_time_verified").alias("verified"),
        (S.text_flag(F.col("m.shiny")) == 1).alias("shiny"), "m.username", "m.weather",
        *[S.rank1_flag(F.col(f"m.pvp.{league}")).alias(f"rank1_{league}") for league in ("little", "great", "ultra")],
        *_extra(parsed),
    )


def _raids(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        F.col("m.gym_id").alias("gym"), "m.gym_name",
        _number("m.latitude", "double").alias("lat"), _number("m.longitude", "double").alias("lon"),
        _number("m.pokemon_id", "int").alias("boss"), _number("m.level", "int").alias("lvl"), "m.form", "m.costume",
        F.col("m.team_id").alias("team"),
        _flag("m.is_exclusive").alias("exclusive"), _flag("m.ex_raid_eligible").alias("ex_eligible"),
        _number("m.spawn", "bigint").alias("spawn"), _number("m.start", "bigint").alias("start_ts"),
        _number("m.end", "bigint").alias("end_ts"), "m.rsvps", *_extra(parsed),
    )


def _quests(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "m.pokestop_id", "m.pokestop_name", F.col("m.latitude").alias("lat"), F.col("m.longitude").alias("lon"),
        "m.type", "m.with_ar", "m.updated", "m.rewards", *_extra(parsed),
    ).withColumnRenamed("pokestop_id", "pokestop")


def _invasions(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        F.col("m.pokestop_id").alias("pokestop"), "m.pokestop_name",
        _number("m.latitude", "double").alias("lat"), _number("m.longitude", "double").alias("lon"),
        "m.display_type", F.col("m.character").alias("character_id"), F.col("m.grunt_type").alias("grunt"),
        _flag("m.confirmed").alias("confirmed"), _number("m.start", "bigint").alias("start_ts"), *_extra(parsed),
    )


#: family -> from its message in column ``m`` to its typed columns
SHAPES = {"sightings": _sightings, "raids": _raids, "quests": _quests, "invasions": _invasions}

_FLAT_QUEST = (
    "pokestop", "pokestop_name", "lat", "lon", "mode", "task_type", "reward_type", "item_id", "amount",
    "creature_id", "creature_form", "updated",
)


def flat_quests(quests: DataFrame) -> DataFrame:
    """Valid quests with their first reward in plain columns, ready for ingestion."""
    flat = quest_labels(first_reward(valid_quests(quests)))
    return flat.select(*_FLAT_QUEST, *[c for c in _CARRIED if c in flat.columns])


def family_of(kind: Column) -> Column:
    """The family of a payload's type; null for types that nobody handles."""
    return F.coalesce(*[F.when(kind == k, F.lit(family)) for k, (family, _) in M.MESSAGES.items()])


def may_be_object(message: Column) -> Column:
    """False for a text that can't hold a JSON object, as it has no closing brace: telling this costs far less than a parse that fails."""
    return message.endswith("}") | message.contains("}")


def messages(kind: Column) -> dict[str, Column]:
    """``m_<family>`` for each family: the parsed message in the column of its own, null in the others."""
    text = F.col("message")
    return {f"m_{family}": F.from_json(F.when((kind == k) & may_be_object(text), text), schema) for k, (family, schema) in M.MESSAGES.items()}


def wide_payloads(payloads: DataFrame) -> DataFrame:
    """All families in one frame, each message parsed once, with its family and coordinates.

    The message stands in the column of its family (``m_<family>``). Unknown types and unreadable messages are dropped,
    as are messages without coordinates, which no family accepts.
    """
    kind = F.col("type")
    rows = payloads.where(kind.isin(*M.MESSAGES)).select(family_of(kind).alias("family"), "type", "message", "arrival")
    keys = F.when(kind == "quest", F.json_object_keys("message"))
    parsed = parsed_once(rows, **messages(kind), keys=keys).drop("type", "message")

    def place(name: str) -> Column:
        return F.coalesce(*[S.strip(F.col(f"m_{family}.{name}").cast("string")).try_cast("double") if "latitude string" in schema else F.col(f"m_{family}.{name}") for family, schema in M.MESSAGES.values()])

    return parsed.withColumns({"lat": place("latitude"), "lon": place("longitude")}).where("lat IS NOT NULL AND lon IS NOT NULL")


def raw_of(wide: DataFrame, family: str) -> DataFrame:
    """One family out of :func:`wide_payloads` (or a table of it), valid and in the shape the ingest step takes; columns of an
    area that is already known come along."""
    rows = wide.where(F.col("family") == family).select(
        F.col(f"m_{family}").alias("m"), *(["keys"] if family == "quests" else []), *[c for c in _CARRIED if c in wide.columns]
    )
    return _VALID[family](SHAPES[family](rows))


_VALID = {"sightings": valid_sightings, "raids": valid_raids, "quests": flat_quests, "invasions": valid_invasions}


def staged_by_family(wide: DataFrame, path: str | None = None) -> DataFrame:
    """A table of :func:`wide_payloads`, written in one pass, of which each family reads only its own part."""
    path = path or scratch_dir(wide.sparkSession, "wide")
    wide.write.partitionBy("family").option("compression", "zstd").parquet(path)
    return wide.sparkSession.read.schema(wide.schema).parquet(path)


def routed_raw(payloads: DataFrame, staged: bool = False) -> dict[str, DataFrame]:
    """Routed, valid frames in the shape the ingest step takes.

    Each frame reads all payloads; for those with ``arrival`` of which several families are used, ``staged`` reads and parses
    them once, into a table by family below the scratch root.
    """
    if staged:
        wide = staged_by_family(wide_payloads(payloads))
        return {family: raw_of(wide, family) for family, _ in M.MESSAGES.values()}
    return {family: _VALID[family](rows) for family, rows in route(payloads).items()}
