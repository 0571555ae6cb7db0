"""Id-to-name lookups from per-language JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: lookup kind -> section of the file (``None``: the whole file is the map)
SECTIONS = {
    "species": None,
    "characters": "invaders",
    "displays": "incident_displays",
    "quest_types": "types",
    "rewards": "rewards",
    "items": "items",
}


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file. The language is the ``lang=`` directory if there is one, else the file's name."""
    files = spark.read.text(path, wholetext=True)
    named = F.regexp_extract("_metadata.file_name", r"([^/]+)\.json$", 1)
    return files.select("value", (F.col("lang") if "lang" in files.columns else named).alias("lang"))


def load_lookup(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(lang, id, name)`` from files ``<lang>.json`` or ``lang=<lang>/...``."""
    section = SECTIONS[kind]
    text = F.col("value") if section is None else F.get_json_object("value", f"$.{section}")
    return (
        _whole_files(spark, path)
        .select(
            "lang",
            F.explode(F.from_json(text, "map<string,string>")).alias("id", "name"),
        )
        .select("lang", F.col("id").try_cast("int").alias("id"), "name")
        .where(F.col("id").isNotNull())
    )


def _title(text):
    """Capital after every non-letter, lower case elsewhere."""
    mark = "\u0001 "
    marked = F.regexp_replace(F.lower(text), r"([^a-z\s])(?=[a-z])", f"$1{mark}")
    return F.replace(F.initcap(marked), F.lit(mark), F.lit(""))


def load_forms(spark: SparkSession, species_path: str, forms_path: str) -> DataFrame:
    """``(species, form, form_name)`` from two files of upper-case keys.

    A form key starts with its species' key. All key prefixes are generated and matched by equality.
    """

    def pairs(path: str, key: str, number: str) -> DataFrame:
        return _whole_files(spark, path).select(
            F.posexplode(F.from_json("value", "map<string,int>")).alias(f"{key}_pos", key, number)
        )

    words = F.split("form_key", "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.concat_ws("_", F.slice(words, 1, n))
    )
    forms = (
        pairs(forms_path, "form_key", "form")
        .where((F.col("form") != 0) & (F.size(words) > 1))
        .withColumn("species_key", F.explode(prefixes))
    )
    matched = forms.join(pairs(species_path, "species_key", "species"), "species_key")
    part = F.replace(F.col("form_key"), F.concat(F.col("species_key"), F.lit("_")), F.lit(""))
    named = matched.withColumn("form_name", _title(F.translate(part, "_", " ")))
    return named.groupBy("species", "form").agg(
        F.min(F.struct("form_key_pos", "form_name"))["form_name"].alias("form_name")
    )
