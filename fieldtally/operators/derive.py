"""Row-wise derivations that need several columns, and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions import fixed_values as V
from fieldtally.functions import scalars as S
from fieldtally.functions.predicates import valid_coords

_REWARD_FIELDS = {"poke_id": "pokemon_id", "poke_form": "form_id", "item_id": "item_id", "item_amount": "amount"}


def first_reward(quests: DataFrame) -> DataFrame:
    """Spread type and first reward over ``ar_*`` or ``normal_*`` columns, chosen by ``with_ar``.

    A creature reward fills id and form, an item reward id and amount, any other only the amount.
    """
    info = F.get("rewards", F.lit(0))["info"]
    value = {name: S.to_int(info[key], None) for name, key in _REWARD_FIELDS.items()}
    has_poke, has_item = value["poke_id"].isNotNull(), value["item_id"].isNotNull()
    kept = {
        "poke_id": value["poke_id"],
        "poke_form": F.when(has_poke, value["poke_form"]),
        "item_id": value["item_id"],
        "item_amount": F.when(has_item | ~has_poke, value["item_amount"]),
    }
    with_ar = F.coalesce("with_ar", F.lit(False))
    out: dict[str, Column] = {}
    for mode, test in (("ar", with_ar), ("normal", ~with_ar)):
        out[f"{mode}_type"] = F.when(test, F.col("type"))
        out[f"reward_{mode}_type"] = F.when(test, F.get("rewards", F.lit(0))["type"])
        for name, col in kept.items():
            out[f"reward_{mode}_{name}"] = F.when(test, col)
    return quests.withColumns(out)


def quest_labels(quests: DataFrame) -> DataFrame:
    """Collapse the per-mode columns into one set; the mode is ``ar`` when the AR type is set."""
    is_ar = F.col("ar_type").isNotNull()

    def pick(ar: str, normal: str) -> Column:
        return F.when(is_ar, F.col(ar)).otherwise(F.col(normal))

    return quests.withColumns(
        {
            "mode": F.when(is_ar, "ar").otherwise("normal"),
            "task_type": pick("ar_type", "normal_type"),
            "reward_type": pick("reward_ar_type", "reward_normal_type"),
            "item_id": pick("reward_ar_item_id", "reward_normal_item_id"),
            "amount": pick("reward_ar_item_amount", "reward_normal_item_amount"),
            "creature_id": pick("reward_ar_poke_id", "reward_normal_poke_id"),
            "creature_form": pick("reward_ar_poke_form", "reward_normal_poke_form"),
        }
    )


def label(col: Column) -> Column:
    """Group label of a field; a missing value is shown as ``None``."""
    return F.coalesce(col.cast("string"), F.lit("None"))


def quest_kind(quests: DataFrame) -> DataFrame:
    """Fact kind ``creature`` or ``item`` with cleaned fields; quests that give neither are dropped."""
    stop = S.clean_text(F.col("pokestop"))
    creature = F.coalesce(F.col("creature_id") > 0, F.lit(False))
    item = F.coalesce(F.col("item_id") > 0, F.lit(False))
    form = S.clean_text(F.col("creature_form").cast("string"))
    return (
        quests.where(F.col("task_type") > 0)
        .where(creature | item)
        .where((stop != "") & valid_coords(F.col("lat"), F.col("lon"), strict=True))
        .withColumns(
            {
                "kind": F.when(creature, "creature").otherwise("item"),
                "pokestop": stop,
                "pokestop_name": S.clean_text(F.col("pokestop_name"), pipe=True),
                "mode": (F.col("mode") == "ar").cast("int"),
                "item_amount": F.when(F.col("amount") > 0, F.col("amount")).otherwise(1),
                "poke_id": F.col("creature_id"),
                "poke_form": F.when(form == "", "0").otherwise(form),
            }
        )
    )


def _class_of(col: Column, classes: dict[str, list[int]], default: str | None) -> Column:
    chain = F
    for name, ids in classes.items():
        chain = chain.when(col.isin(ids), name)
    return chain.otherwise(default)


def with_character_class(df: DataFrame, col: str = "character_id") -> DataFrame:
    return df.withColumn("character_class", _class_of(F.col(col), V.CHARACTER_CLASSES, V.DEFAULT_CHARACTER_CLASS))


def with_reward_class(df: DataFrame, col: str = "reward_type") -> DataFrame:
    """Reward class by type; types without a class are left out."""
    classes = {name: [key] for key, name in V.REWARD_CLASSES.items()}
    named = df.withColumn("reward_class", _class_of(F.col(col), classes, None))
    return named.where(F.col("reward_class").isNotNull())


def with_raid_label(df: DataFrame, col: str = "level") -> DataFrame:
    text = F.col(col).cast("string")
    chain = F
    for level, name in V.RAID_LABELS.items():
        chain = chain.when(text == str(level), name)
    low = F.lower(text)
    extras = (("costume", "Costume"), ("exclusive", "Exclusive"), ("ex eligible", "EX Eligible"))
    for word, name in extras:
        chain = chain.when(low.contains(word), name)
    return df.withColumn("raid_label", chain.otherwise(F.concat(F.lit("Level "), text)))


def pick_language(lookup: DataFrame, lang: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One name per id from a ``(lang, id, name)`` lookup: the chosen language, else English."""
    chosen = F.max(F.when(F.col("lang") == lang, F.col("name")))
    english = F.max(F.when(F.col("lang") == "en", F.col("name")))
    return (
        lookup.where(F.col("lang").isin(lang, "en"))
        .groupBy(*keys)
        .agg(F.coalesce(chosen, english).alias("name"))
    )


def with_name(
    df: DataFrame, id_col: str, lookup: DataFrame, lang: str = "en", fallback: str = "Pokemon #", out: str = "name"
) -> DataFrame:
    """Localised name of ``id_col``; unknown ids become the fallback text plus the id."""
    names = pick_language(lookup, lang).select(F.col("id").alias(id_col), F.col("name").alias("_name"))
    other = F.concat(F.lit(fallback), label(F.col(id_col)))
    return df.join(names, id_col, "left").withColumn(out, F.coalesce("_name", other)).drop("_name").select(
        *df.columns, out
    )


def with_species_name(
    df: DataFrame, species: DataFrame, forms: DataFrame, lang: str = "en",
    species_col: str = "species", form_col: str = "form", out: str = "name",
) -> DataFrame:
    """Species name with its form: none for form 0, the form's own name if known, else ``Form n``.

    ``forms`` has ``(species, form, form_name)`` with integer ids.
    """
    named = with_name(df, species_col, species, lang, "Pokemon #", "_species").withColumn(
        "_form", S.to_int(F.col(form_col), 0)
    )
    known = forms.select(
        F.col("species").alias(species_col), F.col("form").alias("_form"), F.col("form_name").alias("_form_name")
    )
    joined = named.join(known, [species_col, "_form"], "left")
    suffix = F.coalesce("_form_name", F.concat(F.lit("Form "), F.col("_form").cast("string")))
    text = F.when(F.col("_form") == 0, F.col("_species")).otherwise(
        F.concat(F.col("_species"), F.lit(" ("), suffix, F.lit(")"))
    )
    return joined.withColumn(out, text).select(*df.columns, out)


def with_invasion_label(df: DataFrame, characters: DataFrame, displays: DataFrame, lang: str = "en") -> DataFrame:
    """Character name, or ``<display type> (ID: n)`` when the character has no name."""
    chars = pick_language(characters, lang).select(F.col("id").alias("character_id"), F.col("name").alias("_char"))
    shown = with_name(df, "display_type", displays, lang, "Type #", "_display")
    other = F.concat(F.col("_display"), F.lit(" (ID: "), F.col("character_id").cast("string"), F.lit(")"))
    return (
        shown.join(chars, "character_id", "left")
        .withColumn("label", F.coalesce("_char", other))
        .select(*df.columns, "label")
    )


def with_reward_name(
    df: DataFrame, rewards: DataFrame, items: DataFrame, species: DataFrame, forms: DataFrame, lang: str = "en"
) -> DataFrame:
    """Display name, category and filter key of a quest reward.

    Columns used: ``reward_type, item_id, amount, creature_id, creature_form``; missing numbers count as 0.
    The creature shown is the reward's own for encounters and mega energy, the item id's for candies.
    """
    number = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("reward_type", "item_id", "amount", "creature_id")}
    kind, item, amount, creature = (number[c] for c in ("reward_type", "item_id", "amount", "creature_id"))
    shown = F.when(kind == 7, creature).when(kind == 12, F.when(creature > 0, creature).otherwise(item)).otherwise(item)
    base = df.withColumns(
        {
            "_kind": kind, "_item": item, "_shown": shown,
            "_form": F.when(kind == 7, F.coalesce(F.col("creature_form").cast("int"), F.lit(0))).otherwise(0),
            "_times": F.when(amount > 1, F.concat(F.lit(" x"), amount.cast("string"))).otherwise(""),
        }
    )
    base = with_name(base, "_kind", rewards, lang, "Reward Type #", "category")
    base = with_name(base, "_item", items, lang, "Item #", "_item_name")
    base = with_species_name(base, species, forms, lang, "_shown", "_form", "_creature_name")
    category, times, who = F.col("category"), F.col("_times"), F.col("_creature_name")
    kind, shown, item = F.col("_kind"), F.col("_shown").cast("string"), F.col("_item").cast("string")
    name = (
        F.when(kind == 2, F.concat("_item_name", times))
        .when(kind == 7, who)
        .when(kind.isin(4, 9, 12), F.concat(who, F.lit(" "), category, times))
        .otherwise(F.concat(category, times))
    )
    key = (
        F.when(kind == 2, F.concat(F.lit("item_"), item))
        .when(kind == 7, F.concat(F.lit("poke_"), shown, F.lit("_"), F.col("_form").cast("string")))
        .when(kind == 3, "stardust")
        .when(kind == 12, F.concat(F.lit("mega_"), shown))
        .when(kind == 9, F.concat(F.lit("xl_"), item))
        .when(kind == 4, F.concat(F.lit("candy_"), item))
        .when(kind == 1, "xp")
        .otherwise(F.concat(F.lit("other_"), kind.cast("string")))
    )
    return base.withColumns({"reward_name": name, "filter_key": key}).select(
        *df.columns, "reward_name", "category", "filter_key"
    )
