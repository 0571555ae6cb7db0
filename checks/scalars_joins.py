"""Queries for scalar derivations, joins and rollup builders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.base import BLOCKS, HEX_ID, INSIDE, IV_BUCKET, TTH_BUCKET, Frames, query
from fieldtally.functions import fixed_values as V
from fieldtally.functions import scalars as S
from fieldtally.operators import derive as D
from fieldtally.operators import joins as J
from fieldtally.operators import rollups as R
from fieldtally.operators import spatial as X
from fieldtally.operators.merge import shiny_counts
from fieldtally.operators.rollups import ROLLUPS


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


N = "CAST(count(*) AS BIGINT) AS n"

# --- C: scalars ------------------------------------------------------------------------------------------


@query("C1_iv_pct", f"SELECT atk, dfn, sta, round((atk + dfn + sta) / 45.0 * 100, 2) AS iv, {N} FROM sightings GROUP BY ALL")
def c1(f: Frames) -> DataFrame:
    iv = S.iv_pct(F.col("atk"), F.col("dfn"), F.col("sta"))
    return counted(f.raw("sightings").select("atk", "dfn", "sta", iv.alias("iv")), "atk", "dfn", "sta", "iv")


@query("C2_iv_int", f"SELECT CAST(round((atk + dfn + sta) / 45.0 * 100, 0) AS INT) AS iv, {N} FROM sightings GROUP BY ALL")
def c2(f: Frames) -> DataFrame:
    iv = S.iv_int(S.iv_pct(F.col("atk"), F.col("dfn"), F.col("sta")))
    return counted(f.raw("sightings").select(iv.alias("iv")), "iv")


@query("C3_despawn_seconds", f"SELECT CAST(disappear_time - first_seen AS BIGINT) AS s, {N} FROM sightings GROUP BY ALL")
def c3(f: Frames) -> DataFrame:
    s = S.despawn_seconds(F.col("disappear_time"), F.col("first_seen"))
    return counted(f.raw("sightings").select(s.alias("s")), "s")


@query(
    "C4_rank1_flag",
    f"""SELECT rank1_little AS flag_l, CASE WHEN species % 2 = 0 THEN false ELSE rank1_great END AS flag_g, {N}
        FROM sightings GROUP BY ALL""",
)
def c4(f: Frames) -> DataFrame:
    """Leagues with rank 1 among others, without it, with a missing rank, and absent altogether."""
    rows = f.sql(
        """SELECT CASE WHEN rank1_little THEN array(struct(4 AS rank), struct(1 AS rank))
                       ELSE array(struct(2 AS rank), struct(CAST(NULL AS INT) AS rank)) END AS little,
                  CASE WHEN species % 2 = 0 THEN NULL WHEN rank1_great THEN array(struct(1 AS rank))
                       ELSE array(struct(10 AS rank)) END AS great FROM {s}""",
        s=f.raw("sightings"),
    )
    return counted(
        rows.select(S.rank1_flag(F.col("little")).alias("flag_l"), S.rank1_flag(F.col("great")).alias("flag_g")),
        "flag_l", "flag_g",
    )


@query(
    "C5_to_area_local",
    """SELECT gym, arrival, make_timestamp((spawn - 3 * 3600 + offset_hours * 3600) * 1000000) AS spawn_at,
              make_timestamp((start_ts - 3 * 3600 + offset_hours * 3600) * 1000000) AS start_at,
              make_timestamp((end_ts - 3 * 3600 + offset_hours * 3600) * 1000000) AS end_at FROM ev_raids""",
)
def c5(f: Frames) -> DataFrame:
    times = {"spawn": "spawn_at", "start_ts": "start_at", "end_ts": "end_at"}
    return X.assign_area(f.raw("raids"), f.index).select(
        "gym", "arrival", *[S.to_area_local(F.col(a), F.col("offset_hours"), 3).alias(b) for a, b in times.items()]
    )


@query("C6_iv_bucket", f"SELECT iv, {IV_BUCKET} AS iv_bucket, {N} FROM (SELECT *, round((atk + dfn + sta) / 45.0 * 110 - 5, 2) AS iv FROM sightings) GROUP BY ALL")
def c6(f: Frames) -> DataFrame:
    """Stretched beyond 0..100 so that both ends are met."""
    iv = F.round((F.col("atk") + F.col("dfn") + F.col("sta")) / 45.0 * 110 - 5, 2)
    return counted(f.raw("sightings").select(iv.alias("iv")).withColumn("iv_bucket", S.iv_bucket(F.col("iv"))), "iv", "iv_bucket")


@query(
    "C7_tth_bucket",
    f"""SELECT CASE WHEN despawn_s > 0 AND despawn_s < 3600 THEN {TTH_BUCKET} END AS tth_bucket, {N}
        FROM (SELECT disappear_time - first_seen AS despawn_s FROM sightings) GROUP BY ALL""",
)
def c7(f: Frames) -> DataFrame:
    s = S.despawn_seconds(F.col("disappear_time"), F.col("first_seen"))
    return counted(f.raw("sightings").select(S.tth_bucket(s).alias("tth_bucket")), "tth_bucket")


for _id, _grain in (("C8", "minute"), ("C9", "hour"), ("C10", "day"), ("C11", "week"), ("C12", "month")):

    @query(
        f"{_id}_bucket_{_grain}",
        f"SELECT CAST(date_trunc('{_grain}', seen_at) AS TIMESTAMP) AS bucket, {N} FROM ev_sightings GROUP BY ALL",
    )
    def bucketed(f: Frames, grain: str = _grain) -> DataFrame:
        return counted(f.events("sightings").select(S.bucket(F.col("seen_at"), grain).alias("bucket")), "bucket")


@query(
    "C12_month_keys",
    f"""SELECT strftime(seen_at, '%Y%m') AS month, CAST(year(seen_at) % 100 * 100 + month(seen_at) AS INT) AS yymm, {N}
        FROM ev_sightings GROUP BY ALL""",
)
def c12(f: Frames) -> DataFrame:
    seen = F.col("seen_at")
    return counted(f.events("sightings").select(S.month_key(seen).alias("month"), S.yymm(seen).alias("yymm")), "month", "yymm")


@query("C13_hour_of_day", f"SELECT CAST(hour(seen_at) AS INT) AS hour, {N} FROM ev_sightings GROUP BY ALL")
def c13(f: Frames) -> DataFrame:
    return counted(f.events("sightings").select(S.hour_of_day(F.col("seen_at")).alias("hour")), "hour")


@query(
    "C14_sighting_metrics",
    "SELECT area, species, metric, CAST(sum(cnt) AS BIGINT) AS n FROM r_sightings_day GROUP BY ALL",
)
def c14(f: Frames) -> DataFrame:
    return counted(R.sighting_metrics(f.events("sightings")), "area", "species", "metric")


@query("C15_raid_metrics", "SELECT area, boss, metric, CAST(sum(cnt) AS BIGINT) AS n FROM r_raids_minute GROUP BY ALL")
def c15(f: Frames) -> DataFrame:
    return counted(R.raid_metrics(f.events("raids")), "area", "boss", "metric")


_QUEST_COLS = [
    f"{p}{m}_{s}" for m in ("ar", "normal")
    for p, s in (("", "type"), ("reward_", "type"), ("reward_", "poke_id"), ("reward_", "poke_form"),
                 ("reward_", "item_id"), ("reward_", "item_amount"))
]


def _quest_payload(f: Frames) -> DataFrame:
    """Flat quests back to their payload form: a reward list whose first entry counts."""
    return f.sql(
        """SELECT task_type AS type, with_ar, lat, lon, pokestop, pokestop_name, updated, arrival,
                  array(struct(reward_type AS type,
                               map('pokemon_id', CAST(creature_id AS STRING), 'form_id', CAST(creature_form AS STRING),
                                   'item_id', CAST(item_id AS STRING), 'amount', CAST(amount AS STRING)) AS info),
                        struct(99 AS type, map('amount', '77') AS info)) AS rewards
           FROM {q}""",
        q=f.raw("quests"),
    )


def _mode_cols(mode: str, test: str) -> str:
    cols = {
        f"{mode}_type": "task_type", f"reward_{mode}_type": "reward_type", f"reward_{mode}_poke_id": "creature_id",
        f"reward_{mode}_poke_form": "creature_form", f"reward_{mode}_item_id": "item_id", f"reward_{mode}_item_amount": "amount",
    }
    return ", ".join(f"CASE WHEN {test} THEN {src} END AS {name}" for name, src in cols.items())


@query(
    "C16_first_reward",
    f"SELECT arrival, {_mode_cols('ar', 'with_ar')}, {_mode_cols('normal', 'NOT with_ar')} FROM quests",
)
def c16(f: Frames) -> DataFrame:
    return D.first_reward(_quest_payload(f)).select("arrival", *_QUEST_COLS)


@query(
    "C17_quest_labels",
    f"""SELECT CASE WHEN with_ar THEN 'ar' ELSE 'normal' END AS mode, task_type, reward_type,
               coalesce(CAST(item_id AS VARCHAR), 'None') AS item, coalesce(CAST(amount AS VARCHAR), 'None') AS amount,
               coalesce(CAST(creature_id AS VARCHAR), 'None') AS creature, {N} FROM quests GROUP BY ALL""",
)
def c17(f: Frames) -> DataFrame:
    rows = D.quest_labels(D.first_reward(_quest_payload(f))).select(
        "mode", "task_type", "reward_type", D.label(F.col("item_id")).alias("item"),
        D.label(F.col("amount")).alias("amount"), D.label(F.col("creature_id")).alias("creature"),
    )
    return counted(rows, *rows.columns)


@query("C18_quest_kind", "SELECT kind, pokestop, mode, task_type, CASE WHEN kind = 'item' THEN item_id END AS item_id, item_amount, poke_id, CASE WHEN kind = 'creature' THEN poke_form END AS poke_form, arrival FROM quest_rows")
def c18(f: Frames) -> DataFrame:
    creature = F.col("kind") == "creature"
    return D.quest_kind(f.events("quests")).select(
        "kind", "pokestop", "mode", "task_type", F.when(~creature, F.col("item_id")).alias("item_id"), "item_amount",
        "poke_id", F.when(creature, F.col("poke_form")).alias("poke_form"), "arrival",
    )


@query(
    "C19_flag",
    f"""SELECT CAST(CASE WHEN weather <> 0 THEN 1 ELSE 0 END AS INT) AS boosted,
               CAST(CASE WHEN species % 3 = 0 THEN 0 WHEN weather - 4 <> 0 THEN 1 ELSE 0 END AS INT) AS signed, {N}
        FROM sightings GROUP BY ALL""",
)
def c19(f: Frames) -> DataFrame:
    signed = F.when(F.col("species") % 3 != 0, F.col("weather") - 4)
    return counted(
        f.raw("sightings").select(S.flag(F.col("weather")).alias("boosted"), S.flag(signed).alias("signed")), "boosted", "signed"
    )


@query(
    "C20_shiny_flag",
    f"""SELECT CAST(CASE WHEN shiny THEN 1 ELSE 0 END AS INT) AS from_bool,
               CAST(CASE WHEN arrival % 5 IN (0, 1, 3) THEN 1 ELSE 0 END AS INT) AS from_text, {N} FROM sightings GROUP BY ALL""",
)
def c20(f: Frames) -> DataFrame:
    rows = f.sql(
        """SELECT shiny, CASE arrival % 5 WHEN 0 THEN 'true' WHEN 1 THEN '1' WHEN 2 THEN 'false' WHEN 3 THEN ' 7 ' END AS t
           FROM {s}""",
        s=f.raw("sightings"),
    )
    return counted(rows.select(S.flag(F.col("shiny")).alias("from_bool"), S.text_flag(F.col("t")).alias("from_text")), "from_bool", "from_text")


@query(
    "C21_clean_text",
    """SELECT doc_id, substr(regexp_replace(replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '|', '/'),
              '[^\\x00-\\x7F]', '', 'g'), 1, 255) AS name,
              CASE WHEN form = '' THEN '0' ELSE form END AS form
       FROM (SELECT *, substr(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              '[^\\x00-\\x7F]', '', 'g'), 1, 15) AS form FROM documents)""",
)
def c21(f: Frames) -> DataFrame:
    return f.table("documents").select(
        "doc_id", S.clean_text(F.col("text"), 255, pipe=True).alias("name"), S.clean_form(F.col("text"), 15).alias("form")
    )


@query(
    "C21_clean_text_whole",
    """SELECT doc_id, regexp_replace(replace(t, '|', '/'), '[^\\x00-\\x7F]', '', 'g') AS name,
              CASE WHEN regexp_replace(t, '[^\\x00-\\x7F]', '', 'g') = '' THEN '0' ELSE regexp_replace(t, '[^\\x00-\\x7F]', '', 'g') END AS form
       FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents)""",
)
def c21_whole(f: Frames) -> DataFrame:
    return f.table("documents").select("doc_id", S.clean_text(F.col("text"), pipe=True).alias("name"), S.clean_form(F.col("text")).alias("form"))


@query(
    "C23_hex_to_id_high",
    f"""SELECT CAST(CAST({HEX_ID} AS HUGEINT) + CASE WHEN {HEX_ID} % 2 = 0 THEN 9223372036854775808::HUGEINT ELSE 0 END AS DECIMAL(20,0)) AS id, {N}
        FROM sightings GROUP BY ALL""",
)
def c23_high(f: Frames) -> DataFrame:
    """Every even id gets its highest bit set: half of them are beyond the signed range, none is lost."""
    text = F.lpad("spawnpoint_hex", 16, "0")
    even = F.conv(F.substring(text, -1, 1), 16, 10).cast("int") % 2 == 0
    digit = F.lower(F.conv((F.conv(F.substring(text, 1, 1), 16, 10).cast("int") + 8).cast("string"), 10, 16))
    high = F.when(even, F.concat(digit, F.substring(text, 2, 15))).otherwise(text)
    return counted(f.raw("sightings").select(S.unsigned_id(S.hex_to_id(high)).alias("id")), "id")


@query(
    "C22_lenient_casts",
    """SELECT vec, CAST(sum(i) AS BIGINT) AS i, CAST(round(sum(d), 4) AS DOUBLE) AS d FROM (
         SELECT l_linenumber AS vec, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_orderkey AS INT) ELSE -1 END AS i,
                CASE WHEN l_orderkey % 3 = 1 THEN 0.5 ELSE l_orderkey END AS d FROM lineitem) GROUP BY ALL""",
)
def c22(f: Frames) -> DataFrame:
    rows = f.sql(
        """SELECT l_linenumber AS vec,
                  CASE l_orderkey % 3 WHEN 0 THEN concat(' ', CAST(l_orderkey AS STRING)) WHEN 1 THEN 'n/a' ELSE NULL END AS it,
                  CASE l_orderkey % 3 WHEN 1 THEN '' ELSE CAST(l_orderkey AS STRING) END AS dt FROM {l}""",
        l=f.table("lineitem"),
    ).select("vec", S.to_int(F.col("it"), -1).alias("i"), S.to_double(F.col("dt"), 0.5).alias("d"))
    return rows.groupBy("vec").agg(F.sum("i").alias("i"), F.round(F.sum("d"), 4).alias("d"))


@query("C23_hex_to_id", f"SELECT {HEX_ID} AS id, {N} FROM sightings GROUP BY ALL")
def c23(f: Frames) -> DataFrame:
    """Leading zeros make no difference."""
    rows = f.raw("sightings").select(S.hex_to_id(F.concat(F.lit(" 00000000000000000"), "spawnpoint_hex")).alias("id"))
    return counted(rows, "id")


# fixed values: character ids by class, written out apart from the library's lists
_CLASS = """CASE
    WHEN character_id IN (44, 524) THEN 'giovanni'
    WHEN character_id IN (41, 527) THEN 'cliff'
    WHEN character_id IN (42, 526) THEN 'arlo'
    WHEN character_id IN (43, 525) THEN 'sierra'
    WHEN character_id IN (5, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 46, 47, 49, 51, 53, 55, 57, 59, 61, 63, 65, 67, 69, 71, 73, 75, 77, 79, 81, 83, 85, 87, 89) THEN 'female'
    WHEN character_id IN (4, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29, 31, 33, 35, 37, 39, 45, 48, 50, 52, 54, 56, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76, 78, 80, 82, 84, 86, 88, 90) THEN 'male'
    ELSE 'unset' END"""


@query("C24_character_class", f"SELECT character_id, {_CLASS} AS character_class, {N} FROM invasions GROUP BY ALL")
def c24(f: Frames) -> DataFrame:
    return counted(D.with_character_class(f.raw("invasions")), "character_id", "character_class")


@query(
    "C25_reward_class",
    f"""SELECT kind AS reward_type, CASE kind WHEN 1 THEN 'xp' WHEN 2 THEN 'item' WHEN 3 THEN 'stardust' WHEN 4 THEN 'candy'
          WHEN 7 THEN 'pokemon' WHEN 12 THEN 'mega' END AS reward_class, {N}
        FROM (SELECT CAST(task_type % 14 AS INT) AS kind FROM quests) WHERE kind IN (1, 2, 3, 4, 7, 12) GROUP BY ALL""",
)
def c25(f: Frames) -> DataFrame:
    rows = f.raw("quests").select((F.col("task_type") % 14).cast("int").alias("reward_type"))
    return counted(D.with_reward_class(rows), "reward_type", "reward_class")


_SPECIES_TEXT = """CASE WHEN {f} = 0 THEN sn ELSE concat(sn, ' (', coalesce(form_name, concat('Form ', CAST({f} AS VARCHAR))), ')') END"""


def _named_species(source: str, species: str, form: str) -> str:
    """SQL: source columns plus the displayed creature name ``cn``."""
    return f"""(SELECT *, {_SPECIES_TEXT.format(f='ff')} AS cn FROM (
        SELECT x.*, coalesce(n.name, concat('Pokemon #', CAST(x.ss AS VARCHAR))) AS sn, fo.form_name
        FROM (SELECT *, {species} AS ss, {form} AS ff FROM {source}) x LEFT JOIN n_species n ON n.id = x.ss
        LEFT JOIN forms fo ON fo.species = x.ss AND fo.form = x.ff))"""


_REWARD_SOURCE = """(SELECT CAST(task_type % 13 AS INT) AS reward_type, coalesce(item_id, 0) AS item_id,
    coalesce(amount, 0) AS amount, coalesce(creature_id, 0) AS creature_id, coalesce(creature_form, 0) AS creature_form FROM quests)"""


@query(
    "C26_reward_name",
    f"""SELECT reward_type, item_id, amount, creature_id, creature_form,
          CASE WHEN reward_type = 2 THEN concat(iname, t) WHEN reward_type = 7 THEN cn
               WHEN reward_type IN (4, 9, 12) THEN concat(cn, ' ', cat, t) ELSE concat(cat, t) END AS reward_name,
          cat AS category,
          CASE reward_type WHEN 2 THEN concat('item_', item_id) WHEN 7 THEN concat('poke_', ss, '_', ff) WHEN 3 THEN 'stardust'
               WHEN 12 THEN concat('mega_', ss) WHEN 9 THEN concat('xl_', item_id) WHEN 4 THEN concat('candy_', item_id)
               WHEN 1 THEN 'xp' ELSE concat('other_', reward_type) END AS filter_key, {N}
        FROM (SELECT y.*, coalesce(r.name, concat('Reward Type #', y.reward_type)) AS cat,
                     coalesce(i.name, concat('Item #', y.item_id)) AS iname,
                     CASE WHEN amount > 1 THEN concat(' x', amount) ELSE '' END AS t
              FROM {_named_species(_REWARD_SOURCE,
                   "CASE WHEN reward_type = 7 OR (reward_type = 12 AND creature_id > 0) THEN creature_id ELSE item_id END",
                   "CASE WHEN reward_type = 7 THEN creature_form ELSE 0 END")} y
              LEFT JOIN n_rewards r ON r.id = y.reward_type LEFT JOIN n_items i ON i.id = y.item_id)
        GROUP BY ALL""",
)
def c26(f: Frames) -> DataFrame:
    fields = ["reward_type", "item_id", "amount", "creature_id", "creature_form"]
    rows = f.raw("quests").select(
        (F.col("task_type") % 13).cast("int").alias("reward_type"), *[F.coalesce(c, F.lit(0)).alias(c) for c in fields[1:]]
    )
    counts = counted(rows, *fields)
    return D.with_reward_name(counts, f.lookup("rewards"), f.lookup("items"), f.lookup("species"), f.forms(), "de").select(
        *fields, "reward_name", "category", "filter_key", "n"
    )


@query(
    "C27_with_name",
    f"""SELECT s.species, coalesce(n.name, concat('Pokemon #', s.species)) AS name, {N}
        FROM sightings s LEFT JOIN n_species n ON n.id = s.species GROUP BY ALL""",
)
def c27(f: Frames) -> DataFrame:
    return D.with_name(counted(f.raw("sightings"), "species"), "species", f.lookup("species"), "de")


@query(
    "C28_with_species_name",
    f"SELECT species, form, cn AS name, {N} FROM {_named_species('sightings', 'species', 'CAST(form AS INT)')} GROUP BY ALL",
)
def c28(f: Frames) -> DataFrame:
    return D.with_species_name(counted(f.raw("sightings"), "species", "form"), f.lookup("species"), f.forms(), "de")


@query(
    "C29_raid_label",
    f"""SELECT level, CASE level WHEN 6 THEN 'Mega' WHEN 7 THEN 'Mega 5' WHEN 8 THEN 'Ultra Beast' WHEN 9 THEN 'Extended Egg'
          WHEN 10 THEN 'Primal' WHEN 11 THEN 'Shadow Level 1' WHEN 12 THEN 'Shadow Level 2' WHEN 13 THEN 'Shadow Level 3'
          WHEN 14 THEN 'Shadow Level 4' WHEN 15 THEN 'Shadow Level 5' ELSE concat('Level ', level) END AS raid_label, {N}
        FROM (SELECT CAST(1 + boss % 16 AS INT) AS level FROM raids) GROUP BY ALL""",
)
def c29(f: Frames) -> DataFrame:
    rows = f.raw("raids").select((1 + F.col("boss") % 16).cast("int").alias("level"))
    return D.with_raid_label(counted(rows, "level")).select("level", "raid_label", "n")


@query(
    "C30_shiny_odds",
    """SELECT month_year, species, CASE WHEN pct > 0 THEN CAST(floor(100.0 / pct) AS BIGINT) END AS odds FROM (
         SELECT month_year, species, round(sum(CASE WHEN shiny = 1 THEN total_count ELSE 0 END) / sum(total_count) * 100, 4) AS pct
         FROM shiny_months GROUP BY ALL)""",
)
def c30(f: Frames) -> DataFrame:
    hits = F.sum(F.when(F.col("shiny") == 1, F.col("total_count")).otherwise(0))
    rates = shiny_counts(f.events("sightings")).groupBy("month_year", "species").agg(
        F.round(hits / F.sum("total_count") * 100, 4).alias("pct")
    )
    return rates.select("month_year", "species", S.shiny_odds(F.col("pct")).alias("odds"))


@query(
    "C31_invasion_label",
    f"""SELECT i.display_type, i.character_id,
               coalesce(c.name, concat(coalesce(d.name, concat('Type #', i.display_type)), ' (ID: ', i.character_id, ')')) AS label, {N}
        FROM invasions i LEFT JOIN n_characters c ON c.id = i.character_id LEFT JOIN n_displays d ON d.id = i.display_type
        GROUP BY ALL""",
)
def c31(f: Frames) -> DataFrame:
    rows = counted(f.raw("invasions"), "display_type", "character_id")
    return D.with_invasion_label(rows, f.lookup("characters"), f.lookup("displays"), "de").select(
        "display_type", "character_id", "label", "n"
    )


# --- D: joins --------------------------------------------------------------------------------------------


@query("D1_assign_area", "SELECT area_id, area, offset_hours, arrival FROM ev_sightings")
def d1(f: Frames) -> DataFrame:
    return X.assign_area(f.raw("sightings"), f.index).select("area_id", "area", "offset_hours", "arrival")


BLOCKS["areas2"] = """
    SELECT area_id, area, offset_hours, lon0, lat0 FROM areas
    UNION ALL SELECT area_id + 100, concat('B', area), offset_hours + 1, lon0 + 3.0, lat0 + 1.0 FROM areas"""


def overlapping(f: Frames) -> DataFrame:
    """Every area twice, the second one moved and renamed, so that many points lie in two or more."""
    moved = F.transform("ring", lambda p: F.struct((p["lon"] + 3.0).alias("lon"), (p["lat"] + 1.0).alias("lat")))
    return f.areas.unionByName(
        f.areas.select(
            (F.col("area_id") + 100).alias("area_id"), F.concat(F.lit("B"), "area").alias("area"),
            (F.col("offset_hours") + 1).alias("offset_hours"), moved.alias("ring"),
        )
    )


_FIRST_MATCH = f"""SELECT arrival, area_id, area FROM (
    SELECT p.arrival, a.area_id, a.area, row_number() OVER (PARTITION BY p.arrival ORDER BY a.area, a.area_id) AS rn
    FROM raids p JOIN areas2 a ON {INSIDE}) WHERE rn = 1"""


@query("D1_assign_area_overlap", _FIRST_MATCH)
def d1_overlap(f: Frames) -> DataFrame:
    return X.assign_area(f.raw("raids"), overlapping(f)).select("arrival", "area_id", "area")


@query("D1_assign_area_unbroadcast", _FIRST_MATCH)
def d1_shuffled(f: Frames) -> DataFrame:
    """The same with an index that counts as too large to broadcast."""
    index = X.AreaIndex.build(overlapping(f), broadcast_bytes=0)
    return X.assign_area(f.raw("raids"), index).select("arrival", "area_id", "area")


@query(
    "D2_count_points_by_area",
    f"""WITH c AS (SELECT a.area, CAST(count(p.pokestop) AS BIGINT) AS stops
                   FROM areas2 a LEFT JOIN pokestops p ON {INSIDE} GROUP BY ALL)
        SELECT area, stops FROM c UNION ALL SELECT 'grand_total', CAST(sum(stops) AS BIGINT) FROM c""",
)
def d2(f: Frames) -> DataFrame:
    return X.stops_with_total(X.count_points_by_area(f.points("pokestops"), overlapping(f)))


@query("D3_area_id", "SELECT area_id, CAST(count(*) AS BIGINT) AS n FROM ev_raids WHERE area = 'NATION_24' GROUP BY ALL")
def d3(f: Frames) -> DataFrame:
    return counted(f.events("raids").where(F.col("area_id") == J.area_id(f.areas, " nation_24 ")), "area_id")


for _id, _facts, _dim, _key, _how in (
    ("D4_sightings_spawnpoints", "sighting_facts", "spawnpoints", "spawnpoint", "inner"),
    ("D5_raids_gyms", "raid_facts", "gyms", "gym", "inner"),
    ("D6_invasions_stops", "invasion_facts", "pokestops", "pokestop", "inner"),
):

    @query(_id, f"SELECT f.*, d.lat, d.lon FROM {_facts} f JOIN {_dim} d USING ({_key})")
    def attached(f: Frames, facts: str = _facts, dim: str = _dim, key: str = _key, how: str = _how) -> DataFrame:
        return J.attach_point(f.facts(facts), f.points(dim).select(key, "lat", "lon"), key, how)


@query(
    "D7_quests_stops_left",
    """SELECT f.*, d.lat, d.lon FROM quest_item_facts f
       LEFT JOIN (SELECT * FROM pokestops WHERE pokestop NOT LIKE '%7') d USING (pokestop)""",
)
def d7(f: Frames) -> DataFrame:
    """Stops whose name ends in 7 are missing from the dimension."""
    stops = f.points("pokestops").where(~F.col("pokestop").like("%7"))
    return J.attach_point(f.facts("quest_item_facts"), stops.select("pokestop", "lat", "lon"), "pokestop", "left")


_MOVING = """SELECT spawnpoint_hex, arrival, CASE WHEN arrival % 5 = 0 THEN NULL ELSE lat + arrival % 3 END AS lat, lon FROM sightings"""


@query(
    "D8_first_coords",
    f"""WITH m AS ({_MOVING}),
        c AS (SELECT spawnpoint_hex, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY spawnpoint_hex ORDER BY arrival) AS rn
              FROM m WHERE lat IS NOT NULL) WHERE rn = 1)
        SELECT m.spawnpoint_hex, m.arrival, c.lat, c.lon FROM m LEFT JOIN c USING (spawnpoint_hex)""",
)
def d8(f: Frames) -> DataFrame:
    return J.first_coords(f.sql(_MOVING.replace("FROM sightings", "FROM {s}"), s=f.raw("sightings")))


@query(
    "D9_lookup_join",
    f"""SELECT q.task_type, coalesce(n.name, concat('Quest Type #', q.task_type)) AS name, {N}
        FROM quests q LEFT JOIN n_quest_types n ON n.id = q.task_type GROUP BY ALL""",
)
def d9(f: Frames) -> DataFrame:
    return D.with_name(counted(f.raw("quests"), "task_type"), "task_type", f.lookup("quest_types"), "de", "Quest Type #")


# --- E: rollup builders ----------------------------------------------------------------------------------

_E = [
    ("E1", "sightings", "minute"), ("E2", "sightings", "hour"), ("E3", "sightings", "day"), ("E4", "sightings", "week"),
    ("E5", "tth", "minute"), ("E6", "tth", "hour"), ("E7", "tth", "day"), ("E8", "tth", "week"),
    ("E9", "weather_iv", "month"),
    ("E10", "raids", "minute"), ("E11", "raids", "hour"), ("E12", "raids", "day"), ("E13", "raids", "week"),
    ("E14", "quests", "minute"), ("E15", "quests", "hour"), ("E16", "quests", "day"), ("E17", "quests", "week"),
    ("E18", "invasions", "minute"), ("E19", "invasions", "hour"), ("E20", "invasions", "day"), ("E21", "invasions", "week"),
]
for _id, _family, _grain in _E:

    @query(f"{_id}_{_family}_{_grain}", f"SELECT * FROM r_{_family}_{_grain}")
    def rolled(f: Frames, family: str = _family, grain: str = _grain) -> DataFrame:
        return f.roll(family, grain)


for _family in ("sightings", "raids"):

    @query(f"E_coarsen_{_family}_hour_to_week", f"SELECT * FROM r_{_family}_week")
    def coarser(f: Frames, family: str = _family) -> DataFrame:
        return R.coarsen(R.coarsen(f.roll(family, "hour"), "day"), "week")


assert {f for _, f, _ in _E} == set(ROLLUPS)
