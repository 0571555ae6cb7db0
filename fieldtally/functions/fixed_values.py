"""Fixed values. These must equal the game's own ids and labels for right results."""

# Character ids of each class.
GIOVANNI_IDS = [44, 524]
CLIFF_IDS = [41, 527]
ARLO_IDS = [42, 526]
SIERRA_IDS = [43, 525]
FEMALE_GRUNT_IDS = [
    5, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 46, 47, 49, 51, 53, 55, 57, 59, 61, 63, 65,
    67, 69, 71, 73, 75, 77, 79, 81, 83, 85, 87, 89,
]
MALE_GRUNT_IDS = [
    4, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29, 31, 33, 35, 37, 39, 45, 48, 50, 52, 54, 56, 58, 60, 62, 64, 66,
    68, 70, 72, 74, 76, 78, 80, 82, 84, 86, 88, 90,
]
CHARACTER_CLASSES = {
    "giovanni": GIOVANNI_IDS,
    "cliff": CLIFF_IDS,
    "arlo": ARLO_IDS,
    "sierra": SIERRA_IDS,
    "female": FEMALE_GRUNT_IDS,
    "male": MALE_GRUNT_IDS,
}
DEFAULT_CHARACTER_CLASS = "unset"
CHARACTER_CLASS_ORDER = ["male", "female", "cliff", "arlo", "sierra", "giovanni", "unset"]

# Reward type id -> class in the global quest report. Other types are left out of that report.
REWARD_CLASSES = {1: "xp", 2: "item", 3: "stardust", 4: "candy", 7: "pokemon", 12: "mega"}

# Raid level -> label. Levels not listed are shown as "Level n".
RAID_LABELS = {
    6: "Mega",
    7: "Mega 5",
    8: "Ultra Beast",
    9: "Extended Egg",
    10: "Primal",
    11: "Shadow Level 1",
    12: "Shadow Level 2",
    13: "Shadow Level 3",
    14: "Shadow Level 4",
    15: "Shadow Level 5",
}

# Names of the sighting metrics, in report order.
SIGHTING_METRICS = ["total", "iv100", "iv0", "shiny", "pvp_little", "pvp_great", "pvp_ultra"]

# Names of the raid series metrics.
RAID_METRICS = ["total", "costume", "exclusive", "ex_raid_eligible"]

# Edge of a map grid cell in degrees.
GRID_STEP = 0.0005
