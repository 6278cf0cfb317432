"""Fixed values of the combat-log domain (ids and names published by the game).

Everything in this file is data that results must agree with; there is no logic here.
"""

# --- fixed values: difficulty ids -------------------------------------------------------
DIFFICULTY_NAMES = {
    1: "Normal", 2: "Heroic", 3: "10 Normal", 4: "25 Normal", 5: "10 Heroic", 6: "25 Heroic",
    7: "Scenario", 8: "Challenge Mode", 9: "40 Player", 11: "Battleground", 12: "Arena",
    13: "Rated Battleground", 14: "Normal", 15: "Heroic", 16: "Mythic", 17: "LFR", 18: "Event",
    19: "Heroic Scenario", 20: "Mythic Keystone", 23: "Mythic", 24: "Timewalking",
    33: "Timewalking", 167: "Torghast", 168: "Path of Ascension",
}
RAID_DIFFICULTIES = [3, 4, 5, 6, 9, 14, 15, 16, 17, 18, 33]
DUNGEON_DIFFICULTIES = [1, 2, 8, 23, 24]

# --- fixed values: specialisation ids, (class, specialisation) ---------------------------
SPECS = {
    62: ("Mage", "Arcane"), 63: ("Mage", "Fire"), 64: ("Mage", "Frost"),
    65: ("Paladin", "Holy"), 66: ("Paladin", "Protection"), 70: ("Paladin", "Retribution"),
    71: ("Warrior", "Arms"), 72: ("Warrior", "Fury"), 73: ("Warrior", "Protection"),
    102: ("Druid", "Balance"), 103: ("Druid", "Feral"), 104: ("Druid", "Guardian"),
    105: ("Druid", "Restoration"),
    250: ("Death Knight", "Blood"), 251: ("Death Knight", "Frost"), 252: ("Death Knight", "Unholy"),
    253: ("Hunter", "Beast Mastery"), 254: ("Hunter", "Marksmanship"), 255: ("Hunter", "Survival"),
    256: ("Priest", "Discipline"), 257: ("Priest", "Holy"), 258: ("Priest", "Shadow"),
    259: ("Rogue", "Assassination"), 260: ("Rogue", "Outlaw"), 261: ("Rogue", "Subtlety"),
    262: ("Shaman", "Elemental"), 263: ("Shaman", "Enhancement"), 264: ("Shaman", "Restoration"),
    265: ("Warlock", "Affliction"), 266: ("Warlock", "Demonology"), 267: ("Warlock", "Destruction"),
    268: ("Monk", "Brewmaster"), 269: ("Monk", "Windwalker"), 270: ("Monk", "Mistweaver"),
    577: ("Demon Hunter", "Havoc"), 581: ("Demon Hunter", "Vengeance"),
    1467: ("Evoker", "Devastation"), 1468: ("Evoker", "Preservation"), 1473: ("Evoker", "Augmentation"),
}
TANK_SPECS = [66, 73, 104, 250, 268, 581]
HEALER_SPECS = [65, 105, 256, 257, 264, 270, 1468, 1473]

# --- fixed values: keystone affix ids ------------------------------------------------------
AFFIXES = {
    2: "Skittish", 3: "Volcanic", 4: "Necrotic", 5: "Teeming", 6: "Raging", 7: "Bolstering",
    8: "Sanguine", 9: "Tyrannical", 10: "Fortified", 11: "Bursting", 12: "Grievous",
    13: "Explosive", 14: "Quaking", 16: "Infested", 117: "Reaping", 119: "Beguiling",
    120: "Awakened", 121: "Prideful", 122: "Inspiring", 123: "Spiteful", 124: "Storming",
    128: "Tormented", 129: "Encrypted", 130: "Shrouded", 131: "Thundering", 134: "Entangling",
    135: "Afflicted", 136: "Incorporeal", 148: "Xal'atath's Bargain: Ascendant",
    158: "Xal'atath's Bargain: Devour", 159: "Xal'atath's Bargain: Voidbound",
    160: "Xal'atath's Bargain: Oblivion",
}

# --- fixed values: spell and aura ids -------------------------------------------------------
MAJOR_COOLDOWNS = {
    2825: "Bloodlust", 6940: "Blessing of Sacrifice", 10060: "Power Infusion", 20484: "Rebirth",
    20707: "Soulstone", 31850: "Ardent Defender", 32182: "Heroism", 33206: "Pain Suppression",
    47788: "Guardian Spirit", 61999: "Raise Ally", 80353: "Time Warp",
    86659: "Guardian of Ancient Kings", 95750: "Intercession", 102342: "Ironbark",
    178207: "Drums of Fury", 230935: "Drums of the Mountain", 256740: "Drums of the Maelstrom",
    264667: "Primal Rage", 361227: "Return", 390386: "Fury of the Aspects",
}
TRACKED_COOLDOWNS = {
    498: "Divine Protection", 642: "Divine Shield", 2825: "Bloodlust", 10060: "Power Infusion",
    31821: "Aura Mastery", 32182: "Heroism", 47536: "Rapture", 64843: "Divine Favor",
    80353: "Time Warp", 90355: "Ancient Hysteria", 264667: "Primal Rage",
}
BLOODLUST = [2825, 32182, 80353, 178207, 230935, 256740, 264667, 390386]
BATTLE_RES = [20484, 20707, 61999, 95750, 361227]
MAJOR_BUFFS = [2825, 10060, 32182, 80353, 90355, 160452, 264667, 390386]
FLASKS = [370652, 370653, 370654, 370655, 371172, 371204, 371339, 371354, 371386,
          431972, 431973, 431974, 431975, 431976, 431977]
FOODS = [104273, 462854, 462855, 462856, 462857]
RUNES = [393438, 452925]

# --- fixed values: equipment slots (shirt and tabard carry no item level) ------------------------
SLOTS = {
    1: "Head", 2: "Neck", 3: "Shoulder", 4: "Shirt", 5: "Chest", 6: "Waist", 7: "Legs", 8: "Feet",
    9: "Wrist", 10: "Hands", 11: "Finger_1", 12: "Finger_2", 13: "Trinket_1", 14: "Trinket_2",
    15: "Back", 16: "Main_Hand", 17: "Off_Hand", 18: "Ranged", 19: "Tabard",
}
COSMETIC_SLOTS = [4, 19]
MAIN_HAND = 16
ENCHANTABLE = ["Main_Hand", "Off_Hand", "Chest", "Legs", "Feet", "Hands", "Wrist", "Back"]
DEFENSIVE_TALENTS = [1000, 2000, 3000]
AOE_TALENTS = [4000, 5000, 6000]

# --- fixed values: event type sets ----------------------------------------------------------------
COMBAT_TYPES = ["UNIT_DIED", "UNIT_DESTROYED", "SPELL_SUMMON", "SPELL_CREATE", "SPELL_INSTAKILL"]
COMBAT_SUFFIXES = ["_DAMAGE", "_HEAL", "_CAST_SUCCESS", "_CAST_START", "_INTERRUPT", "_DISPEL",
                   "_STOLEN", "_AURA_APPLIED", "_AURA_REMOVED", "_AURA_REFRESH"]
IMPORTANCE = {
    "UNIT_DIED": 5, "UNIT_DESTROYED": 5, "ENCOUNTER_START": 5, "ENCOUNTER_END": 5,
    "CHALLENGE_MODE_START": 5, "CHALLENGE_MODE_END": 5, "SPELL_INTERRUPT": 4, "SPELL_DISPEL": 4,
    "SPELL_DAMAGE": 2, "SWING_DAMAGE": 2, "SPELL_HEAL": 2, "SPELL_AURA_APPLIED": 2,
    "SPELL_AURA_REMOVED": 2, "SPELL_CAST_SUCCESS": 1, "SPELL_CAST_START": 1,
}
COOLDOWN_WORDS = ["heroism", "bloodlust", "time warp", "ancient hysteria", "guardian spirit",
                  "divine hymn", "tranquility", "avenging wrath", "metamorphosis", "avatar"]
REGIONS = ["US", "EU", "KR", "CN", "TW"]

# --- fixed values: least number of parameters per event family --------------------------------
# (base parameters, then prefix, then suffix without the optional trailing flags)
BASE_PARAMS = 8
PREFIX_PARAMS = {"SPELL": 3, "RANGE": 3, "ENVIRONMENTAL": 1, "SWING": 0}
SUFFIX_PARAMS = [
    ("_AURA_APPLIED_DOSE", 2), ("_AURA_REMOVED_DOSE", 2), ("_AURA_APPLIED", 1), ("_AURA_REMOVED", 1),
    ("_AURA_REFRESH", 1), ("_CAST_START", 0), ("_CAST_SUCCESS", 0), ("_CAST_FAILED", 1),
    ("_DAMAGE", 6), ("_MISSED", 3), ("_HEAL", 3), ("_ENERGIZE", 4), ("_INTERRUPT", 3),
    ("_DISPEL", 4),
]
SPECIAL_PARAMS = {
    "COMBAT_LOG_VERSION": 4, "ZONE_CHANGE": 3, "MAP_CHANGE": 6, "ENCOUNTER_START": 5,
    "ENCOUNTER_END": 6, "CHALLENGE_MODE_START": 5, "CHALLENGE_MODE_END": 6, "COMBATANT_INFO": 24,
    "PARTY_KILL": 0, "EMOTE": 1,
}
BASE_ONLY = ["UNIT_DIED", "UNIT_DESTROYED", "UNIT_DISSIPATES"]
ADVANCED_BLOCK = 19
ADVANCED_FAMILIES = "DAMAGE|HEAL|ABSORBED|MISSED|ENERGIZE|DRAIN|LEECH"

# --- fixed values: resource kinds --------------------------------------------------------------
POWER_TYPES = {-2: "Health", 0: "Mana", 1: "Rage", 2: "Focus", 3: "Energy", 4: "Combo Points",
               5: "Runes", 6: "Runic Power", 7: "Soul Shards", 8: "Lunar Power", 9: "Holy Power",
               11: "Maelstrom", 12: "Chi", 13: "Insanity", 16: "Arcane Charges", 17: "Fury",
               18: "Pain", 19: "Essence"}
