"""Fixed values of the questionnaire study: code-books, scale items, feature labels.

These must equal the study's own values for right results, so they are stated
plainly, in the study's order.  Each book is data for the generic operators in
``panelstats.operators.codebook``; users may pass their own.
"""

from __future__ import annotations

from ..operators.codebook import OrdinalRule, id_range


def R(lo: int, hi: int, answer: str, score: str) -> OrdinalRule:
    return OrdinalRule(id_range(lo, hi), answer, score)


def R2(a: int, b: int, answer: str, score: str) -> OrdinalRule:
    return OrdinalRule((a, b), answer, score)

# ---------------------------------------------------------------------------
# Ordinal scoring rules (question id range, answer text, score).
# Unmatched answers keep their text.
# ---------------------------------------------------------------------------
ORDINAL_RULES = [
    # city environment, 13-22
    R(13, 22, "Never", "1"),
    R(13, 22, "Rarely", "2"),
    R(13, 22, "Sometimes", "3"),
    R(13, 22, "Often", "4"),
    R(13, 22, "Always", "5"),
    # trait impulsivity at baseline, reversed, 31-35
    R(31, 35, "Rarely /<br>Never", "4"),
    R(31, 35, "Occasionally", "3"),
    R(31, 35, "Often", "2"),
    R(31, 35, "Almost always /<br>Always", "1"),
    # trait impulsivity at baseline, 36-39
    R(36, 39, "Rarely /<br>Never", "1"),
    R(36, 39, "Occasionally", "2"),
    R(36, 39, "Often", "3"),
    R(36, 39, "Almost always /<br>Always", "4"),
    # wellbeing at baseline, 41-54
    R(41, 54, "None of<br>the time", "1"),
    R(41, 54, "Rarely", "2"),
    R(41, 54, "Some of<br>the time", "3"),
    R(41, 54, "Often", "4"),
    R(41, 54, "All of<br>the time", "5"),
    # alcohol, 27
    R(27, 27, "Never", "0"),
    R(27, 27, "Monthly or less", "1"),
    R(27, 27, "2-4 times per month", "2"),
    R(27, 27, "2-3 times per week", "3"),
    R(27, 27, "4+ times per week", "4"),
    # alcohol, 28 and 152, including spreadsheet-mangled dates
    R2(28, 152, "1-2", "0"),
    R2(28, 152, "3-4", "1"),
    R2(28, 152, "5-6", "2"),
    R2(28, 152, "7-9", "3"),
    R2(28, 152, "10+", "4"),
    R2(28, 152, "01-Feb", "0"),
    R2(28, 152, "03-Apr", "1"),
    R2(28, 152, "06-Jun", "2"),
    R2(28, 152, "07-Sep", "3"),
    # alcohol, 29
    R(29, 29, "Never", "0"),
    R(29, 29, "Less than monthly", "1"),
    R(29, 29, "Monthly", "2"),
    R(29, 29, "Weekly", "3"),
    R(29, 29, "Daily or almost daily", "4"),
    # wellbeing, momentary, 131-144
    R(131, 144, "I very much disagree", "1"),
    R(131, 144, "I slightly disagree", "2"),
    R(131, 144, "Not sure", "3"),
    R(131, 144, "I slightly agree", "4"),
    R(131, 144, "I very much agree", "5"),
    # impulsivity, momentary, reversed, 154-158
    R(154, 158, "I very much disagree", "5"),
    R(154, 158, "I slightly disagree", "4"),
    R(154, 158, "Not sure", "3"),
    R(154, 158, "I slightly agree", "2"),
    R(154, 158, "I very much agree", "1"),
    # impulsivity, momentary, 159-162
    R(159, 162, "I very much disagree", "1"),
    R(159, 162, "I slightly disagree", "2"),
    R(159, 162, "Not sure", "3"),
    R(159, 162, "I slightly agree", "4"),
    R(159, 162, "I very much agree", "5"),
]

# Impulsivity-only scoring (31-39) with -1 for anything else.
IMPULSIVITY_RULES = [r for r in ORDINAL_RULES if 31 <= min(r.ids) <= 39]

# ---------------------------------------------------------------------------
# Column labels of the wide table used by the analysis.
# ---------------------------------------------------------------------------
AGE = "001_Age"
GENDER = "002_Gender"
GREW_UP = "003_Where did you grow up"
YEARS_IN_CITY = "004_How many years have you lived in the city"
EDUCATION = "005_What is your level of education"
OCCUPATION = "006_Occupation"
PHYSICAL_HEALTH = "007_How would you rate your physical health overall"
MENTAL_HEALTH = "008_How would you rate your mental health overall"

INDOORS = "104_Are you indoors or outdoors"
TREES_IN = "107_Can you see trees"
SKY_IN = "108_Can you see the sky"
TREES_OUT = "112_Can you see trees"
BIRDS_OUT = "113_Can you hear birds singing"
WATER_OUT = "114_Can you see or hear water"
NATURE_OUT = "121_Do you feel you have any contact with nature in this place"

TREES = "201_Can you see trees"
SKY = "202_Can you see the sky"
BIRDS = "203_Can you hear birds singing"
WATER = "204_Can you see or hear water"
NATURE = "205_Do you feel in contact with nature"

# ---------------------------------------------------------------------------
# Categorical code-books.  Anything else, and null, is -1.
# ---------------------------------------------------------------------------
_HEALTH = {"Very poor": 0, "Poor": 1, "Fair": 2, "Good": 3, "Very good": 4}
BASELINE_BOOKS = {
    GENDER: {"Female": 0, "Male": 1, "Other": 2},
    GREW_UP: {"In the country": 0, "In a village": 0, "In a town": 1, "Multiple places": 2},
    EDUCATION: {"Secondary school": 0, "Training college": 1, "Apprenticeship": 2,
                "University": 3, "Doctoral degree": 4},
    OCCUPATION: {"Student": 0, "Employed": 1, "Self-employed": 2, "Retired": 3, "Unemployed": 4},
    PHYSICAL_HEALTH: _HEALTH,
    MENTAL_HEALTH: _HEALTH,
}

# The older health scale ("Very poor" is not in it).
_OLD_HEALTH = {"Poor": 0, "Fair": 1, "Good": 2, "Very good": 3}
BASELINE_BOOKS_OLD = {**BASELINE_BOOKS, PHYSICAL_HEALTH: _OLD_HEALTH, MENTAL_HEALTH: _OLD_HEALTH}

_YES_NO = {"no": 0, "not sure": 0, "yes": 1}
MOMENTARY_BOOKS = {
    INDOORS: {"Indoors": 0, "Outdoors": 1},
    TREES: _YES_NO,
    SKY: _YES_NO,
    BIRDS: _YES_NO,
    WATER: _YES_NO,
    NATURE: _YES_NO,
}

# ---------------------------------------------------------------------------
# Items of the four composite scores (cleaned labels).
# ---------------------------------------------------------------------------
BASE_WELLBEING_ITEMS = [
    "041_Ive been feeling optimistic about the future",
    "042_Ive been feeling useful",
    "043_Ive been feeling relaxed",
    "044_Ive been feeling interested in other people",
    "045_Ive had energy to spare",
    "046_Ive been dealing with problems well",
    "047_Ive been thinking clearly",
    "048_Ive been feeling good about myself",
    "049_Ive been feeling close to other people",
    "050_Ive been feeling confident",
    "051_Ive been able to make up my own mind about things",
    "052_Ive been feeling loved",
    "053_Ive been interested in new things",
    "054_Ive been feeling cheerful",
]
MOM_WELLBEING_ITEMS = [
    "131_Right now I feel optimistic about the future",
    "132_Right now I feel useful",
    "133_Right now I feel relaxed",
    "134_Right now I feel interested in other people",
    "135_Right now I have energy to spare",
    "136_Right now I deal with problems well",
    "137_Right now I think clearly",
    "138_Right now I feel good about myself",
    "139_Right now I feel close to other people",
    "140_Right now I feel confident",
    "141_Right now I am able to make up my own mind about things",
    "142_Right now I feel loved",
    "143_Right now I am interested in new things",
    "144_Right now I feel cheerful",
]
BASE_IMPULSE_ITEMS = [
    "031_I am focused seeing things through to the end",
    "032_I plan work tasks and activities in my free time carefully",
    "033_I plan events and activities well ahead of time",
    "034_I think carefully before doing and saying things",
    "035_I find it easy to exercise self-control",
    "036_I encounter problems because I do things without stopping to think",
    "037_I become involved with things that I later wish I could get out of",
    "038_I tend to jump from one interest to another",
    "039_I tend to act on impulse",
]
MOM_IMPULSE_ITEMS = [
    "154_Today I was focused seeing things through to the end",
    "155_Today I planned work tasks and activities in my free time carefully",
    "156_Today I planned events and activities well ahead of time",
    "157_Today I thought carefully before doing and saying things",
    "158_Today I found it easy to exercise self-control",
    "159_Today I encountered problems because I do things without stopping to think",
    "160_Today I became involved with things that I later wish I could get out of",
    "161_Today I jumped from one interest to another",
    "162_Today I acted on impulse",
]

COMPOSITES = {
    "baseWellBeingScore": BASE_WELLBEING_ITEMS,
    "momWellBeingScore": MOM_WELLBEING_ITEMS,
    "baseImpulseScore": BASE_IMPULSE_ITEMS,
    "momImpulseScore": MOM_IMPULSE_ITEMS,
}

# Regression features of the model job (label momWellBeingScore).
REGRESSION_FEATURES = [
    "baseWellBeingScore",
    MENTAL_HEALTH + "_numeric",
    INDOORS + "_numeric",
    TREES + "_numeric",
    SKY + "_numeric",
    BIRDS + "_numeric",
    WATER + "_numeric",
    NATURE + "_numeric",
    "impulseInt1",
    "impulseInt2",
    "impulseInt3",
    "impulseInt4",
    "impulseInt5",
]
