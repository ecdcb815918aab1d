"""Hand-built questionnaire answers (long form) for the end-to-end tests.

Participants ``P1_1`` (27 assessments), ``P2_2`` (26) and ``P3_3`` (25, dropped by
the > 25 rule); ``P4_4`` has no baseline and ``P5_5`` no momentary rows.
Answers are chosen so that every composite item and categorical column exists.
"""

from __future__ import annotations

import datetime as dt
import random

from panelstats.plans import codebooks as cb
from panelstats.sources.io import ANSWERS_SCHEMA


def raw_text(label: str) -> str:
    """The question text as the app stores it: apostrophes and final punctuation."""
    text = label.split("_", 1)[1].replace("Ive ", "I've ")
    return text + ("?" if text.startswith(("Can", "Are", "Do", "How", "What", "Where")) else ".")


BASE_ANSWERS = {
    cb.AGE: ["25", "31", "47"],
    cb.GENDER: ["Female", "Male", "Other", "Prefer not to say"],
    cb.GREW_UP: ["In the country", "In a village", "In a town", "Multiple places"],
    cb.YEARS_IN_CITY: ["3", "10", "22"],
    cb.EDUCATION: ["Secondary school", "University", "Doctoral degree"],
    cb.OCCUPATION: ["Student", "Employed", "Retired"],
    cb.PHYSICAL_HEALTH: ["Very poor", "Fair", "Good", "Very good"],
    cb.MENTAL_HEALTH: ["Poor", "Fair", "Good"],
}
WB_BASE = ["None of<br>the time", "Rarely", "Some of<br>the time", "Often", "All of<br>the time"]
IMP_BASE = ["Rarely /<br>Never", "Occasionally", "Often", "Almost always /<br>Always"]
AGREE = ["I very much disagree", "I slightly disagree", "Not sure", "I slightly agree", "I very much agree"]
YES_NO = ["yes", "no", "not sure"]


def _qid(label: str) -> int:
    return int(label.split("_", 1)[0])


def answer_rows(seed: int = 7):
    rnd = random.Random(seed)
    t0 = dt.datetime(2017, 3, 1, 8, 0, 0)
    rows = []

    def add(p, a, label, text, value=None, geo=("51.5,-0.1", "51.5,-0.1"), minute=0):
        rows.append((p, a, geo[0], geo[1], _qid(label), raw_text(label), text,
                     value if value is not None else "None", t0 + dt.timedelta(days=a, minutes=minute)))

    participants = {"P1_1": 27, "P2_2": 26, "P3_3": 25, "P4_4": 27, "P5_5": 27,
                    **{f"P{i}_{i}": 26 + i % 3 for i in range(6, 14)}}
    for p, n in participants.items():
        for a in range(n):
            if a == 0 and p == "P4_4":
                continue
            if a > 0 and p == "P5_5":
                continue
            if a == 0:
                for label, choices in BASE_ANSWERS.items():
                    text = rnd.choice(choices)
                    add(p, a, label, text, value=text if text.isdigit() else None)
                for label in cb.BASE_WELLBEING_ITEMS:
                    add(p, a, label, rnd.choice(WB_BASE))
                for label in cb.BASE_IMPULSE_ITEMS:
                    add(p, a, label, rnd.choice(IMP_BASE))
                add(p, a, "028_How many drinks", rnd.choice(["1-2", "01-Feb", "05-Jun"]))
            else:
                indoors = rnd.random() < 0.6
                add(p, a, cb.INDOORS, "Indoors" if indoors else "Outdoors")
                if indoors:
                    add(p, a, cb.TREES_IN, rnd.choice(YES_NO))
                    add(p, a, cb.SKY_IN, rnd.choice(YES_NO))
                else:
                    add(p, a, cb.TREES_OUT, rnd.choice(YES_NO))
                    add(p, a, cb.BIRDS_OUT, rnd.choice(YES_NO))
                    add(p, a, cb.WATER_OUT, rnd.choice(YES_NO))
                    add(p, a, cb.NATURE_OUT, rnd.choice(YES_NO))
                for label in cb.MOM_WELLBEING_ITEMS + cb.MOM_IMPULSE_ITEMS:
                    if not (p == "P2_2" and a == 3 and label == cb.MOM_WELLBEING_ITEMS[0]):
                        add(p, a, label, rnd.choice(AGREE))
                # a game question, dropped
                rows.append((p, a, None, None, 2001, "Game score.", None, "17", t0))
    return rows


def answers_frame(spark, seed: int = 7):
    return spark.createDataFrame(answer_rows(seed), ANSWERS_SCHEMA)
