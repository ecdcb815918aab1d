"""The questionnaire study's jobs (E1-E5) as registered queries on the driver's tables.

The study's answers are private, so they are derived: every customer is a participant who
answers the baseline questions, every order is a momentary assessment of its customer.  An
answer is picked among its question's options by a hash of (customer or order, question), so
the whole study code-book, the composite items and the place questions are exercised, and
every query grows with the tables.  Missing answers, answers given twice (the earlier one
counts), date-mangled answers and game questions occur.

``ORACLE_SQL`` computes the same from the same tables in plain SQL: its answers come from the
same question list, its scores from the same rules, which are data here as there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import col, handover, r_name
from . import codebooks as cb
from . import questionnaire as q
from .catalog import _model_columns, _sql_model, _sql_models

#: Participants with more than so many assessments stay (the tables hold fewer than the study's 25).
MIN_ASSESSMENTS = 8

_AGREE = ["I very much disagree", "I slightly disagree", "Not sure", "I slightly agree", "I very much agree"]
_RARELY = ["None of<br>the time", "Rarely", "Some of<br>the time", "Often", "All of<br>the time"]
_OFTEN = ["Rarely /<br>Never", "Occasionally", "Often", "Almost always /<br>Always"]
_SEEN = ["yes", "no", "not sure"]


def _question(label: str, options: list, place: str | None = None) -> dict:
    """A question as the app stores it: id, text with apostrophes and final punctuation, options."""
    number, text = label.split("_", 1)
    text = text.replace("Ive ", "I've ") + ("?" if text.startswith(("Can", "Are", "Do", "How", "What", "Where")) else ".")
    return {"id": int(number), "text": text, "options": [str(o) for o in options], "place": place}


BASELINE_QUESTIONS = [
    _question(cb.AGE, range(18, 70)), _question(cb.GENDER, [*cb.BASELINE_BOOKS[cb.GENDER], "Prefer not to say"]),
    _question(cb.GREW_UP, list(cb.BASELINE_BOOKS[cb.GREW_UP])), _question(cb.YEARS_IN_CITY, range(0, 40)),
    _question(cb.EDUCATION, list(cb.BASELINE_BOOKS[cb.EDUCATION])), _question(cb.OCCUPATION, list(cb.BASELINE_BOOKS[cb.OCCUPATION])),
    _question(cb.PHYSICAL_HEALTH, list(cb.BASELINE_BOOKS[cb.PHYSICAL_HEALTH])),
    _question(cb.MENTAL_HEALTH, list(cb.BASELINE_BOOKS[cb.MENTAL_HEALTH])),
    *(_question(c, _RARELY) for c in cb.BASE_WELLBEING_ITEMS), *(_question(c, _OFTEN) for c in cb.BASE_IMPULSE_ITEMS),
    _question("027_How often do you drink", ["Never", "Monthly or less", "2-3 times per week"]),
    _question("028_How many drinks", ["1-2", "01-Feb", "05-Jun", "10+"]),
]
MOMENTARY_QUESTIONS = [
    _question(cb.INDOORS, list(cb.MOMENTARY_BOOKS[cb.INDOORS])),
    _question(cb.TREES_IN, _SEEN, "Indoors"), _question(cb.SKY_IN, _SEEN, "Indoors"),
    _question(cb.TREES_OUT, _SEEN, "Outdoors"), _question(cb.BIRDS_OUT, _SEEN, "Outdoors"),
    _question(cb.WATER_OUT, _SEEN, "Outdoors"), _question(cb.NATURE_OUT, _SEEN, "Outdoors"),
    *(_question(c, _AGREE) for c in cb.MOM_WELLBEING_ITEMS + cb.MOM_IMPULSE_ITEMS),
    _question("2001_Game score", range(0, 30)),
]
_PLACE_QUESTION = int(cb.INDOORS.split("_", 1)[0])
#: Question whose answer is given twice, and one that some leave out (of every so many).
_TWICE, _LEFT_OUT, _LEFT_OUT_OF = 132, 131, 17


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long answers with the study's nine columns."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    drawn = lambda text: F.conv(F.substring(F.md5(F.concat("key_text", text)), 1, 8), 16, 10).cast("bigint")
    # a question as often as it is answered, with the text that its answer is drawn by
    given = lambda x: [x | {"later": later, "by": f":{x['id']}{extra}"}
                       for later, extra in enumerate(["", "again"] if x["id"] == _TWICE else [""])]
    asked = lambda questions: F.explode(F.from_json(
        F.lit(json.dumps([y for x in questions for y in given(x)])),
        "array<struct<id:int,text:string,options:array<string>,place:string,later:int,by:string>>")).alias("q")

    def rows(people: DataFrame, questions: list[dict]) -> DataFrame:
        """A row per answer; what holds for all answers of a row of ``people`` is found before they are asked."""
        people = people.withColumn("key_text", F.col("key").cast("string"))
        people = people.select("key_text", (drawn(F.lit(f":{_PLACE_QUESTION}")) % 2).cast("int").alias("place"),
                               (drawn(F.lit(":0")) % _LEFT_OUT_OF).alias("left_out"),
                               F.concat(F.lit("P"), "who").alias("participantUUID"), F.col("number").alias("assessmentNumber"),
                               F.when(F.col("number") % 5 != 0, F.lit("51.5,-0.2")).alias("geotagEnd"),
                               F.array("at", F.col("at") + F.make_dt_interval(hours=F.lit(1))).alias("times"))
        place = F.get(F.array(*[F.lit(o) for o in cb.MOMENTARY_BOOKS[cb.INDOORS]]), F.col("place"))
        out = people.select("*", asked(questions)).where(F.col("q.place").isNull() | (F.col("q.place") == place))
        out = out.where((F.col("q.id") != _LEFT_OUT) | (F.col("left_out") != 0))
        text = F.get("q.options", (drawn(F.col("q.by")) % F.size("q.options")).cast("int"))
        return out.select(
            "participantUUID", "assessmentNumber", F.lit("51.5,-0.1").alias("geotagStart"), "geotagEnd", F.col("q.id").alias("QuestionId"), F.col("q.text").alias("Question"), text.alias("AnswerText"),
            F.lit("None").alias("AnswerValue"), F.get("times", F.col("q.later")).alias("TimeAnswered"))

    base = read("customer").select(F.col("c_custkey").alias("who"), F.lit(0).alias("number"), F.col("c_custkey").alias("key"),
                                   F.lit("2017-03-01 08:00:00").cast("timestamp").alias("at"))
    moments = read("orders").select(F.col("o_custkey").alias("who"), (F.col("o_orderkey") + 1).cast("int").alias("number"),
                                    F.col("o_orderkey").alias("key"), F.to_timestamp(F.to_date("o_orderdate")).alias("at"))
    return rows(base, BASELINE_QUESTIONS).unionByName(rows(moments, MOMENTARY_QUESTIONS))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.wrangle(answers(spark, sf_dir), MIN_ASSESSMENTS, sort=False)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.analysis_table(handover(wide(spark, sf_dir), "study_wide"))


# -- SQL twins ------------------------------------------------------------------

def _text(v: object) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _name(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def _values(questions: list[dict], base: bool) -> list[str]:
    return [f"({base}, {x['id']}, {_text(x['text'])}, [{', '.join(map(_text, x['options']))}], {_text(x['place'])})" for x in questions]


def _drawn(question: str, extra: str = "") -> str:
    return f"('0x' || substr(md5(CAST(key AS VARCHAR) || ':' || {question} || '{extra}'), 1, 8))::BIGINT"


_LABELS = sorted({f"{x['id']:03d}_" + x["text"].translate(str.maketrans("", "", "'?,:."))
                  for x in BASELINE_QUESTIONS + MOMENTARY_QUESTIONS if x["id"] < 2000}, key=str.encode)


def _sql_wide() -> str:
    """CTEs ending in ``wide``."""
    rules = ", ".join(f"({min(r.ids)}, {max(r.ids)}, {_text(r.answer)}, {_text(r.score)})" if len(r.ids) == max(r.ids) - min(r.ids) + 1
                      else ", ".join(f"({i}, {i}, {_text(r.answer)}, {_text(r.score)})" for i in r.ids) for r in cb.ORDINAL_RULES)
    places = "[" + ", ".join(map(_text, cb.MOMENTARY_BOOKS[cb.INDOORS])) + "]"
    columns = ", ".join(f"arg_min_null(score, nth) FILTER (WHERE label = {_text(c)}) AS {_name(c)}" for c in _LABELS)
    sums = ", ".join(f"{' + '.join(f'TRY_CAST({_name(c)} AS DOUBLE)' for c in items)} AS {_name(s)}" for s, items in cb.COMPOSITES.items())
    return f"""questions(base, id, question, options, place) AS (VALUES {', '.join(_values(BASELINE_QUESTIONS, True) + _values(MOMENTARY_QUESTIONS, False))}),
rules(lo, hi, answer, score) AS (VALUES {rules}),
asked AS (SELECT c_custkey AS who, 0 AS number, c_custkey AS key, 0 AS later, id, question, options, place FROM customer, questions WHERE base
  UNION ALL SELECT o_custkey, CAST(o_orderkey + 1 AS INTEGER), o_orderkey, later, id, question, options, place
  FROM orders, questions, (VALUES (0), (1)) l(later) WHERE NOT base AND (later = 0 OR id = {_TWICE})),
given AS (SELECT who, number, id, later AS nth, regexp_replace(printf('%03d', id) || '_' || question, '[''?,:.]', '', 'g') AS label,
    options[CASE later WHEN 0 THEN {_drawn('id')} ELSE {_drawn('id', 'again')} END % len(options) + 1] AS answer
  FROM asked WHERE id < 2000 AND (place IS NULL OR place = {places}[{_drawn(str(_PLACE_QUESTION))} % 2 + 1])
    AND (id <> {_LEFT_OUT} OR {_drawn('0')} % {_LEFT_OUT_OF} <> 0)),
scored AS (SELECT 'P' || who AS participantUUID, number AS assessmentNumber, '51.5,-0.1' AS geotagStart,
    CASE WHEN number % 5 <> 0 THEN '51.5,-0.2' END AS geotagEnd, label, nth, coalesce(r.score, given.answer) AS score
  FROM given LEFT JOIN rules r ON id BETWEEN lo AND hi AND given.answer = r.answer),
kept AS (SELECT participantUUID FROM scored GROUP BY 1 HAVING count(DISTINCT assessmentNumber) > {MIN_ASSESSMENTS}),
cells AS (SELECT participantUUID, assessmentNumber, geotagStart, geotagEnd, {columns} FROM scored
  WHERE participantUUID IN (SELECT participantUUID FROM kept) GROUP BY ALL),
wide AS (SELECT *, {sums} FROM cells)"""


def _coded(c: str, book: dict[str, int], source: str) -> str:
    return f"CASE {source} " + " ".join(f"WHEN {_text(a)} THEN {n}" for a, n in book.items()) + f" ELSE -1 END AS {_name(c + '_numeric')}"


def _sql_analysis() -> str:
    """CTEs ending in ``analysis``: one row per momentary assessment with its participant's baseline."""
    combined = {
        cb.TREES: f"coalesce({_name(cb.TREES_IN)}, {_name(cb.TREES_OUT)})", cb.SKY: f"coalesce({_name(cb.SKY_IN)}, 'NA')",
        cb.BIRDS: f"coalesce({_name(cb.BIRDS_OUT)}, 'NA')", cb.WATER: f"coalesce({_name(cb.WATER_OUT)}, 'NA')",
        cb.NATURE: f"coalesce({_name(cb.NATURE_OUT)}, 'NA')"}
    confounders = [cb.AGE, cb.GENDER, cb.GREW_UP, cb.YEARS_IN_CITY, cb.EDUCATION, cb.OCCUPATION, cb.PHYSICAL_HEALTH, cb.MENTAL_HEALTH]
    mom = ", ".join([_name(cb.INDOORS), *(f"{e} AS {_name(c)}" for c, e in combined.items()),
                     *(_coded(c, book, combined.get(c, _name(c))) for c, book in cb.MOMENTARY_BOOKS.items())])
    base = ", ".join([*map(_name, confounders), *(_coded(c, book, _name(c)) for c, book in cb.BASELINE_BOOKS.items())])
    return _sql_wide() + f""",
mom AS (SELECT participantUUID AS momParticipantUUID, assessmentNumber AS momAssessmentNumber, geotagStart AS momGeoTagStart,
    geotagEnd AS momGeoTagEnd, momWellBeingScore, {mom} FROM wide WHERE assessmentNumber > 0),
base AS (SELECT participantUUID, baseWellBeingScore, baseImpulseScore, {base} FROM wide WHERE assessmentNumber = 0),
analysis AS (SELECT * FROM mom JOIN base ON momParticipantUUID = participantUUID)"""


# -- the queries ------------------------------------------------------------------

def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """The descriptive report as one table of (statistic, question, answer, value)."""
    text = lambda v: F.lit(v).cast("string")

    def row(name, question, answer, value):
        return [F.lit(name).alias("statistic"), question.alias("question"), answer.alias("answer"), F.round(value.cast("double"), 6).alias("value")]

    one = lambda name: report[name].select(*row(name, text(None), text(None), F.col(report[name].columns[0])))
    spread = lambda name, keep: report[name].select(*keep, F.posexplode(F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).alias("v"))
                                                                                 for c in report[name].columns if c.startswith("n_")])))
    parts = [one("participants"), one("mean_momWellBeingScore"), one("mean_assessments"),
             report["per_answer"].select(*row("per_answer", F.col("question"), F.col("answer"), F.col("n_participants"))),
             report["mean_of_distinct"].select(*row("mean_of_distinct", F.col("question"), text(None), F.col("mean"))),
             spread("place_counts", []).select(*row("place_counts", text(None), F.col("col.n"), F.col("col.v"))),
             spread("answer_tally", ["question"]).select(*row("answer_tally", F.col("question"), F.col("col.n"), F.col("col.v")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql_report() -> str:
    row = lambda name, question, answer, value, tail="": (
        f"SELECT '{name}' AS statistic, {question} AS question, {answer} AS answer, round(CAST({value} AS DOUBLE), 6) AS value FROM {tail or 'analysis'}")
    who, none = "momParticipantUUID", "CAST(NULL AS VARCHAR)"
    parts = [row("participants", none, none, f"count(DISTINCT {who})"), row("mean_momWellBeingScore", none, none, "avg(momWellBeingScore)"),
             row("mean_assessments", none, none, "avg(n)", f"(SELECT count(DISTINCT momAssessmentNumber) AS n FROM analysis GROUP BY {who})")]
    for c in [cb.GENDER, cb.GREW_UP, cb.OCCUPATION, cb.EDUCATION, cb.PHYSICAL_HEALTH, cb.MENTAL_HEALTH]:
        parts.append(row("per_answer", _text(c), "a", "count(a)", f"(SELECT DISTINCT {who}, {_name(c)} AS a FROM analysis) GROUP BY a"))
    for c in [cb.AGE, "baseWellBeingScore", "baseImpulseScore"]:
        parts.append(row("mean_of_distinct", _text(c), none, "avg(v)", f"(SELECT DISTINCT {who}, TRY_CAST({_name(c)} AS DOUBLE) AS v FROM analysis)"))
    for n, v in {"n_indoors": "Indoors", "n_outdoors": "Outdoors", "n_na": "NA"}.items():
        parts.append(row("place_counts", none, f"'{n}'", f"count(*) FILTER (WHERE {_name(cb.INDOORS)} = '{v}')"))
    for c in [cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE]:
        for n, v in {"n_yes": "yes", "n_no": "no", "n_not_sure": "not sure", "n_na": "NA"}.items():
            parts.append(row("answer_tally", _text(c), f"'{n}'", f"count(*) FILTER (WHERE {_name(c)} = '{v}')"))
        parts.append(row("answer_tally", _text(c), "'n_total'", "count(*)"))
    return f"WITH {_sql_analysis()}\n" + "\nUNION ALL ".join(parts)


def study_wide(spark, sf_dir):
    """Raw answers to the wide assessment table with composite scores, the whole code-book."""
    return wide(spark, sf_dir)


def study_analysis(spark, sf_dir):
    """Momentary rows with combined place features, codes, and the participant's baseline (34 columns)."""
    return analysis(spark, sf_dir)


def study_report(spark, sf_dir):
    """The descriptive report of the analysis table as one long table."""
    return report_rows(q.describe_report(handover(analysis(spark, sf_dir), "study_analysis")))


# -- E4: the regression job ---------------------------------------------------------

_LABEL = "momWellBeingScore"
_KEY = ["momParticipantUUID", "momAssessmentNumber", "momGeoTagStart", "momGeoTagEnd"]


def study_regression(spark, sf_dir):
    """Fit on the train half, coefficients and the metrics of both halves as (part, name, value)."""
    found = q.regression_job(handover(analysis(spark, sf_dir), "study_analysis"))
    parts = [found["coefficients"].select(F.lit("coefficients").alias("part"), F.col("term").alias("name"), F.round("estimate", 3).alias("value"))]
    for part in ("train_metrics", "test_metrics"):
        m = found[part]
        items = F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 4).alias("value")) for c in m.columns])
        parts.append(m.select(F.lit(part).alias("part"), F.inline(items)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sql_regression() -> str:
    products = dict(zip(["impulseInt1", "impulseInt2", "impulseInt3", "impulseInt4", "impulseInt5"], [cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE]))
    columns = {f: f"baseImpulseScore * {_name(products[f] + '_numeric')}" if f in products else _name(f) for f in cb.REGRESSION_FEATURES}
    # concat_ws leaves nulls out, as there
    key = "md5(concat_ws('|', " + ", ".join(_KEY) + ") || ':123')"
    halves = f"""halves AS (SELECT {', '.join(f'CAST({e} AS DOUBLE) AS f{i}' for i, e in enumerate(columns.values(), 1))}, {_LABEL} AS y,
    ('0x' || substr({key}, 1, 8))::BIGINT < 2147483648 AS train FROM analysis WHERE {_LABEL} IS NOT NULL)"""
    ctes, _ = _sql_model("job", "(SELECT * FROM halves WHERE train)", "y", {c: f"f{i}" for i, c in enumerate(columns, 1)}, "e")
    k = len(columns)
    fitted = f"fitted AS (SELECT {', '.join(f'max(est) FILTER (WHERE i = {i}) AS b{i}' for i in range(1, k + 2))} FROM ef)"
    errors = f"errors AS (SELECT train, y, y - (b{k + 1} + {' + '.join(f'b{i} * f{i}' for i in range(1, k + 1))}) AS e FROM halves, fitted)"
    metrics = {"n": "count(e)", "rmse": "sqrt(avg(e * e))", "mse": "avg(e * e)", "mae": "avg(abs(e))", "r2": "1 - sum(e * e) / (var_pop(y) * count(e))"}
    parts = ["SELECT 'coefficients' AS part, term AS name, round(est, 3) AS value FROM ef JOIN enames USING (i)"]
    parts += [f"SELECT '{part}', '{n}', round(CAST({e} AS DOUBLE), 4) FROM errors WHERE e IS NOT NULL AND train = {train}"
              for part, train in (("train_metrics", "true"), ("test_metrics", "false")) for n, e in metrics.items()]
    return f"WITH {_sql_analysis()},\n{halves}, {ctes}, {fitted}, {errors}\n" + "\nUNION ALL ".join(parts)


# -- E5: the association analyses -----------------------------------------------------

#: The parts of the association report that study_models does not give.
_ASSOCIATIONS = ("gamma", "gamma_interval", "pearson", "describe", "mean_assessments", "occupations")
_INTERVAL = (cb.GENDER, cb.OCCUPATION)
_PEARSON = {"base_wellbeing_age": ("baseWellBeingScore", cb.AGE), "base_wellbeing_gender": ("baseWellBeingScore", cb.GENDER + "_numeric")}
_DESCRIBED = [cb.AGE, "baseWellBeingScore", _LABEL, "baseImpulseScore"]


def study_gamma(spark, sf_dir):
    """Gamma of every pair of the study's columns, the one with an interval, and the
    correlations, descriptions and counts of the association report as (part, x, y, ..., value)."""
    found = q.association_report(handover(analysis(spark, sf_dir), "study_analysis"), only=_ASSOCIATIONS)
    columns = ["x", "y", "n_obs", "n_concordant", "n_discordant", "gamma", "ase", "lower", "upper", "value"]
    text = ("x", "y")

    def part(name: str, df: DataFrame, **own) -> DataFrame:
        one = lambda c: (own[c] if c in own else F.lit(None)).cast("string" if c in text else "double").alias(c)
        return df.select(F.lit(name).alias("part"), *map(one, columns))

    def listed(df: DataFrame, items: list[tuple]) -> DataFrame:
        """A row (x, y, n, value) per item of a table of one row."""
        return df.select(F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), col(n).cast("double").alias("n"),
                                                     F.round(col(v), 6).alias("v")) for x, y, n, v in items])))

    def gamma(name: str, rounded: tuple) -> DataFrame:
        return part(name, found[name], **{c: F.col(c) for c in ("x", "y", "n_obs", "n_concordant", "n_discordant")},
                    **{c: F.round(c, 6) for c in rounded})

    figures = lambda name, items: part(name, listed(found[name], items), x=F.col("x"), y=F.col("y"), n_obs=F.col("n"), value=F.col("v"))
    parts = [gamma("gamma", ("gamma",)), gamma("gamma_interval", ("gamma", "ase", "lower", "upper")),
             figures("pearson", [(*pair, f"n_{n}", f"r_{n}") for n, pair in _PEARSON.items()]),
             figures("describe", [(c, v, f"n_{c}", f"{v}_{c}") for c in _DESCRIBED for v in ("mean", "sd")]),
             part("mean_assessments", found["mean_assessments"], value=F.round("mean_assessments", 6)),
             part("occupations", found["occupations"], x=F.col("momParticipantUUID"), value=col(f"n_{cb.OCCUPATION}"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql_study_gamma() -> str:
    pairs = [(x, y) for x in q.GAMMA_ROWS for y in q.GAMMA_COLUMNS]
    cells = " UNION ALL ".join(
        f"SELECT {i} AS pair, dense_rank() OVER (ORDER BY x) AS x, dense_rank() OVER (ORDER BY y) AS y, n FROM (SELECT {_name(x)} AS x, "
        f"{_name(y + ' ') if x == y else _name(y)} AS y, count(*)::DOUBLE AS n FROM twins WHERE {_name(x)} IS NOT NULL AND {_name(y)} IS NOT NULL GROUP BY 1, 2)"
        for i, (x, y) in enumerate(pairs))
    again = ", ".join(f"{_name(x)} AS {_name(x + ' ')}" for x in q.GAMMA_ROWS)
    names = ", ".join(f"({i}, {_text(x)}, {_text(y)})" for i, (x, y) in enumerate(pairs))
    number = lambda c: f"TRY_CAST({_name(c)} AS DOUBLE)"
    row = lambda part, x, y, n, value, tail="": (
        f"SELECT '{part}', {x}, {y}, CAST({n} AS DOUBLE), NULL, NULL, NULL, NULL, NULL, NULL, round(CAST({value} AS DOUBLE), 6) FROM {tail or 'analysis'}")
    rows = [row("pearson", _text(x), _text(y), f"count(*) FILTER (WHERE {number(x)} IS NOT NULL AND {number(y)} IS NOT NULL)",
                f"corr({number(x)}, {number(y)})") for x, y in _PEARSON.values()]
    rows += [row("describe", _text(c), f"'{v}'", f"count({number(c)})", f"{f}({number(c)})") for c in _DESCRIBED for v, f in (("mean", "avg"), ("sd", "stddev_samp"))]
    rows.append(row("mean_assessments", "NULL", "NULL", "NULL", "avg(n)", "(SELECT count(DISTINCT momAssessmentNumber) AS n FROM analysis GROUP BY momParticipantUUID)"))
    rows.append(row("occupations", "momParticipantUUID", "NULL", "NULL", f"count(DISTINCT {_name(cb.OCCUPATION)})", "analysis GROUP BY momParticipantUUID"))
    return f"""WITH {_sql_analysis()},
twins AS (SELECT *, {again} FROM analysis), t AS ({cells}), names(pair, x, y) AS (VALUES {names}),
p AS (SELECT a.pair, coalesce(sum(CASE WHEN a.y < b.y THEN a.n * b.n END), 0) AS c, coalesce(sum(CASE WHEN a.y > b.y THEN a.n * b.n END), 0) AS d
      FROM t a JOIN t b ON a.pair = b.pair AND a.x < b.x GROUP BY a.pair),
u AS (SELECT x, y, n FROM t WHERE pair = {pairs.index(_INTERVAL)}),
m AS (SELECT a.x, a.y, a.n, coalesce(sum(CASE WHEN (b.x > a.x) = (b.y > a.y) THEN b.n END), 0) AS ca, coalesce(sum(CASE WHEN (b.x > a.x) <> (b.y > a.y) THEN b.n END), 0) AS da
      FROM u a LEFT JOIN u b ON a.x <> b.x AND a.y <> b.y GROUP BY a.x, a.y, a.n),
s AS (SELECT sum(n * ca) AS P, sum(n * da) AS Q, sum(n) AS n_obs FROM m),
e AS (SELECT P, Q, s.n_obs, CASE WHEN P + Q > 0 THEN (P - Q) / (P + Q) END AS g,
        CASE WHEN P + Q > 0 THEN 4.0 / ((P + Q) * (P + Q)) * sqrt(sum(n * pow(Q * ca - P * da, 2))) END AS ase FROM m, s GROUP BY P, Q, s.n_obs)
SELECT 'gamma' AS part, names.x, names.y, n_obs, coalesce(c, 0) AS n_concordant, coalesce(d, 0) AS n_discordant,
       CASE WHEN c + d > 0 THEN round((c - d) / (c + d), 6) END AS gamma, NULL::DOUBLE AS ase, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::DOUBLE AS value
FROM (SELECT pair, sum(n) AS n_obs FROM t GROUP BY pair) o JOIN names USING (pair) LEFT JOIN p USING (pair)
UNION ALL SELECT 'gamma_interval', {_text(_INTERVAL[0])}, {_text(_INTERVAL[1])}, n_obs, P / 2, Q / 2, round(g, 6), round(ase, 6),
       round(g - 1.959963984540054 * ase, 6), round(g + 1.959963984540054 * ase, 6), NULL FROM e
UNION ALL """ + "\nUNION ALL ".join(rows)


def study_models(spark, sf_dir):
    """The adjusted OLS model and the interaction models with inference."""
    found = q.association_report(handover(analysis(spark, sf_dir), "study_analysis"), only=("ols", "interaction_models"))
    return _model_columns(found["ols"].unionByName(found["interaction_models"]))


def _sql_study_models() -> str:
    number = lambda c: f"TRY_CAST({_name(c)} AS DOUBLE)"
    coded = [c + "_numeric" for c in [cb.GENDER, cb.GREW_UP, cb.EDUCATION, cb.OCCUPATION, cb.PHYSICAL_HEALTH, cb.MENTAL_HEALTH]]
    place = [c + "_numeric" for c in [cb.TREES, cb.SKY, cb.BIRDS, cb.WATER, cb.NATURE]]
    outdoors = {r_name(cb.INDOORS) + "_Outdoors": f"({_name(cb.INDOORS)} = 'Outdoors')::INT"}
    plain = lambda names: {r_name(c): number(c) for c in names}
    terms = ["baseWellBeingScore", cb.AGE, *coded, cb.INDOORS, *place]
    models = {f"{_LABEL} ~ {' + '.join(map(r_name, terms))}": plain(["baseWellBeingScore", cb.AGE, *coded]) | outdoors | plain(place)}
    covariates = plain(["baseWellBeingScore", cb.AGE, cb.GENDER + "_numeric", cb.OCCUPATION + "_numeric"])
    models[r_name(cb.INDOORS)] = covariates | {f"baseImpulseScore:{r_name(cb.INDOORS)}_{v}": f"baseImpulseScore * ({_name(cb.INDOORS)} = '{v}')::INT"
                                               for v in ("Outdoors", "Indoors")}
    for c in place:
        models[r_name(c)] = covariates | {f"baseImpulseScore:{r_name(c)}": f"baseImpulseScore * {_name(c)}"}
    return _sql_models(models, "analysis", _LABEL, f"WITH {_sql_analysis()}")


QUERIES = {f.__name__: f for f in (study_wide, study_analysis, study_report, study_regression, study_gamma, study_models)}
ORACLE_SQL = {
    "study_wide": f"WITH {_sql_wide()}\nSELECT * FROM wide",
    "study_analysis": f"WITH {_sql_analysis()}\nSELECT * FROM analysis",
    "study_report": _sql_report(),
    "study_regression": _sql_regression(),
    "study_gamma": _sql_study_gamma(),
    "study_models": _sql_study_models(),
}
