"""Explicit schemas of the domain relations, and their data-quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTEMPT = "id long, bank_id long, question_id long, question_key string, selected_keys string, is_correct boolean, self_grade string, self_score double, user_answer string, seconds long, session_id long, answered_at timestamp_ntz"
QUESTION = "id long, external_id string, question_number int, question_type string, content string, options array<struct<key:string,text:string>>, answer_keys string, answer_text string, analysis string, category string, topic string, volume int, score double, bank_id long, material_id long, favorite boolean, deleted boolean"
BANK = "id long, name string, description string, package_key string, version string, schema_version int, checksum string, parent_key string, sources array<string>, review_enabled boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
REVIEW_STATE = "question_id long, bank_id long, level int, interval_days int, due_at timestamp_ntz, suspended boolean"
QUESTION_SKILL = "question_id long, bank_id long, node_id string, template_id string, source string, confidence double, confirmed boolean, origin string, shadowed boolean, updated_at timestamp_ntz"
PACKAGE = "schemaVersion int, packageKey string, title string, version string, description string, questions array<struct<questionKey:string,volume:int,type:string,content:string,options:array<struct<key:string,text:string>>,answerKeys:string,answerText:string,analysis:string,topic:string,category:string,score:double,materialKey:string>>, materials array<struct<materialKey:string,content:string>>, images map<string,string>"
RECORD_FILE = "schemaVersion int, exportedAt string, records array<struct<packageKey:string,packageVersion:string,questionKey:string,selectedKeys:string,isCorrect:boolean,userAnswer:string,selfGrade:string,answeredAt:timestamp_ntz>>"
TEMPLATE = "templateId string, name string, version string, stages array<struct<id:string,name:string,nodes:array<struct<id:string,name:string,level:int,weight:double,prereq:array<string>,keywords:array<string>>>>>"

#: Longest texts that a contract allows (fixed values).
LIMITS = {"title": 120, "description": 2000, "source": 500, "key": 100, "version": 40, "answer_text": 2000}
QUESTION_TYPES = ("SINGLE", "MULTIPLE", "JUDGE", "SUBJECTIVE")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that break a uniqueness rule, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for each rule (true: broken) that a row breaks."""
    broken = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]
    return df.select(key, F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("rule"))


def too_long(columns: dict[str, int]) -> Column:
    """Whether some column is longer than allowed."""
    return reduce(lambda a, b: a | b, [F.length(c) > n for c, n in columns.items()])


def question_rules() -> dict[str, Column]:
    """The rules for edited question content (true: broken)."""
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    objective = F.col("question_type") != "SUBJECTIVE"
    keys = F.filter(F.split(F.coalesce("answer_keys", F.lit("")), ","), lambda k: F.trim(k) != "")
    known = F.transform("options", lambda o: o["key"])
    return {
        "type": ~F.col("question_type").isin(*QUESTION_TYPES),
        "blank": blank,
        "stem": F.length("content") > 20000,
        "score": ~((F.col("score") > 0) & (F.col("score") <= 1000)),
        "options": objective & (F.size(F.coalesce("options", F.array().cast("array<struct<key:string,text:string>>"))) < 2),
        "keys": objective & (F.size(F.array_except(keys, F.coalesce(known, F.array().cast("array<string>")))) > 0),
    }


def enforce_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


#: Most questions and materials of an edited import (fixed values).
MOST_QUESTIONS, MOST_MATERIALS = 5000, 500


def import_errors(questions: DataFrame, materials: DataFrame, job: str) -> DataFrame:
    """job, rule: imports with too many questions or materials."""
    counts = []
    for rows, rule, most in ((questions, "QUESTIONS", MOST_QUESTIONS), (materials, "MATERIALS", MOST_MATERIALS)):
        counts.append(rows.groupBy(job).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(job, F.lit(rule).alias("rule")))
    return counts[0].unionByName(counts[1])
