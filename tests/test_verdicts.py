"""Replies about two reports: each fault, in its order."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions import verdicts

LEFT, RIGHT = "Sam Altman 加入 Acme's 新模型 team; GPT-5 launches", "At Acme, sam  altman... gpt-5 新模型"
GOOD = {"relationship": "same_event", "shared_subjects": ["Sam Altman"], "shared_action": "Launch"}


@pytest.mark.parametrize(("reply", "fault"), [
    (GOOD, ""), (GOOD | {"shared_subjects": ["sam altman", "新模型", "GPT-5"]}, ""), (GOOD | {"relationship": "distinct", "shared_subjects": [], "shared_action": " "}, ""),
    ("nope", "no_object"), ([1], "no_object"), (None, "no_object"), (GOOD | {"more": 1}, "wrong_fields"), ({"relationship": "distinct"}, "wrong_fields"), (GOOD | {"relationship": "same"}, "unknown_relationship"), (GOOD | {"relationship": 1}, "unknown_relationship"),
    (GOOD | {"shared_subjects": "x"}, "subjects_no_texts"), (GOOD | {"shared_subjects": ["x", 1]}, "subjects_no_texts"), (GOOD | {"shared_subjects": [" "]}, "subjects_no_texts"), (GOOD | {"shared_action": None}, "action_no_text"),
    (GOOD | {"shared_subjects": []}, "same_event_without_subject_or_action"), (GOOD | {"shared_action": ""}, "same_event_without_subject_or_action"), (GOOD | {"shared_subjects": ["team"]}, "no_strong_subject"), (GOOD | {"shared_subjects": ["openai"]}, "no_strong_subject"),
    (GOOD | {"shared_subjects": ["Sam Altman", "Acm"]}, "subject_not_anchored"), (GOOD | {"shared_subjects": ["Sam Altman", "launches"]}, "subject_not_anchored"), (GOOD | {"shared_subjects": ["Sam Altman", "!!"]}, "subject_not_anchored"),
    (GOOD | {"shared_action": "hire"}, "action_not_shared"), (GOOD | {"relationship": "uncertain", "shared_action": "sue"}, "action_not_shared"),
])
def test_faults(spark, reply, fault):
    text = reply if reply is None or reply == "nope" else json.dumps(reply)
    row = spark.createDataFrame([(text, LEFT, RIGHT)], "r string, a string, b string")
    strong, acts = F.array(*map(F.lit, ("sam altman", "openai", "team"))), [F.array(*map(F.lit, x)) for x in (("launch", "hire"), ("launch",))]
    assert row.select(verdicts.fault(F.col("r"), F.col("a"), F.col("b"), strong, *acts).alias("f")).first()["f"] == fault
