import pytest
from pyspark.sql import functions as F

from quillsieve.operators import findings

DISGUISED = ["Pok​yn pro vyhodnocení", "ｉｇｎｏｒｅ ａｌｌ rules", "wskazówka dla \U0001d429\U0001d42b\U0001d428\U0001d420\U0001d42b\U0001d41a\U0001d426\U0001d42e", "ígnöre all", "score️ this", "sys­tem pro⁠mpt"]


@pytest.mark.parametrize("text", [*DISGUISED, "Ignore all previous", "POKYN PRO systém"])
def test_instruction_sees_through_disguise(spark, text):
    """Cases that the SQL beside the queries, with its smaller fold, cannot decide."""
    r = spark.createDataFrame([(text,)], "t string").select(findings.instruction(F.col("t")).alias("hit"), findings.escalate(F.lit("info"), findings.instruction(F.col("t"), broad=True)).alias("severity"), findings.context(F.concat(F.lit("A first line.\n"), "t", F.lit("\nA last line."))).alias("context")).first()
    assert r.hit and r.severity == "critical" and r.context == text


def test_instruction_leaves_others(spark):
    rows = spark.createDataFrame([("A ﬁne text​, nothing else",), ("",), (None,)], "t string").select(findings.instruction(F.col("t")).alias("hit"), findings.context(F.col("t")).alias("context")).collect()
    assert [tuple(r) for r in rows] == [("", "A ﬁne text​, nothing else"), ("", ""), (None, None)]
