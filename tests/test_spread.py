import os

import pytest
from pyspark.sql import functions as F

from veilscribe import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", ["q_all_rules", "q_rules_planted", "q_raw_rule_hits", "q_email_spans", "q_phone_spans", "q_redact", "q_tokens_to_tags"])
def test_rules_run_on_all_cores(spark, name):
    # before, the tables' only row group was one task
    tasks = catalogue.QUERIES[name](spark, DATA).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1
