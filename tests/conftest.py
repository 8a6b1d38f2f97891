from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from coverwise.session import build_session
    s = build_session("local[*]", shuffle_partitions=8, app_name="coverwise-tests")
    yield s
    s.stop()


# A small policy corpus written for these tests (not the reference's data).
KB = [
    ("kb-enroll", 0, "Enrollment windows and plan changes",
     "Open enrollment runs each autumn from November 1 to December 15. "
     "Members may change plans or add dependents during this window. "
     "Outside the window a qualifying life event is required."),
    ("kb-auth", 1, "Prior authorization rules",
     "Prior authorization is required before advanced imaging such as an MRI or CT scan. "
     "Your doctor submits the request and a decision is made within five business days. "
     "Emergency care never needs prior authorization."),
    ("kb-copay", 2, "Copays by visit type",
     "A primary care visit has a 20 dollar copay. Specialist visits cost 45 dollars. "
     "Emergency room visits cost 300 dollars unless you are admitted."),
    ("kb-tele", 3, "Virtual visits",
     "Telehealth visits are available at any hour through the member app. "
     "A virtual primary care visit costs 10 dollars."),
    ("kb-rx", 4, "Pharmacy benefits",
     "Generic drugs on tier one cost 5 dollars at in-network pharmacies. "
     "Brand drugs on tier two cost 30 dollars."),
]


@pytest.fixture(scope="session")
def kb(spark):
    return spark.createDataFrame(KB, "id string, pos long, title string, text string") \
        .withColumn("category", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("policy"))
