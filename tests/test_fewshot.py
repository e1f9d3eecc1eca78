"""Few-shot prompts of all messages against their SQL."""

import duckdb
import pytest

from claimloom.plans import text_queries as tq
from claimloom.plans.catalog import ORACLES, full_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prompts(spark):
    return [tuple(r) for r in tq.fewshot_prompt(spark, DATA).select("message_id", "prompt").collect()]


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for name in ("documents", "embeddings", "labels"):
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return made


def test_every_message_with_parsed_claims_gets_one_prompt(prompts, con):
    wanted = con.execute(full_sql("SELECT DISTINCT message_id FROM f_pclaims_g")).fetchall()
    assert sorted(m for m, _ in prompts) == sorted(m for m, in wanted)


def test_prompts_equal_the_sql(prompts, con):
    assert sorted(prompts) == sorted(con.execute(full_sql(ORACLES["fewshot_prompt"])).fetchall())
