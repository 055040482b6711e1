"""URLs are parsed for groups, not for every capture; a micro-batch is not one task's."""

import re

import pytest

from stratarc.operators import stats, tree
from stratarc.plans.catalogue import _stream
from stratarc.plans.fixture import captures
from stratarc.streaming import live


@pytest.mark.parametrize("plan", [tree.nodes, lambda c: tree.find_type(c, "text/html"), stats.content_types])
def test_no_url_is_parsed_before_its_group(spark, sf_dir, plan):
    text = plan(captures(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    at = [k for k, line in enumerate(lines) if re.search(r"Aggregate \[uri#\d+", line)]
    assert at and not any("://" in line for line in lines[at[-1] + 1 :])


@pytest.mark.parametrize("plan", [live.live_nodes, live.live_newest_host])
def test_streams_parse_a_url_once_a_row(spark, sf_dir, plan):
    text = plan(captures(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    lines = text.splitlines()
    last = max(k for k, line in enumerate(lines) if re.search(r"Aggregate \[", line))
    assert not any("Filter" in line and "://" in line for line in lines[last + 1 :])


def test_a_micro_batch_has_a_file_for_each_core(spark, sf_dir):
    c = captures(spark, sf_dir)
    rows, at = _stream(spark, c.drop("headers"))
    written = spark.read.parquet(f"{at}/in")
    assert written.count() == c.count()
    assert len(written.inputFiles()) == 4 * spark.sparkContext.defaultParallelism
    got = live.drain(live.live_nodes(rows), "update", ["node"], at)
    assert got.agg({"records": "sum"}).first()[0] == c.count()
    assert spark.read.parquet(f"{at}/rows").select("__n").distinct().count() == 4  # micro-batches as before
