"""Queries that answer for all rows, where the ones they are named after take a subset."""


def test_groups_hold_every_capture(spark, sf_dir):
    from stratarc.plans.catalogue import QUERIES
    from stratarc.plans.fixture import captures

    got = QUERIES["uri_groups_all"](spark, sf_dir)
    assert got.count() == captures(spark, sf_dir).count() > QUERIES["uri_groups"](spark, sf_dir).count()


def test_group_positions_over_days(spark):
    from datetime import datetime

    from stratarc.operators.stats import uri_captures

    at = [datetime(2024, 1, 2, 5), datetime(2024, 1, 2, 5), datetime(2024, 1, 3), datetime(2023, 12, 31), None]
    rows = [("u", f"c{i}", t) for i, t in enumerate(at)] + [(None, "n", at[0])]
    got = {r.custom_id: (r.n, r.pos) for r in uri_captures(spark.createDataFrame(rows, "uri string, custom_id string, archived_ts timestamp_ntz")).collect()}
    assert got == {"c2": (5, 1), "c1": (5, 2), "c0": (5, 3), "c3": (5, 4), "c4": (5, 5), "n": (1, 1)}


def test_references_of_every_page(spark, sf_dir):
    from stratarc.plans.catalogue import QUERIES
    from stratarc.plans.fixture import pages

    linked = pages(spark, sf_dir).where("html RLIKE '(href|src)=\"'").count()
    count = lambda name: QUERIES[name](spark, sf_dir).select("page_uri").distinct().count()
    assert count("page_refs_all") == linked == count("page_refs")


def test_pattern_of_every_url(spark, sf_dir):
    from stratarc.plans.catalogue import QUERIES
    from stratarc.plans.fixture import captures

    got = sum(r.urls for r in QUERIES["capture_pattern_all"](spark, sf_dir).collect())
    assert got == captures(spark, sf_dir).select("uri").distinct().count()
