"""Queries over whole tables miss no row of them."""

import os

import pytest

from opsweave.plans import catalog, logs, measured, rendered, served, stored  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return lambda name: catalog.QUERIES[name](spark, SF)


def test_windows_hold_every_row(spark, run):
    requests, orders = catalog.view(spark, SF, "requests"), catalog.view(spark, SF, "orders")
    s = run("a1_summary_raw_whole").first()
    assert s.exact and s.requests_all == requests.count()
    assert not (r := run("r12_a1_summary_rollup_whole").first()).exact and r.requests_all == requests.count()
    images = run("a4_image_summary_whole").first()
    assert images.done + images.running == orders.count()
    assert sum(r.n for r in run("b8_status_by_class_whole").collect()) == requests.count()
    assert sum(r.samples for r in run("a14_device_ownership_whole").collect()) == requests.count()


def test_no_call_and_no_name_is_left_out(spark, run):
    requests = catalog.view(spark, SF, "requests")
    assert run("j2_fifo_join_whole").count() == requests.where("class != 'health'").count()
    named = run("j6_model_names_whole")
    assert named.count() == requests.count()
    assert named.where("model like 'learned%'").count() > 0 and named.where("model is null").count() > 0
