"""Tables that grow with the input are not sent through the driver, however few bytes their files have."""

from polisgrid.plans.queries import QUERIES


def test_truncated_terrain_is_joined_by_shuffles(spark):
    import polisgrid.plans.queries_mesh  # noqa: F401

    plan = QUERIES["terrain_truncate"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
