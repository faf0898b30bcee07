"""The rules across a batch share one shuffle of its triples."""

import pytest

from orrery import queries

SF = "/root/testdata/sf0.001"


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("FileScan")


@pytest.mark.parametrize(
    "name",
    [
        "validate_status_counts",  # F6
        "validate_issue_histogram",  # F7
        "validate_first_parent",  # F8
    ],
)
def test_triples_are_read_and_shuffled_once(spark, name):
    """A shuffle for the triples by name and one for the result; three scans, of its three tables."""
    assert shuffles(queries.QUERIES[name](spark, SF)) == (2, 3)
