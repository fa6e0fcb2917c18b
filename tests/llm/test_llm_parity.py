"""Registered llm queries against their SQL."""

import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import queries as q  # noqa: E402
from tests.parity import connect, difference  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    assert difference(q.queries()[name](spark, SF), connect(SF).sql(q.oracle_sql()[name])) is None


def test_jaccard_join_at_the_next_size(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(q.queries()["op10_ngram_jaccard_join"](spark, sf), connect(sf).sql(q.oracle_sql()["op10_ngram_jaccard_join"])) is None


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} <= {k.split("_")[0] + "_" for k in entry.queries() if k[:2] == "op" and k[2].isdigit()}
    assert "pipeline" in entry.queries()
