import json

import pytest

from glossa.sources import services
from glossa.sources.readers import lookup_source

TABLE = {"RA": ["right atrium", "room air"], "MS": ["multiple sclerosis"], "RA_(disambiguation)": ["a page"]}


def flaky(times):
    """A client that fails the first times that it is asked for a term in a process."""
    asked = {}

    def client(term):
        asked[term] = asked.get(term, 0) + 1
        if asked[term] <= times:
            raise ConnectionError(term)
        return TABLE.get(term, [])

    return client


def pairs(df):
    return sorted((r.term, r.answer) for r in df.collect())


def test_answers_equal_the_table(spark):
    terms = spark.createDataFrame([("RA",), ("MS",), ("RA",), (None,), ("none",)], "sf string")
    table = spark.createDataFrame([(t, a) for t, found in TABLE.items() for a in found], "sf string, lf string")
    want = sorted((r.sf, r.lf) for r in lookup_source(terms.distinct(), table).collect())
    assert pairs(services.answers(terms, flaky(2), delay=0)) == want
    assert pairs(services.answers(terms, flaky(0), pattern="{}_(disambiguation)")) == [("RA", "a page")]
    assert pairs(services.answers(terms.limit(0), flaky(0))) == []


def test_format_reads_and_retries(spark):
    services.register(spark, "terms", flaky(1))
    read = spark.read.format("terms").option("delay", "0").option("tasks", "2")
    got = read.option("terms", json.dumps(["MS", "RA", "RA", "none"])).load()
    assert pairs(got) == [("MS", "multiple sclerosis"), ("RA", "right atrium"), ("RA", "room air")]
    assert got.columns == ["term", "answer"]
    assert pairs(read.option("terms", "[]").load()) == []


def test_a_client_that_never_answers_is_an_error(spark):
    with pytest.raises(Exception, match="ConnectionError"):
        services.answers(spark.createDataFrame([("RA",)], "sf string"), flaky(9), retries=1, delay=0).collect()
    calls = []
    with pytest.raises(ConnectionError):
        services.ask(lambda t: calls.append(t) or flaky(9)(t), "RA", retries=2, delay=0)
    assert calls == ["RA"] * 3
