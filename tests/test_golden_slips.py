import pytest

from golden_texts import GOLDEN
from slipweave.operators.slips import parse_slips


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, k, t) for i, (k, (t, _)) in enumerate(GOLDEN.items())]
    df = spark.createDataFrame(rows, "idx long, file_name string, raw_text string")
    return {r.file_name: r.asDict() for r in parse_slips(df).collect()}


@pytest.mark.parametrize("case", list(GOLDEN))
def test_fields(parsed, case):
    got = parsed[case]
    for key, want in GOLDEN[case][1].items():
        value = got[key]
        assert (str(value) if key == "transaction_date" else value) == want, (key, value)
