import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tarnbrook.codec import InvalidRecord, canonical, parse_record, parse_records, record_json, record_json_column

VALID = [
    '{"id":"a","hash":"h","data":{"z":1,"a":[1.0,null,true]}}', '{"id":"a","hash":"","data":null}', '{"hash":"h","data":1,"id":"a","more":2}', '["a","h",{"k":1}]',
    '{"id":"a","hash":"h","data":{"k":1,"k":2}}', '{"id":"é🦀","hash":"h","data":18446744073709551615}',
]
INVALID = [
    "{", "", "[]", "1", '{"id":1,"hash":"h","data":1}', '{"id":"a","hash":"h"}', '{"id":null,"hash":"h","data":1}', '{"id":"a","id":"b","hash":"h","data":1}', '{"id":"a","hash":"h","data":1} x',
    "{'id':'a','hash':'h','data':1}", '{"id":"a","hash":"h","data":NaN}', '{"id":"a","hash":"h","data":007}', '{"id":"a","hash":"h","data":1e400}', '{"id":"a","hash":"h","data":' + "[" * 200 + "]" * 200 + "}", '{"invalid": json structure',
]


@pytest.mark.parametrize("text", VALID)
def test_valid(text):
    id_, hash_, data = parse_record(text)
    assert parse_record(record_json(id_, hash_, data)) == (id_, hash_, data)


@pytest.mark.parametrize("text", INVALID)
def test_invalid(text):
    with pytest.raises(InvalidRecord):
        parse_record(text)


def test_data_is_canonical():
    assert parse_record(VALID[0])[2] == '{"a":[1.0,null,true],"z":1}'
    assert parse_record(VALID[4])[2] == '{"k":2}'


_json = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), x, max_size=4), max_leaves=20)


@given(st.text(st.characters(exclude_categories=["Cs"])), _json)
def test_round_trip(id_, data):
    assert json.loads(parse_record(record_json(id_, "h", canonical(data)))[2]) == data


def test_column_forms(spark):
    rows = [parse_record(t) for t in VALID] + [('q"\\\n\u0001', "x{}", "[]")]
    df = spark.createDataFrame(rows, "id string, hash string, data_json string")
    texts = [r[0] for r in df.select(record_json_column(df.id, df.hash, df.data_json)).collect()]
    assert [parse_record(t) for t in texts] == rows
    back = parse_records(spark.createDataFrame([(t,) for t in [*VALID, *INVALID, None]], "value string")).select("record.*").collect()
    assert [r["error"] is None for r in back] == [True] * len(VALID) + [False] * (len(INVALID) + 1)
