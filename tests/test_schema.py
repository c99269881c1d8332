import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from tessera.functions.schema import PROPERTIES, SQL_TYPES, TYPES, SchemaError, faults_of, parse_schema

NAMES = st.from_regex(r"[a-z][a-z0-9_]{0,8}", fullmatch=True)
COLUMN = st.fixed_dictionaries({"name": NAMES, "type": st.sampled_from(sorted(TYPES))}, optional={"description": st.text(max_size=12), "pattern": st.sampled_from(["^a+$", r"\d{2}", ""])})
COLUMNS = st.lists(COLUMN, min_size=1, max_size=5, unique_by=lambda c: c["name"])


def spelled(columns, name="shipments"):
    return f"TABLE {name} WITH COLUMNS {json.dumps(columns)}"


@given(COLUMNS)
def test_what_is_declared_is_what_comes_out(columns):
    found = parse_schema(spelled(columns))
    assert found.name == "shipments" and [f.name for f in found.struct] == [c["name"] for c in columns]
    assert [f.dataType for f in found.struct] == [TYPES[c["type"]] for c in columns]
    assert found.patterns == {c["name"]: c["pattern"] for c in columns if "pattern" in c}
    assert [f.metadata.get("comment") for f in found.struct] == [c.get("description") for c in columns]
    row = found.row_json_schema()["schema"]
    assert row["required"] == [c["name"] for c in columns] and row["additionalProperties"] is False
    for c in columns:
        assert row["properties"][c["name"]] == {k: v for k, v in c.items() if k != "name"}
    rows = found.table_json_schema()["schema"]["properties"]["rows"]
    assert rows == {"type": "array", "items": row}


@given(COLUMNS, st.data())
def test_every_broken_property_is_named(columns, data):
    """Each broken property of each column is a fault of its own; the others stay unnamed."""
    broken = set()
    for k, c in enumerate(columns):
        for p in PROPERTIES:
            how = data.draw(st.sampled_from(["whole", "mistyped"] + ["absent"] * p.needed))
            if how == "absent":
                c.pop(p.key, None)
            elif how == "mistyped":
                c[p.key] = data.draw(st.sampled_from([7, [], {}, True]))
            if how != "whole":
                broken.add((k + 1, p.key))
    named = {(int(f.split(":")[0].removeprefix("column ")), f.split("'")[1]) for f in faults_of(columns) if f.startswith("column ") and ":" in f}
    assert named == broken
    if broken:
        with pytest.raises(SchemaError) as e:
            parse_schema(spelled(columns))
        assert len(e.value.faults) >= len(broken)


@pytest.mark.parametrize("text", [None, 5, "", "  ", "SELECT 1", "TABLE WITH COLUMNS []", "TABLE parcels", "TABLE parcels WITH COLUMNS {}", "TABLE parcels WITH COLUMNS []", "TABLE parcels ()", "TABLE parcels WITH COLUMNS [weight]", "TABLE parcels (weight MASS)", "TABLE parcels (weight)", 'TABLE parcels WITH COLUMNS ["weight"]', 'TABLE parcels WITH COLUMNS [null]'])
def test_what_is_no_schema_is_refused(text):
    with pytest.raises(ValueError, match="schema: "):
        parse_schema(text)


def test_blank_names_unknown_types_and_broken_patterns():
    faults = faults_of([{"name": " ", "type": "text"}, {"name": "zip", "type": "string", "pattern": "("}, {"name": "zip", "type": "integer"}])
    assert [f.split(" must be")[0] for f in faults[:3]] == ["column 1: 'name'", "column 1: 'type'", "column 2: 'pattern'"]
    assert faults[3:] == ["column name 'zip' is used 2 times"]


@given(st.lists(st.tuples(NAMES, st.sampled_from(sorted(SQL_TYPES))), min_size=1, max_size=6))
def test_short_spelling(columns):
    found = parse_schema("TABLE parcels (" + ", ".join(f"{n} {k}{'(9, 2)' if k == 'DECIMAL' else ''}" for n, k in columns) + ")")
    assert [(f.name, f.dataType) for f in found.struct] == [(n, SQL_TYPES[k]) for n, k in columns]


def test_rows_that_break_a_pattern(spark):
    spec = parse_schema(spelled([{"name": "zip", "type": "string", "pattern": r"^\d{5}$"}, {"name": "n", "type": "integer", "pattern": "^[1-9]"}]))
    rows = spark.createDataFrame([("12345", 4), ("1234", 0), (None, None)], T.StructType([T.StructField("zip", T.StringType()), T.StructField("n", T.LongType())]))
    assert [r[0] for r in rows.select(spec.violations()).collect()] == [[], ["zip", "n"], []]
