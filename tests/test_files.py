"""Transcripts in every form that they come in, segments by strategy, and what titles tell of meetings."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources import files


def test_transcripts_in_every_form(spark, tmp_path):
    long = "x" * 1001
    forms = {
        "a": {"symbol": "A", "quarter": "Q1", "year": 2024, "content": "one"}, "b": [{"symbol": "B", "quarter": "2", "transcript": "two"}, {"symbol": "NO", "content": "later"}],
        "c": {"symbol": "C", "note": "short", "body": long, "more": "y" * 2000}, "d": {"symbol": "D", "note": "short"}, "e": [{"symbol": "E", "body": long}], "f": [], "g": {"content": None, "transcript": "hidden"}, "h": {"content": "", "quarter": "x"},
    }
    for name, data in forms.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    (tmp_path / "z.json").write_text("no json")
    got = {r["symbol"]: (r["quarter"], r["year"], r["content"]) for r in files.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"A": (1, 2024, "one"), "B": (2, None, "two"), "C": (None, None, long)}


def test_segments_by_strategy(spark):
    rows = [("ABC", "word " * 200), (None, "short"), ("X", None), ("Y", ""), ("Z", "a sentence that is long enough to be kept here, really. " * 2)]
    df = spark.createDataFrame(rows, "symbol string, content string")
    full = {r["symbol"]: r["segment"] for r in text.segments(df, "full").collect()}
    assert full == {"ABC": ("word " * 102).strip() + ".", "Z": ("a sentence that is long enough to be kept here, really. " * 2).strip()}
    kept = text.segments(df, "sentences").filter("symbol = 'Z'").collect()
    assert [(r["pos"], r["quarter"], r["year"]) for r in kept] == [(0, "?", "?"), (1, "?", "?")]
    with pytest.raises(ValueError):
        text.segments(df, "words")


def test_meetings_of_titles(spark):
    titles = ["Minutes of the Committee, October 28-29, 2025", "Statement, May 7, 2024 (Meeting 12)", "meeting notes", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    day, number = files.meeting(F.col("t"))
    assert [tuple(r) for r in df.select(day, number).collect()] == [("October 28-29, 2025", None), ("May 7, 2024", "12"), (None, None), (None, None)]
