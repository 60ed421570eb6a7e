"""A growing folder of CSV files: arrivals in parts are numbered as one read; what cannot be used is listed."""

from __future__ import annotations

import pytest

from tests.compare import SF_DIR, assert_same
from tidemark.plans.queries import ORACLES, QUERIES
from tidemark.sources.bars import numbered, read_bars
from tidemark.streaming.growing import read_growing, read_unusable, write_growing

HEADER = "open,high,low,close,snapshotTime\n"
BARS = ["series_key", "ts", "open", "high", "low", "close", "rn", "n"]


def line(hour: int, close: str = "1.5", day: int = 2) -> str:
    return f"1,2,0.5,{close},2026:03:{day:02d}-{hour:02d}:00:00\n"


def arrive(spark, folder, name: str, text: str, out: str, checkpoint: str) -> None:
    (folder / name).write_text(text)
    query = write_growing(spark, str(folder), out, checkpoint, once=True)
    query.awaitTermination(120)


def as_set(df, columns=BARS):
    return sorted(tuple(r) for r in df.select(columns).collect())


@pytest.mark.parametrize("name", ["growing_bars", "growing_unusable"])
def test_query_matches_its_oracle(spark, name):
    assert assert_same(QUERIES[name](spark, SF_DIR), ORACLES[name], SF_DIR) > 100


def test_two_arrivals_are_one_read(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    # The rows of a file are in no order; the second brings bad rows, one bar again and one from before.
    arrive(spark, folder, "a.csv", HEADER + line(11) + line(9), out, checkpoint)
    assert [r[-2:] for r in as_set(read_growing(spark, out))] == [(0, 2), (1, 2)]
    bad = line(13, "x") + line(14, "") + line(15, "NaN") + "1,2,0.5,1,yesterday\n" + "1,2,0.5\n" + line(11) + line(10)
    arrive(spark, folder, "b.csv", HEADER + line(13) + bad + line(12), out, checkpoint)
    got = as_set(read_growing(spark, out))
    listed = read_unusable(spark, out)
    assert sorted(r["reason"] for r in listed.collect()) == ["cells", "late", "late", "number", "number", "number", "time"]
    assert {r["file"].rsplit("/", 1)[1] for r in listed.collect()} == {"b.csv"}
    assert listed.where("reason = 'cells'").first()["line"] == "1,2,0.5"
    whole = tmp_path / "whole.csv"
    whole.write_text(HEADER + line(9) + line(11) + line(12) + line(13))
    assert got == as_set(numbered(read_bars(spark, whole)))
    # Nothing new, and a file without a row: nothing is read or numbered again.
    write_growing(spark, str(folder), out, checkpoint, once=True).awaitTermination(120)
    arrive(spark, folder, "c.csv", HEADER, out, checkpoint)
    assert as_set(read_growing(spark, out)) == got
    arrive(spark, folder, "d.csv", HEADER + line(8, day=3), out, checkpoint)
    assert [r[-2:] for r in as_set(read_growing(spark, out))] == [(k, 5) for k in range(5)]


def test_a_batch_that_is_run_again_gives_each_row_once(spark, tmp_path):
    """A new checkpoint starts with the same number, as a batch does that had not been committed."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for checkpoint in ("one", "two"):
        arrive(spark, folder, "a.csv", HEADER + line(9) + line(10), out, str(tmp_path / checkpoint))
        assert [r[-2:] for r in as_set(read_growing(spark, out))] == [(0, 2), (1, 2)]


def test_other_headers_stop_it(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    (folder / "a.csv").write_text("open,high,low,snapshotTime\n1,2,1,2026:03:02-09:30:00\n")
    with pytest.raises(ValueError, match="close"):
        write_growing(spark, str(folder), out, checkpoint)
    (folder / "a.csv").write_text(HEADER + line(9))
    arrive(spark, folder, "a.csv", HEADER + line(9), out, checkpoint)
    with pytest.raises(Exception, match="CSV header does not conform"):
        arrive(spark, folder, "b.csv", "high,open,low,close,snapshotTime\n" + line(10), out, checkpoint)


def test_a_column_that_is_not_read_still_counts_as_a_cell(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    text = "open,high,low,close,date,volume\n1,2,0.5,1,2026-03-02 09:00:00\n1,2,0.5,1,2026-03-02 10:00:00,7\n"
    arrive(spark, folder, "a.csv", text, out, str(tmp_path / "checkpoint"))
    assert [r[-2:] for r in as_set(read_growing(spark, out))] == [(0, 1)]
    assert [(r["reason"], r["line"]) for r in read_unusable(spark, out).collect()] == [("cells", "1,2,0.5,1,2026-03-02 09:00:00")]
