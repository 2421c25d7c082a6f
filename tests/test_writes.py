"""Reruns replace what they scored and nothing else; damaged text is dropped, not fatal."""
from datetime import date

import pytest

from quarterdeck.plans import writes
from quarterdeck.sources.companyfacts import parse_company_facts
from quarterdeck.sources.filings import NUM_COLUMNS, SUB_COLUMNS, parse_num, parse_sub

DAY, LATER = date(2001, 1, 1), date(2001, 2, 1)


def flags(spark, rows):
    return spark.createDataFrame(rows, "cik long, as_of date, code string")


def stored(spark, path):
    return sorted((r["cik"], r["as_of"], r["code"]) for r in writes.read_table(spark, path).collect())


def test_last_flag_vanishes_and_others_stay(spark, tmp_path):
    root = str(tmp_path)
    writes.write_run({"red_flags": flags(spark, [(1, DAY, "A"), (1, LATER, "A"), (2, LATER, "B")])}, root)
    scored = spark.createDataFrame([(1, LATER)], "cik long, as_of date")
    writes.write_run({"red_flags": flags(spark, [])}, root, scored)
    assert stored(spark, f"{root}/red_flags") == [(1, DAY, "A"), (2, LATER, "B")]
    writes.write_run({"red_flags": flags(spark, [])}, root, spark.createDataFrame([(2, LATER)], "cik long, as_of date"))
    assert stored(spark, f"{root}/red_flags") == [(1, DAY, "A")]


def test_one_company_is_written_again(spark, tmp_path):
    path = str(tmp_path / "periods")
    rows = [(k, DAY, "old") for k in range(200)]
    writes.write_bucketed(flags(spark, rows), path, buckets=8)
    writes.write_bucketed(flags(spark, [(7, DAY, "new"), (7, LATER, "new")]), path, buckets=8)
    got = writes.read_table(spark, path)
    assert got.count() == 201 and sorted(r["code"] for r in got.where("cik = 7").collect()) == ["new", "new"]
    writes.write_bucketed(flags(spark, []), path, buckets=8, batch=spark.createDataFrame([(7,)], "cik long"))
    assert writes.read_table(spark, path).where("cik = 7").count() == 0 and writes.read_table(spark, path).count() == 199


@pytest.mark.parametrize("step", ["_commit", "_fs"])
def test_a_run_that_ends_between_the_steps_changes_nothing(spark, tmp_path, monkeypatch, step):
    root, path = str(tmp_path), str(tmp_path / "red_flags")
    old = [(1, DAY, "A"), (2, DAY, "A"), (2, LATER, "B")]
    writes.write_run({"red_flags": flags(spark, old)}, root)
    held, real, calls = writes.read_table(spark, path), getattr(writes, step), []

    def stop(*args):
        calls.append(args)
        if step == "_commit" or args[1].endswith(f"{writes.COMMITS}/000000000002"):  # files are written; the new commit has no number yet
            raise OSError("executor of the driver is gone")
        return real(*args)

    monkeypatch.setattr(writes, step, stop)
    with pytest.raises(OSError):
        writes.write_run({"red_flags": flags(spark, [(1, DAY, "new"), (3, LATER, "new")])}, root)
    assert calls and stored(spark, path) == old and held.count() == 3
    monkeypatch.setattr(writes, step, real)
    writes.write_run({"red_flags": flags(spark, [(1, DAY, "new")])}, root)
    new = [(1, DAY, "new"), (2, DAY, "A"), (2, LATER, "B")]
    assert stored(spark, path) == new and held.count() == 3  # a reader that started before keeps its files until tidy()
    writes.tidy(spark, path)
    assert stored(spark, path) == new and len(list((tmp_path / "red_flags" / "_data").glob("*/*=*"))) == 2
    with pytest.raises(RuntimeError, match="another run"):
        writes._commit(spark, path, 1, {})


def test_bad_numbers_are_dropped(spark):
    given = {"adsh": "x", "filed": "20010101", "ddate": "20010101", "value": "1"}
    sub = spark.createDataFrame([tuple(given.get(c, v) if c != "cik" else v for c in SUB_COLUMNS) for v in ("1", "Infinity", "NaN", "1e30")], [*SUB_COLUMNS])
    assert [r["cik"] for r in parse_sub(sub).collect()] == [1]
    num = spark.createDataFrame([tuple(given.get(c, v) if c != "qtrs" else v for c in NUM_COLUMNS) for v in ("4", "99999999999", "NaN")], [*NUM_COLUMNS])
    assert [r["qtrs"] for r in parse_num(num).collect()] == [4]


def test_bad_dates_are_dropped(spark):
    entry = '{"end": "%s", "val": 1, "form": "10-K", "filed": "%s", "accn": "a"}'
    entries = ",".join(entry % x for x in (("2001-01-01", "2001-02-01"), ("2000-99-99", "2001-02-01"), ("2001-01-01", "soon")))
    doc = '{"cik": 1, "facts": {"us-gaap": {"Assets": {"units": {"USD": [%s]}}, "Revenues": {"units": {"USD": [%s]}}}}}' % (entries, entries)
    rows = parse_company_facts(spark.createDataFrame([(doc,)], "value string")).collect()
    assert rows and all(r["period_end"] == date(2001, 1, 1) and r["filed_date"] == date(2001, 2, 1) for r in rows)
