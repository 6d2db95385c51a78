"""Queries against their SQL on small odd tables: empty spans, letters of two bytes."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

from . import oracle


def write(folder, name, columns, rows):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t ({columns})")
    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"COPY t TO '{folder}/{name}.parquet' (FORMAT parquet)")


@pytest.mark.parametrize("name", ["j3_residues", "j4_spliced", "j5_absorbed_rests", "j10_priority_union", "j11_new_spans", "j14_refused_bounds"])
def test_empty_spans(spark, tmp_path, name):
    """An empty span overlaps one that it lies inside, on either side; one at an edge does not."""
    at = dt.datetime(2024, 1, 1)
    # Odd ids are spans; even ones are segments, moved by 20 s and cut to a quarter.
    rows = [
        (1, 0, 1.0), (2, 10, 0.0),  # an empty segment inside a span
        (4, 100, 4.0), (3, 150, 0.0),  # an empty span inside a segment
        (5, 300, 1.0), (6, 280, 0.0), (8, 340, 0.0),  # empty segments at both edges
        (10, 500, 4.0), (13, 530, 0.00002), (15, 540, 0.5), (12, 555, 0.00005),
    ]
    table = [(k, at + dt.timedelta(seconds=s), 1, "view", value, "{}") for k, s, value in rows]
    write(tmp_path, "events", "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR", table)
    oracle.check(spark, str(tmp_path), entry.queries()[name], entry.oracle_sql()[name])


def said(folder, *texts):
    write(folder, "conversations", "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", [(1, i, "user", t) for i, t in enumerate(texts)])


def test_edits_of_words_with_a_q(spark, tmp_path):
    said(tmp_path, "Q" + "a" * 5 + "ó" + "a" * 7, "Qaaa", "a" * 7 + "éé" + "a" * 5, "a" * 12 + "É", "aaaa Q" + "a" * 12)
    oracle.check(spark, str(tmp_path), entry.queries()["j12_relevant_clauses"], entry.oracle_sql()["j12_relevant_clauses"])


def test_edits_of_bytes(spark, tmp_path):
    said(tmp_path, "éa b", "aa b", "éé b", "ae", "ée", "ê", "", "éß", "x")
    oracle.check(spark, str(tmp_path), entry.queries()["x21_edit_distance"], entry.oracle_sql()["x21_edit_distance"])


def test_every_seventh_video_is_saved_again(spark, tmp_path):
    write(tmp_path, "conversations", "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", [(v, t, "user", f"{v} {t}") for v in range(90) for t in range(2)])
    got = {(r.vid, r.id): r.text for r in entry.queries()["s8_saved_fields"](spark, str(tmp_path)).collect()}
    assert got == {(v, t): "saved again" if v % 7 == 0 else f"{v} {t}" for v in range(90) for t in range(2)}
    oracle.check(spark, str(tmp_path), entry.queries()["s8_saved_fields"], entry.oracle_sql()["s8_saved_fields"])
