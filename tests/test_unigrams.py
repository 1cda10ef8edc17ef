import re

import pytest

from keyloom.sources.unigrams import load_unigrams, parse_points, read_unigram_files, rejected_records

GOOD = ["a\t1999,3,1", '"a"\t"1999,3,1"', '"a""b\tc"\t2000,1,1\t1999,2,2', " \t1470,1,1", "a,b\t2019,9223372036854775807,1", "a\t1999,007,01", "x_NOUN\t2000,2,2"]
BAD = {
    None: "null line", "": "empty token", "\t1999,1,1": "empty token", '""\t1999,1,1': "empty token", "a": "no data point", "a\t": "empty point", "a\t\t1999,1,1": "empty point",
    "a\t1999,1": "point without three numbers", "a\t1999,1,1,1": "point without three numbers", "a\t1999, 1,1": "point with an invalid number", "a\t+999,1,1": "point with an invalid number",
    "a\t1999,1,1 ": "point with an invalid number", "a\t1999,1,1\n": "point with an invalid number", "a\t٢٠٠٠,1,1": "point with an invalid number", "a\t1469,1,1": "year out of range",
    "a\t2020,1,1": "year out of range", "a\t1999,0,0": "match count below 1", "a\t1999,3,4": "volume count out of range", "a\t1999,3,0": "volume count out of range",
    "a\t1999,9223372036854775808,1": "count beyond 64 bits", 'a"b\t1999,1,1': "broken quoting", '"a\t1999,1,1': "broken quoting", '"a"b\t1999,1,1': "broken quoting", 'a\t"1999,1,1': "broken quoting",
}


def test_lines_come_out_apart_with_their_reason(spark):
    rows = [(k, line) for k, line in enumerate([*GOOD, *BAD])]
    df = spark.createDataFrame(rows + rows[:3] + rows[-2:], "line_id BIGINT, line STRING")
    valid, rejected = load_unigrams(df)
    assert {r.line_id for r in valid.collect()} == set(range(len(GOOD)))
    assert {r.line: r.reason for r in rejected.collect()} == BAD
    tokens = {r.word for r in valid.collect()}
    assert {"a", 'a"b\tc', " ", "a,b", "x_NOUN"} == tokens
    assert valid.filter("line_id = 2").count() == 2


def test_points(spark):
    cases = {"1999,3,1": None, '"1999,3,1"': None, None: "null point", "1999\t3,1": "more than one field", '"1999,3,1': "broken quoting", "1999,3": "point without three numbers", "": "empty point"}
    df = spark.createDataFrame([(k, p) for k, p in enumerate(cases)], "point_id BIGINT, data_point STRING")
    assert {r.data_point: r.kl_reason for r in parse_points(df).collect()} == cases


def test_records_once_and_empty_tables(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a\t1999,1,1"), (None, "b")], "line_id BIGINT, line STRING")
    points = spark.createDataFrame([(1, None), (1, None)], "point_id BIGINT, data_point STRING")
    got = sorted((r.src_table, r.record_id or 0) for r in rejected_records(lines, points).collect())
    assert got == [("data_points", 1), ("unigram_lines", 0), ("unigram_lines", 1)]
    assert rejected_records(lines.limit(0), points.limit(0)).count() == 0


def test_clashing_and_extra_columns_and_long_lines(spark):
    long = "w" * 200_000 + "\t" + "\t".join(["1999,1,1"] * 20_000)
    quoted = '"' + 'q""' * 100_000 + '"\t1999,1,1'
    df = spark.createDataFrame([(1, long, "x", 1), (2, quoted, "y", 2)], "line_id BIGINT, line STRING, fields STRING, points INT")
    valid, rejected = load_unigrams(df)
    assert valid.count() == 20_001 and rejected.count() == 0


def test_gzip_files(spark, tmp_path):
    import gzip

    for name in ("1-00001.gz", "2-00001.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("a\t1999,1,1\nb\t2000,1\n")
    rows = read_unigram_files(spark, str(tmp_path)).collect()
    assert sorted(r.line for r in rows) == ["a\t1999,1,1", "b\t2000,1"] and {r.partition_file for r in rows} == {"1-00001.gz"}


@pytest.mark.parametrize("seed", range(3))
def test_against_a_plain_reader(spark, seed):
    import random

    rng = random.Random(seed)
    lines = ["".join(rng.choice(['"', '""', "\t", "a", "1999,2,1", "1999,2", ",", '"1999,2,1"', '"a"', " "]) for _ in range(rng.randint(1, 6))) for _ in range(300)]

    def right(line):
        fields, at = [], 0
        while True:
            m = re.compile(r'"(?:[^"]|"")*"|[^"\t]*').match(line, at)
            fields.append(m.group())
            at = m.end()
            if at == len(line):
                break
            if line[at] != "\t":
                return False
            at += 1
        bare = [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in fields]
        return bare[0] != "" and len(bare) > 1 and all(re.fullmatch("1999,2,1", p) for p in bare[1:])

    df = spark.createDataFrame(list(enumerate(lines)), "line_id BIGINT, line STRING")
    assert {r.line_id for r in load_unigrams(df)[1].collect()} == {k for k, x in enumerate(lines) if not right(x)}
