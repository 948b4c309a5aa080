import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import text as T

# The fixed pattern as the re module writes letters and digits.
PLAIN = re.compile(V.TABLE_REF_PATTERN.replace(r"\p{L}\p{N}_", r"\w"))


def expected_refs(text):
    return sorted({".".join(parts) for parts in PLAIN.findall(text)})


def test_truncate(values):
    got = values(lambda x: T.truncate(x, 3), [None, "", "abc", "abcd", "éèêë", "a𝄞bc"])
    mark = V.TRUNCATION_MARKER
    assert got == ["", "", "abc", "abc" + mark, "éèê" + mark, "a𝄞b" + mark]


def test_strip_removes_what_str_strip_removes(values):
    texts = [" \n\t a b \r\n", "\xa0 x　", "", "\x1cy\x85", "no"]
    assert values(T.strip, texts) == [t.strip() for t in texts]
    assert set(V.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_refs_of_known_texts(values):
    texts = [
        "select * from a.b.c join `d`.e.`f-1` using (x)",
        "a.b.c.d and a.b.c",
        "two.parts only",
        "\nnew_line.s.t",
        "café x.y.zé 1abc.d.e -q.r.s",
        "x`abc.d.e`y.f.g",
        None,
    ]
    got = values(T.table_refs, texts)
    assert got[:-1] == [expected_refs(t) for t in texts[:-1]]
    assert got[-1] == []
    assert got[0] == ["a.b.c", "d.e.f-1"]
    assert got[1] == ["a.b.c"]


def test_refs_agree_with_plain_search_on_random_texts(values):
    draw = random.Random(7)
    alphabet = ["a", "B", "_", "-", "1", ".", ".", ".", "`", " ", "é", "\n"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(3000)]
    assert values(T.table_refs, texts) == [expected_refs(t) for t in texts]


def test_first_text_skips_empty(values):
    assert values(lambda x: T.first_text(x, F.lit(""), F.lit("z")), [None, "", "a"]) == ["z", "z", "a"]


def test_first_nonempty(spark):
    row = spark.range(1).select(
        T.first_nonempty(F.array().cast("array<int>"), F.array(F.lit(1))).alias("a"),
        T.first_nonempty(F.lit(None).cast("array<int>")).alias("b"),
    ).first()
    assert row.a == [1] and row.b is None


def test_bullets_and_lines(spark):
    listed = F.array(*[F.lit(x) for x in "abcd"])
    none = F.array().cast("array<string>")
    row = spark.range(1).select(
        T.bullets(listed, 3, "-").alias("a"), T.bullets(none, 3, "nothing").alias("b"),
        T.lines(listed, 2, "-").alias("c"), T.lines(none, 2, "none").alias("d"),
    ).first()
    assert tuple(row) == ("- a\n- b\n- c", "nothing", "a\nb", "none")


def test_iso_text(spark):
    stamps = [datetime(2024, 1, 1, 0, 0, 7, 179575), datetime(2024, 2, 3, 4, 5, 6)]
    rows = spark.createDataFrame([(i, s.isoformat()) for i, s in enumerate(stamps)], "i int, s string")
    got = [r.y for r in rows.orderBy("i").select(T.iso_utc(F.col("s").cast("timestamp")).alias("y")).collect()]
    assert got == [s.replace(tzinfo=timezone.utc).isoformat() for s in stamps]


def test_bytes_that_are_not_utf8(values):
    got = values(T.decode_utf8, [bytearray(b"ok \xc3\xa9"), bytearray(b"bad \xff end")], "binary")
    assert got == ["ok é", "bad � end"]


def test_number_or(values):
    assert values(lambda x: T.number_or(x, "double", "0.1"), [None, "", "0.5", "warm"]) == [0.1, 0.1, 0.5, None]
    assert values(lambda x: T.number_or(x, "bigint", "1600"), [None, "12", "1.5"]) == [1600, 12, None]


def test_list_of_path(values):
    assert values(T.list_of_path, ["", "/a\"b"]) == ["[]", '["/a\\"b"]']


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_iso_time_does_not_follow_the_session_zone(spark, zone):
    from faultlens.functions.text import iso_utc

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 2024-03-10T02:30Z falls into the hour New York leaves out on that day.
        micros = [1710037800000000, 1710037800250000, -1, 0]
        rows = spark.createDataFrame([(m,) for m in micros], "m bigint").select(iso_utc(F.timestamp_micros("m")).alias("t"))
        assert [r.t for r in rows.collect()] == [
            "2024-03-10T02:30:00+00:00", "2024-03-10T02:30:00.250000+00:00", "1969-12-31T23:59:59.999999+00:00",
            "1970-01-01T00:00:00+00:00",
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
