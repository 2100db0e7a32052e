import pytest
from pyspark.sql import functions as F

from quernlake.operators import quality, star_schema
from quernlake.schemas import PAYMENT_CSV_COLUMNS
from quernlake.sources import payments

GOOD = dict(zip(PAYMENT_CSV_COLUMNS, "s1,1,T1,M1,11112222,Title,100,1,Paid,Paid,,P1,B1,C1,Automated,10,,2026-01-01 10:00:00,,,,2026-01-01 11:00:00".split(","), strict=True))


def rows(spark, *changes):
    data = []
    for i, change in enumerate(changes):
        row = {k: v or None for k, v in {**GOOD, "session_key": f"s{i}", **change}.items()}
        data.append((*[row[c] for c in PAYMENT_CSV_COLUMNS], i + 1))
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in PAYMENT_CSV_COLUMNS) + f", {quality.ROW} long")


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"merchant_key": "  "}, "blank"), ({"try_seq": "40000"}, "whole number"), ({"amount": "-1"}, "whole number"), ({"init_time_ms": "x"}, "whole number"), ({"created_at": "nope"}, "timestamp"),
        ({"settled_at": "nope"}, "timestamp"), ({"session_status": "Odd"}, "session status"), ({"try_status": "Odd"}, "attempt status"), ({"verify_type": "Odd"}, "verify type"),
    ],
)
def test_row_rules(spark, change, reason):
    with pytest.raises(quality.QualityError, match=f"CSV row 3: .*{reason}") as told:
        quality.validate(rows(spark, {}, change))
    assert "Odd" not in str(told.value) and "nope" not in str(told.value)


def test_cross_row_rules(spark):
    with pytest.raises(quality.QualityError, match="CSV row 2: the attempt is a duplicate"):
        quality.validate(rows(spark, {"session_key": "a"}, {"session_key": "a"}))
    with pytest.raises(quality.QualityError, match="session values vary"):
        quality.validate(rows(spark, {"session_key": "a"}, {"session_key": "a", "try_seq": "2", "amount": "5"}))
    with pytest.raises(quality.QualityError, match="several titles"):
        quality.validate(rows(spark, {}, {"category_title": "Other"}))
    good = rows(spark, {"session_key": "a"}, {"session_key": "a", "try_seq": "2"})
    assert quality.validate(good) is good


def test_star_schema(spark):
    tables = star_schema.star_schema(rows(spark, {"session_key": "a"}, {"session_key": "a", "try_seq": "2"}, {"session_key": "b", "terminal_key": "T2"}))
    assert {k: v.count() for k, v in tables.items()} == {"merchants": 1, "merchant_categories": 1, "terminals": 2, "payment_sessions": 2, "payment_tries": 3}
    assert quality.orphans(tables["payment_tries"], tables["payment_sessions"], ["session_id", "merchant_id"]).count() == 0
    assert quality.orphans(tables["payment_sessions"], tables["terminals"], ["terminal_id", "merchant_id"]).count() == 0
    assert quality.repeated_keys(tables["payment_tries"], ["session_id", "try_seq"]).count() == 0
    assert dict(tables["payment_sessions"].dtypes)["created_at"] == "timestamp_ntz"


def csv(path, lines, header=",".join(PAYMENT_CSV_COLUMNS), bom=False):
    path.write_text(("﻿" if bom else "") + "\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_load(spark, tmp_path):
    line = ",".join(GOOD.values())
    one = csv(tmp_path / "one.csv", [line, line.replace("s1,1", "s1,2", 1), line.replace("s1,1", "s2,1", 1)], bom=True)
    root = str(tmp_path / "warehouse")
    normalize = lambda staging: star_schema.star_schema(quality.validate(staging))
    assert payments.load_payments(spark, one, root, normalize) == "loaded"
    assert payments.load_payments(spark, one, root, normalize) == "unchanged"
    assert payments.read_table(spark, root, "payment_tries").count() == 3
    two = csv(tmp_path / "two.csv", [line])
    with pytest.raises(payments.SourceError, match="another dataset"):
        payments.load_payments(spark, two, root, normalize)
    assert payments.load_payments(spark, two, root, normalize, replace=True) == "loaded"
    assert payments.read_table(spark, root, "payment_sessions").count() == 1
    audit = payments.read_imports(spark, root).collect()
    assert len(audit) == 1 and audit[0].source_row_count == 1 and len(audit[0].sha256) == 64


def test_header_and_numbers(spark, tmp_path):
    with pytest.raises(payments.SourceError) as told:
        payments.inspect_source(spark, csv(tmp_path / "bad.csv", [], header="a,secret-value"))
    assert "secret-value" not in str(told.value)
    many = spark.range(100, numPartitions=7).orderBy("id")
    found = payments.numbered(many, "n").agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert tuple(found) == (1, 100, 100)


def test_a_failed_load_leaves_the_last_one(spark, tmp_path):
    line, root = ",".join(GOOD.values()), str(tmp_path / "warehouse")
    one = csv(tmp_path / "one.csv", [line])
    normalize = lambda staging: star_schema.star_schema(quality.validate(staging))
    payments.load_payments(spark, one, root, normalize)

    def broken(staging):
        tables = normalize(staging)
        return {**tables, "terminals": tables["terminals"].limit(0)}

    two = csv(tmp_path / "two.csv", [line, line.replace("s1,1", "s1,2", 1)])
    with pytest.raises(payments.SourceError, match="payment_sessions refers to no row of terminals"):
        payments.load_payments(spark, two, root, broken, replace=True)
    assert payments.read_table(spark, root, "payment_tries").count() == 1 and payments.read_imports(spark, root).count() == 1
    with pytest.raises(payments.SourceError, match="a key of payment_tries"):
        payments.load_payments(spark, two, root, lambda s: {**normalize(s), "payment_tries": normalize(s)["payment_tries"].withColumn("try_seq", F.lit(1).cast("smallint"))}, replace=True)
    assert payments.load_payments(spark, two, root, normalize, replace=True) == "loaded"
    assert payments.read_table(spark, root, "payment_tries").count() == 2
    assert [p.name for p in (tmp_path / "warehouse").iterdir() if p.name.startswith("version-")].__len__() == 1


def test_constraints_ride_on_the_write(spark, tmp_path):
    line, root = ",".join(GOOD.values()), str(tmp_path / "warehouse")
    normalize = lambda staging: star_schema.star_schema(quality.validate(staging))
    payments.load_payments(spark, csv(tmp_path / "one.csv", [line]), root, normalize)

    def negative(staging):
        tables = normalize(staging)
        return {**tables, "payment_sessions": tables["payment_sessions"].withColumn("amount", F.lit(-1).cast("long"))}

    two = csv(tmp_path / "two.csv", [line, line.replace("s1,1", "s1,2", 1)])
    with pytest.raises(payments.SourceError, match="payment_sessions: .*amount is not negative"):
        payments.load_payments(spark, two, root, negative, replace=True)
    odd = lambda s: {**normalize(s), "payment_tries": normalize(s)["payment_tries"].withColumn("try_status", F.lit("Odd"))}
    with pytest.raises(payments.SourceError, match="payment_tries: .*try_status is known"):
        payments.load_payments(spark, two, root, odd, replace=True)
    assert payments.read_table(spark, root, "payment_tries").count() == 1


def test_of_two_loads_at_once_one_wins(spark, tmp_path):
    from threading import Barrier, Thread

    line, root = ",".join(GOOD.values()), str(tmp_path / "warehouse")
    files = [csv(tmp_path / f"{i}.csv", [line.replace("s1", f"s{i}{k}") for k in range(i + 1)]) for i in range(3)]
    plain = lambda staging: star_schema.star_schema(staging)
    payments.load_payments(spark, files[0], root, plain)
    gate, told = Barrier(2, timeout=120), []

    def load(path):
        def normalize(staging):  # both are past the look at what is loaded
            gate.wait()
            return plain(staging)

        try:
            told.append(payments.load_payments(spark, path, root, normalize, replace=True))
        except payments.SourceError as error:
            told.append(str(error))

    threads = [Thread(target=load, args=(f,)) for f in files[1:]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(told) == ["another load was committed meanwhile; nothing of this one remains", "loaded"]
    rows = {payments.read_table(spark, root, name).count() for name in ("payment_sessions", "payment_tries")}
    assert rows in ({2}, {3}) and payments.read_imports(spark, root).first().source_row_count in rows
    assert len([p for p in (tmp_path / "warehouse").iterdir() if p.name.startswith("version-")]) == 1


def test_digest_is_that_of_the_file(spark, tmp_path):
    import hashlib

    path = tmp_path / "a.csv"
    csv(path, [",".join(GOOD.values())])
    found = payments.inspect_source(spark, str(path))
    assert found.sha256 == hashlib.sha256(path.read_bytes()).hexdigest() and found.size == path.stat().st_size


def test_digest_follows_lines(spark, tmp_path):
    line = ",".join(GOOD.values())
    a, b = csv(tmp_path / "a.csv", [line, line.replace("s1", "s2")]), csv(tmp_path / "b.csv", [line.replace("s1", "s2"), line])
    found = [payments.inspect_source(spark, p) for p in (a, b, a)]
    assert found[0].sha256 == found[2].sha256 != found[1].sha256 and found[0].size == (tmp_path / "a.csv").stat().st_size
