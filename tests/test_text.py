from datetime import date

import pytest
from pyspark.sql import functions as F

from quernlake.functions import calendar, redact, text


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("كتاب يك", "کتاب یک"), ("۱۲۳ ٤٥", "123 45"), ("مَدرَسـه", "مدرسه"), ("خانۀ", "خانه"), ("می‌شود", "میشود"), ("  a \t b\n", "a b"), ("ﬁ①", "fi1"), ("", ""), ("أإآؤئ", "اااوی")],
)
def test_normalize(spark, given, wanted):
    assert one(spark, given, text.normalize) == wanted
    assert one(spark, wanted, text.normalize) == wanted


def test_variants_and_counts(spark):
    assert one(spark, "می‌شود", text.query_variants) == ["میشود", "می‌شود"]
    assert one(spark, "plain", text.query_variants) == ["plain"]
    assert one(spark, "   ", text.query_variants) == []
    assert one(spark, None, text.normalize) is None
    assert one(spark, "", text.estimate_tokens) == 1 and one(spark, "a b", text.estimate_tokens) == 7
    assert one(spark, "12 سلام x", text.direction) == "rtl" and one(spark, "1 x سلام", text.direction) == "ltr"
    assert one(spark, "نصب node.js و redis", text.latin_tokens) == ["node.js", "redis"]
    assert one(spark, "a/b#c:12", text.display_path) == "a/b#c"


def test_links():
    base = "https://docs.example.org/guide/page/"
    assert text.absolute_links("[a](../x) [b](https://y.z) <a href='/q'>", base) == f"[a](https://docs.example.org/guide/x) [b](https://y.z) <a href='https://docs.example.org/q'>"
    assert text.absolute_links("[r]: other.md \"T\"", base) == "[r]: https://docs.example.org/guide/page/other.md \"T\""
    assert text.absolute_links("[m](mailto:a@b.c) ![d](data:x)", base) == "[m](mailto:a@b.c) ![d](data:x)"


def test_ingest_redaction():
    mask = redact.PLACEHOLDER
    cases = {
        "tool --password=hunter2 --x": ({"password_flag": 1}, f"tool --password={mask} --x"),
        "mysql -u root -pS3cret db": ({"password_flag": 1}, f"mysql -u root -p{mask} db"),
        "redis-cli -a topsecret": ({"password_flag": 1}, f"redis-cli -a {mask}"),
        "postgres://user:pw@host/db": ({"uri_credential": 1}, f"postgres://user:{mask}@host/db"),
        'password = "abc"': ({"password_assignment": 1}, f'password = "{mask}"'),
        "DB_PASSWORD: 123e4567-e89b-12d3-a456-426614174000": ({"password_uuid": 1}, f"DB_PASSWORD: {mask}"),
        "DB_PASS=aB3dE5fG7hI9jK1lM3nO5pQ7": ({"password_alphanumeric": 1}, f"DB_PASS={mask}"),
        "secret_key = " + "ab12" * 10: ({"hex_secret": 1}, f"secret_key = {mask}"),
        "key q8ZrT2mXv5Lk9WbN3cYp7DsF": ({"high_entropy": 1}, f"key {mask}"),
        # not credentials
        "password = environment.NAME": ({}, None), "password == other": ({}, None), 'token = "' + "ab12" * 10 + '"': ({}, None), "aaaaaaaaaaaaaaaaaaaaaaaaaaaa": ({}, None), "DB_PASSWORD: short": ({}, None),
    }
    for given, (counts, wanted) in cases.items():
        done, found = redact.redact_text(given)
        assert (found, done) == (counts, wanted or given)
        assert redact.redact_text(done) == (done, {})


def test_serving_redaction(spark):
    serve = lambda t: one(spark, t, redact.redact_serving)
    mask = redact.PLACEHOLDER
    assert serve("api_key: abc, x") == f"api_key={mask}, x"
    assert serve("redis://u:p@h:1") == mask and serve("use sk-abcdefghijkl0 now") == f"use {mask} now"
    assert serve("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----") == mask
    assert one(spark, "see https://a.b/c) and", redact.sanitize) == f"see {redact.LINK_PLACEHOLDER}) and"
    assert one(spark, "HTTP://x", redact.has_raw_link) and not one(spark, "x", redact.has_raw_link)


def test_calendar(spark):
    for day, jalali in ((date(2024, 3, 20), (1403, 1, 1)), (date(2025, 3, 21), (1404, 1, 1)), (date(2026, 3, 21), (1405, 1, 1)), (date(2025, 3, 20), (1403, 12, 30)), (date(2026, 8, 20), (1405, 5, 29))):
        assert calendar.to_jalali(day) == jalali and calendar.from_jalali(*jalali) == day
    assert calendar.jalali_month(date(2025, 3, 10)) == (date(2025, 2, 19), date(2025, 3, 21))
    assert calendar.previous_equal(date(2026, 2, 1), date(2026, 3, 1)) == (date(2026, 1, 4), date(2026, 2, 1))
    df = spark.sql("SELECT date'2026-01-31' AS d")
    assert tuple(df.select(*calendar.gregorian_month(F.col("d"), -1)).first()) == (date(2025, 12, 1), date(2026, 1, 1))
    assert df.select(calendar.jalali_text("d")).first()[0] == "1404-11-11"


def test_credentials_in_other_case_reach_the_shapes(spark):
    """The native prefilter folds case as the shapes do: long s and the Kelvin sign are letters of these words, too."""
    from quernlake.functions import redact

    texts = ["paſſwd = xyz9secretvalue", "PAſSWORD=Xy12345678901234567890123Ab", "DSN: mySQL://u:p4ss@h", "nothing here"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.r.text for r in rows.select("t", redact.redact_ingest(F.col("t")).alias("r")).collect()}
    assert got == {t: redact.redact_text(t)[0] for t in texts}
    assert got[texts[0]] != texts[0]
