"""Golden cases of the scalar expressions."""

import pytest
from pyspark.sql import functions as F

from tidepost.functions import redact, text, times, urls, values
from tidepost.functions.hashing import fingerprint
from tidepost.functions.similarity import ratio


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("https://Shop.Example.org/a?UTM_medium=m&b&c=1,2#frag", "https://shop.example.org/a?b=&c=1%2C2"),
        ("HTTP://U:P@EX.com?b=a%20d~*&utm_x=1&&=5&z=%zz", "http://u:p@ex.com?b=a+d~%2A&=5&z=%25zz"),
        ("/only/path?x", "/only/path?x="),
    ],
)
def test_canonical_url(spark, given, wanted):
    assert one(spark, urls.canonical_url(F.lit(given))) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [(" Straße,  No. 7 ", "strasse no 7"), ("ﬁrst ǰob", "first j ob"), ("\x1c A b", "a b"), (None, "")],
)
def test_plain_name(spark, given, wanted):
    assert one(spark, text.plain_name(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("<p>a&amp;b &lt;b&gt; c</p><script>x<y</script>d<br>e<!-- z -->f", "a&b c d e f"),
        ("&lt;p&gt;It&#x27;s caf&eacute;&lt;/p&gt;", "It's café"),
        ("1 < 2 <b title='>'>yes</b>", "1 < 2 yes"),
        ("<template><p>no</p></template>ok", "ok"),
        ("plain  text", "plain text"),
        ("", None),
    ],
)
def test_plain_text(spark, given, wanted):
    rows = spark.createDataFrame([(given,)], "html string")
    assert text.with_plain_text(rows, "html", "text").first()["text"] == wanted


@pytest.mark.parametrize(
    "given, bare, closed",
    [
        ("<h1>ver&amp</h1><p>und&amp;&amp;</p>", "ver& und&&", "ver&amp und&&"),
        ("a&lt b &amp;copy &eacute;", "a < b © é", "a&lt b &copy é"),
        ("&eacute; &noit; &nosuch;x &#233;&#233", "é &noit; &nosuch;x éé", "é &noit; &nosuch;x é&#233"),
    ],
)
def test_references_without_semicolon(spark, given, bare, closed):
    rows = spark.createDataFrame([(given,)], "html string")
    assert text.with_plain_text(rows, "html", "text").first()["text"] == bare
    assert text.with_plain_text(rows, "html", "text", bare_references=False).first()["text"] == closed


def test_native_text_equals_parsed_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    found = {r["page_id"]: r for r in text.with_plain_text(rows, "html", "text").collect()}
    for row in found.values():
        parsed = text._parsed_text(row["html"])
        assert row["text"] == " ".join(parsed.split())


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("2031-05-06T07:08:09Z", "2031-05-06 07:08:09"),
        ("2031-05-06T07:08-04:30", "2031-05-06 11:38:00"),
        ("20310506T070809", "2031-05-06 07:08:09"),
        ("2031-05-06", "2031-05-06 00:00:00"),
        ("2031-02-30", None),
        ("2031", None),
        ("soon", None),
    ],
)
def test_iso_time(spark, given, wanted):
    found = one(spark, times.iso_time(F.lit(given)).cast("string"))
    assert found == wanted


def test_epoch_time(spark):
    assert one(spark, times.epoch_time(F.lit(1_700_000_000)).cast("string")) == "2023-11-14 22:13:20"
    assert one(spark, times.epoch_time(F.lit(1_700_000_000_500)).cast("string")) == "2023-11-14 22:13:20.5"


def test_date_bound():
    assert times.date_bound("2031-05-06", True).isoformat() == "2031-05-06T23:59:59.999999+00:00"
    with pytest.raises(times.InvalidDateFilter):
        times.date_bound("yesterday", False)


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("x?token=a1&page=2", "x?token=[redacted]&page=2"),
        ("Authorization: Digest a=\"b\", c", "Authorization: [redacted]"),
        ("cookie: a=b; c", "cookie: [redacted]"),
        ("at https://me:pw@host.example.com/x", "at https://[redacted]@host.example.com/x"),
        ("reauthorization: later", "reauthorization: later"),
        ("?session_id=1&primary_key=2", "?session_id=1&primary_key=2"),
    ],
)
def test_redacted(spark, given, wanted):
    assert one(spark, redact.redacted(F.lit(given))) == wanted


def test_fingerprint_ignores_spelling(spark):
    def made(company, title):
        return fingerprint(F.lit(company), F.lit(title), F.lit("Here"), F.lit("https://x/1"), F.lit("1"))

    assert one(spark, made("Foo, Ltd.", "Head  of Ops")) == one(spark, made("foo ltd", "head of ops"))
    assert one(spark, made("Foo", "Head of Ops")) != one(spark, made("foo ltd", "head of ops"))


@pytest.mark.parametrize(
    "left, right, wanted",
    [
        ("openai", "openai inc", 0.75),
        ("software engineer", "software engineer ii", 0.9189),
        ("product manager", "product marketing manager", 0.75),
        ("san francisco ca", "sf ca us", 0.4167),
        ("", "", 1.0),
        ("", "x", 0.0),
    ],
)
def test_ratio(spark, left, right, wanted):
    rows = spark.createDataFrame([(left, right)], "a string, b string")
    assert rows.select(ratio("a", "b")).first()[0] == pytest.approx(wanted, abs=1e-4)


def test_run_labels(spark):
    at = "CAST('2031-01-01 00:00:00' AS TIMESTAMP)"
    end = "CAST('2031-01-01 00:03:05.6' AS TIMESTAMP)"
    assert one(spark, values.run_duration(F.expr(at), F.expr(end))) == "3m 6s"
    assert one(spark, values.run_duration(F.expr(at), F.expr("CAST(NULL AS TIMESTAMP)"))) == "—"
    # 0.4994 s as microseconds, 0.500 s between the milliseconds of both ends.
    at, end = (F.expr(f"CAST('2031-01-01 00:00:0{s}' AS TIMESTAMP_NTZ)") for s in ("0.000900", "0.500300"))
    assert one(spark, values.run_duration(at, end)) == "1s"
    assert one(spark, values.run_label(F.lit("success"), F.lit(0))) == "Success · 0 jobs"
