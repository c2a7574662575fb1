import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martwright import functions as fn
from martwright.sources.naming import schema_name_column, schema_name_for_env


def one(spark, column, **values):
    values = values or {"x": ("int", None)}
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    row = [tuple(v for _, v in values.values())]
    return spark.createDataFrame(row, names).select(column.alias("r")).first().r


DATES = [
    ("2018-02-26", dt.datetime(2018, 2, 26)),
    ("2018-02-26 9:05", dt.datetime(2018, 2, 26, 9, 5)),
    ("2018-2-26 9:5:7", dt.datetime(2018, 2, 26, 9, 5, 7)),
    ("2/6/2018", dt.datetime(2018, 2, 6)),
    ("02/26/2018 19:58:54", dt.datetime(2018, 2, 26, 19, 58, 54)),
    ("12/6/2018 7:", dt.datetime(2018, 12, 6, 7)),
    ("2018\\02\\26 19:58:54", dt.datetime(2018, 2, 26, 19, 58, 54)),
    (None, None),
    ("", None),
    ("   ", None),
    ("2018-2-6", None),
    ("2018-02-26 19", None),
    ("2018-02-26T10:00:00", None),
    ("2018-13-01 00:00:00", None),
    ("13/45/2018", None),
    ("next week", None),
]


def test_standardize_to_datetime(spark):
    df = spark.createDataFrame([(t,) for t, _ in DATES], "t string")
    got = [r.d for r in df.select(fn.standardize_to_datetime("t").alias("d")).collect()]
    assert got == [d for _, d in DATES]


def test_date_text_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # Midnight did not exist on this day in that zone.
        got = one(spark, fn.standardize_to_datetime("t"), t=("string", "2018-11-04"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == dt.datetime(2018, 11, 4)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("sao-paulo", "Sao-Paulo"),
        ("santa bárbara d'oeste", "Santa Bárbara D'Oeste"),
        ("ELDORADO DO SUL", "Eldorado Do Sul"),
        ("são joão\tdel-rei", "São João\tDel-Rei"),
        ("élan (novo)/b2b", "Élan (Novo)/B2b"),
        ("", ""),
        (None, None),
    ],
)
def test_initcap_words(spark, text, want):
    assert one(spark, fn.initcap_words("t"), t=("string", text)) == want


def test_clean_label(spark):
    assert one(spark, fn.clean_label("t"), t=("string", "cama_mesa_BANHO")) == "Cama Mesa Banho"


def test_ascii_clean(spark):
    text = "Ação\n“Größe” – œuvre Øl 100€ 日本 ñ"
    want = 'Acao"Grosse" - oeuvre Ol 100EUR  n'
    assert one(spark, fn.ascii_clean("t"), t=("string", text)) == want
    assert one(spark, fn.ascii_clean("t"), t=("string", None)) is None


def test_round_and_quotient(spark):
    assert one(spark, fn.r2(F.lit(1.005))) == Decimal("1.01")
    assert one(spark, fn.r2(F.lit(-2.675))) == Decimal("-2.68")
    assert one(spark, fn.quotient(F.lit(1), F.lit(3))) == Decimal("0.3333333333")
    assert one(spark, fn.quotient(F.lit(1), F.lit(0))) is None
    # The quotient is cut before it is scaled, as in exact numeric division step by step.
    assert one(spark, fn.r2(fn.quotient(F.lit(1), F.lit(1200)) * 30)) == Decimal("0.02")


def test_ladder(spark):
    low = fn.ladder("v", [(90, "a"), (80, "b")], "c")
    assert [one(spark, low, v=("double", v)) for v in (90.0, 89.99, 80.0, 79.99, None)] == list(
        "abbcc"
    )
    high = fn.ladder("v", [(30, 1), (60, 2)], 3, op="<=")
    assert [one(spark, high, v=("int", v)) for v in (30, 31, 60, 61, None)] == [1, 2, 2, 3, 3]


def test_days_and_hours(spark):
    t0, t1 = dt.datetime(2018, 1, 1, 12), dt.datetime(2018, 1, 3, 11, 30)
    span = {"a": ("timestamp_ntz", t1), "b": ("timestamp_ntz", t0)}
    assert one(spark, fn.whole_days_between("a", "b"), **span) == 1
    assert one(spark, fn.whole_days_between("b", "a"), **span) == -1
    assert one(spark, fn.hours_between("a", "b"), **span) == 47.5
    assert one(spark, fn.hours_between("b", "a"), **span) == -47.5


@pytest.mark.parametrize(
    ("kind", "channel", "tier"),
    [
        ("online_big", "Online", "Big"),
        ("online_other", "Online", None),
        ("offline", "Offline", None),
        ("industry", None, "Industry"),
        ("other", None, "Other"),
        (None, None, None),
    ],
)
def test_lead_types(spark, kind, channel, tier):
    assert one(spark, fn.lead_channel(F.col("k")), k=("string", kind)) == channel
    assert one(spark, fn.lead_tier(F.col("k")), k=("string", kind)) == tier


def test_recency_status_edges(spark):
    got = [
        one(spark, fn.recency_status(F.col("d")), d=("int", d))
        for d in (30, 31, 90, 91, 180, 181, None)
    ]
    assert got == ["Active", "At Risk", "At Risk", "Churning", "Churning", "Churned", "Churned"]


def test_schema_names(spark):
    for env, want in (("dev", "staging_dev"), ("uat", "staging_uat"), ("prod", "staging")):
        assert schema_name_for_env("staging", env) == want
        column = schema_name_column(F.lit("staging"), F.lit(env))
        assert one(spark, column) == want


def test_ascii_clean_knows_all_of_latin_1(spark):
    wanted = dict(
        zip(
            map(chr, range(0xA0, 0x100)),
            """| |!|C/|PS|$?|Y=|PIPE|SS|"|(c)|a|<<|!||(r)|-|deg|+-|2|3|'|u|P|*|,|1|o|>>|1/4|1/2|3/4|?|
            A|A|A|A|A|A|AE|C|E|E|E|E|I|I|I|I|D|N|O|O|O|O|O|x|O|U|U|U|U|Y|Th|ss|
            a|a|a|a|a|a|ae|c|e|e|e|e|i|i|i|i|d|n|o|o|o|o|o|/|o|u|u|u|u|y|th|y""".replace(
                "\n            ", ""
            )[1:].split("|"),
        )
    )
    wanted["¦"] = "|"
    assert len(wanted) == 96
    signs = spark.createDataFrame([(s, f"[{s}]") for s in wanted], "sign string, t string")
    got = dict(map(tuple, signs.select("sign", fn.ascii_clean("t")).collect()))
    assert got == {sign: f"[{ascii_form}]" for sign, ascii_form in wanted.items()}


def test_ascii_clean_of_typographic_signs(spark):
    signs = {"€": "EUR", "…": "...", "—": "--", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"',
             "•": "*", "™": "(tm)", "‹": "<", "›": ">", "‚": ",", "„": ",,", "−": "-", "ﬁ": "fi"}
    assert one(spark, fn.ascii_clean("t"), t=("string", "".join(signs))) == "".join(signs.values())


def test_ascii_clean_columns(spark):
    df = spark.createDataFrame([(1, "é", "ñº", None)], "n int, a string, b string, c string")
    assert tuple(fn.ascii_clean_columns(df).first()) == (1, "e", "no", None)
