"""The known cases: ages, loading, lookups, families, the newsletter table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clubledger.constants import NEWSLETTER_CATEGORIES
from clubledger.functions.normalise import member_number, parse_date
from clubledger.functions.people import age_at
from clubledger.operators import byexample, families, filters
from clubledger.operators.newsletter import newsletter_rows, newsletter_text
from clubledger.sources.exports import number_people, read_people

AS_OF = dt.date(2024, 2, 28)
# The known sample export and what is expected of it.
HEADER = (
    "MITGLIEDERNR;GESCHLECHT;VORNAME;NACHNAME;STRASSE;PLZ;ORT;GEBURTSDATUM;KATEGORIE;"
    "EMAIL;EMAIL ALTERNATIV;EMAILVEREIN"
)


def export_text(categories=("kat1", "kat2", "Aktive Turner", "Aktive Turner")):
    rows = [
        f"123;Männlich;vorname1;nachname1;strasse1;5436;ort1;01.01.99;{categories[0]};email1;email2;",
        f"456;Weiblich;vorname2;nachname2;strasse2;6390;ort2;02.02.00;{categories[1]};email3;;",
        f"789;Männlich;vorname3;nachname3;strasse3;6390;ort2;03.03.00;{categories[2]};email3;;",
        f";Weiblich;vorname4;nachname4;strasse4;1234;ort1;04.04.55;{categories[3]};;;",
        ";;;;;;;;;;;",
    ]
    return "﻿" + "\n".join([HEADER, *rows])


@pytest.fixture()
def people(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(export_text(), encoding="utf-8")
    return number_people(read_people(spark, str(path), AS_OF))


@pytest.mark.parametrize(
    "birthday, day, expected",
    [
        ("22.08.1996", dt.date(2023, 8, 21), 26),
        ("22.08.1996", dt.date(2023, 8, 22), 27),
        ("29.02.2000", dt.date(2023, 2, 28), 22),
        ("29.02.2000", dt.date(2023, 3, 1), 23),
    ],
)
def test_age(spark, birthday, day, expected):
    row = spark.range(1).select(age_at(parse_date(F.lit(birthday), AS_OF), day).alias("age"))
    assert row.first().age == expected


def test_people_load(people):
    rows = people.orderBy("pos").collect()
    assert [r.member_number for r in rows] == [123, 456, 789, None]
    assert [r.plz for r in rows] == ["5436", "6390", "6390", "1234"]
    assert [r.birthday for r in rows] == [
        dt.date(1999, 1, 1),
        dt.date(2000, 2, 2),
        dt.date(2000, 3, 3),
        dt.date(1955, 4, 4),
    ]
    assert [r.emails for r in rows] == [["email1", "email2"], ["email3"], ["email3"], []]
    assert [r.email for r in rows] == ["email1", "email3", "email3", None]
    assert not any(r.printed_magazine for r in rows)
    assert all(r.phone_m is None and r.date_added is None for r in rows)


def test_comma_separated_file_with_plus_quotes(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("MITGLIEDERNR,VORNAME,NACHNAME\n1,+Anna, Maria+,Muster\n2,Beat,Muster\n")
    rows = read_people(spark, str(path), AS_OF).orderBy("pos").collect()
    assert [(r.member_number, r.first_name) for r in rows] == [(1, "Anna, Maria"), (2, "Beat")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('MITGLIEDERNR;VORNAME;NACHNAME\n1;Anna;"Muster\nFrei"\n2;Beat;Gut\n')
    rows = read_people(spark, str(path), AS_OF, multi_line=True).orderBy("pos").collect()
    assert [(r.member_number, r.last_name) for r in rows] == [(1, "Muster\nFrei"), (2, "Gut")]


def test_parquet_file(spark, people, tmp_path):
    path = str(tmp_path / "people.parquet")
    spark.createDataFrame(
        [(1.0, "Anna", dt.date(2000, 1, 2)), (None, None, None)],
        "MITGLIEDERNR double, VORNAME string, GEBURTSDATUM date",
    ).write.parquet(path)
    rows = read_people(spark, path, AS_OF).collect()
    assert [(r.member_number, r.first_name, r.birthday) for r in rows] == [
        (1, "Anna", dt.date(2000, 1, 2))
    ]


def test_unknown_file_types_are_refused(spark):
    for name in ("people.xlsx", "people.doc"):
        with pytest.raises(ValueError):
            read_people(spark, name, AS_OF)


def test_lookups(people):
    assert filters.lookup(people, "first_name", "vorname1").count() == 1
    day = dt.date(1999, 1, 1)
    assert filters.lookup(people, "birthday", day, "gt").count() == 2
    assert filters.lookup(people, "birthday", day, "ge").count() == 3
    assert filters.lookup(people, "birthday", day, lambda a, b: a < b).count() == 1
    assert filters.lookup(people, "email", None).count() == 1
    assert filters.lookup(people, "member_number", None, "ne").count() == 3


def test_clear_by_example(spark, people):
    example = spark.createDataFrame([("vorname2", "nachname2")], "first_name string, last_name string")
    cleared = byexample.clear_matching(people, example, "email")
    assert filters.without_email(people).count() == 1
    assert filters.without_email(cleared).count() == 2
    assert cleared.columns == people.columns
    assert cleared.where("first_name = 'vorname2'").first().emails is None


def test_clear_by_full_records(people):
    # A record read from a file has lists, and an empty list only equals an empty one.
    same = people.where("first_name IN ('vorname1', 'vorname4')").drop("person_id")
    cleared = byexample.clear_matching(people, same, "email")
    assert filters.without_email(cleared).count() == 2
    no_emails = same.where("email IS NULL").withColumn("first_name", F.lit(None).cast("string"))
    hits = byexample.matching_people(people, no_emails)
    assert hits.count() == 1


def test_mail_families(spark, people):
    sizes = {r.email: r.n_people for r in families.mail_families(people).collect()}
    assert sizes == {"email1": 1, "email3": 2, None: 1}
    one_more = spark.createDataFrame([("email3",)], "email string")
    more = families.mail_families(families.add_people(people, one_more))
    assert {r.email: r.n_people for r in more.collect()} == {"email1": 1, "email3": 3, None: 1}
    assert families.families_with_value(people, "email", None, "email").count() == 1
    first_seen = [r.email for r in families.mail_families(people).orderBy("first_pos").collect()]
    assert first_seen == ["email1", "email3", None]


def test_newsletter_table(spark, tmp_path):
    path = tmp_path / "people.csv"
    categories = ("Aktive Turner", "Kitu (Kinder)", "Aktive Turner", "kat4")
    path.write_text(export_text(categories), encoding="utf-8")
    people = read_people(spark, str(path), AS_OF)
    table = newsletter_text(newsletter_rows(people, AS_OF)).orderBy("Email")
    assert table.columns[:6] == ["firstname", "lastname", "Email", "maennlich", "weiblich", "updated"]
    assert table.columns[6:] == list(NEWSLETTER_CATEGORIES)
    off = dict.fromkeys(NEWSLETTER_CATEGORIES, "False")
    assert [r.asDict() for r in table.collect()] == [
        {
            "firstname": "vorname1",
            "lastname": "nachname1",
            "Email": "email1",
            "maennlich": "True",
            "weiblich": "False",
            "updated": "28.02.2024",
            **off,
            "aktive_turner": "True",
        },
        {
            "firstname": "vorname2 & vorname3",
            "lastname": "nachname2 & nachname3",
            "Email": "email3",
            "maennlich": "True",
            "weiblich": "True",
            "updated": "28.02.2024",
            **off,
            "aktive_turner": "True",
            "kitu": "True",
        },
    ]


def test_member_numbers_are_exact(spark):
    texts = ["9007199254740993", "123.0", " 7 ", "12.7", "1e3", "x", "", None]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in table.select(member_number(table["t"])).collect()]
    assert found == [9007199254740993, 123, 7, None, None, None, None, None]
