"""From files to lists: load a small club and write everything."""

import dataclasses
import csv
import datetime as dt
import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clubledger.__main__ import parse, run
from clubledger.operators.quality import DataQualityError
from clubledger.operators.sync import store_snapshot
from clubledger.plans.ledger import load_ledger
from clubledger.sinks.files import write_list
from clubledger.sources.exports import read_group_rows, read_housemates, read_table

AS_OF = dt.date(2024, 2, 28)
COLUMNS = (
    "MITGLIEDERNR;GESCHLECHT;VORNAME;NACHNAME;STRASSE;PLZ;ORT;GEBURTSDATUM;KATEGORIE;EINTRITT;"
    "EMAIL;EMAIL ALTERNATIV;EMAILVEREIN;TELEFONM;VEREINZEITSCHR"
)
MEMBERS = [
    "1;Männlich;Anton;Frei;Dorfstr. 1;5436;Ort;01.02.1980;Aktive Turner;03.04.1999;a@x;;;079 1 2;",
    "2;Weiblich;Berta;Frei;Dorfstrasse 1;5436;Ort;05.06.1985;Aktive Turnerin;07.08.2014;a@x;;;;",
    "3;Weiblich;Clara;Gut;Weg 2;5430;Dorf;09.10.1950;Ehrenmitg. turnend;11.12.1975;;;;;",
    "4;Männlich;Dario;Gut;Weg 2;5430;Dorf;01.01.1998;Knaben;02.02.2010;d@x;;;;VEREINSZEITSCHRIFT",
    "5;Weiblich;Elsa;Hug;Gasse 3;5400;Stadt;03.03.2019;Kitu (Kinder);04.04.2023;e@x;f@x;;;",
    "317492;Weiblich;Fritz;Alt;Gasse 9;5400;Stadt;03.03.1930;Passivmitglied;04.04.1965;u@x;;;;",
]
GROUPS = [
    "1;Männerriege;8 Kitu ø Kitu",
    "1;Leiter;14 Volleyball ø Volleyball",
    "2;Volleyball 1;14 Volleyball ø Volleyball",
    "2;Volleyball 1;14 Volleyball ø Volleyball",
    "3;Leiterin;8 Kitu ø Kitu",
    "317492;Männerriege;",
    "99;Männerriege;",
    ";;",
]


@pytest.fixture(scope="module")
def club(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("club")

    def put(name, header, rows, encoding="utf-8"):
        path = folder / name
        path.write_text("\n".join([header, *rows]) + "\n", encoding=encoding)
        return str(path)

    extra = ["900;Weiblich;Gina;Gast;Allee 4;5000;Fern;;;;g@x;;;;", ";;Hans;Gast;;;;;;;u@x;;;;"]
    backup = [
        "3;Weiblich;Clara;Gut;Weg 2;5430;Dorf;09.10.1950;Passivmitglied;11.12.1975;clara@x;;;;",
        "3;Weiblich;Clara;Gut;;;;;;;later@x;;;;",
        "5;Weiblich;Elsa;Hug;;;;;;;other@x;;;;",
    ]
    return {
        "members": put("members.csv", COLUMNS, MEMBERS),
        "groups": put("groups.csv", "MITGLIEDERNR;FUNKTIOND;ORGANTITEL", GROUPS, "latin1"),
        "extra": put("extra.csv", COLUMNS, extra),
        "removed": put("abmeldungen.csv", COLUMNS, [";;;;;;;;;;u@x;;;;", ";;;;;;;;;;e@x;;;;"]),
        "backup": put("backup.csv", COLUMNS, backup),
        "housemates": put("housemates.csv", "Mitgliedernummern", ["3, 5", "77, 1"]),
    }


@pytest.fixture(scope="module")
def ledger(spark, club):
    return load_ledger(spark, as_of=AS_OF, **club)


def read_csv(path):
    rows = []
    for part in sorted(Path(path).rglob("part-*.csv")):
        with open(part, encoding="utf-8", newline="") as f:
            rows += [(part.parent.name, r) for r in csv.DictReader(f)]
    return rows


def test_people(ledger):
    rows = {r.first_name: r for r in ledger.people.collect()}
    assert len(rows) == 8
    assert rows["Anton"].email == "a@x" and rows["Anton"].phone_m == "07912"
    assert rows["Elsa"].email is None and rows["Elsa"].emails is None
    assert rows["Fritz"].email is None
    assert rows["Hans"].email == "u@x"
    assert rows["Anton"].tags == ["BaseMember"]
    assert rows["Gina"].tags == ["NonMemberNewsletterRecipient"]
    assert rows["Dario"].printed_magazine is False and rows["Clara"].printed_magazine is True
    order = [r.first_name for r in ledger.people.orderBy("pos").collect()]
    assert order == ["Anton", "Berta", "Clara", "Dario", "Elsa", "Fritz", "Gina", "Hans"]
    assert ledger.people.select("person_id").distinct().count() == 8


def test_newsletter_and_sync(spark, ledger):
    rows = {r.Email: r for r in ledger.newsletter().collect()}
    assert set(rows) == {"a@x", "d@x", "g@x", "u@x"}
    assert rows["a@x"].firstname == "Anton & Berta" and rows["a@x"].lastname == "Frei"
    snapshot = spark.createDataFrame(
        [(1, "a@x", None, "inactive"), (2, "old@x", dt.date(2023, 1, 1), "active")],
        "receiver_id bigint, email string, updated date, status string",
    )
    log, after = ledger.sync(snapshot)
    assert {tuple(r) for r in log.collect()} == {
        ("a@x", "update"),
        ("a@x", "activate"),
        ("d@x", "insert"),
        ("g@x", "insert"),
        ("u@x", "insert"),
        ("old@x", "delete"),
    }
    assert {r.email: r.status for r in after.collect()} == dict.fromkeys(rows, "active")


def test_sync_reports_and_confirms(spark, ledger):
    schema = "receiver_id bigint, email string, updated date, status string"
    rows = [(1, "a@x", None, "inactive"), (2, "old@x", None, "active"), (3, "old@x", None, "active"), (4, None, None, "active")]
    snapshot = spark.createDataFrame(rows, schema)
    log, after = ledger.sync(snapshot)
    actions = {tuple(r) for r in log.collect()}
    assert {("old@x", "repeated address"), (None, "missing address")} <= actions
    results = spark.createDataFrame(
        [("a@x", "push", "update success"), ("d@x", "push", "invalid"), ("g@x", "push", "update success"), ("old@x", "delete", "success")],
        "email string, step string, status string",
    )
    failed, confirmed = ledger.confirm(snapshot, log, after, results)
    assert {tuple(r) for r in failed.collect()} == {("d@x", "insert", "invalid"), ("u@x", "insert", None), (None, "delete", None)}
    assert {r.email for r in confirmed.collect()} == {"a@x", "g@x"}
    strict = dataclasses.replace(ledger, strict=True)
    with pytest.raises(DataQualityError):
        strict.confirm(snapshot, log, after, results)
    with pytest.raises(DataQualityError):
        strict.sync(spark.createDataFrame([(1, "a@x", None, "asleep")], schema))


def test_sync_of_a_stored_snapshot_and_clustered_people(spark, club, ledger):
    schema = "receiver_id bigint, email string, updated date, status string"
    rows = [(1, "a@x", None, "inactive"), (2, "old@x", None, "active"), (4, None, None, "active")]
    snapshot = spark.createDataFrame(rows, schema)
    log, after = ledger.sync(snapshot)
    clustered = load_ledger(spark, as_of=AS_OF, clustered=True, **club)
    log2, after2 = clustered.sync(store_snapshot(snapshot, f"mailing_{uuid.uuid4().hex}"))
    assert sorted(map(str, log.collect())) == sorted(map(str, log2.collect()))
    assert sorted(map(str, after.collect())) == sorted(map(str, after2.collect()))
    assert sorted(map(str, ledger.no_mail().collect())) == sorted(map(str, clustered.no_mail().collect()))


def test_lists(ledger):
    def names(df):
        return sorted(r.Vorname for r in df.collect())

    assert names(ledger.no_mail()) == ["Clara", "Elsa", "Fritz"]
    assert names(ledger.honorary_no_mail()) == ["Clara"]
    assert names(ledger.joined_between(dt.date(1999, 4, 3), dt.date(2014, 8, 7))) == ["Anton"]
    assert names(ledger.joined_between(None, None)) == ["Anton", "Berta", "Clara", "Fritz"]
    assert names(ledger.youth_born_in(1998)) == ["Dario"]
    assert [(r.Vorname, r.Email) for r in ledger.lost_emails().collect()] == [("Clara", "clara@x")]
    lists = {(r.list_name, r.Vorname) for r in ledger.assembly_lists(2015).collect()}
    assert lists == {
        ("neumitglieder", "Berta"),
        ("jubilare_40", "Clara"),
        ("jubilare_50", "Fritz"),
        ("jugenduebertritte", "Dario"),
    }
    with pytest.raises(ValueError):
        ledger.assembly_lists(15)
    salutations = {r.Vorname: r.Anrede for r in ledger.joined_between(None, None).collect()}
    assert salutations["Anton"] == "Lieber" and salutations["Clara"] == "Liebe"


def test_magazine_list(ledger):
    rows = [tuple(r) for r in ledger.magazine_list().collect()]
    # Gina and Hans have a blank cell in the magazine column, which counts as yes.
    assert rows == [
        ("Gina Gast", "Allee 4", "5000", "Fern", "Gina Gast"),
        ("Fritz Alt", "Gasse 9", "5400", "Stadt", "Fritz Alt"),
        ("Fam. Gut & Hug", "Weg 2", "5430", "Dorf", "Clara Gut, Elsa Hug"),
        ("Fam. Frei", "Dorfstr. 1", "5436", "Ort", "Anton Frei, Berta Frei"),
        ("Hans Gast", None, None, None, "Hans Gast"),
    ]


def test_groups(ledger):
    bag = sorted((r.riege, r.Vorname, r.Funktion) for r in ledger.rosters().collect())
    assert bag == [
        ("Kitu", "Clara", "Leiter*in"),
        ("Kitu", "Elsa", "Mitglied"),
        ("Männerriege", "Anton", "Mitglied"),
        ("Volleyball 1", "Anton", "Leiter*in"),
        ("Volleyball 1", "Berta", "Mitglied"),
        ("Volleyball 1", "Berta", "Mitglied"),
        ("Volleyball 2", "Anton", "Leiter*in"),
        ("Volleyball 3", "Anton", "Leiter*in"),
    ]
    cells = {(r.riege, r.other): r.n for r in ledger.overlap().collect()}
    assert cells[("Volleyball 1", "Volleyball 1")] == 3
    assert cells[("Volleyball 1", "Männerriege")] == 1
    assert cells[("Männerriege", "Volleyball 1")] == 1
    assert len(cells) == 16


def test_statistics(ledger):
    row = ledger.statistics().first().asDict()
    assert row["total"] == 6 and row["adults"] == 4 and row["children"] == 2
    assert row["men"] == 1 and row["women"] == 3 and row["passive_women"] == 1
    assert row["boys"] == 1 and row["girls"] == 1
    assert row["max_age"] == 93 and row["min_age"] == 4
    text = ledger.statistics_text().first().statistics
    assert "Total Number of Members: 6" in text and "Oldest Member (years): 93" in text


def test_exports(ledger, tmp_path):
    out = str(tmp_path)
    rosters = read_csv(ledger.export("rosters", out))
    assert {folder for folder, _ in rosters} == {
        f"riege={g}" for g in ("Kitu", "Männerriege", "Volleyball 1", "Volleyball 2", "Volleyball 3")
    }
    assert (tmp_path / "rosters" / "export_28.02.2024").is_dir()
    assert rosters[0][1]["Geburtsdatum"].count(".") == 2
    newsletter = read_csv(ledger.export("newsletter", out))
    assert {r["maennlich"] for _, r in newsletter} <= {"True", "False"}
    assert {r["updated"] for _, r in newsletter} == {"28.02.2024"}
    assembly = read_csv(ledger.export("assembly_lists", out, year=2015))
    assert ("list_name=jubilare_40", "Clara") in {(f, r["Vorname"]) for f, r in assembly}
    # One file cut into parts, with the groups as a header at its head.
    parts = sorted(Path(ledger.export("overlap", out)).glob("part-*"))
    matrix = list(csv.DictReader("".join(p.read_text() for p in parts).splitlines()))
    assert {r["riege"]: r["Volleyball 2"] for r in matrix}["Volleyball 1"] == "1"
    assert len(read_csv(ledger.export("no_mail", out))) == 3
    assert len(read_csv(ledger.export("magazine_list", out))) == 5
    assert len(read_csv(ledger.export("joined_between", out, begin=None, end=None))) == 4
    where = ledger.export("receivers", out)
    lines = [x for p in Path(where).glob("part-*") for x in p.read_text().splitlines()]
    assert {json.loads(x)["email"] for x in lines} == {"a@x", "d@x", "g@x", "u@x"}
    parquet = ledger.export("statistics", out, fmt="parquet")
    assert list(Path(parquet).glob("*.parquet"))


def test_strict_loading(spark, club, tmp_path):
    load_ledger(spark, as_of=AS_OF, strict=True, **club)
    bad = tmp_path / "groups.csv"
    bad.write_text("MITGLIEDERNR;FUNKTIOND;ORGANTITEL\n1;Leiter;unbekannt\n", encoding="latin1")
    with pytest.raises(DataQualityError):
        load_ledger(spark, as_of=AS_OF, strict=True, **{**club, "groups": str(bad)})


def test_members_alone(spark, club):
    alone = load_ledger(spark, club["members"], club["groups"], AS_OF)
    assert alone.people.count() == 6
    assert alone.lost_emails().count() == 0
    assert alone.magazine_list().count() == 4


def test_group_file_is_read_as_latin1(spark, club):
    rows = read_group_rows(spark, club["groups"]).orderBy("row_id").collect()
    assert len(rows) == 7
    assert rows[0].function_name == "Männerriege" and rows[0].organ == "8 Kitu ø Kitu"


def test_housemate_file(spark, club):
    rows = read_housemates(spark, club["housemates"]).orderBy("group_pos", "member_pos").collect()
    assert [(r.member_pos, r.member_number) for r in rows] == [(0, 3), (1, 5), (0, 77), (1, 1)]
    assert read_housemates(spark, None).count() == 0


def test_positions_follow_the_file_across_blocks(spark, tmp_path):
    path = tmp_path / "long.csv"
    lines = [f"{i};x{i};{'y' * 50}" for i in range(5000)]
    path.write_text("\n".join(["MITGLIEDERNR;VORNAME;NACHNAME", *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = read_table(spark, str(path), multi_line=False)
        assert table.rdd.getNumPartitions() > 4
        numbers = [int(r.MITGLIEDERNR) for r in table.orderBy("pos").select("MITGLIEDERNR").collect()]
        assert numbers == list(range(5000))
        sizes = table.groupBy(
            F.col("pos").withField("row", F.floor(F.col("pos.row") / 10)).alias("b")
        ).count()
        assert sizes.agg(F.max("count")).first()[0] <= 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_command_line(spark, club, tmp_path):
    files = [f"--{k}={v}" for k, v in club.items()]
    common = [*files, f"--out={tmp_path}", "--as-of=2024-02-28"]
    run(spark, parse(["youth_born_in", "--year=1998", *common]))
    assert [r["Vorname"] for _, r in read_csv(tmp_path / "youth_born_in")] == ["Dario"]
    snapshot = str(tmp_path / "before.parquet")
    spark.createDataFrame(
        [(1, "old@x", None, "active")],
        "receiver_id bigint, email string, updated date, status string",
    ).write.parquet(snapshot)
    run(spark, parse(["sync", f"--snapshot={snapshot}", *common]))
    log = {(r["email"], r["action"]) for _, r in read_csv(tmp_path / "change_log")}
    assert ("old@x", "delete") in log and ("a@x", "insert") in log
    assert spark.read.parquet(str(tmp_path / "snapshot")).count() == 4
    for wrong in (["youth_born_in", *common], ["sync", *common], ["unknown", *common]):
        with pytest.raises(SystemExit):
            parse(wrong)


def test_quotes_and_blanks_survive(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('MITGLIEDERNR;VORNAME;NACHNAME\n1;"Hans ""Hansi""; jun.";" Muster "\n')
    rows = read_table(spark, str(path)).drop("pos")
    assert [tuple(r) for r in rows.collect()] == [("1", 'Hans "Hansi"; jun.', " Muster ")]
    out = str(tmp_path / "out")
    write_list(rows.withColumn("leer", F.lit("")).withColumn("nichts", F.lit(None).cast("string")), out)
    ((_, row),) = read_csv(out)
    assert row["VORNAME"] == 'Hans "Hansi"; jun.' and row["NACHNAME"] == " Muster "
    assert row["leer"] == "" and row["nichts"] == ""
    with pytest.raises(ValueError):
        write_list(rows, out + "2", fmt="xlsx")


def test_line_breaks_inside_quotes_are_one_record(spark, tmp_path):
    path = tmp_path / "members.csv"
    path.write_text('A;B;C\n1;"two\nlines";x\n2;"a ""b""";\n3\n', encoding="utf-8")
    rows = read_table(spark, str(path)).orderBy("pos").drop("pos").collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines", "x"), ("2", 'a "b"', None), ("3", None, None)]


def test_cells_beyond_the_last_column_are_refused(spark, tmp_path):
    path = tmp_path / "groups.csv"
    path.write_text("MITGLIEDERNR;FUNKTIOND;ORGANTITEL\n1;a;b\n2;a;b;c\n", encoding="ISO-8859-1")
    with pytest.raises(Exception, match="more cells than columns"):
        read_group_rows(spark, str(path)).collect()
    mates = tmp_path / "mates.csv"
    mates.write_text("Mitgliedernummern\n1, 2\n3, 4;5\n", encoding="utf-8")
    with pytest.raises(Exception, match="more cells than columns"):
        read_housemates(spark, str(mates)).collect()
