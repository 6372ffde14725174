"""Households, housemates and long lists against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from clubledger.operators import families, households
from clubledger.sources.exports import housemate_links

SCHEMA = (
    "person_id bigint, pos bigint, member_number bigint, first_name string, last_name string,"
    " street string, plz string, city string"
)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def links_of(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return housemate_links(spark.createDataFrame(rows, "group_pos bigint, Mitgliedernummern string"))


def random_people(seed, n=80):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        street = rnd.choice(["Dorfstr.", "DORFSTRASSE", "Dorfstrasse", "Weg"]) + f" {rnd.randint(1, 6)}"
        number = None if rnd.random() < 0.1 else rnd.randint(1, 60) if rnd.random() < 0.2 else 100 + i
        plz = None if rnd.random() < 0.1 else str(rnd.choice([5430, 5436]))
        rows.append((i, i, number, f"V{rnd.randint(0, 9)}", f"N{rnd.randint(0, 3)}", street, plz, "Ort"))
    return rows


def key_of(row):
    return (row[4], row[5].lower().replace("str.", "strasse"), row[6], row[7])


def expected_list(rows, texts=()):
    """Households merged over shared housemate groups, headed by the first link."""
    houses = {}
    for r in rows:
        houses.setdefault(key_of(r), []).append(r)
    order = list(houses)
    first_link, parent = {}, {k: k for k in houses}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for g, text in enumerate(texts):
        found = []
        for m, number in enumerate(text.split(", ")):
            home = next((k for k in order if any(p[2] == int(number) for p in houses[k])), None)
            if home is not None:
                found.append(home)
                first_link.setdefault(home, (g, m))
        for home in found[1:]:
            parent[root(home)] = root(found[0])
    merged = {}
    for k in houses:
        merged.setdefault(root(k), []).append(k)
    out = []
    for keys in merged.values():
        keys.sort(key=lambda k: first_link.get(k, (0, 0)))
        people = [p for k in keys for p in houses[k]]
        names = " & ".join(sorted({p[4] for p in people}))
        head = people[0]
        name = f"Fam. {names}" if len(people) > 1 else f"{head[3]} {head[4]}"
        listed = ", ".join(f"{p[3]} {p[4]}" for p in people)
        out.append((name, head[5], head[6], head[7], listed))
    return sorted(out, key=str)


def printed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("partitions", [1, 37])
def test_household_list(spark, seed, partitions):
    rows = random_people(seed)
    people = table(spark, rows).repartition(partitions)
    assert printed(households.household_list(people)) == expected_list(rows)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_housemates(spark, seed):
    rows = random_people(seed)
    rnd = random.Random(seed)
    numbers = [r[2] for r in rows if r[2] is not None]
    texts = [", ".join(str(x) for x in [*rnd.sample(numbers, rnd.randint(1, 3)), 9999]) for _ in range(8)]
    people = table(spark, rows).repartition(5)
    merged = households.combine_housemates(people, links_of(spark, texts))
    assert merged.count() == len(rows)
    assert printed(households.household_list(merged)) == expected_list(rows, texts)


def test_no_housemates_change_nothing(spark):
    rows = random_people(6)
    none = links_of(spark, ["9999, 9998"])
    merged = households.combine_housemates(table(spark, rows), none)
    assert printed(households.household_list(merged)) == expected_list(rows)


def test_merged_family_name_address_and_order(spark):
    rows = [
        (0, 0, 1, "Anna", "Meier", "Dorfstr. 1", "5436", "Ort"),
        (1, 1, 2, "Beat", "Huber", "Weg 2", "5430", "Dorf"),
        (2, 2, 3, "Cora", "Meier", "Dorfstrasse 1", "5436", "Ort"),
        (3, 3, 4, "Dino", "Frei", "Gasse 3", "5400", "Stadt"),
    ]
    merged = households.combine_housemates(table(spark, rows), links_of(spark, ["2, 1, 3"]))
    assert printed(households.household_list(merged)) == [
        ("Dino Frei", "Gasse 3", "5400", "Stadt", "Dino Frei"),
        ("Fam. Huber & Meier", "Weg 2", "5430", "Dorf", "Beat Huber, Anna Meier, Cora Meier"),
    ]


@pytest.mark.parametrize("linked", [False, True])
def test_large_household_is_one_row(spark, linked):
    rows = [(i, i, i, f"V{i}", "Gross", "Weg 1", "5436", "Ort") for i in range(25)]
    rows += [(100, 100, 100, "Eva", "Klein", "Gasse 2", "5436", "Ort")]
    people = table(spark, rows).repartition(3)
    texts = ["3, 100"] if linked else []
    if linked:
        people = households.combine_housemates(people, links_of(spark, texts))
    # In blocks of ten or of all: the same rows, as plain Python has them.
    for size in (10, 10_000):
        assert printed(households.household_list(people, size)) == expected_list(rows, texts)
    assert households.household_people(people).count() == len(rows)


def test_household_of_25000_is_one_row(spark):
    big = spark.range(25_000).selectExpr(
        "id AS person_id", "id AS pos", "id AS member_number", "concat('V', id) AS first_name",
        "'Gross' AS last_name", "'Weg 1' AS street", "'5436' AS plz", "'Ort' AS city",
    )
    others = big.withColumn("street", F.concat(F.lit("Gasse "), "pos"))
    others = others.withColumns({c: F.col(c) + 100_000 for c in ("person_id", "pos")})
    alone = households.household_list(big).collect()
    among = households.household_list(big.unionByName(others)).where("Strasse = 'Weg 1'").collect()
    assert len(alone) == 1 and alone == among
    assert alone[0].Personen == ", ".join(f"V{i} Gross" for i in range(25_000))


def test_list_is_sorted_missing_last(spark):
    rows = random_people(8)
    listed = households.sorted_household_list(households.household_list(table(spark, rows)))
    keys = [(r.PLZ is None, r.PLZ or "", r.Ort, r.Strasse, r.Name) for r in listed.collect()]
    assert keys == sorted(keys)
    assert listed.columns == ["Name", "Strasse", "PLZ", "Ort", "Personen"]


def test_household_lookup_and_extension(spark):
    rows = random_people(9)
    people = table(spark, rows)
    found = households.households_with_value(people, "first_name", "V1")
    expected = {key_of(r) for r in rows if r[3] == "V1"}
    assert {tuple(r)[:4] for r in found.collect()} == expected
    more = families.add_people(people, people.withColumn("person_id", F.col("person_id") + 1000))
    sizes = {tuple(r)[:4]: r.n_people for r in households.household_sizes(more).collect()}
    once = {tuple(r)[:4]: r.n_people for r in households.household_sizes(people).collect()}
    assert sizes == {k: 2 * n for k, n in once.items()}
