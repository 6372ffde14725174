"""Club-shaped inputs derived from whole benchmark tables.

The SQL below is read by Spark to make the inputs of the queries and by the SQL
check to make the same inputs there; it uses only what both understand. People
come from ``orders`` (one person per order, families and households around the
customer), group rows from ``lineitem``, and the side lists from ``customer``,
``supplier`` and the people themselves. Every row of these tables makes a row of its list;
remainders, balances and dates only make up values, such as an address that nobody
has or a name that matches nobody.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2024, 2, 28)
ASSEMBLY_YEAR = 2015

# Coach rows of organ7 name an organ that is not in this list, on purpose.
ORGAN_GROUPS = {
    "organ1": ["Riege 1", "Riege 2"],
    "organ2": ["Riege 3"],
    "organ3": ["Jugi 1", "Jugi 5"],
    "organ4": ["Riege 7"],
    "organ5": ["Riege 8"],
    "organ6": ["Volleyball"],
}

# Member numbers: the order key as a rule. Some people share a number with
# others, some have none. Missing values occur in most columns.
PEOPLE = """
SELECT o_orderkey AS person_id, o_orderkey AS pos,
 CASE WHEN o_totalprice >= 490000 THEN NULL WHEN o_totalprice < 5000 THEN o_custkey
      ELSE o_orderkey END AS member_number,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Männlich'
      WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Weiblich'
      WHEN o_orderstatus = 'O' THEN 'Männlich' WHEN o_orderstatus = 'F' THEN 'Weiblich'
 END AS gender,
 concat('Vorname', CAST(day(o_orderdate) AS STRING)) AS first_name,
 concat(CASE WHEN o_orderstatus = 'F' THEN 'Ledig' ELSE 'Nachname' END,
        CAST(o_custkey AS STRING)) AS last_name,
 concat(CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'Dorfstr. ' ELSE 'Dorfstrasse ' END,
        CAST(o_custkey AS STRING)) AS street,
 CASE WHEN o_custkey % 50 > 0 THEN CAST(1000 + o_custkey % 50 AS STRING) END AS plz,
 concat('Ort', CAST(o_custkey % 50 AS STRING)) AS city,
 CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED')
      THEN DATE '1930-01-01' + CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 28000 AS INT) END AS birthday,
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_totalprice < 2500 THEN ''
      ELSE concat('familie', CAST(o_custkey AS STRING), '.', lower(o_orderstatus), '@example.org')
 END AS email,
 CASE CAST(FLOOR(o_totalprice) AS BIGINT) % 12
   WHEN 0 THEN 'Aktive Turner' WHEN 1 THEN 'Aktive Turnerin' WHEN 2 THEN 'Passivmitglied'
   WHEN 3 THEN 'Freimitg. Turnend (1)' WHEN 4 THEN 'Freimitg. nturnend (10)'
   WHEN 5 THEN 'Ehrenmitg. nturnend' WHEN 6 THEN 'Ehrenmitg. turnend' WHEN 7 THEN 'Mädchen'
   WHEN 8 THEN 'Knaben' WHEN 9 THEN 'Kitu (Kinder)' WHEN 10 THEN 'Gönner' END AS category,
 CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 6574
   WHEN '2-HIGH' THEN -3652 WHEN '3-MEDIUM' THEN -7305 WHEN '4-NOT SPECIFIED' THEN -10957
   ELSE -14610 END AS date_added,
 o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT' AS printed_magazine
FROM {orders}
"""

# The member export as text, the way it comes from the file: numbers with a
# decimal tail, blanks in phone numbers, two kinds of dates.
RAW_EXPORT = """
SELECT person_id, pos,
 CASE WHEN gender = 'Männlich' THEN concat(CAST(member_number AS STRING), '.0')
      ELSE CAST(member_number AS STRING) END AS MITGLIEDERNR,
 gender AS GESCHLECHT, first_name AS VORNAME, last_name AS NACHNAME, street AS STRASSE,
 CASE WHEN gender = 'Weiblich' AND plz IS NOT NULL THEN concat(plz, '.0')
      WHEN plz IS NULL THEN '' ELSE plz END AS PLZ,
 city AS ORT,
 CASE WHEN gender = 'Weiblich' THEN
   concat(lpad(CAST(day(birthday) AS STRING), 2, '0'), '.', lpad(CAST(month(birthday) AS STRING), 2, '0'),
          '.', lpad(CAST(year(birthday) % 100 AS STRING), 2, '0'))
  ELSE
   concat(lpad(CAST(day(birthday) AS STRING), 2, '0'), '.', lpad(CAST(month(birthday) AS STRING), 2, '0'),
          '.', CAST(year(birthday) AS STRING)) END AS birthday_text,
 birthday IS NULL AS no_birthday, category AS KATEGORIE,
 CASE WHEN gender = 'Weiblich' THEN NULL ELSE email END AS EMAIL,
 CASE WHEN gender = 'Weiblich' THEN email END AS EMAILVEREIN,
 CAST(date_added AS STRING) AS EINTRITT,
 concat('056 ', lpad(CAST(person_id % 1000 AS STRING), 3, '0'), ' 10 20') AS TELEFONP,
 CASE WHEN printed_magazine THEN '' ELSE 'VEREINSZEITSCHRIFT' END AS VEREINZEITSCHR
FROM {people}
"""

# The group file: repeats, unmatched numbers and blank function names included. A member
# is in one "Gruppe" at most, so no two of them share anybody.
ORGAN_ROWS = """
SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS row_id,
 CASE WHEN l_discount = 0 AND l_linenumber = 7 THEN NULL ELSE l_orderkey END AS member_number,
 CASE WHEN l_tax = 0.08 THEN 'Leiter' WHEN l_tax = 0.07 THEN 'Leiterin'
      WHEN l_tax = 0.06 AND l_linenumber = 1 THEN NULL
      WHEN l_tax = 0.05 AND l_linenumber = 2 THEN 'Kitu'
      WHEN l_tax = 0.04 AND l_linenumber = 1 THEN concat('Gruppe ', CAST(l_partkey % 150 AS STRING))
      WHEN l_returnflag = 'R' THEN concat('Jugi ', CAST(CAST(l_quantity AS INT) AS STRING))
      ELSE concat('Riege ', CAST(CAST(l_quantity AS INT) AS STRING)) END AS function_name,
 concat('organ', CAST(l_linenumber AS STRING)) AS organ
FROM {lineitem}
"""

# Households known to belong together: every customer's first and last order and, where
# the account balance is below 2000, the first order of the next customer.
HOUSEMATES = """
SELECT c.c_custkey AS group_pos,
 concat(CAST(a.lo AS STRING), ', ', CAST(a.hi AS STRING),
        CASE WHEN c.c_acctbal < 2000 AND b.lo IS NOT NULL THEN concat(', ', CAST(b.lo AS STRING))
        ELSE '' END) AS Mitgliedernummern
FROM {customer} c
JOIN (SELECT o_custkey AS custkey, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi
      FROM {orders} GROUP BY o_custkey) a ON a.custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey AS custkey, MIN(o_orderkey) AS lo
      FROM {orders} GROUP BY o_custkey) b ON b.custkey = c.c_custkey + 1
"""

# An older copy of the people, which has the address of those who had joined by then;
# some know the member number, the others only name and postal code, some only the name.
BACKUP = """
SELECT person_id AS ref_pos,
 CASE WHEN gender = 'Männlich' THEN member_number END AS member_number,
 first_name, last_name,
 CASE WHEN category IS NOT NULL THEN plz END AS plz,
 CASE WHEN category <> 'Knaben' AND date_added < DATE '1985-01-01'
      THEN concat('backup', CAST(person_id AS STRING), '@example.org') END AS email
FROM {people}
"""

# People to be cleared by example: a name each, with or without the postal code. Those
# born later are listed under a name that nobody has.
CLEAR_LIST = """
SELECT CASE WHEN birthday < DATE '1940-01-01' THEN first_name ELSE concat('Alt', first_name) END AS first_name,
 last_name, CASE WHEN gender = 'Männlich' THEN plz END AS plz
FROM {people}
"""

# Unsubscribed addresses, two for every customer: some listed twice, some that nobody has,
# some entries without an address.
REMOVELIST = """
SELECT CASE WHEN c_acctbal < 0 THEN concat('familie', CAST(c_custkey AS STRING), '.o@example.org')
 ELSE concat('ehemals', CAST(c_custkey AS STRING), '@example.org') END AS email
FROM {customer}
UNION ALL
SELECT CASE WHEN c_acctbal < -500 THEN concat('familie', CAST(c_custkey AS STRING), '.o@example.org')
 END AS email
FROM {customer}
"""

# Recipients who are not members; some are members' families too.
EXTRA = """
SELECT -1 - s_suppkey AS person_id, 1000000000000 + s_suppkey AS pos,
 concat('Kontakt', CAST(s_nationkey AS STRING)) AS first_name, s_name AS last_name,
 CASE WHEN s_acctbal < 2000 THEN concat('familie', CAST(s_suppkey AS STRING), '.o@example.org')
      ELSE concat('kontakt', CAST(s_suppkey AS STRING), '@example.org') END AS email
FROM {supplier}
"""

# The mailing service before the sync: current, stale and unknown addresses.
RECEIVERS = """
SELECT MIN(person_id) AS receiver_id,
 CASE WHEN MIN(date_added) < DATE '1990-01-01' THEN email ELSE concat('frueher.', email) END AS email,
 CASE WHEN MIN(first_name) = 'Vorname1' THEN NULL
      WHEN MIN(category) = 'Knaben' THEN DATE '2024-02-28' ELSE DATE '2024-01-31' END AS updated,
 CASE WHEN MIN(first_name) = 'Vorname2' THEN 'bounce' WHEN MAX(gender) = 'Männlich' THEN 'inactive'
      ELSE 'active' END AS status
FROM {people} WHERE email IS NOT NULL AND email <> ''
GROUP BY email
UNION ALL
SELECT 1000000000 + c_custkey AS receiver_id, concat('alt', CAST(c_custkey AS STRING), '@example.org') AS email,
 CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN DATE '2024-02-28'
      ELSE DATE '2023-12-31' END AS updated,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'inactive' ELSE 'active' END AS status
FROM {customer}
"""

# In dependency order.
DERIVED = {
    "people": PEOPLE,
    "raw_export": RAW_EXPORT,
    "organ_rows": ORGAN_ROWS,
    "housemates": HOUSEMATES,
    "backup": BACKUP,
    "clear_list": CLEAR_LIST,
    "removelist": REMOVELIST,
    "extra": EXTRA,
    "receivers": RECEIVERS,
}
TABLES = ["customer", "orders", "lineitem", "supplier"]


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a DataFrame."""
    sql = DERIVED[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    if "{people}" in sql:
        used["people"] = derived(spark, sf_dir, "people")
    return spark.sql(sql, **used)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members with their list of addresses."""
    table = derived(spark, sf_dir, "people")
    return table.withColumn("emails", F.when(F.col("email").isNotNull(), F.array("email")))


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text export under its file's column names."""
    table = derived(spark, sf_dir, "raw_export")
    birthday = F.when(~F.col("no_birthday"), F.col("birthday_text"))
    return table.withColumn("GEBURTSDATUM", birthday).drop("birthday_text", "no_birthday")


def with_clauses(names: list[str]) -> str:
    """The same inputs as a ``WITH`` prefix for the SQL check."""
    wanted = [n for n in DERIVED if n in names or (n == "people" and _needs_people(names))]
    bodies = []
    for name in wanted:
        body = DERIVED[name]
        for table in [*TABLES, "people"]:
            body = body.replace(f"{{{table}}}", table)
        bodies.append(f"{name} AS ({body.strip()})")
    return ",\n".join(bodies)


def _needs_people(names: list[str]) -> bool:
    return any("{people}" in DERIVED[n] for n in names)
