"""The registered queries in plain SQL, for an independent check."""

from __future__ import annotations

from clubledger.constants import NEWSLETTER_CATEGORIES
from clubledger.workload.inputs import with_clauses

AS_OF = "DATE '2024-02-28'"
ADULT = (
    "('Aktive Turner', 'Aktive Turnerin', 'Passivmitglied', 'Freimitg. Turnend (1)', "
    "'Freimitg. nturnend (10)', 'Ehrenmitg. nturnend', 'Ehrenmitg. turnend')"
)
PASSIVE = "('Passivmitglied', 'Freimitg. nturnend (10)', 'Ehrenmitg. nturnend')"
HONORARY = "('Ehrenmitg. nturnend', 'Ehrenmitg. turnend')"
YOUTH = "('Mädchen', 'Knaben', 'Kitu (Kinder)')"


def _with(inputs: list[str], body: str, recursive: bool = False) -> str:
    body = body.strip()
    start = "WITH RECURSIVE " if recursive else "WITH "
    more = ",\n" + body.removeprefix("WITH ") if body.startswith("WITH ") else "\n" + body
    return start + with_clauses(inputs) + more


def _address(p: str = "") -> str:
    return f"""{p}first_name AS Vorname, {p}last_name AS Nachname, {p}street AS Strasse,
 {p}plz AS PLZ, {p}city AS Ort, {p}birthday AS Geburtsdatum, {p}category AS Kategorie,
 {p}gender AS Geschlecht, CASE WHEN {p}gender = 'Weiblich' THEN 'Liebe' ELSE 'Lieber' END AS Anrede,
 {p}email AS Email, {p}date_added AS Beitrittsdatum"""


def _age(birthday: str, day: str) -> str:
    return f"""year({day}) - year({birthday}) - CASE WHEN month({day}) * 100 + day({day})
 < month({birthday}) * 100 + day({birthday}) THEN 1 ELSE 0 END"""


FLAGS = ",\n ".join(
    f"coalesce(bool_or(category = '{v}'), false) AS {k}" for k, v in NEWSLETTER_CATEGORIES.items()
)


def _newsletter(source: str) -> str:
    return f"""SELECT coalesce(string_agg(DISTINCT first_name, ' & ' ORDER BY first_name), '') AS firstname,
 coalesce(string_agg(DISTINCT last_name, ' & ' ORDER BY last_name), '') AS lastname, email AS Email,
 coalesce(bool_or(gender = 'Männlich'), false) AS maennlich,
 coalesce(bool_or(gender = 'Weiblich'), false) AS weiblich,
 {AS_OF} AS updated,
 {FLAGS}
FROM {source} WHERE email IS NOT NULL AND email <> '' GROUP BY email"""


_TRUTH = ["maennlich", "weiblich", *NEWSLETTER_CATEGORIES]
_PRINTED = ",\n ".join(f"CASE WHEN {c} THEN 'True' ELSE 'False' END AS {c}" for c in _TRUTH)
_PRINT = f"""SELECT firstname, lastname, Email, '28.02.2024' AS updated,
 {_PRINTED} FROM rows_"""
_RECORD = ["firstname", "lastname", "maennlich", "weiblich", "updated", *NEWSLETTER_CATEGORIES]
_ATTRIBUTES = ["firstname", "lastname", "updated", *_TRUTH]
_PAYLOAD = "\nUNION ALL ".join(
    f"SELECT Email AS email, 'User Import' AS source, '{c}' AS attribute, {c} AS attribute_value FROM printed"
    for c in _ATTRIBUTES
)

STREET_KEY = "replace(lower(street), 'str.', 'strasse')"
HOUSE = f"last_name, {STREET_KEY} AS street_key, plz, city"

# Group rows joined to their one person; the numbers that are ignored do occur
# only in large data.
MATCHED = """usable AS (SELECT * FROM organ_rows WHERE member_number IS NOT NULL
  AND member_number NOT IN (317492, 871369)),
owners AS (SELECT member_number, COUNT(*) AS owners, MIN(person_id) AS person_id FROM people
  WHERE member_number IS NOT NULL GROUP BY member_number),
matched AS (SELECT u.*, o.person_id, coalesce(u.function_name IN ('Leiter', 'Leiterin'), false) AS coach
  FROM usable u JOIN owners o ON o.member_number = u.member_number WHERE o.owners = 1)"""
ORGAN_MAP = """organ_map AS (SELECT * FROM (VALUES ('organ1', 'Riege 1'), ('organ1', 'Riege 2'),
  ('organ2', 'Riege 3'), ('organ3', 'Jugi 1'), ('organ3', 'Jugi 5'), ('organ4', 'Riege 7'),
  ('organ5', 'Riege 8'), ('organ6', 'Volleyball')) t(organ, riege))"""
BAG = f"""WITH {MATCHED},
{ORGAN_MAP},
bag AS (SELECT person_id, function_name AS riege, 'member' AS role FROM matched
   WHERE NOT coach AND function_name IS NOT NULL
 UNION ALL SELECT m.person_id, g.riege, 'coach' FROM matched m JOIN organ_map g ON g.organ = m.organ
   WHERE m.coach
 UNION ALL SELECT person_id, 'Kitu', 'member' FROM people WHERE category = 'Kitu (Kinder)')"""
YOUTH_TEST = " OR ".join(
    f"contains(riege, '{m}')"
    for m in ("Meitliriege", "Knaben", "Jugi", "Kids", "Jugend", "klein", "Mädchen", "Elki", "Kitu")
)
CELLS = f"""{BAG},
grown AS (SELECT * FROM bag WHERE NOT ({YOUTH_TEST})),
counted AS (SELECT riege, person_id, COUNT(*) AS k FROM grown GROUP BY riege, person_id),
cells AS (SELECT a.riege, b.riege AS other, CAST(SUM(a.k) AS BIGINT) AS n FROM counted a
  JOIN counted b ON a.person_id = b.person_id GROUP BY a.riege, b.riege)"""

LIST_COLUMNS = """CASE WHEN COUNT(*) > 1 THEN 'Fam. ' || string_agg(DISTINCT last_name, ' & ' ORDER BY last_name)
   ELSE MIN(first_name || ' ' || last_name) END AS Name"""

BEST_OFFER = """WITH offers AS (
 SELECT p.person_id, arg_min(b.email, b.ref_pos) AS filled FROM people p JOIN backup b
  ON p.first_name = b.first_name AND p.last_name = b.last_name
  AND (b.member_number IS NULL OR b.member_number = p.member_number)
  AND (b.plz IS NULL OR b.plz = p.plz)
 WHERE p.email IS NULL AND b.email IS NOT NULL GROUP BY p.person_id)"""

MAIN = """prepared AS (
 SELECT p.person_id, p.member_number, p.first_name, p.last_name, p.street, p.plz, p.city, p.birthday,
  p.category, p.gender, CASE WHEN r.email IS NULL THEN p.email END AS email, p.date_added,
  'BaseMember' AS tags
 FROM people p LEFT JOIN (SELECT DISTINCT email FROM removelist WHERE email IS NOT NULL) r
  ON r.email = p.email
 UNION ALL SELECT person_id, NULL, first_name, last_name, NULL, NULL, NULL, NULL, NULL, NULL, email, NULL,
  'NonMemberNewsletterRecipient' FROM extra)"""
MAIN_INPUTS = ["people", "removelist", "extra"]
MERGED = f"""WITH {MAIN},
incoming AS (SELECT DISTINCT email FROM prepared WHERE email IS NOT NULL AND email <> ''),
pushed AS (
 SELECT r.receiver_id, coalesce(r.email, i.email) AS email, r.receiver_id IS NOT NULL AS known,
  i.email IS NOT NULL AS incoming, CASE WHEN i.email IS NOT NULL THEN {AS_OF} ELSE r.updated END AS updated,
  coalesce(r.status, 'active') AS status
 FROM receivers r FULL JOIN incoming i ON r.email = i.email)"""
SYNC_INPUTS = [*MAIN_INPUTS, "receivers"]

SQL: dict[str, str] = {
    "newsletter": _with(["people"], _newsletter("people")),
    "newsletter_print": _with(["people"], f"WITH rows_ AS ({_newsletter('people')})\n{_PRINT}"),
    "newsletter_payload": _with(
        ["people"],
        f"WITH rows_ AS ({_newsletter('people')}),\nprinted AS ({_PRINT})\n{_PAYLOAD}",
    ),
    "receiver_attributes": _with(
        ["people"],
        f"""WITH rows_ AS ({_newsletter('people')}),
printed AS ({_PRINT}),
payload AS ({_PAYLOAD})
SELECT DISTINCT attribute FROM payload""",
    ),
    "normalised_people": _with(
        ["people"],
        """SELECT person_id, member_number, gender, first_name, last_name, street, plz, city, birthday,
 CASE WHEN email <> '' THEN email END AS email,
 CAST(CASE WHEN email <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_emails,
 '056' || lpad(CAST(person_id % 1000 AS VARCHAR), 3, '0') || '1020' AS phone_p,
 CAST(NULL AS VARCHAR) AS phone_m, category, date_added, printed_magazine FROM people""",
    ),
    "ages": _with(
        ["people"],
        f"SELECT person_id, birthday, CAST({_age('birthday', AS_OF)} AS BIGINT) AS age FROM people",
    ),
    "age_at_entry": _with(
        ["people"],
        f"SELECT person_id, CAST({_age('birthday', 'date_added')} AS BIGINT) AS age FROM people",
    ),
    "person_labels": _with(
        ["people"],
        """SELECT person_id, first_name || ' ' || last_name || ' - '
 || coalesce(CAST(member_number AS VARCHAR), '') AS label FROM people""",
    ),
    "text_keys": _with(
        ["people"],
        f"""SELECT person_id, {STREET_KEY} AS street_key,
 replace(lower(gender), 'ä', 'ae') AS gender_key FROM people""",
    ),
    "youth_groups": _with(
        ["organ_rows"],
        f"""WITH names AS (SELECT DISTINCT function_name AS riege FROM organ_rows
 WHERE function_name IS NOT NULL)
SELECT riege, {YOUTH_TEST} AS youth FROM names""",
    ),
    "tags_added": _with(["people"], "SELECT person_id, 'BaseMember,Neu' AS tags FROM people"),
    "property_cleared": _with(
        ["people"],
        """SELECT person_id, CASE WHEN city <> 'Ort7' THEN city END AS city,
 CASE WHEN category IS DISTINCT FROM 'Gönner' THEN email END AS email,
 CASE WHEN category IS DISTINCT FROM 'Gönner' AND email IS NOT NULL THEN CAST(1 AS BIGINT) END AS n_emails
FROM people""",
    ),
    "lookup_equal": _with(
        ["people"],
        "SELECT person_id, first_name, last_name FROM people WHERE first_name = 'Vorname1'",
    ),
    "lookup_missing": _with(
        ["people"], "SELECT person_id, last_name FROM people WHERE birthday IS NULL"
    ),
    "lookup_compared": _with(
        ["people"],
        """SELECT person_id, birthday FROM people
WHERE birthday >= DATE '1999-01-01' AND birthday < DATE '2005-01-01'""",
    ),
    "addresses": _with(["people"], f"SELECT person_id, {_address()} FROM people"),
    "adults_joined": _with(
        ["people"],
        f"""SELECT {_address()} FROM people WHERE category IN {ADULT}
 AND date_added >= DATE '1986-01-01' AND date_added < DATE '1987-01-01'""",
    ),
    "adults_joined_since": _with(
        ["people"],
        f"SELECT {_address()} FROM people WHERE category IN {ADULT} AND date_added >= DATE '2014-01-01'",
    ),
    "youth_born_in_1998": _with(
        ["people"],
        f"SELECT {_address()} FROM people WHERE category IN {YOUTH} AND year(birthday) = 1998",
    ),
    "assembly_lists": _with(
        ["people"],
        f"""WITH lists AS (
 SELECT 'neumitglieder' AS list_name, p.* FROM people p
  WHERE category IN {ADULT} AND date_added >= DATE '2014-01-01'
 UNION ALL SELECT 'jubilare_' || CAST(y AS VARCHAR), p.* FROM people p
  JOIN (VALUES (25), (30), (40), (50), (60), (70), (80)) t(y) ON year(date_added) = 2015 - y
  WHERE category IN {ADULT}
 UNION ALL SELECT 'jugenduebertritte', p.* FROM people p
  WHERE category IN {YOUTH} AND year(birthday) = 1998)
SELECT person_id, list_name, {_address()} FROM lists""",
    ),
    "no_mail": _with(["people"], f"SELECT {_address()} FROM people WHERE email IS NULL"),
    "honorary_no_mail": _with(
        ["people"],
        f"SELECT {_address()} FROM people WHERE email IS NULL AND category IN {HONORARY}",
    ),
    "magazine_recipients": _with(
        ["people"], f"SELECT {_address()} FROM people WHERE printed_magazine"
    ),
    "statistics": _with(
        ["people"],
        f"""WITH base AS (SELECT coalesce(category IN {ADULT}, false) AS adult,
  coalesce(category IN {PASSIVE}, false) AS passive, coalesce(gender = 'Männlich', false) AS male,
  {_age('birthday', AS_OF)} AS age FROM people)
SELECT COUNT(*) AS total, COUNT(*) FILTER (adult) AS adults,
 COUNT(*) FILTER (adult AND male) AS men, COUNT(*) FILTER (adult AND male AND NOT passive) AS active_men,
 COUNT(*) FILTER (adult AND male AND passive) AS passive_men,
 COUNT(*) FILTER (adult AND NOT male) AS women,
 COUNT(*) FILTER (adult AND NOT male AND NOT passive) AS active_women,
 COUNT(*) FILTER (adult AND NOT male AND passive) AS passive_women,
 COUNT(*) FILTER (NOT adult) AS children, COUNT(*) FILTER (NOT adult AND male) AS boys,
 COUNT(*) FILTER (NOT adult AND NOT male) AS girls,
 CAST(MAX(age) AS BIGINT) AS max_age, CAST(MIN(age) AS BIGINT) AS min_age FROM base""",
    ),
    "mail_families": _with(
        ["people"],
        "SELECT email, COUNT(*) AS n_people, MIN(pos) AS first_pos FROM people GROUP BY email",
    ),
    "mail_family_first_names": _with(
        ["people"], "SELECT DISTINCT email, first_name FROM people WHERE first_name IS NOT NULL"
    ),
    "mail_family_lookup": _with(
        ["people"],
        """SELECT email, COUNT(*) AS n_people, MIN(pos) AS first_pos FROM people
GROUP BY email HAVING bool_or(first_name = 'Vorname7')""",
    ),
    "mail_families_extended": _with(
        ["people", "extra"],
        """WITH everyone AS (SELECT email, pos FROM people UNION ALL SELECT email, pos FROM extra)
SELECT email, COUNT(*) AS n_people, MIN(pos) AS first_pos FROM everyone GROUP BY email""",
    ),
    "household_sizes": _with(
        ["people"],
        f"""SELECT {HOUSE}, COUNT(*) AS n_people, MIN(pos) AS first_pos FROM people
GROUP BY last_name, {STREET_KEY}, plz, city""",
    ),
    "household_lookup": _with(
        ["people"],
        f"""SELECT {HOUSE}, COUNT(*) AS n_people, MIN(pos) AS first_pos FROM people
GROUP BY last_name, {STREET_KEY}, plz, city HAVING bool_or(birthday IS NULL)""",
    ),
    "household_list": _with(
        ["people"],
        f"""SELECT {LIST_COLUMNS}, arg_min(street, pos) AS Strasse, plz AS PLZ, city AS Ort,
 string_agg(first_name || ' ' || last_name, ', ' ORDER BY pos) AS Personen
FROM people WHERE printed_magazine GROUP BY last_name, {STREET_KEY}, plz, city""",
    ),
    # The label of a household is the smallest household number that can be
    # reached over the housemate groups.
    "household_list_merged": _with(
        ["people", "housemates"],
        f"""WITH printed AS (SELECT *, {STREET_KEY} AS street_key FROM people WHERE printed_magazine),
houses AS (SELECT last_name, street_key, plz, city, MIN(pos) AS house FROM printed
  GROUP BY last_name, street_key, plz, city),
residents AS (SELECT p.*, h.house FROM printed p JOIN houses h ON h.last_name = p.last_name
  AND h.street_key = p.street_key AND h.plz IS NOT DISTINCT FROM p.plz AND h.city = p.city),
links AS (SELECT group_pos, CAST(trim(number) AS BIGINT) AS member_number, member_pos
  FROM (SELECT group_pos, unnest(string_split(Mitgliedernummern, ', ')) AS number,
   generate_subscripts(string_split(Mitgliedernummern, ', '), 1) AS member_pos FROM housemates) u),
numbered AS (SELECT member_number, MIN(house) AS house FROM residents
  WHERE member_number IS NOT NULL GROUP BY member_number),
listed AS (SELECT l.group_pos, l.member_pos, n.house FROM links l
  JOIN numbered n ON n.member_number = l.member_number),
pairs AS (SELECT DISTINCT a.house AS x, b.house AS y FROM listed a JOIN listed b ON a.group_pos = b.group_pos),
reach AS (SELECT x AS node, x AS seen FROM pairs
  UNION SELECT r.node, p.y FROM reach r JOIN pairs p ON p.x = r.seen),
labels AS (SELECT node, MIN(seen) AS label FROM reach GROUP BY node),
first_link AS (SELECT house, MIN(group_pos * 1000 + member_pos) AS link FROM listed GROUP BY house),
placed AS (SELECT r.*, coalesce(l.label, r.house) AS label, coalesce(f.link, 0) AS link FROM residents r
  LEFT JOIN labels l ON l.node = r.house LEFT JOIN first_link f ON f.house = r.house)
SELECT {LIST_COLUMNS}, arg_min(street, link * 1000000000 + pos) AS Strasse,
 nullif(arg_min(coalesce(plz, ''), link * 1000000000 + pos), '') AS PLZ,
 arg_min(city, link * 1000000000 + pos) AS Ort,
 string_agg(first_name || ' ' || last_name, ', ' ORDER BY link, pos) AS Personen
FROM placed GROUP BY label""",
        recursive=True,
    ),
    "housemate_numbers": _with(
        ["people", "housemates"],
        """SELECT group_pos, member_pos - 1 AS member_pos, CAST(number AS BIGINT) AS member_number
FROM (SELECT group_pos, unnest(string_split(Mitgliedernummern, ', ')) AS number,
 generate_subscripts(string_split(Mitgliedernummern, ', '), 1) AS member_pos FROM housemates) u""",
    ),
    "group_memberships": _with(
        ["people", "organ_rows"], f"{BAG}\nSELECT person_id, riege, role FROM bag"
    ),
    "group_rosters": _with(
        ["people", "organ_rows"],
        f"""{BAG}
SELECT b.riege, {_address('p.')}, CASE WHEN b.role = 'coach' THEN 'Leiter*in' ELSE 'Mitglied' END AS Funktion
FROM bag b JOIN people p ON p.person_id = b.person_id""",
    ),
    "group_sizes": _with(
        ["people", "organ_rows"],
        f"{BAG}\nSELECT riege, role, COUNT(*) AS n_entries FROM bag GROUP BY riege, role",
    ),
    "member_groups": _with(
        ["people", "organ_rows"],
        f"{BAG}\nSELECT riege FROM bag WHERE role = 'member' UNION SELECT 'Kitu' AS riege",
    ),
    "unknown_organs": _with(
        ["people", "organ_rows"],
        f"""WITH {MATCHED},
{ORGAN_MAP}
SELECT organ, COUNT(*) AS n_rows FROM matched
WHERE coach AND organ NOT IN (SELECT organ FROM organ_map) GROUP BY organ""",
    ),
    "dropped_memberships": _with(
        ["people", "organ_rows"],
        """WITH owners AS (SELECT member_number, COUNT(*) AS owners FROM people
  WHERE member_number IS NOT NULL GROUP BY member_number),
reasons AS (SELECT CASE WHEN r.member_number IS NULL THEN 'no number'
  WHEN r.member_number IN (317492, 871369) THEN 'excluded' WHEN o.owners IS NULL THEN 'unmatched'
  WHEN o.owners > 1 THEN 'ambiguous' END AS reason
  FROM organ_rows r LEFT JOIN owners o ON o.member_number = r.member_number)
SELECT reason, COUNT(*) AS n_rows FROM reasons WHERE reason IS NOT NULL GROUP BY reason""",
    ),
    "group_overlap": _with(["people", "organ_rows"], f"{CELLS}\nSELECT riege, other, n FROM cells"),
    "group_matrix": _with(
        ["people", "organ_rows"],
        f"""{CELLS},
names AS (SELECT DISTINCT riege FROM grown)
SELECT a.riege, b.riege AS other, coalesce(c.n, 0) AS n FROM names a CROSS JOIN names b
LEFT JOIN cells c ON c.riege = a.riege AND c.other = b.riege""",
    ),
    "unsubscribed": _with(
        ["people", "removelist"],
        """WITH rest AS (SELECT person_id, CASE WHEN email NOT IN
  (SELECT email FROM removelist WHERE email IS NOT NULL) THEN email END AS email FROM people)
SELECT person_id, email, CASE WHEN email IS NOT NULL THEN CAST(1 AS BIGINT) END AS n_emails FROM rest""",
    ),
    "email_backfill": _with(
        ["people", "backup"],
        f"""{BEST_OFFER}
SELECT p.person_id, coalesce(p.email, o.filled) AS email, coalesce(p.email, o.filled) AS first_of_emails
FROM people p LEFT JOIN offers o ON o.person_id = p.person_id""",
    ),
    "lost_emails": _with(
        ["people", "backup"],
        f"""{BEST_OFFER},
found AS (SELECT p.* REPLACE (o.filled AS email) FROM people p JOIN offers o ON o.person_id = p.person_id)
SELECT person_id, {_address()} FROM found""",
    ),
    "cleared_by_example": _with(
        ["people", "clear_list"],
        """SELECT p.person_id, CASE WHEN NOT EXISTS (SELECT 1 FROM clear_list c
  WHERE c.first_name = p.first_name AND c.last_name = p.last_name
  AND (c.plz IS NULL OR c.plz = p.plz)) THEN p.email END AS email FROM people p""",
    ),
    "extra_recipients": _with(
        ["people", "extra"],
        """SELECT person_id, email, 'BaseMember' AS tags FROM people
UNION ALL SELECT person_id, email, 'NonMemberNewsletterRecipient' FROM extra""",
    ),
    "prepared_people": _with(MAIN_INPUTS, f"WITH {MAIN}\nSELECT * FROM prepared"),
    "prepared_newsletter": _with(MAIN_INPUTS, f"WITH {MAIN}\n{_newsletter('prepared')}"),
    "sync_change_log": _with(
        SYNC_INPUTS,
        f"""{MERGED}
SELECT email, 'insert' AS action FROM pushed WHERE NOT known
UNION ALL SELECT email, 'update' FROM pushed WHERE known AND incoming
UNION ALL SELECT email, 'delete' FROM pushed WHERE updated IS DISTINCT FROM {AS_OF}
UNION ALL SELECT email, 'activate' FROM pushed WHERE updated = {AS_OF} AND status = 'inactive'""",
    ),
    "sync_snapshot": _with(
        SYNC_INPUTS,
        f"""{MERGED}
SELECT receiver_id, email, updated, CASE WHEN status = 'inactive' THEN 'active' ELSE status END AS status
FROM pushed WHERE updated = {AS_OF}""",
    ),
    "sync_pushed": _with(
        SYNC_INPUTS, f"{MERGED}\nSELECT receiver_id, email, updated, status FROM pushed"
    ),
    "sync_attributes": _with(
        SYNC_INPUTS,
        f"""{MERGED},
rows_ AS ({_newsletter('prepared')}),
printed AS ({_PRINT}),
payload AS ({_PAYLOAD}),
kept AS (SELECT * FROM pushed WHERE updated = {AS_OF})
SELECT email, attribute, attribute_value FROM payload
UNION ALL SELECT email, 'note', 'alt' FROM kept WHERE known
UNION ALL SELECT email, 'firstname', 'Alt' FROM kept WHERE known AND NOT incoming""",
    ),
    "lookup_not_missing": _with(
        ["people"], "SELECT person_id, birthday FROM people WHERE birthday IS NOT NULL"
    ),
    "group_matrix_wide": _with(
        ["people", "organ_rows"],
        f"""{CELLS},
names AS (SELECT DISTINCT riege FROM grown)
SELECT a.riege, b.riege AS other, coalesce(c.n, 0) AS n FROM names a CROSS JOIN names b
LEFT JOIN cells c ON c.riege = a.riege AND c.other = b.riege""",
    ),
    "memberships_without_excluded": _with(
        ["people", "organ_rows"],
        f"""{BAG.replace("(317492, 871369)", "(3, 7, 32)")}
SELECT riege, role, COUNT(*) AS n_entries FROM bag GROUP BY riege, role""",
    ),
    "preschool_conflicts": _with(
        ["people", "organ_rows"],
        f"""WITH {MATCHED}
SELECT m.person_id FROM matched m JOIN people p ON p.person_id = m.person_id
WHERE NOT m.coach AND m.function_name = 'Kitu' AND p.category = 'Kitu (Kinder)'""",
    ),
    "address_problems": _with(
        ["people"],
        "SELECT email, COUNT(*) AS n FROM people GROUP BY email HAVING COUNT(*) > 1 OR email IS NULL",
    ),
    "saved_filter": _with(
        ["people", "receivers"],
        f"SELECT * FROM receivers WHERE updated IS DISTINCT FROM {AS_OF} AND status <> 'active'",
    ),
    "failed_sync_actions": _with(
        SYNC_INPUTS,
        f"""{MERGED},
answered AS (SELECT email, known, incoming, updated, CASE WHEN snapshot_status = 'bounce' THEN 'failed'
  WHEN snapshot_updated IS NOT NULL THEN 'fine' END AS answer
  FROM (SELECT p.*, r.status AS snapshot_status, r.updated AS snapshot_updated FROM pushed p
    LEFT JOIN receivers r ON r.email = p.email) b)
SELECT email, CASE WHEN NOT incoming THEN 'delete' WHEN known THEN 'update' ELSE 'insert' END AS action,
 answer AS status FROM answered
WHERE (answer IS NULL OR answer = 'failed') AND (incoming OR updated IS DISTINCT FROM {AS_OF})""",
    ),
    "receiver_records": _with(
        ["people"],
        f"""WITH rows_ AS ({_newsletter('people')}),
printed AS ({_PRINT})
SELECT concat('{{"email":"', Email, '","source":"User Import","attributes":{{}},"global_attributes":{{',
 {", ',', ".join(f"""'"{c}":"', {c}, '"'""" for c in _RECORD)},
 '}},"tags":[],"orders":[]}}') AS value FROM printed""",
    ),
    "receivers_deleted": _with(
        ["people", "receivers"], f"SELECT * FROM receivers WHERE updated = {AS_OF}"
    ),
    "stale_receivers": _with(
        ["people", "receivers"],
        f"SELECT * FROM receivers WHERE updated <> {AS_OF} OR updated IS NULL",
    ),
    "inactive_receivers": _with(
        ["people", "receivers"], "SELECT email FROM receivers WHERE status = 'inactive'"
    ),
    "bounced_receivers": _with(
        ["people", "receivers"], "SELECT * FROM receivers WHERE status = 'bounce'"
    ),
}
_STATS = """SELECT COUNT(*) AS total_count, COUNT(*) FILTER (status = 'active') AS active_count,
 COUNT(*) FILTER (status = 'inactive') AS inactive_count,
 COUNT(*) FILTER (status = 'bounce') AS bounce_count FROM receivers"""
SQL["receiver_stats"] = _with(["people", "receivers"], _STATS)
SQL["stale_receiver_stats"] = _with(
    ["people", "receivers"], f"{_STATS} WHERE updated IS DISTINCT FROM {AS_OF}"
)
SQL["excluded_memberships"] = SQL["dropped_memberships"].replace("(317492, 871369)", "(3, 7, 32)")
SQL["household_list_printed"] = f"""SELECT row_number() OVER (ORDER BY PLZ NULLS LAST, Ort NULLS LAST,
 Strasse NULLS LAST, Name NULLS LAST, Personen NULLS LAST) AS position, * FROM ({SQL['household_list']}) listed"""
SQL["stored_adults_joined"] = SQL["adults_joined"]
SQL["stored_lookup_number"] = _with(
    ["people"],
    "SELECT person_id, member_number, first_name, last_name FROM people WHERE member_number = 7",
)
_SOME_GONE = MERGED.replace(
    "FROM receivers r FULL JOIN",
    "FROM (SELECT * REPLACE (CASE WHEN status <> 'bounce' THEN email END AS email) FROM receivers) r FULL JOIN",
)
SQL["sync_stored"] = _with(
    SYNC_INPUTS,
    f"""{_SOME_GONE}
SELECT receiver_id, email, updated, CASE WHEN status = 'inactive' THEN 'active' ELSE status END AS status
FROM pushed WHERE updated = {AS_OF}""",
)
