"""Fixed values of the domain: categories, group names, column names, formats.

Everything here is a value that results depend on; no logic lives here.
"""

# --- fixed values: member categories -----------------------------------------
ADULT_CATEGORIES = [
    "Aktive Turner",
    "Aktive Turnerin",
    "Passivmitglied",
    "Freimitg. Turnend (1)",
    "Freimitg. nturnend (10)",
    "Ehrenmitg. nturnend",
    "Ehrenmitg. turnend",
]
YOUTH_CATEGORIES = ["Mädchen", "Knaben", "Kitu (Kinder)"]
HONORARY_CATEGORIES = ["Ehrenmitg. nturnend", "Ehrenmitg. turnend"]
NON_ACTIVE_ADULT_CATEGORIES = [
    "Passivmitglied",
    "Freimitg. nturnend (10)",
    "Ehrenmitg. nturnend",
]
PRESCHOOL_CATEGORY = "Kitu (Kinder)"
PRESCHOOL_GROUP = "Kitu"

# --- fixed values: gender and salutation -------------------------------------
MALE = "Männlich"
FEMALE = "Weiblich"
GENDER_FLAGS = ["maennlich", "weiblich"]
SALUTATION_FEMALE = "Liebe"
SALUTATION_OTHER = "Lieber"

# --- fixed values: a group with one of these in its name is a youth group ----
YOUTH_GROUP_MARKERS = [
    "Meitliriege",
    "Knaben",
    "Jugi",
    "Kids",
    "Jugend",
    "klein",
    "Mädchen",
    "Elki",
    "Kitu",
]

# --- fixed values: function titles that mean "coach" -------------------------
COACH_FUNCTIONS = ["Leiter", "Leiterin"]
ROLE_LABELS = {"member": "Mitglied", "coach": "Leiter*in"}

# --- fixed values: member numbers whose group rows are ignored ---------------
EXCLUDED_MEMBER_NUMBERS = [317492, 871369]

# --- fixed values: tags -------------------------------------------------------
TAG_BASE_MEMBER = "BaseMember"
TAG_EXTRA_RECIPIENT = "NonMemberNewsletterRecipient"

# --- fixed values: export column -> record field ------------------------------
EXPORT_COLUMNS = {
    "gender": "GESCHLECHT",
    "first_name": "VORNAME",
    "last_name": "NACHNAME",
    "street": "STRASSE",
    "plz": "PLZ",
    "city": "ORT",
    "birthday": "GEBURTSDATUM",
    "category": "KATEGORIE",
    "date_added": "EINTRITT",
    "member_number": "MITGLIEDERNR",
    "phone_p": "TELEFONP",
    "phone_m": "TELEFONM",
    "phone_g": "TELEFONG",
    "printed_magazine": "VEREINZEITSCHR",
}
EXPORT_EMAIL_COLUMNS = ["EMAIL", "EMAIL ALTERNATIV", "EMAILVEREIN"]
GROUP_FILE_COLUMNS = {
    "member_number": "MITGLIEDERNR",
    "function_name": "FUNKTIOND",
    "organ": "ORGANTITEL",
}
HOUSEMATES_COLUMN = "Mitgliedernummern"
PRINTED_MAGAZINE_OPT_OUT = "VEREINSZEITSCHRIFT"

# --- fixed values: address list column -> record field ------------------------
ADDRESS_COLUMNS = {
    "Vorname": "first_name",
    "Nachname": "last_name",
    "Strasse": "street",
    "PLZ": "plz",
    "Ort": "city",
    "Geburtsdatum": "birthday",
    "Kategorie": "category",
    "Geschlecht": "gender",
    "Anrede": None,
    "Email": "email",
    "Beitrittsdatum": "date_added",
}

# --- fixed values: newsletter flag column -> member category ------------------
NEWSLETTER_CATEGORIES = {
    "aktive_turner": "Aktive Turner",
    "aktive_turnerin": "Aktive Turnerin",
    "passivmitglied": "Passivmitglied",
    "kitu": "Kitu (Kinder)",
    "maedchen": "Mädchen",
    "knaben": "Knaben",
    "freimitglied_turnend": "Freimitg. Turnend (1)",
    "freimitglied_nicht_turnend": "Freimitg. nturnend (10)",
    "ehrenmitglied_nicht_turnend": "Ehrenmitg. nturnend",
    "ehrenmitglied_turnend": "Ehrenmitg. turnend",
}

# --- fixed values: organ title of a coach row -> groups coached ---------------
ORGAN_GROUPS = {
    "12 Frauen 30+ ø Frauen 30+": ["Frauen 30+"],
    "24 MuKi/ElKi ø MuKi/ElKi": ["Elki"],
    "15 Netzball ø Netzball": ["Netzball"],
    "7 Unihockey Herren ø Unihockey Herren": ["Unihockey Herren 1", "Unihockey Herren 2"],
    "23 Laufträff ø Laufträff": ["Laufträff"],
    "19 Faustball ø Faustball": ["Faustball"],
    "17 Senioren ø Senioren": ["Senioren"],
    "14 Volleyball ø Volleyball": ["Volleyball 2", "Volleyball 1", "Volleyball 3"],
    "2 Aktive U30 Damen ø Aktive U30 Damen": ["Aktive U30 Damen"],
    "1 Unihockey Damen ø Unihockey Damen": ["Unihockey Damen"],
    "18 Seniorinnen ø Seniorinnen": ["Seniorinnen"],
    "10 Leichtathletik Kids ø Leichtathletik Kids": ["Leichtathletik Kids"],
    "21 VGT Damen ø VGT Damen": ["VGT Damen"],
    "16 Männerriege ø Männerriege": ["Männerriege"],
    "8 Kitu ø Kitu": ["Kitu"],
    "22 Aerobic ø Aerobic": ["Aerobic"],
    "3 Meitliriege ø Meitliriege": [
        "Meitliriege 2",
        "Meitliriege 4",
        "Meitliriege 1",
        "Meitliriege 5",
        "Meitliriege 3",
    ],
    "11 Aktive U30 Herren ø Aktive U30 Herren": ["Aktive U30 Herren"],
    "13 Frauen 50+ ø Frauen 50+": ["Frauen 50+"],
    "9 Getu Mädchen ø Getu Mädchen": ["Getu Mädchen"],
    "4 Jugi ø Jugi": ["Jugi mittel", "Jugi klein", "Jugi gross"],
    "6 Unihockey Knaben ø Unihockey Knaben": ["Unihockey Knaben"],
    "42 VGT Jugend ø VGT Jugend": ["VGT Jugend"],
    "43 Unihockey Kids ø Unihockey Kids": ["Unihockey Kids"],
}

# --- fixed values: yearly assembly --------------------------------------------
ANNIVERSARIES = [25, 30, 40, 50, 60, 70, 80]
ADULT_AGE_OFFSET = 17

# --- fixed values: mailing service --------------------------------------------
RECEIVER_SOURCE = "User Import"
RECEIVER_TYPES = ["active", "inactive", "all", "bounce"]
UPSERT_OK = "update success"
DELETE_OK = "success"

# --- fixed values: statistics text, label and figure --------------------------
STATISTICS_LABELS = {
    "Total Number of Members": "total",
    "Number of Adults": "adults",
    "Men": "men",
    "active Men": "active_men",
    "passive or non-active Men": "passive_men",
    "Women": "women",
    "active Women": "active_women",
    "passive or non-active Women": "passive_women",
    "Number of Children": "children",
    "Boys": "boys",
    "Girls": "girls",
    "Oldest Member (years)": "max_age",
    "Youngest Member (years)": "min_age",
}

# --- fixed values: date formats (Spark patterns) ------------------------------
DISPLAY_DATE = "dd.MM.yyyy"
SHORT_YEAR_DATE = "dd.MM.yy"
ISO_DATE = "yyyy-MM-dd"
