"""Patterns, word lists, label maps and texts.

Everything in this module is data that decides results (what counts as a phone
number, which words are car brands, how a legend reads).  Patterns are written
without flags; ``functions.spans`` adds the Unicode flag when it compiles them.
"""

# --- fixed values: phone numbers --------------------------------------------
PHONES = [
    r"\b0\d{1,2}[/.\s]\d{2,3}[/.\s]\d{2}[/.\s]\d{2}\b",
    r"\+32\s+[2-9]\s+\d{3}\s+\d{2}\s+\d{2}",
    r"\+?32\s?\d{9}",
    r"\+?32\s?\d{3}\s?\d{2}\s?\d{2}\s?\d{2}",
    r"\b0[4-9]\d{2}[/.\s]?\d{2}[/.\s]?\d{2}[/.\s]?\d{2}\b",
    r"\+?31\s?\d{9}",
    r"\+?31\s?6\s?\d{4}\s?\d{4}",
    r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}",
    r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
    r"\+?1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\+?44\s?\d{2,4}\s?\d{3,4}\s?\d{4}",
    r"\b0\d{2,4}\s?\d{3,4}\s?\d{4}\b",
    r"\+?33\s?\d{9}",
    r"\+?33\s?\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}",
    r"\b0\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}\b",
    r"\+?49\s?\d{2,4}\s?\d{6,8}",
    r"\b0\d{2,4}\s?\d{6,8}\b",
    r"\+?212\s?\d{9}",
    r"\+?79\s?\d{9}",
    r"\+\d{2,3}\s?\d{8,12}",
]

# --- fixed values: e-mail ----------------------------------------------------
EMAIL_LOCAL = r"[a-zA-Z0-9._%+-]"
EMAIL = EMAIL_LOCAL + r"+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# --- fixed values: bank accounts ---------------------------------------------
IBANS = [
    r"\bBE\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\b",
    r"\bNL\d{2}\s?[A-Z]{4}\s?\d{4}\s?\d{4}\s?\d{2}\b",
    r"\bDE\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}\b",
    r"\bFR\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{3}\b",
    r"\bGB\d{2}\s?[A-Z]{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}\b",
    r"\bES\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\b",
    r"\bIT\d{2}\s?[A-Z]\d{3}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{3}\b",
    r"\b[A-Z]{2}\d{2}\s?[A-Z0-9]{4}(?:\s?[A-Z0-9]{4}){2,6}\b",
]

# --- fixed values: dates of birth --------------------------------------------
DATE = r"\b\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b"
DOB_CUES = [
    "geboren op", "geboren", "geboortedatum", "geboortedatum:",
    "birth", "date of birth", "dob", "born on", "born",
    "né le", "née le", "naissance", "date de naissance",
    "geboren am", "geburtsdatum", "geb.",
    "°", "*",
]

# --- fixed values: addresses -------------------------------------------------
ADDRESSES = [
    r"[A-Z][a-zé]+(?:straat|laan|weg|plein|singel|dreef|lei|steenweg|kaai)[a-z]*\s+\d+(?:/[A-Z]?\d+)?",
    r"\b[1-9]\d{3} [A-Z][a-z]+\b",
    r"\b\d{4}\s?[A-Z]{2}\s+[A-Z][a-z]+(?:\s+\([A-Za-z]+\))?",
    r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Way|Court|Ct|Place|Pl)\b",
    r"\b\d{5}(?:-\d{4})?\b",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b",
    r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b",
    r"\b\d+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:Street|Road|Lane|Avenue|Gardens|Square|Terrace|Close|Crescent)\b",
    r"\b\d+\s+(?:rue|avenue|boulevard|place|allée|chemin|impasse)\s+(?:de\s+(?:la\s+)?|du\s+|des\s+)?[A-Z][a-zé-]+(?:\s+[A-Z][a-zé-]+)*\b",
    r"\b\d{5}\s+[A-Z][a-zé-]+(?:-[A-Z][a-zé-]+)*\b",
    r"\b[A-Z][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse)\s+\d+[a-z]?\b",
    r"\b\d{5}\s+[A-Z][a-zäöüß]+\b",
]

# --- fixed values: national identity numbers ---------------------------------
NATIONAL_IDS = [
    (r"\b\d{9}\b", "NL_BSN"),
    (r"\b\d{8}[-.\s]?\d{1}\b", "NL_BSN"),
    (r"\b\d{2}\.?\d{2}\.?\d{2}[-.\s]?\d{3}[-.\s]?\d{2}\b", "BE_NATIONAL"),
    (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "US_SSN"),
    (r"\b[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]\b", "UK_NI"),
    (r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", "FR_INSEE"),
    (r"\b\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}\s?\d\b", "DE_SOZVERS"),
    (r"\b[A-Z]\d{8}\b", "DE_PERSO"),
    (r"\b\d{8}[-\s]?[A-Z]\b", "ES_DNI"),
    (r"\b[XYZ][-\s]?\d{7}[-\s]?[A-Z]\b", "ES_NIE"),
    (r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", "IT_CF"),
    (r"\b[A-Z]{1,2}\d{6,8}\b", "PASSPORT"),
]
ID_CUES = [
    "bsn", "burgerservicenummer", "sofinummer", "sofi-nummer",
    "nationaal nummer", "rijksregisternummer", "identiteitskaartnummer",
    "national number", "id number",
    "ssn", "social security", "national insurance", "ni number",
    "passport", "driver license", "driving licence",
    "numéro de sécurité sociale", "numéro insee", "passeport",
    "sozialversicherungsnummer", "personalausweis", "reisepass",
    "dni", "nie", "documento nacional",
    "codice fiscale",
]
SSN_CUES = ["ssn", "social security"]
BSN_WEIGHTS = [9, 8, 7, 6, 5, 4, 3, 2, -1]

# --- fixed values: places ----------------------------------------------------
PLACES = [
    "Antwerpen", "Gent", "Brugge", "Leuven", "Mechelen", "Aalst", "Hasselt",
    "Sint-Niklaas", "Kortrijk", "Oostende", "Genk", "Roeselare", "Dendermonde",
    "Turnhout", "Lokeren", "Beveren", "Vilvoorde", "Waregem", "Ieper",
    "Herentals", "Diest", "Tongeren", "Lommel", "Tienen", "Maasmechelen",
    "Geraardsbergen", "Ninove", "Wetteren", "Brasschaat", "Beringen",
    "Temse", "Knokke-Heist", "Mol", "Aarschot", "Izegem", "Eeklo",
    "Deinze", "Halle", "Dilsen-Stokkem", "Pelt", "Zottegem", "Oudenaarde",
    "Menen", "Willebroek", "Zele", "Wevelgem", "Bree", "Bornem",
    "Brussel", "Brussels", "Bruxelles", "Schaarbeek", "Anderlecht", "Molenbeek",
    "Etterbeek", "Elsene", "Ixelles", "Ukkel", "Uccle", "Jette", "Evere",
    "Sint-Gillis", "Sint-Jans-Molenbeek", "Vorst", "Forest", "Watermaal-Bosvoorde",
    "Luik", "Liège", "Charleroi", "Namen", "Namur", "Bergen", "Mons",
    "La Louvière", "Doornik", "Tournai", "Seraing", "Verviers", "Moeskroen",
    "Châtelet", "Binche", "Soignies", "Ath", "Eupen", "Malmedy", "Arlon",
    "Zaventem", "Mortsel", "Boom", "Kapellen", "Schoten", "Wijnegem",
    "Merksem", "Deurne", "Berchem", "Hoboken", "Borgerhout", "Wilrijk",
    "Amsterdam", "Rotterdam", "Den Haag", "'s-Gravenhage", "Utrecht",
    "Eindhoven", "Tilburg", "Groningen", "Almere", "Breda", "Nijmegen",
    "Enschede", "Apeldoorn", "Haarlem", "Arnhem", "Zaanstad", "Amersfoort",
    "Haarlemmermeer", "Dordrecht", "Leiden", "Zoetermeer", "Maastricht",
    "Delft", "Deventer", "Alkmaar", "Venlo", "Hilversum", "Heerlen",
    "Roosendaal", "Oss", "Schiedam", "Spijkenisse", "Helmond",
    "Aken", "Aachen", "Keulen", "Köln", "Düsseldorf", "Dusseldorf",
    "Bonn", "Duisburg", "Essen", "Mönchengladbach",
]
PREPOSITION_PLACE = r"(?:te|in|naar|uit|van|bij)\s+([A-Z][a-zé-]+(?:-[A-Z][a-zé]+)?)\b"
NOT_A_PLACE_AFTER_PREPOSITION = ["het", "de", "een", "dit", "dat", "deze"]

LOCATION_MARKERS = [
    r"\bte\s+([A-Z][a-zA-Zé\-]+(?:\s*-\s*[A-Z][a-zA-Zé]+)?)",
    r"\brichting\s+([A-Z][a-zA-Zé\-]+)",
    r"\bnaar\s+([A-Z][a-zA-Zé\-]+)",
    r"\bvanuit\s+([A-Z][a-zA-Zé\-]+)",
    r"\bvia\s+([A-Z][a-zA-Zé\-]+)",
    r"\bt\.?h\.?v\.?\s+([A-Z][a-zA-Zé\-]+)",
    r"\bter hoogte van\s+([A-Z][a-zA-Zé\-]+)",
    r"\b\d{4}[ ]+([A-Z][a-zA-Zé\-]+)\b",
    r"\b\d{4}[ ]*[A-Z]{2}[ ]+([A-Z][a-zA-Zé\-]+)\b",
    r"\b([A-Z]{3,})\s+\d{4}\b",
    r"\brichting\s+([a-zA-Z][a-zA-Zé\-]+)",
]
NOT_A_PLACE_AFTER_MARKER = [
    "het", "de", "een", "van", "naar", "met", "voor", "door", "over",
    "België", "Nederland", "Duitsland", "Frankrijk",
    "Politie", "Justitie", "Parket", "Rechtbank",
    "Procureur", "Onderzoeksrechter", "Commissaris",
    "Maandag", "Dinsdag", "Woensdag", "Donderdag", "Vrijdag", "Zaterdag", "Zondag",
    "Januari", "Februari", "Maart", "April", "Mei", "Juni",
    "Juli", "Augustus", "September", "Oktober", "November", "December",
]

# --- fixed values: streets ---------------------------------------------------
STREET_SUFFIXES = [
    "straat", "laan", "weg", "plein", "singel", "dreef", "lei", "steenweg",
    "kaai", "baan", "dijk", "gracht", "kade", "pad", "hof", "park",
    "boulevard", "avenue", "ring", "passage", "markt", "poort", "dam",
    "vest", "wal", "statie", "square", "plaats", "berg", "brug",
]
ANY_STREET = r"\b[A-Za-zé\-]+(?:" + "|".join(STREET_SUFFIXES) + r")\b"
NOT_STREETS = [
    "overlevering", "uitvoering", "niet-uitvoering", "levering", "bezorging",
    "herinnering", "verandering", "verbetering", "verklaring", "bewering",
    "ervaring", "oefening", "vergadering", "bediening", "besturing",
    "verwijdering", "verschijning", "verbinding", "beëindiging", "opening",
    "sluiting", "aflevering", "inlevering", "aanlevering", "toelevering",
    "onderweg", "halverwege", "vanwege", "wegens",
    "verlaan",
    "schadedam", "verdamdam",
    "volplein",
    "loopbaan", "rijbaan", "racebaan", "vliegbaan", "schaatsbaan",
    "wielerbaan", "omloopbaan", "glijbaan",
    "tegenpad", "voetpad", "fietspad", "wandelpad", "bospad",
    "ijsberg", "zandberg", "afvalberg", "schuldenberg",
    "paspoort", "exportpoort", "importpoort",
    "luchtbrug", "touwbrug",
    "zwemvest", "reddingsvest", "kogelvrijevest",
    "arbeidsmarkt", "huizenmarkt", "woningmarkt", "aandelenmarkt", "obligatiemarkt",
    "verblijfplaats", "woonplaats", "geboorteplaats", "werkplaats", "vindplaats",
    "bergplaats", "bewaarplaats", "opslagplaats", "parkeerplaats", "zitplaats",
    "standplaats", "ligplaats", "rustplaats", "slaapplaats", "speelplaats",
    "rechtbank", "vooruitgang", "achteruitgang",
]
PRECISE_STREETS = [
    r"\b(?:de\s+)?(?:Grote|Kleine|Oude|Nieuwe|Sint|St\.|Heilige|Lange|Korte)?\s*[A-Z][a-zé]+(?:straat|laan|weg|plein|singel|dreef|lei|steenweg|kaai|baan|dijk|gracht|kade|pad|hof|park|boulevard|avenue|ring|markt)\b",
    r"\b(?:Van|De|Het|Den|Ter)\s+[A-Z][a-zé]+(?:straat|laan|weg|plein)\b",
    r"\b(?:Koning|Koningin|President|Generaal|Kolonel|Burgemeester|Professor|Dokter|Prins|Prinses)\s+[A-Z][a-zé]+(?:straat|laan|weg|plein)\b",
]

# --- fixed values: person names ----------------------------------------------
NAMES = [
    r"\b(?:EL|VAN|DE|DER|DEN|TEN|TER)\s+[A-Z]{2,}\s+[A-Z][a-zé]+(?:\s+[A-Z][a-zé]+)?\b",
    r"\b(?:El|Van|De|Der|Den|Ten|Ter|La|Le)\s+[A-Z][a-zé]+\s+[A-Z][a-zé]+(?:\s+[A-Z][a-zé]+)?\b",
    r"\b(?:Jean|Marie|Pierre|Jacques|Philippe|François|Michel|André|Louis|Charles)[-\s][A-Z][a-zé]+(?:\s+(?:de|du|la|le)\s+[A-Z][a-zé]+)?\b",
    r"\b(?:de|du)\s+(?:la\s+)?[A-Z][a-zé]+\s+[A-Z][a-zé]+\b",
    r"\b(?:von|zu|vom)\s+(?:der\s+)?[A-Z][a-zé]+(?:\s+[A-Z][a-zé]+)?\b",
    r"\bO'[A-Z][a-z]+\b",
    r"\b(?:Mc|Mac)[A-Z][a-z]+\b",
    r"\b[A-Z]{2,}(?:\s+[A-Z][a-zé]+){1,3}\b",
    r"\b[A-Z][a-zé]+\s+[A-Z]{2,}\b",
    r"\b(?:EL|VAN|DE)\s+(?!ERSTE|EERSTE|AANLEG|VLAANDEREN|NEDERLAND|FRANCE|GERMANY)[A-Z]{2,}\b",
    r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b",
]
NOT_NAMES = [
    "VAN EERSTE", "DE EERSTE", "VAN AANLEG", "DE AANLEG",
    "VLAANDEREN", "NEDERLAND", "BELGIE", "BELGIUM",
    "PRO JUSTITIA", "EUR", "SEPA", "BTW", "BIC",
    "DE GROTE MARKT", "DE KLEINE MARKT", "DE OUDE MARKT",
    "DE GROTE PLAATS", "HET GROTE PLEIN", "DE MARKT",
    "VAN DE MARKT", "VAN HET PLEIN",
]
NOT_IN_NAMES = ["VLAANDEREN", "NEDERLAND", "BELGIE", "AFDELING"]
NOT_LAST_IN_NAMES = [
    "markt", "plein", "straat", "laan", "weg", "dreef", "lei",
    "kaai", "dijk", "gracht", "park", "bos", "hof", "tuin",
    "kerk", "station", "haven", "poort", "brug", "centrum",
]

NAME_BEFORE_DATE = r"([A-Z][A-Za-zé\'\-]+(?:\s+[A-Z]?[a-zé\'\-]+)*(?:\s+[A-Z][A-Za-zé\'\-]+)*)\s*[-–]\s*\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}"
NOT_NAMES_BEFORE_DATE = [
    "geboren", "geboortedatum", "datum", "nationaliteit", "wettelijke", "werkelijke",
]
CAPS_NAME = r"\b([A-Z]{3,}(?:\s+[A-Z][a-z]+)*)\s*(?:[-–]\s*\d{1,2}[-/\.]|Nationaliteit|PERSON_|geboren)"
NOT_CAPS_NAMES = ["PERSON", "PLACE", "STREET", "PHONE", "EMAIL", "VEHICLE", "ROAD", "PAGE"]
NAME_BEFORE_TOKEN = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s+PERSON_\d{3,4}"

# --- fixed values: vehicles and roads ----------------------------------------
BRANDS = [
    "fiat", "bmw", "mercedes", "mercedes-benz", "audi", "volkswagen", "vw",
    "opel", "peugeot", "renault", "citroën", "citroen", "volvo", "skoda",
    "seat", "porsche", "ferrari", "lamborghini", "alfa", "mini", "smart",
    "jaguar", "land rover", "landrover", "bentley", "rolls-royce", "aston martin",
    "maserati", "bugatti", "dacia", "lancia", "saab",
    "toyota", "honda", "nissan", "mazda", "hyundai", "kia", "suzuki",
    "mitsubishi", "lexus", "subaru", "isuzu", "daihatsu", "infiniti",
    "acura", "genesis", "ssangyong",
    "ford", "chevrolet", "chevy", "dodge", "jeep", "tesla", "cadillac",
    "chrysler", "buick", "gmc", "lincoln", "ram", "hummer",
    "iveco", "man", "daf", "scania", "renault trucks",
]
BRAND_TAIL = r"(?:\s+[A-Za-z0-9\-]+)?"
MODELS = [
    "ducato", "sprinter", "transit", "transporter", "crafter", "vivaro",
    "trafic", "master", "boxer", "jumper", "daily", "vito", "caddy",
    "berlingo", "partner", "kangoo", "combo", "doblo", "nv200", "hiace",
    "golf", "polo", "passat", "corsa", "astra", "focus", "fiesta",
    "civic", "corolla", "camry", "yaris", "clio", "megane", "scenic",
    "3-serie", "5-serie", "a3", "a4", "a6", "c-klasse", "e-klasse",
]
ROAD = r"\b[NAERnaer]\d{1,4}\b"

# --- fixed values: text clean-up and tokens ----------------------------------
LINE_BREAK_PARTICLES = ["EL", "VAN", "DE", "DER", "DEN", "TEN", "TER", "LA", "LE"]
NAME_PARTICLES = ["EL", "AL", "VAN", "DE", "DER", "DEN", "TEN", "TER", "LA", "LE"]
MASK_MARKS = ["XX", "xx", "***"]
PAGE_MARK = r"--- Page \d+ ---"
TOKEN_CATEGORIES = [
    "PERSON", "PHONE", "EMAIL", "ADDRESS", "IBAN", "DOB", "ID", "ORG",
    "PLACE", "LOCATION", "STREET", "ROAD", "VEHICLE",
]

# --- fixed values: order of detectors (ties are broken by it) ----------------
PATTERN_PROFILE = [
    "email", "iban", "phone", "vehicle", "road", "dob", "address", "any_street",
    "context_place", "place", "national_id", "context_name", "name",
]
HYBRID_PROFILE = [
    "email", "phone", "iban", "dob", "national_id", "vehicle", "road", "any_street",
    "context_place", "place", "context_name", "name",
]

# --- fixed values: labels of entity models -> categories ---------------------
NER_LABELS = {
    "PER": "PERSON", "PERSON": "PERSON",
    "LOC": "PLACE", "GPE": "PLACE", "FAC": "PLACE",
    "ORG": "ORG", "ORGANIZATION": "ORG",
    "DATE": "DATE", "TIME": "TIME",
    "MISC": "MISC", "PRODUCT": "MISC", "EVENT": "MISC", "WORK_OF_ART": "MISC", "LAW": "MISC",
    "MONEY": "MONEY", "QUANTITY": "MISC", "PERCENT": "MISC", "CARDINAL": "MISC", "ORDINAL": "MISC",
    "NORP": "MISC",
}
NER_DEFAULT_CATEGORIES = ["PERSON", "PLACE", "ORG"]
HYBRID_LABELS = {
    "PER": "PERSON", "PERSON": "PERSON",
    "LOC": "PLACE", "GPE": "PLACE", "FAC": "PLACE",
    "ORG": "ORG",
    "MISC": "MISC", "NORP": "MISC", "EVENT": "MISC", "PRODUCT": "MISC", "WORK_OF_ART": "MISC",
}
ZERO_SHOT_LABELS = {
    "person": "PERSON", "name": "PERSON", "first name": "PERSON", "last name": "PERSON",
    "location": "PLACE", "city": "PLACE", "country": "PLACE", "state": "PLACE",
    "address": "ADDRESS", "street": "STREET",
    "organization": "ORG", "company": "ORG",
    "phone number": "PHONE", "email": "EMAIL", "email address": "EMAIL",
    "ip address": "IP", "url": "URL",
    "credit card number": "CREDIT_CARD", "bank account number": "IBAN", "iban": "IBAN",
    "social security number": "ID", "passport number": "ID", "driver's license number": "ID",
    "national id": "ID", "tax id": "ID", "health insurance id": "ID",
    "medical record number": "ID", "vehicle registration": "ID", "license plate": "ID",
    "date of birth": "DOB", "date": "DATE",
    "username": "CREDENTIAL", "password": "CREDENTIAL", "api key": "CREDENTIAL",
}
RULE_ENGINE_LABELS = {
    "PERSON": "PERSON", "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON",
    "LOCATION": "PLACE", "GPE": "PLACE",
    "ORG": "ORG", "ORGANIZATION": "ORG",
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "URL": "URL", "IP_ADDRESS": "IP",
    "CREDIT_CARD": "CREDIT_CARD", "IBAN_CODE": "IBAN", "US_BANK_NUMBER": "BANK", "UK_NHS": "ID",
    "US_SSN": "ID", "US_PASSPORT": "ID", "US_DRIVER_LICENSE": "ID",
    "SG_NRIC_FIN": "ID", "AU_ABN": "ID", "AU_ACN": "ID", "AU_TFN": "ID", "AU_MEDICARE": "ID",
    "IN_PAN": "ID", "IN_AADHAAR": "ID", "IN_VEHICLE_REGISTRATION": "ID", "IN_VOTER": "ID",
    "IN_PASSPORT": "ID",
    "DATE_TIME": "DATE", "CRYPTO": "CRYPTO", "MEDICAL_LICENSE": "ID", "NRP": "MISC",
}
ZERO_SHOT_DEFAULT = [
    "person", "organization", "phone number", "address", "email", "credit card number",
    "social security number", "passport number", "driver's license number",
    "bank account number", "date of birth", "location", "city", "street",
]
ZERO_SHOT_EXTRA = [
    "health insurance id", "medical record number", "tax id", "national id",
    "vehicle registration", "ip address", "username", "password", "api key", "license plate",
]
LANGUAGES = ["nl", "en", "de", "fr", "it", "es"]
LANGUAGE_NAMES = {
    "dutch": "nl", "nederlands": "nl", "flemish": "nl", "vlaams": "nl",
    "english": "en", "engels": "en",
    "german": "de", "deutsch": "de", "duits": "de",
    "french": "fr", "français": "fr", "frans": "fr",
    "italian": "it", "italiano": "it", "italiaans": "it",
    "spanish": "es", "español": "es", "spaans": "es",
}

# --- fixed values: legend ----------------------------------------------------
CATEGORY_TEXT = {
    "PERSON": "Person names (individuals)",
    "PLACE": "Locations (cities, towns, regions)",
    "STREET": "Street names",
    "ROAD": "Road/highway numbers (N-roads, A-roads, E-roads)",
    "VEHICLE": "Vehicle brands and models (cars, vans, trucks)",
    "ADDRESS": "Full addresses",
    "PHONE": "Phone numbers",
    "EMAIL": "Email addresses",
    "IBAN": "Bank account numbers",
    "ID": "National ID numbers (BSN, etc.)",
    "DOB": "Dates of birth",
    "ORG": "Organizations",
}
LEGEND_RULE = "=" * 60
LEGEND_HEAD = [
    LEGEND_RULE,
    "DOCUMENT LEGEND - PLACEHOLDER KEY",
    LEGEND_RULE,
    "",
    "This document has been sanitized. Sensitive data has been",
    "replaced with placeholders. Each placeholder follows the",
    "format CATEGORY_NNN (e.g., PERSON_001, PLACE_002).",
    "",
    "PLACEHOLDER CATEGORIES:",
    "",
]
LEGEND_FOOT = [
    "",
    "IMPORTANT: Different numbers = different entities.",
    "  PERSON_001 and PERSON_002 are two different people.",
    "  PLACE_001 appearing twice means the SAME location.",
    "",
    LEGEND_RULE,
    "",
]
MAPPING_VERSION = "1.0"
