"""Word lists and names: defaults that a user replaces by tables of their own.

Each list is a table by country or language, kept in alphabetical order, and
flattened for the functions that read it.
"""

from __future__ import annotations


def flat(table: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """All words of a table, each once, in order."""
    return tuple(sorted({w for words in table.values() for w in words}))


#: Short forms of company types, by the country whose law knows them.
LEGAL_FORMS_BY_COUNTRY = {
    "AT": ("ag", "eu", "gesmbh", "gmbh", "kg", "og"),
    "BE": ("bv", "nv", "sa", "srl", "vzw"),
    "CH": ("ag", "gmbh", "sa", "sagl", "sarl"),
    "CZ": ("as", "sro"),
    "DE": ("ag", "eg", "ev", "gbr", "ggmbh", "gmbh", "kg", "kgaa", "ohg", "partg", "se", "ug"),
    "DK": ("aps", "as", "ivs"),
    "ES": ("sa", "sau", "sl", "slu"),
    "FI": ("oy", "oyj"),
    "FR": ("sa", "sarl", "sas", "sasu", "sca", "snc"),
    "GB": ("cic", "limited", "llp", "ltd", "plc"),
    "IE": ("clg", "dac", "limited", "ltd", "plc"),
    "IT": ("sapa", "snc", "spa", "srl"),
    "NL": ("bv", "cv", "nv", "vof"),
    "NO": ("as", "asa"),
    "PL": ("sa", "sp", "zoo"),
    "PT": ("lda", "sa"),
    "SE": ("ab", "hb"),
    "US": ("co", "company", "corp", "corporation", "inc", "incorporated", "llc"),
    "any": ("group", "gruppe", "holding", "holdings"),
}
#: Names under which a national branch adds its country.
COUNTRY_WORDS = {
    "AT": ("austria", "osterreich"),
    "CH": ("schweiz", "suisse", "switzerland"),
    "DE": ("deutschland", "germany"),
    "ES": ("espana", "spain"),
    "FR": ("france",),
    "GB": ("uk",),
    "IE": ("ireland",),
    "IT": ("italia", "italy"),
    "NL": ("nederland", "netherlands"),
}
LEGAL_FORMS = flat(LEGAL_FORMS_BY_COUNTRY | {f"name {k}": v for k, v in COUNTRY_WORDS.items()})

#: What firms that recruit or lend staff call their trade.
AGENCY_WORDS_BY_LANGUAGE = {
    "de": ("arbeitnehmerüberlassung", "leiharbeit", "personalberatung", "personaldienstleister", "personaldienstleistungen", "personalvermittlung", "zeitarbeit"),
    "en": ("employment agency", "executive search", "headhunters", "headhunting", "recruiters", "recruiting", "recruitment", "staffing", "temp agency"),
    "es": ("seleccion de personal", "trabajo temporal"),
    "fr": ("cabinet de recrutement", "interim", "travail temporaire"),
    "nl": ("detachering", "uitzendbureau", "werving"),
}
AGENCY_WORDS = flat(AGENCY_WORDS_BY_LANGUAGE)

GENDER_MARKERS = "(?i)\\(?\\b[mfwdx](?:\\s*[/|,*]\\s*[mfwdx]){1,3}\\b\\)?|\\(all genders\\)|[*:_]in(?:nen)?\\b"

#: Folded local names of cities, by country, and their English names.
CITY_NAMES = {
    "AT": {"wien": "vienna"},
    "BE": {"antwerpen": "antwerp", "brussel": "brussels", "bruxelles": "brussels", "gent": "ghent"},
    "CH": {"basel": "basle", "geneve": "geneva", "genf": "geneva", "luzern": "lucerne"},
    "CZ": {"praha": "prague"},
    "DE": {"hannover": "hanover", "koln": "cologne", "munchen": "munich", "nurnberg": "nuremberg"},
    "ES": {"sevilla": "seville"},
    "GR": {"athina": "athens"},
    "IT": {"firenze": "florence", "genova": "genoa", "milano": "milan", "napoli": "naples", "roma": "rome", "torino": "turin", "venezia": "venice"},
    "NL": {"den haag": "the hague"},
    "PL": {"krakow": "cracow", "warszawa": "warsaw"},
    "PT": {"lisboa": "lisbon"},
    "RO": {"bucuresti": "bucharest"},
    "SE": {"goteborg": "gothenburg"},
}
CITY_ALIASES = {local: name for names in CITY_NAMES.values() for local, name in names.items()}

LANGUAGE_ALIASES = {"english": "en", "englisch": "en", "anglais": "en", "ingles": "en", "german": "de", "deutsch": "de", "allemand": "de", "aleman": "de", "french": "fr", "franzosisch": "fr", "francais": "fr", "frances": "fr", "spanish": "es", "spanisch": "es", "espagnol": "es", "espanol": "es", "en": "en", "de": "de", "fr": "fr", "es": "es"}

#: Words that say what kind of region a name is of.
REGION_WORDS_BY_LANGUAGE = {
    "de": ("bezirk", "bundesland", "kanton", "kreis", "land", "landkreis", "regierungsbezirk", "stadtkreis"),
    "en": ("borough", "city", "county", "district", "of", "province", "region", "state", "the"),
    "es": ("comunidad", "de", "provincia"),
    "fr": ("canton", "de", "departement", "du"),
    "it": ("citta", "di", "provincia", "regione"),
}
REGION_WORDS = flat(REGION_WORDS_BY_LANGUAGE)

#: Words of a title that set its level: two jobs whose levels differ aren't one.
LEVEL_WORDS_BY_LANGUAGE = {
    "de": ("ausbildung", "auszubildende", "berufseinsteiger", "leiter", "leiterin", "leitung", "praktikant", "praktikantin", "praktikum", "werkstudent", "werkstudentin"),
    "en": ("apprentice", "associate", "chief", "director", "graduate", "head", "intern", "junior", "lead", "manager", "principal", "senior", "trainee"),
    "es": ("becario", "jefe", "practicas"),
    "fr": ("alternant", "chef", "directeur", "responsable", "stagiaire"),
}
LEVEL_WORDS = flat(LEVEL_WORDS_BY_LANGUAGE)

#: Normalised words and phrases by the class of employment that they name.
EMPLOYMENT_WORDS = {
    "fixed": {"de": ("befristet", "befristete", "zeitvertrag"), "en": ("fixed term", "fixedterm", "temp", "temporary"), "es": ("temporal",), "fr": ("cdd", "duree determinee"), "nl": ("tijdelijk",)},
    "full": {"de": ("vollzeit",), "en": ("full time", "fulltime"), "es": ("jornada completa", "tiempo completo"), "fr": ("temps complet", "temps plein"), "nl": ("voltijd",)},
    "hired": {"de": ("freiberufler", "freiberuflich", "freie mitarbeit"), "en": ("contract", "contractor", "freelance", "freelancer", "self employed"), "es": ("autonomo",), "fr": ("independant",), "nl": ("zzp",)},
    "lasting": {"de": ("festanstellung", "unbefristet", "unbefristete"), "en": ("permanent", "regular"), "es": ("indefinido",), "fr": ("cdi", "duree indeterminee"), "nl": ("vast",)},
    "learning": {"de": ("ausbildung", "praktikant", "praktikantin", "praktikum", "werkstudent", "werkstudentin"), "en": ("apprentice", "apprenticeship", "intern", "internship", "trainee", "working student"), "es": ("becario", "practicas"), "fr": ("alternance", "stage", "stagiaire"), "nl": ("stagiair",)},
    "part": {"de": ("teilzeit",), "en": ("part time", "parttime"), "es": ("jornada parcial", "tiempo parcial"), "fr": ("temps partiel",), "nl": ("deeltijd",)},
}
#: Normalised words and phrases by the place of work that they name; the first class wins.
WORK_MODE_WORDS = {
    "hybrid": {"de": ("hybrides arbeiten",), "en": ("hybrid",), "es": ("hibrido",), "fr": ("hybride",)},
    "remote": {"de": ("fernarbeit", "home office", "homeoffice"), "en": ("remote", "telecommute", "work from home"), "es": ("teletrabajo",), "fr": ("teletravail",), "nl": ("thuiswerk",)},
    "on_site": {"de": ("vor ort",), "en": ("office", "on site", "onsite"), "es": ("presencial",), "fr": ("sur site",), "nl": ("op locatie",)},
}
#: Names of all of Europe or of large parts of it.
EUROPE_WORDS = ("dach", "eea", "emea", "eu", "europa", "europe", "european union")
