"""Public holiday rules, made into the holiday dimension. Dates follow published law and market notices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.frames import local_frame

Holiday = tuple[date, str]
FIRST_YEAR, LAST_YEAR = 1970, 2100


def easter(year: int) -> date:
    """Gregorian computus."""
    century, golden = year // 100, year % 19
    leap = century // 4
    epact = (19 * golden + century - leap - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * (year % 100 // 4) - epact - year % 100 % 4) % 7
    month, day = divmod(epact + weekday - 7 * ((golden + 11 * epact + 22 * weekday) // 451) + 114, 31)
    return date(year, month, day + 1)


def nth_weekday(year: int, month: int, weekday: int, n: int) -> date:
    """n-th (n > 0) or last (n = -1) weekday of a month; Monday is 0."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7)


def target(year: int) -> Iterator[Holiday]:
    """TARGET closing days; the euro settlement system opened in 1999."""
    yield date(year, 1, 1), "New Year's Day"
    if year >= 2000:
        yield easter(year) - timedelta(days=2), "Good Friday"
        yield easter(year) + timedelta(days=1), "Easter Monday"
        yield date(year, 5, 1), "Labour Day"
        yield date(year, 12, 26), "Christmas Holiday"
    yield date(year, 12, 25), "Christmas Day"
    if year in (1999, 2001):
        yield date(year, 12, 31), "Additional closing day"


def germany(year: int) -> Iterator[Holiday]:
    yield date(year, 1, 1), "Neujahr"
    for days, name in ((-2, "Karfreitag"), (1, "Ostermontag"), (39, "Christi Himmelfahrt"), (50, "Pfingstmontag")):
        yield easter(year) + timedelta(days=days), name
    yield date(year, 5, 1), "Erster Mai"
    if year >= 1990:
        yield date(year, 10, 3), "Tag der Deutschen Einheit"
    if year == 2017:
        yield date(year, 10, 31), "Reformationstag"
    yield date(year, 12, 25), "Erster Weihnachtstag"
    yield date(year, 12, 26), "Zweiter Weihnachtstag"


def bavaria(year: int) -> Iterator[Holiday]:
    yield from germany(year)
    yield date(year, 1, 6), "Heilige Drei Könige"
    yield easter(year) + timedelta(days=60), "Fronleichnam"
    yield date(year, 11, 1), "Allerheiligen"


def _observed(day: date, name: str) -> Iterator[Holiday]:
    yield day, name
    if day.weekday() == 5:
        yield day - timedelta(days=1), f"{name} (observed)"
    elif day.weekday() == 6:
        yield day + timedelta(days=1), f"{name} (observed)"


def united_states(year: int) -> Iterator[Holiday]:
    """Federal holidays, observed on the nearest weekday."""
    fixed = [(1, 1, "New Year's Day", 1870), (6, 19, "Juneteenth National Independence Day", 2021), (7, 4, "Independence Day", 1870),
             (11, 11, "Veterans Day", 1978), (12, 25, "Christmas Day", 1870)]
    for month, day, name, since in fixed:
        if year >= since:
            yield from _observed(date(year, month, day), name)
    if date(year + 1, 1, 1).weekday() == 5:
        yield date(year, 12, 31), "New Year's Day (observed)"
    if year >= 1986:
        yield nth_weekday(year, 1, 0, 3), "Martin Luther King Jr. Day"
    yield nth_weekday(year, 2, 0, 3), "Washington's Birthday"
    yield nth_weekday(year, 5, 0, -1), "Memorial Day"
    yield nth_weekday(year, 9, 0, 1), "Labor Day"
    yield nth_weekday(year, 10, 0, 2), "Columbus Day"
    yield nth_weekday(year, 11, 3, 4), "Thanksgiving Day"


def new_york_exchange(year: int) -> Iterator[Holiday]:
    """Full-day closings; New Year's Day on a Saturday isn't observed."""
    if date(year, 1, 1).weekday() != 5:
        yield from _observed(date(year, 1, 1), "New Year's Day")
    if year >= 1998:
        yield nth_weekday(year, 1, 0, 3), "Martin Luther King Jr. Day"
    yield nth_weekday(year, 2, 0, 3), "Washington's Birthday"
    yield easter(year) - timedelta(days=2), "Good Friday"
    yield nth_weekday(year, 5, 0, -1), "Memorial Day"
    if year >= 2022:
        yield from _observed(date(year, 6, 19), "Juneteenth National Independence Day")
    yield from _observed(date(year, 7, 4), "Independence Day")
    yield nth_weekday(year, 9, 0, 1), "Labor Day"
    yield nth_weekday(year, 11, 3, 4), "Thanksgiving Day"
    yield from _observed(date(year, 12, 25), "Christmas Day")
    #: Unscheduled closings.
    for day in ("2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"):
        if date.fromisoformat(day).year == year:
            yield date.fromisoformat(day), "Special closing"


def england(year: int) -> Iterator[Holiday]:
    """Bank holidays of England and Wales with substitute days."""
    new_year = date(year, 1, 1)
    yield new_year, "New Year's Day"
    if new_year.weekday() >= 5:
        yield new_year + timedelta(days=7 - new_year.weekday()), "New Year's Day (substitute day)"
    yield easter(year) - timedelta(days=2), "Good Friday"
    yield easter(year) + timedelta(days=1), "Easter Monday"
    if year >= 1978:
        yield (date(year, 5, 8) if year in (1995, 2020) else nth_weekday(year, 5, 0, 1)), "May Day"
    moved = {2002: date(2002, 6, 4), 2012: date(2012, 6, 4), 2022: date(2022, 6, 2)}
    yield moved.get(year, nth_weekday(year, 5, 0, -1)), "Spring Bank Holiday"
    yield nth_weekday(year, 8, 0, -1), "Late Summer Bank Holiday"
    christmas, boxing = date(year, 12, 25), date(year, 12, 26)
    yield christmas, "Christmas Day"
    yield boxing, "Boxing Day"
    if christmas.weekday() >= 5:
        yield date(year, 12, 27), "Christmas Day (substitute day)"
    if boxing.weekday() >= 5:
        yield date(year, 12, 28), "Boxing Day (substitute day)"
    #: One-off bank holidays.
    for day, name in (("1999-12-31", "Millennium Celebrations"), ("2002-06-03", "Golden Jubilee"), ("2011-04-29", "Royal Wedding"),
                      ("2012-06-05", "Diamond Jubilee"), ("2022-06-03", "Platinum Jubilee"), ("2022-09-19", "State Funeral"),
                      ("2023-05-08", "Coronation")):
        if date.fromisoformat(day).year == year:
            yield date.fromisoformat(day), name


#: Announced public holidays of China, first and last days, by year.
CHINA = {
    2023: (("2023-01-01", "2023-01-02", "New Year's Day"), ("2023-01-21", "2023-01-27", "Spring Festival"), ("2023-04-05", "2023-04-05", "Tomb-Sweeping Day"),
           ("2023-04-29", "2023-05-03", "Labor Day"), ("2023-06-22", "2023-06-24", "Dragon Boat Festival"), ("2023-09-29", "2023-10-06", "National Day")),
    2024: (("2024-01-01", "2024-01-01", "New Year's Day"), ("2024-02-10", "2024-02-17", "Spring Festival"), ("2024-04-04", "2024-04-06", "Tomb-Sweeping Day"),
           ("2024-05-01", "2024-05-05", "Labor Day"), ("2024-06-08", "2024-06-10", "Dragon Boat Festival"), ("2024-09-15", "2024-09-17", "Mid-Autumn Festival"),
           ("2024-10-01", "2024-10-07", "National Day")),
    2025: (("2025-01-01", "2025-01-01", "New Year's Day"), ("2025-01-28", "2025-02-04", "Spring Festival"), ("2025-04-04", "2025-04-06", "Tomb-Sweeping Day"),
           ("2025-05-01", "2025-05-05", "Labor Day"), ("2025-05-31", "2025-06-02", "Dragon Boat Festival"), ("2025-10-01", "2025-10-08", "National Day")),
    2026: (("2026-01-01", "2026-01-03", "New Year's Day"), ("2026-02-15", "2026-02-23", "Spring Festival"), ("2026-04-04", "2026-04-06", "Tomb-Sweeping Day"),
           ("2026-05-01", "2026-05-05", "Labor Day"), ("2026-06-19", "2026-06-21", "Dragon Boat Festival"), ("2026-09-25", "2026-09-27", "Mid-Autumn Festival"),
           ("2026-10-01", "2026-10-07", "National Day")),
}


def china(year: int) -> Iterator[Holiday]:
    for first, last, name in CHINA.get(year, ()):
        day = date.fromisoformat(first)
        while day <= date.fromisoformat(last):
            yield day, name
            day += timedelta(days=1)


#: A holiday as a row: a day of the year, or days from Easter Sunday; with a weekday, the first such day from the day of the year on (Monday is 0).
#: ``moved``: nearest (Saturday to Friday, Sunday to Monday) or monday (both to Monday) where it falls on a weekend, else null.
RULE_ROWS = "ref_label string, name string, month int, day int, easter int, weekday int, since int, until int, moved string"

_FIXED = {"new_year": (1, 1), "epiphany": (1, 6), "labour": (5, 1), "assumption": (8, 15), "all_saints": (11, 1), "armistice": (11, 11), "immaculate": (12, 8), "christmas": (12, 25), "second": (12, 26)}
_MOVING = {"thursday": -3, "friday": -2, "sunday": 0, "monday": 1, "prayer": 26, "ascension": 39, "whit_sunday": 49, "whit_monday": 50, "corpus": 60}

#: National holidays by country, from the year on in which the whole list holds. A day is named by what it is, by its date, or by the first
#: weekday from a date on; then its name, and the years it holds for where these are fewer.
_COUNTRIES: dict[str, tuple[int, list[tuple]]] = {
    "FR": (1982, [("new_year", "Jour de l'an"), ("monday", "Lundi de Pâques"), ("labour", "Fête du Travail"), ((5, 8), "Fête de la Victoire"), ("ascension", "Ascension"), ("whit_monday", "Lundi de Pentecôte"),
                  ((7, 14), "Fête nationale"), ("assumption", "Assomption"), ("all_saints", "Toussaint"), ("armistice", "Armistice"), ("christmas", "Noël")]),
    "IT": (2001, [("new_year", "Capodanno"), ("epiphany", "Epifania del Signore"), ("sunday", "Pasqua di Resurrezione"), ("monday", "Lunedì dell'Angelo"), ((4, 25), "Festa della Liberazione"), ("labour", "Festa dei Lavoratori"),
                  ((6, 2), "Festa della Repubblica"), ("assumption", "Assunzione della Vergine"), ("all_saints", "Tutti i Santi"), ("immaculate", "Immacolata Concezione"), ("christmas", "Natale"), ("second", "Santo Stefano")]),
    "BE": (1974, [("new_year", "Nieuwjaar"), ("sunday", "Pasen"), ("monday", "Paasmaandag"), ("labour", "Dag van de Arbeid"), ("ascension", "O. L. H. Hemelvaart"), ("whit_sunday", "Pinksteren"), ("whit_monday", "Pinkstermaandag"),
                  ((7, 21), "Nationale feestdag"), ("assumption", "O. L. V. Hemelvaart"), ("all_saints", "Allerheiligen"), ("armistice", "Wapenstilstand"), ("christmas", "Kerstmis")]),
    "AT": (1974, [("new_year", "Neujahr"), ("epiphany", "Heilige Drei Könige"), ("monday", "Ostermontag"), ("labour", "Staatsfeiertag"), ("ascension", "Christi Himmelfahrt"), ("whit_monday", "Pfingstmontag"), ("corpus", "Fronleichnam"),
                  ("assumption", "Mariä Himmelfahrt"), ((10, 26), "Nationalfeiertag"), ("all_saints", "Allerheiligen"), ("immaculate", "Mariä Empfängnis"), ("christmas", "Christtag"), ("second", "Stefanitag")]),
    "PT": (2016, [("new_year", "Ano Novo"), ("friday", "Sexta-feira Santa"), ("sunday", "Páscoa"), ((4, 25), "Dia da Liberdade"), ("labour", "Dia do Trabalhador"), ("corpus", "Corpo de Deus"), ((6, 10), "Dia de Portugal"),
                  ("assumption", "Assunção de Nossa Senhora"), ((10, 5), "Implantação da República"), ("all_saints", "Dia de Todos os Santos"), ((12, 1), "Restauração da Independência"), ("immaculate", "Imaculada Conceição"),
                  ("christmas", "Dia de Natal")]),
    "LU": (1962, [("new_year", "Neijoerschdag"), ("monday", "Ouschterméindeg"), ("labour", "Dag vun der Aarbecht"), ((5, 9), "Europadag", 2019), ("ascension", "Christi Himmelfaart"), ("whit_monday", "Péngschtméindeg"),
                  ((6, 23), "Nationalfeierdag"), ("assumption", "Léiffrawëschdag"), ("all_saints", "Allerhellgen"), ("christmas", "Chrëschtdag"), ("second", "Stiefesdag")]),
    "PL": (1990, [("new_year", "Nowy Rok"), ("epiphany", "Święto Trzech Króli", 2011), ("sunday", "Niedziela Wielkanocna"), ("monday", "Poniedziałek Wielkanocny"), ("labour", "Święto Państwowe"), ((5, 3), "Święto Narodowe Trzeciego Maja"),
                  ("whit_sunday", "Zielone Świątki"), ("corpus", "Dzień Bożego Ciała"), ("assumption", "Wniebowzięcie Najświętszej Marii Panny"), ("all_saints", "Uroczystość Wszystkich Świętych"),
                  ("armistice", "Narodowe Święto Niepodległości"), ((12, 24), "Wigilia Bożego Narodzenia", 2025), ("christmas", "Boże Narodzenie (pierwszy dzień)"), ("second", "Boże Narodzenie (drugi dzień)")]),
    "DK": (1971, [("new_year", "Nytårsdag"), ("thursday", "Skærtorsdag"), ("friday", "Langfredag"), ("sunday", "Påskedag"), ("monday", "Anden påskedag"), ("prayer", "Store bededag", 1686, 2023), ("ascension", "Kristi himmelfartsdag"),
                  ("whit_sunday", "Pinsedag"), ("whit_monday", "Anden pinsedag"), ("christmas", "Juledag"), ("second", "Anden juledag")]),
    "NO": (1948, [("new_year", "Første nyttårsdag"), ("thursday", "Skjærtorsdag"), ("friday", "Langfredag"), ("sunday", "Første påskedag"), ("monday", "Andre påskedag"), ("labour", "Arbeidernes dag"), ((5, 17), "Grunnlovsdagen"),
                  ("ascension", "Kristi himmelfartsdag"), ("whit_sunday", "Første pinsedag"), ("whit_monday", "Andre pinsedag"), ("christmas", "Første juledag"), ("second", "Andre juledag")]),
    "FI": (1992, [("new_year", "Uudenvuodenpäivä"), ("epiphany", "Loppiainen"), ("friday", "Pitkäperjantai"), ("sunday", "Pääsiäispäivä"), ("monday", "Toinen pääsiäispäivä"), ("labour", "Vappu"), ("ascension", "Helatorstai"),
                  ("whit_sunday", "Helluntaipäivä"), ((6, 20, 5), "Juhannuspäivä"), ((10, 31, 5), "Pyhäinpäivä"), ((12, 6), "Itsenäisyyspäivä"), ("christmas", "Joulupäivä"), ("second", "Tapaninpäivä")]),
    "BR": (2003, [("new_year", "Confraternização Universal"), ("friday", "Sexta-feira Santa"), ((4, 21), "Tiradentes"), ("labour", "Dia do Trabalhador"), ((9, 7), "Independência do Brasil"), ((10, 12), "Nossa Senhora Aparecida"),
                  ((11, 2), "Finados"), ((11, 15), "Proclamação da República"), ((11, 20), "Dia Nacional de Zumbi e da Consciência Negra", 2024), ("christmas", "Natal")]),
}


def country_rules() -> list[tuple]:
    """The countries' holidays as RULE_ROWS."""
    out = []
    for country, (since, held) in _COUNTRIES.items():
        for what, name, *years in held:
            place = _FIXED.get(what, what) if isinstance(what, str) else what
            day = (None, None, _MOVING[what], None) if isinstance(place, str) else (place[0], place[1], None, place[2] if len(place) > 2 else None)
            out.append((f"country {country}", name, *day, max(since, years[0]) if years else since, years[1] if len(years) > 1 else None, None))
    return out


def easter_day(year: Column) -> Column:
    """Gregorian computus as a column."""
    whole = lambda x: F.floor(x)
    century, golden = whole(year / 100), year % 19
    epact = (golden * 19 + century - whole(century / 4) - whole((century - whole((century + 8) / 25) + 1) / 3) + 15) % 30
    weekday = (century % 4 * 2 + whole(year % 100 / 4) * 2 - epact - year % 100 % 4 + 32) % 7
    n = epact + weekday - whole((golden + epact * 11 + weekday * 22) / 451) * 7 + 114
    return F.make_date(year, whole(n / 31).cast("int"), (n % 31 + 1).cast("int"))


def expand_rules(rules: DataFrame, first: int, last: int) -> DataFrame:
    """(ref_label, date, name) of rules (RULE_ROWS) in the years from first to last; of several on one day of a reference the first by name stays."""
    rows = rules.withColumn("year", F.explode(F.sequence(F.greatest(F.lit(first), F.coalesce("since", F.lit(first))), F.lit(max(first, last))))).where(
        (F.col("year") <= F.lit(last)) & (F.col("year") >= F.coalesce("since", F.lit(first))) & (F.col("year") <= F.coalesce("until", F.lit(last))))
    plain = F.make_date("year", "month", "day")
    on = F.when(F.col("easter").isNotNull(), F.date_add(easter_day(F.col("year")), F.col("easter"))).otherwise(F.date_add(plain, F.coalesce((F.col("weekday") - F.weekday(plain) + 7) % 7, F.lit(0))))
    rows = rows.withColumn("on", on)
    step = (F.when((F.weekday("on") == 5) & (F.col("moved") == "nearest"), -1).when((F.weekday("on") == 5) & (F.col("moved") == "monday"), 2)
            .when((F.weekday("on") == 6) & F.col("moved").isNotNull(), 1).otherwise(0))
    return rows.select("ref_label", F.date_add("on", step).alias("date"), "name").groupBy("ref_label", "date").agg(F.min("name").alias("name"))


#: Label of a reference -> rule (none: rows of ``country_rules``) and first year of its range.
RULES: dict[str, tuple[Callable[[int], Iterator[Holiday]] | None, int]] = {
    "financial XECB": (target, 1999), "country DE": (germany, FIRST_YEAR), "country DE-BY": (bavaria, FIRST_YEAR),
    "country US": (united_states, FIRST_YEAR), "financial XNYS": (new_york_exchange, FIRST_YEAR), "country GB-ENG": (england, FIRST_YEAR),
    "country CN": (china, min(CHINA)), **{f"country {c}": (None, since) for c, (since, _) in _COUNTRIES.items()},
}
#: Last years of references that end before LAST_YEAR.
LAST_YEARS = {"country CN": max(CHINA)}


def holiday_rows(label: str, first: int, last: int) -> list[tuple[str, date, str]]:
    rule, since = RULES[label]
    days: dict[date, str] = {}
    for year in range(max(first, since), min(last, LAST_YEAR) + 1):
        for day, name in rule(year):
            days.setdefault(day, name)
    return [(label, d, n) for d, n in sorted(days.items())]


def holiday_dim(spark: SparkSession, labels: list[str], first: int = 1990, last: int = 2040) -> DataFrame:
    """(ref_label, date, name) for known references; other calendars come from a user's table of the same columns."""
    rows = [r for label in sorted(set(labels)) if RULES[label][0] for r in holiday_rows(label, first, last)]
    made = local_frame(spark, rows, "ref_label string, date date, name string")
    told = [r for r in country_rules() if r[0] in labels]
    return made.unionByName(expand_rules(local_frame(spark, told, RULE_ROWS), first, min(last, LAST_YEAR))) if told else made


def holiday_ranges(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(ref_label, first_year, last_year): the years for which a reference's rules hold."""
    return local_frame(spark, [(label, RULES[label][1], LAST_YEARS.get(label, LAST_YEAR)) for label in sorted(set(labels))], "ref_label string, first_year int, last_year int")
