"""Written forms and how they are spoken: numbers, dates, times, money, telephone numbers, decimals, gendered words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textqc import ONES, TENS, spelled_number

# Hebrew words spelled alike for a man and a woman, each with how it is said to either.
GENDERED = [
    ("שלך", "shelcha", "shelach"), ("לך", "lecha", "lach"), ("אותך", "otcha", "otach"), ("עליך", "aleicha", "alaich"), ("אליך", "eleicha", "elaich"),
    ("איתך", "itcha", "itach"), ("ממך", "mimcha", "mimech"), ("בך", "becha", "bach"), ("בשבילך", "bishvilcha", "bishvilech"), ("אצלך", "etzlecha", "etzlech"),
    ("בעצמך", "be'atzmecha", "be'atzmech"), ("כמוך", "kamocha", "kamoch"), ("לידיעתך", "leyedi'at'cha", "leyedi'atech"), ("ידיעתך", "yedi'at'cha", "yedi'atech"),
    ("דעתך", "da'at'cha", "da'atech"), ("שמך", "shimcha", "shmech"), ("רצונך", "retzoncha", "retzonech"), ("שאלתך", "she'elatcha", "she'elatech"),
    ("כוונתך", "kavanat'cha", "kavanatech"), ("תשובתך", "tshuvatcha", "tshuvatech"), ("זכותך", "zchutcha", "zchutech"), ("אמרת", "amarta", "amart"),
    ("עשית", "asita", "asit"), ("הלכת", "halachta", "halacht"), ("רצית", "ratzita", "ratzit"), ("חשבת", "chashavta", "chashavt"), ("הבנת", "hevanta", "hevant"),
    ("ידעת", "yadata", "yadat"), ("ראית", "ra'ita", "ra'it"), ("שמעת", "shamata", "shamat"), ("כתבת", "katavta", "katavt"),
]
# Kinds of pairs and their weights in percent.
KINDS = {"number": 15, "date": 15, "time": 15, "currency": 15, "phone": 10, "decimal": 15, "hebrew_gender": 15}
# Ordinals that are not their number with th.
IRREGULAR = {1: "first", 2: "second", 3: "third", 5: "fifth", 8: "eighth", 9: "ninth", 12: "twelfth", 20: "twentieth", 30: "thirtieth"}


def literals(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def draw(key: Column, what: str, many: int) -> Column:
    """A number from 0 below ``many`` that only the key and ``what`` decide."""
    return F.pmod(F.xxhash64(F.lit(what), key), F.lit(many))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(spelled_number(n), F.when(n == 1, f" {one}").otherwise(f" {many}"))


def digits(text: Column) -> Column:
    """The digits of a text said one by one."""
    return F.array_join(F.transform(F.split(text, ""), lambda d: spelled_number(d.cast("long"))), " ")


def ordinal(n: Column) -> Column:
    """Ordinals from 1 to 31."""
    def word(i: int) -> str:
        if i in IRREGULAR:
            return IRREGULAR[i]
        return f"{TENS[i // 10 - 2]}-{IRREGULAR.get(i % 10, ONES[i % 10] + 'th')}" if i > 20 else ONES[i] + "th"

    return F.get(literals(map(word, range(1, 32))), (n - 1).cast("int"))


def year(n: Column) -> Column:
    """Years said by halves, but for the first ten of this century."""
    half, rest = F.floor(n / 100), n % 100
    early = F.when(rest == 0, "two thousand").otherwise(F.concat(F.lit("two thousand and "), spelled_number(rest)))
    tail = F.when(rest == 0, "hundred").when(rest < 10, F.concat(F.lit("oh "), spelled_number(rest))).otherwise(spelled_number(rest))
    return F.when(n.between(2000, 2009), early).otherwise(F.concat_ws(" ", spelled_number(half), tail))


def spoken_pair(key: Column) -> tuple[Column, Column, Column]:
    """(type, written, spoken) of a pair drawn for a key, kinds by weight; spoken without " and " and hyphens."""
    u, kind, edge = draw(key, "kind", sum(KINDS.values())), F.lit(None).cast("string"), 0
    for name, weight in KINDS.items():
        edge += weight
        kind = F.coalesce(kind, F.when(u < edge, name))
    number = draw(key, "number", 1_000_001)
    day = F.date_add(F.lit("1900-01-01").cast("date"), draw(key, "day", 55_151).cast("int"))
    style = draw(key, "style", 4)
    month = F.date_format(day, "MMMM")
    date_written = F.when(style == 0, F.date_format(day, "yyyy-MM-dd")).when(style == 1, F.date_format(day, "MMMM dd, yyyy")).when(
        style == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    date_spoken = F.concat(month, F.lit(" "), ordinal(F.dayofmonth(day)), F.lit(", "), year(F.year(day).cast("long")))
    hour, minute = draw(key, "hour", 24), draw(key, "minute", 60)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("long")
    past = F.when(minute == 0, F.lit(None)).when(minute < 10, F.concat(F.lit("oh "), spelled_number(minute))).otherwise(spelled_number(minute))
    time_spoken = F.concat_ws(" ", spelled_number(twelve), past, F.when(hour < 12, "AM").otherwise("PM"))
    dollars, cents = draw(key, "dollars", 1001), draw(key, "cents", 100)
    money_spoken = F.when(cents == 0, plural(dollars, "dollar", "dollars")).when(dollars == 0, plural(cents, "cent", "cents")).otherwise(
        F.concat(plural(dollars, "dollar", "dollars"), F.lit(" and "), plural(cents, "cent", "cents")))
    parts = [(draw(key, "area", 800) + 200).cast("string"), (draw(key, "prefix", 800) + 200).cast("string"), (draw(key, "line", 9000) + 1000).cast("string")]
    whole, fraction = draw(key, "whole", 101), (draw(key, "fraction", 999) + 1).cast("string")
    word, woman = draw(key, "word", len(GENDERED)).cast("int"), draw(key, "gender", 2) == 1
    written = {
        "number": number.cast("string"), "date": date_written, "time": F.format_string("%02d:%02d", hour, minute), "currency": F.format_string("$%d.%02d", dollars, cents),
        "phone": F.concat_ws("-", *parts), "decimal": F.concat_ws(".", whole.cast("string"), fraction),
        "hebrew_gender": F.concat(F.get(literals(g[0] for g in GENDERED), word), F.when(woman, " (Read as Feminine)").otherwise(" (Read as Masculine)")),
    }
    spoken = {
        "number": spelled_number(number), "date": date_spoken, "time": time_spoken, "currency": money_spoken, "phone": F.concat_ws(", ", *map(digits, parts)),
        "decimal": F.concat(spelled_number(whole), F.lit(" point "), digits(fraction)),
        "hebrew_gender": F.when(woman, F.get(literals(g[2] for g in GENDERED), word)).otherwise(F.get(literals(g[1] for g in GENDERED), word)),
    }

    def of_kind(values: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(kind == name, value) for name, value in values.items()])

    return kind, of_kind(written), F.regexp_replace(F.regexp_replace(of_kind(spoken), " and ", " "), "-", " ")


def gendered_pair(number: Column) -> tuple[Column, Column, Column]:
    """(type, written, spoken) of the pair of a number from 0 below 62: each word as said to a man and to a woman."""
    word, woman = F.floor(number / 2).cast("int"), number % 2 == 1
    written = F.concat(F.get(literals(g[0] for g in GENDERED), word), F.when(woman, " (Read as Feminine)").otherwise(" (Read as Masculine)"))
    spoken = F.when(woman, F.get(literals(g[2] for g in GENDERED), word)).otherwise(F.get(literals(g[1] for g in GENDERED), word))
    return F.when(woman, "hebrew_gender_f").otherwise("hebrew_gender_m"), written, spoken
