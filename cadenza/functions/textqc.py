"""Checks and repairs of candidate translations, and scalar helpers of lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import script as S

SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[\p{L}\p{N}_]+"
# Words of negation and of coordination, and words whose repetition is not heard as one.
NEGATIONS = {
    "en": "not no never cannot none without nor n't",
    "ru": "не нет никогда нельзя",
    "es": "no nunca sin nada",
    "fr": "ne pas jamais sans",
    "de": "nicht kein nie ohne",
    "it": "non mai senza",
    "pt": "não nunca sem",
    "zh": "不 没",
    "ja": "ない ません",
    "ko": "안 않 없",
    "ar": "لا لم لن ليس",
    "he": "לא אין בלי",
}
COORDINATORS = {"en": "and or", "ru": "и или", "es": "y o", "fr": "et ou", "de": "und oder", "it": "e o", "pt": "e ou"}
REPEATABLE = (
    "the a an and or of to in on at is are was were be by for with that this it as so no not very really much more most"
    " too just even still"
)
# Three-letter codes of the target languages.
ISO_639_2 = {"en": "eng", "zh": "chi", "de": "ger", "it": "ita", "pt": "por", "es": "spa", "ja": "jpn", "ko": "kor", "fr": "fre", "ru": "rus", "he": "heb"}
LEGACY = {"iw": "he"}


def empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often and inside whatever lambda it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(empty(text), F.lit(f"({WORD})"), F.lit(1))


def compare_tokens(text: Column, lang: str) -> Column:
    """Lower-case tokens for comparison: characters where words have no spaces, ASCII words in English."""
    low = F.lower(empty(text))
    if S.script_name(lang) in ("cjk", "hangul"):
        return F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}])"), F.lit(1))
    pattern = "([a-z0-9']+)" if lang.lower() == "en" else r"([\p{L}\p{N}_']+)"
    return F.regexp_extract_all(low, F.lit(pattern), F.lit(1))


def echoes(out: Column, src: Column) -> Column:
    """more than 65 % of the output's tokens stand in a source of four tokens or more."""
    def said(both: Column) -> Column:
        a, b = both["a"], both["b"]
        same = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
        return (F.size(b) >= 4) & (F.size(a) > 0) & (same * 100 > F.size(a) * 65)

    return bound(F.struct(words(F.lower(empty(out))).alias("a"), words(F.lower(empty(src))).alias("b")), said)


def not_a_translation(out: Column, src: Column) -> Column:
    """an echo, markdown, or more than four times and eight tokens over a source of four or more."""
    n, m = F.size(words(src)), F.size(words(out))
    return echoes(out, src) | empty(out).rlike(rf"\*\*|(^|\n){SPACE}*[-*•]{SPACE}") | ((n >= 4) & (m > 4 * n + 8))


def adjacent_repeat(text: Column, target: str = "en") -> Column:
    """The first word of four letters or more said twice, a coordinator at most between; else null."""
    if S.script_name(target) == "cjk":
        return F.lit(None).cast("string")
    joins = COORDINATORS.get(target, COORDINATORS["en"]).split()
    skip = REPEATABLE.split() if target == "en" else []

    def first_repeated(toks: Column) -> Column:
        def hit(i: Column) -> Column:
            a = F.lower(F.get(toks, i))
            second, third = F.lower(F.get(toks, i + 1)), F.lower(F.get(toks, i + 2))
            repeated = (a == second) | (F.coalesce(second.isin(*joins), F.lit(False)) & F.coalesce(a == third, F.lit(False)))
            return (F.length(a) >= 4) & ~a.isin(*(skip or [""])) & F.coalesce(repeated, F.lit(False))

        places = F.filter(F.when(F.size(toks) > 1, F.sequence(F.lit(0), F.size(toks) - 2)).otherwise(F.array().cast("array<int>")), hit)
        return F.get(toks, F.get(places, F.lit(0)))

    return bound(words(text), first_repeated)


def without_adjacent_repeat(text: Column, target: str = "en") -> Column:
    """The line with the second half of such a repeat gone."""
    joins = "|".join(sorted(COORDINATORS.get(target, COORDINATORS["en"]).split()))
    w = r"(?iu)(?<![\p{L}\p{N}_])([\p{L}\p{N}_]{4,})"
    end = r"(?![\p{L}\p{N}_])"
    out = F.regexp_replace(empty(text), rf"{w}{end}{SPACE}*,{SPACE}*\1{end}", "$1")
    out = F.regexp_replace(out, rf"{w}([.!?…]+){SPACE}*\1{end}[.!?…]*(?={SPACE}|$)", "$1$2")
    out = F.regexp_replace(out, rf"{w}{end}{SPACE}+(?:{joins}){SPACE}+\1{end}", "$1")
    return F.trim(F.regexp_replace(out, rf"{SPACE}{{2,}}", " "))


def proper_nouns(text: Column) -> Column:
    """Words of three letters or more that are capitalised and do not open a sentence, in lower case."""
    spaced = F.concat(F.lit("."), empty(text))
    found = F.regexp_extract_all(
        spaced, F.lit(r"([.!?][^\p{L}\p{N}_]*[\p{L}\p{N}_][\p{L}\p{N}_'-]*|[\p{L}\p{N}_][\p{L}\p{N}_'-]*)"), F.lit(1)
    )
    named = F.filter(found, lambda x: x.rlike(r"^\p{Lu}[\p{L}\p{N}_'-]{2,}$"))
    return F.array_distinct(F.transform(named, F.lower))


def digit_runs(text: Column) -> Column:
    """The numbers of a text as a set of digit strings."""
    return F.array_distinct(F.regexp_extract_all(empty(text), F.lit(r"(\d+)"), F.lit(1)))


def negated(text: Column, target: str = "en") -> Column:
    """The text has a word of negation; in Chinese, Japanese and Korean, which part or glue words otherwise, anywhere in it."""
    lexicon = NEGATIONS.get(target, NEGATIONS["en"]).split()
    low = F.lower(empty(text))
    inside = [low.contains(x) for x in lexicon]
    if S.script_name(target) in ("cjk", "hangul"):
        return reduce(or_, inside)
    found = F.arrays_overlap(words(low), F.array(*[F.lit(x) for x in lexicon]))
    return found | low.contains("n't") if target == "en" else found


def may_shorten(current: Column, shorter: Column, target: str = "en") -> Column:
    """A shorter line keeps half of the units, all numbers, four fifths of the names, and negation."""
    have, n = S.speech_units(current, target), S.speech_units(shorter, target)
    names = proper_nouns(current)
    kept = F.size(F.filter(names, lambda x: F.lower(empty(shorter)).contains(x)))
    return (
        (n < have) & (n >= 3) & (n * 2 >= have) & (F.size(F.array_except(digit_runs(current), digit_runs(shorter))) == 0)
        & (kept * 10 >= F.size(names) * 8) & (~negated(current, target) | negated(shorter, target))
    )


def within_edits(a: Column, b: Column, k: int) -> Column:
    """At most ``k`` edits apart."""
    return F.levenshtein(a, b, k) >= 0


def variant_names(a: Column, b: Column) -> Column:
    """Spellings of one name: as many tokens, each equal or a near one.

    Tokens below five letters must be equal, below seven one edit is allowed, from there two.
    """
    x, y = F.split(F.lower(a), " "), F.split(F.lower(b), " ")

    def near(p: Column, q: Column) -> Column:
        short = F.least(F.length(p), F.length(q))
        allowed = F.when(short < 5, 0).when(short < 7, 1).otherwise(2)
        return F.coalesce(F.levenshtein(p, q) <= allowed, F.lit(False))

    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, near), lambda t: t)


def normal_lang(code: Column) -> Column:
    """Lower case, legacy codes folded."""
    low = F.lower(F.trim(empty(code)))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv]), low), low)


def lang3(code: Column) -> Column:
    """The three-letter code, und if there is none."""
    table = F.create_map(*[F.lit(x) for kv in ISO_639_2.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(empty(code))), F.lit("und"))


def uid(start_ms: Column, end_ms: Column, text: Column) -> Column:
    """Identity of a segment from what created it."""
    def seconds(ms: Column) -> Column:
        return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((F.pmod(ms, F.lit(1000))).cast("string"), 3, "0"))
    return F.concat(F.lit("s"), F.substring(F.sha1(F.concat_ws("|", seconds(start_ms), seconds(end_ms), empty(text))), 1, 11))


def seed_of(key: Column, speak: Column) -> Column:
    """A seed from identity and line."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", key, empty(speak))), 1, 8), 16, 10).cast("long")


def token_budget(text: Column, lang: str, rate: float = 12.5) -> Column:
    """Tokens a voice may use: between 96 and 2048, by units."""
    per = 0.25 if S.script_name(lang) in ("cjk", "hangul") else 0.65
    return F.greatest(F.lit(96), F.least(F.lit(2048), F.floor((S.speech_units(text, lang) * per + 2.5) * rate)))


def tail_pad(track_ms: Column, total_ms: Column, floor: int = 50) -> Column:
    """How long the last picture is held so that no audio is cut."""
    return F.when(track_ms - total_ms > floor, track_ms - total_ms).otherwise(0)


def tempo_chain(rate: Column) -> Column:
    """Factors between a half and two whose product is the rate."""
    n = F.when(rate > 2, F.ceil(F.log2(rate)) - 1).when(rate < 0.5, F.ceil(-F.log2(rate)) - 1).otherwise(0).cast("int")
    step = F.when(rate > 2, 2.0).otherwise(0.5)
    return F.concat(F.array_repeat(step, n), F.array(F.round(rate / F.pow(step, n), 6)))


def slug(text: Column) -> Column:
    """A name for a folder: letters and digits, underscores between, at most 48 characters."""
    s = F.regexp_replace(F.regexp_replace(empty(text), r"[^\p{L}\p{N}_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(s, F.lit(48)), F.lit("")), F.lit("run"))


def percent(x: Column) -> Column:
    """A share as whole percent."""
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def clock(ms: Column) -> Column:
    """M:ss."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def timecode(ms: Column) -> Column:
    """M:ss.d."""
    return F.concat(clock(ms), F.lit("."), (F.floor((ms % 1000 + 50) / 100) % 10).cast("string"))


def lines(n: Column) -> Column:
    """How many lines."""
    return F.concat(n.cast("string"), F.when(n == 1, " line").otherwise(" lines"))


def without_editorial(text: Column) -> Column:
    """X11: a translator's line without channel label, closing note, bracketed alternatives and leading junk."""
    out = F.regexp_replace(F.trim(empty(text)), r"(?i)^(thought|analysis|final)\s*\n+", "")
    out = F.regexp_replace(out, r"(?is)\s*\*?\((note|translator'?s? note)\b.*\)\*?\s*\z", "")
    out = F.regexp_replace(out, r"\[([^\]/]*)(/[^\]]*)?\]", "$1")
    out = F.regexp_replace(out, r"^[\s/|,;:.!?\-–—*]+(?=[\p{L}\p{N}])", "")
    return F.trim(F.regexp_replace(out, rf"{SPACE}{{2,}}", " "))


def numbered_lines(out: Column, k: Column) -> Column:
    """The k lines of a numbered reply, or null unless the numbers are exactly 1 to k in order."""
    lines = F.filter(F.split(empty(out), r"\r?\n"), lambda x: x.rlike(r"^\s*\d+[.):]\s+\S"))
    numbers = F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*(\d+)", 1).cast("int"))
    texts = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[.):]\s+", "")))
    return F.when((k > 0) & (numbers == F.sequence(F.lit(1), k)), texts)


ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _below_thousand(k: int) -> str:
    low = k % 100
    said = ONES[low] if low < 20 else TENS[low // 10 - 2] + (f"-{ONES[low % 10]}" if low % 10 else "")
    return said if k < 100 else f"{ONES[k // 100]} hundred" + (f" and {said}" if low else "")


#: The numbers below a thousand in words, one text; as a constant it is split once for a whole query.
BELOW_THOUSAND = "|".join(map(_below_thousand, range(1000)))


def spelled_number(n: Column) -> Column:
    """A whole number below a million million in English words."""
    def group(k: Column) -> Column:
        return F.get(F.split(F.lit(BELOW_THOUSAND), r"\|"), k.cast("int"))

    parts = []
    for size, name in ((10**9, "billion"), (10**6, "million"), (10**3, "thousand")):
        g = F.floor(n / size) % 1000
        parts.append(F.when(g > 0, F.concat(group(g), F.lit(f" {name}"))))
    last = n % 1000
    joint = F.when((last > 0) & (last < 100) & (n >= 1000), F.concat(F.lit("and "), group(last))).when(last > 0, group(last))
    return F.when(n == 0, "zero").otherwise(F.regexp_replace(F.concat_ws(", ", *parts, joint), ", and ", " and "))


def spelled_numbers(text: Column) -> Column:
    """A text with its free-standing whole numbers in English words.

    Numbers that touch a letter, a colon, a hyphen or a further dotted part stay; thousands commas are
    read through, an ordinal ending is dropped and a percent sign is spoken.
    """
    number = r"((?<![\p{L}\p{N}_:.\-])(?:\d{1,3}(?:,\d{3})+|\d{1,12})(?:\s?%|(?:st|nd|rd|th)(?![\p{L}\p{N}_]))?(?![\p{L}\p{N}_:\-]|\.\d))"
    # Every piece is a number, what lies between digits, or a digit of a number that stays; group 1 tells.
    pattern = F.lit(rf"{number}|\D+|\d")

    def say(x: Column) -> Column:
        def spoken(n: Column) -> Column:
            year = (~x.contains(",")) & (n >= 1900) & (n <= 2099) & ~x.contains("%") & (n % 100 > 9)
            return F.when(year, F.concat(spelled_number(F.floor(n / 100)), F.lit(" "), spelled_number(n % 100))).otherwise(spelled_number(n))

        n = F.regexp_replace(F.regexp_extract(x, r"^([\d,]+)", 1), ",", "").cast("long")
        return F.concat(bound(n, spoken), F.when(x.contains("%"), " percent").otherwise(""))

    pieces, numbers = F.regexp_extract_all(empty(text), pattern, F.lit(0)), F.regexp_extract_all(empty(text), pattern, F.lit(1))
    told = F.zip_with(pieces, numbers, lambda x, n: F.when(n != "", say(n)).otherwise(x))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\d"), F.array_join(told, "")).otherwise(empty(text))


# Marks of unspaced scripts and the plain mark each stands for.
PLAIN_MARKS = {"。": ".", "｡": ".", "！": "!", "？": "?", "，": ",", "、": ",", "；": ";", "：": ":"}


def prepared(text: Column, lang: str) -> Column:
    """What a voice may be given: letters of the target's script, digits and plain marks, ended by a stop."""
    plain = F.translate(empty(text), "".join(PLAIN_MARKS), "".join(PLAIN_MARKS.values()))
    kept = F.regexp_replace(plain, rf"[^{S.char_class(S.RANGES[S.script_name(lang)])}0-9.,!?;:'\"\- ]", " ")
    line = F.trim(F.regexp_replace(kept, " {2,}", " "))
    return F.when(~line.rlike(r"[\p{L}\p{N}]"), "").when(line.rlike("[.!?]$"), line).otherwise(F.concat(line, F.lit(".")))


def without_repeated_end(text: Column) -> Column:
    """The line without closing clauses of four words or more that it said before; ended by a stop."""
    def norm(x: Column) -> Column:
        return F.trim(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " ")))

    clauses = F.regexp_extract_all(F.trim(empty(text)), F.lit(r"([^,;:.!?…]+[,;:.!?…]*\s*)"), F.lit(1))

    def drop(kept: Column, _: Column) -> Column:
        last, before = norm(F.element_at(kept, -1)), norm(F.array_join(F.slice(kept, F.lit(1), F.size(kept) - 1), " "))
        said = (F.size(kept) > 1) & (F.size(F.split(last, " ")) >= 4) & F.concat(F.lit(" "), before, F.lit(" ")).contains(F.concat(F.lit(" "), last, F.lit(" ")))
        return F.when(said, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)

    line = F.rtrim(F.array_join(F.aggregate(clauses, clauses, drop), ""))
    return F.when((line == "") | line.rlike("[.!?…]$"), line).otherwise(F.concat(F.regexp_replace(line, "[,;: ]+$", ""), F.lit(".")))


def latin_skeleton(word: Column) -> Column:
    """A word's consonants, c as k, doubles once."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(empty(word)), "c", "k"), "[aeiou]", ""), r"(.)\1+", "$1")


# Options of a voice as a map of strings; a default is the same as nothing.
OPTIONS = {"seed": "", "greedy": "false", "speed": "1.0", "ref": "auto", "temperature": "0.9"}


def _defaults() -> Column:
    return F.create_map(*[F.lit(x) for kv in OPTIONS.items() for x in kv])


def option_violations(options: Column) -> Column:
    """Unknown options, and values that are not of the option's kind; a null value is a reset and is fine."""
    def bad(k: Column, v: Column) -> Column:
        number = v.rlike(r"^\d+(\.\d+)?$")
        return ~F.coalesce(
            F.when(v.isNull(), True).when(k == "seed", v.rlike(r"^\d*$")).when(k == "greedy", v.isin("true", "false")).when(k.isin("speed", "temperature"), number).when(k == "ref", v != ""), F.lit(False)
        )
    return F.array_sort(F.map_keys(F.map_filter(options, bad)))


def options_stripped(options: Column) -> Column:
    """The options that are known and no default."""
    return F.map_filter(options, lambda k, v: F.map_contains_key(_defaults(), k) & (v != F.try_element_at(_defaults(), k)))


def options_merged(current: Column, updates: Column) -> Column:
    """Updates laid over the current options; an update that is null resets to the default."""
    both = F.map_zip_with(current, updates, lambda k, a, b: F.when(F.map_contains_key(updates, k), b).otherwise(a))
    return options_stripped(F.map_filter(both, lambda k, v: v.isNotNull()))


def options_fingerprint(options: Column) -> Column:
    """A hash of the options that are no default, in the order of their names; empty without any."""
    pairs = F.array_sort(F.transform(F.map_entries(options_stripped(options)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.when(F.size(pairs) == 0, "").otherwise(F.substring(F.sha1(F.array_join(pairs, "|")), 1, 10))
