"""PII: surrogates for detected entities, in DataFrame functions only.

Entities are found by one pattern, and names once more without their titles in the text that has them.
Each becomes a surrogate that is a keyed hash of its type and normalised form, written in the format of the original: an e-mail address stays one, a phone number
keeps its country code and its punctuation, an address of four octets keeps valid octets, a number that
passes the Luhn check still passes it, a name keeps its title, gender and script. Equal entities have
equal surrogates in all documents (coreference). A collision check over all distinct entities finds
different entities with one surrogate, and surrogates that are real entities; these draw again.
"""

from __future__ import annotations

import itertools
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qlog.llm.common import written

#: Largest number of redrawn entities that go to the rewriting as one broadcast map, a few kB on each row; more are joined by text.
MAP_LIMIT = 100
#: Setting of the session that holds the secret key of surrogates.
KEY = "spark.qlog.pii.key"
#: Draws after which a number's format is held to have no room left.
MOST_ROUNDS = 200

# Titles by gender and script, and the syllables and given names that surrogate names are made of.
TITLES = {
    ("latin", "m"): ["Mr", "Herr", "Monsieur", "Señor", "Sr"],
    ("latin", "f"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"],
    ("latin", ""): ["Dr", "Prof", "Professor", "Doctor", "Doktor"],
    ("cyrillic", "m"): ["господин", "Господин", "г-н"],
    ("cyrillic", "f"): ["госпожа", "Госпожа", "г-жа"],
    ("greek", "m"): ["κύριος", "Κύριος", "κος", "Κος"],
    ("greek", "f"): ["κυρία", "Κυρία", "κα", "Κα"],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Marco", "Noel", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"],
    ("cyrillic", "f"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Роза", "София", "Тамара"],
    ("greek", "m"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Ιάσονας", "Κώστας", "Λευτέρης", "Μάριος", "Νίκος", "Ορέστης", "Πέτρος", "Σταύρος", "Φώτης", "Χρήστος"],
    ("greek", "f"): ["Άννα", "Βάσω", "Γεωργία", "Δάφνη", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λένα", "Μαρία", "Νίκη", "Όλγα", "Ρένα", "Σοφία"],
}
SYLLABLES = {
    "latin": ["ba", "do", "fen", "gar", "hol", "jin", "kel", "lum", "mar", "nor", "pel", "quin", "ros", "sel", "tor", "wen"],
    "greek": ["βα", "δο", "φεν", "γαρ", "χολ", "ζιν", "κελ", "λουμ", "μαρ", "νορ", "πελ", "κιν", "ροσ", "σελ", "τορ", "βεν"],
    "cyrillic": ["ба", "до", "фен", "гар", "хол", "жин", "кел", "лум", "мар", "нор", "пел", "кин", "рос", "сел", "тор", "вен"],
}

#: Words inside a name that stay as they are.
PARTICLES = ["von", "vom", "van", "zu", "zum", "zur", "de", "del", "der", "den", "des", "di", "da", "dos", "du", "la", "le", "ten", "ter", "bin", "ibn", "y", "e"]

_ADDRESS = r"[\p{L}\p{N}._%+-]"
_TITLE_WORDS = "|".join(t for ts in TITLES.values() for t in ts)
#: The titles that a name begins with, and the blank after them.
TITLED = rf"^(?:(?:{_TITLE_WORDS})\.? ){{1,3}}"
#: Names are found in the scripts that surrogates can be written in.
_SCRIPTS = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"
_UPPER, _LETTER = rf"[\p{{Lu}}&&{_SCRIPTS}]", rf"[\p{{L}}&&{_SCRIPTS}]"
_WORD = rf"(?!(?:{_TITLE_WORDS})(?!\p{{L}}))(?:[ae]l-|d['’])?(?:{_UPPER}{_LETTER}*(?:['’-]{_UPPER}{_LETTER}+)+|{_UPPER}{_LETTER}+)(?!\p{{L}})"
_WORDS = rf"(?:(?:{_UPPER}\.|{'|'.join(PARTICLES)}) )*{_WORD}"
_GROUP = "[0-9A-Fa-f]{1,4}"
PATTERN = "|".join(
    [
        rf"(?<!{_ADDRESS}){_ADDRESS}++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)+",
        r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        r"(?=\+(?:[ .()-]{0,2}[0-9]){8})\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
        r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
        rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![\p{{L}}\p{{N}}:]|\.[0-9])",
        r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
        r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])",
        r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])",
        r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])",
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        # national phone numbers: area code in brackets, groups of 3-3-4, a leading 0
        r"(?<![\p{L}\p{N}])\([0-9]{2,5}\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,5}(?![0-9])",
        r"(?<![\p{L}\p{N}.,:/_-])(?:1[ .-])?[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9]|[.-][0-9])",
        r"(?<![\p{L}\p{N}.,:/_-])(?![0-9]{2}[./-][0-9]{2}[./-](?:19|20)[0-9]{2}(?![0-9]))(?=0(?:[ /.-]?[0-9]){8,13}(?![0-9]))0(?:[0-9]{1,4}(?:[ /.-][0-9]{2,8}){1,4}|[1-9][0-9]{8,10})(?![0-9])",
        rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE_WORDS})\.? ){{1,3}}{_WORDS}(?: {_WORDS})*",
    ]
)
#: No text without one of these can hold an entity; spares most texts the pattern.
HINT = rf"[0-9]|@|(?:{_TITLE_WORDS})\.? \p{{L}}"
TYPES = ["email", "phone", "ip", "ssn", "iban", "number", "name"]


def entity_type(e: Column) -> Column:
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(F.startswith(e, F.lit("+")), "phone")
        .when(e.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(e.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip")
        .when(e.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(e.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"), "number")
        .when(e.rlike(r"^[0-9(]"), "phone")
        .otherwise("name")
    )


def normal(e: Column, kind: Column) -> Column:
    """Form in which two mentions of one entity are equal."""
    return (
        F.when(kind.isin("email", "ip"), F.lower(e))
        .when(kind.isin("phone", "ssn", "number"), F.regexp_replace(e, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .otherwise(e)
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it; keeps plans small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dealt(e: Column, slot: str, values) -> Column:
    """``e`` with its matches of ``slot`` (one character each) replaced by the elements of ``values(how many)``."""

    def filled(gaps: Column) -> Column:
        return F.array_join(F.zip_with(gaps, F.array_append(F.slice(values(F.size(gaps) - 1), 1, F.size(gaps) - 1), F.lit("")), lambda g, v: F.concat(g, v)), "")

    return _let(F.split(e, slot, -1), filled)


def _hash(key: str, kind: Column, form: Column, turn: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, form, turn.cast("string")), 256)


#: What hex digits become: digits, small and capital letters.
_DIGITS, _SMALL, _CAPITAL = ("abcdef", "012345"), ("0123456789abcdef", "abdefgiklmnoprst"), ("0123456789abcdef", "ABDEFGIKLMNOPRST")


def _stream(h: Column, salt: str, alphabet: tuple[str, str]):
    """``values`` for ``_dealt``: as many characters as are asked for, 64 from each block's hash."""

    def values(count: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((count - 1) / 64).cast("int"))), lambda b: F.sha2(F.concat(h, F.lit(salt), b.cast("string")), 256))
        return F.split(F.translate(F.array_join(blocks, ""), *alphabet), "")

    return values


def _number(h: Column, at: int) -> Column:
    """Four hex digits of a hash as a number."""
    return F.conv(F.substring(h, at, 4), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), n % len(words) + 1)


def _parts(e: Column) -> tuple[Column, Column]:
    """Titles of a name with the blank after them, and the words of the rest; the last one is the surname."""
    title = F.regexp_extract(e, TITLED, 0)
    return title, F.split(F.substring(e, F.length(title) + 1, F.length(e)), " ")


def _cyrillic(word: Column) -> Column:
    return word.rlike(r"\p{IsCyrillic}")


def _by_script(word: Column, made) -> Column:
    """``made(script)`` for the script of a word."""
    return F.when(_cyrillic(word), made("cyrillic")).when(word.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _joined(word: Column, made) -> Column:
    """``made(part, number)`` of each part of a word, with the hyphens and apostrophes between them kept."""
    marks = "['’-]"
    parts = F.transform(F.split(word, marks, -1), made)
    return F.array_join(F.zip_with(parts, F.array_append(F.regexp_extract_all(word, F.lit(marks), F.lit(0)), F.lit("")), lambda g, v: F.concat(g, v)), "")


def _gender(title: Column, words: Column) -> Column:
    """By the first title; where that tells none, by the first given name."""
    bare = F.regexp_extract(title, r"^[^ .]+", 0)
    female = bare.isin(TITLES["latin", "f"] + TITLES["cyrillic", "f"] + TITLES["greek", "f"]) | (bare.isin(TITLES["latin", ""]) & F.element_at(words, 1).isin(GIVEN["latin", "f"] + GIVEN["cyrillic", "f"] + GIVEN["greek", "f"]))
    return F.when(female, "f").otherwise("m")


def _stem(surname: Column) -> Column:
    """Surname without its Cyrillic feminine ending."""
    return F.when(_cyrillic(surname), F.regexp_replace(surname, "а$", "")).otherwise(surname)


def _syllables(script: str, h: Column, count: Column) -> Column:
    """Up to 16 syllables dealt by a hash."""
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda k: _pick(SYLLABLES[script], F.conv(F.substring(h, 4 * k - 3, F.lit(4)), 16, 10).cast("int"))), "")


def _surname(stem: Column, key: str, turn: Column) -> Column:
    """Three syllables, and one more with each draw (Cyrillic ones end in the masculine ending); two for each further part.

    Parts of one or two letters, as of O'Brien, stay.
    """
    count = F.least(turn + 3, F.lit(16))

    def made(script: str, h: Column) -> Column:
        return _joined(stem, lambda part, n: F.when(F.length(part) < 3, part).otherwise(F.initcap(_syllables(script, F.sha2(F.concat(h, n.cast("string")), 256), F.when(n == 0, count).otherwise(2 + turn % 14)))))

    whole = _let(_hash(key, F.lit("surname"), stem, turn), lambda h: _by_script(stem, lambda script: made(script, h)))
    return F.when(_cyrillic(stem), F.concat(whole, F.lit("ов"))).otherwise(whole)


def _given(word: Column, gender: Column, surname: Column, key: str, turn: Column) -> Column:
    """A given name by gender and the surname's script; from the third draw on with syllables added."""

    def one(script: str, h: Column) -> Column:
        first = F.when(gender == "f", _pick(GIVEN[script, "f"], _number(h, 1))).otherwise(_pick(GIVEN[script, "m"], _number(h, 1)))
        return F.when(turn > 1, F.concat(first, _syllables(script, F.sha2(h, 256), F.least(F.greatest(turn - 1, F.lit(1)), F.lit(16))))).otherwise(first)

    def made(script: str, h: Column) -> Column:
        return _joined(word, lambda _, n: one(script, F.sha2(F.concat(h, n.cast("string")), 256)))

    return _let(_hash(key, F.concat(F.lit("given "), gender), word, turn), lambda h: _by_script(surname, lambda script: made(script, h)))


def _given_form(stem: Column, gender: Column, word: Column) -> Column:
    return F.concat_ws("|", stem, gender, word)


def _name(e: Column, key: str, turn) -> Column:
    """Titles kept; given names by gender and script; surname by its stem (Cyrillic ones end by gender).

    ``turn(type, form)`` gives the draw of a surname and of a given name within its surname.
    """
    title, words = _parts(e)

    def whole(surname: Column, gender: Column) -> Column:
        stem = _stem(surname)
        last = F.concat(_surname(stem, key, turn(F.lit("surname"), stem)), F.when(_cyrillic(surname) & (gender == "f"), "а").otherwise(""))
        given = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: F.when(w.isin(PARTICLES), w).otherwise(_given(w, gender, surname, key, turn(F.lit("given"), _given_form(stem, gender, w)))))
        return F.concat(title, F.array_join(F.array_append(given, last), " "))

    return _let(F.struct(F.element_at(words, -1).alias("s"), _gender(title, words).alias("g")), lambda x: whole(x["s"], x["g"]))


def units(e: Column) -> Column:
    """(type, form, e) of all that draws on its own in an entity: itself; of a name its surname and its given names."""

    def unit(kind: Column, form: Column, own: Column) -> Column:
        return F.struct(kind.alias("type"), form.alias("form"), own.alias("e"))

    title, words = _parts(e)

    def of_name(surname: Column, gender: Column) -> Column:
        stem = _stem(surname)
        given = F.transform(F.filter(F.slice(words, 1, F.size(words) - 1), lambda w: ~w.isin(PARTICLES)), lambda w: unit(F.lit("given"), _given_form(stem, gender, w), w))
        return F.array_append(given, unit(F.lit("surname"), stem, stem))

    names = _let(F.struct(F.element_at(words, -1).alias("s"), _gender(title, words).alias("g")), lambda x: of_name(x["s"], x["g"]))
    return _let(entity_type(e), lambda kind: F.when(kind == "name", names).otherwise(F.array(unit(kind, normal(e, kind), e))))


def _drawn(kind: Column, form: Column, e: Column, key: str, turn: Column) -> Column:
    """Surrogate of a unit in normal form; of a given name together with its surname's stem."""
    parts = F.split(form, r"\|")
    stem, gender, word = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    given = F.concat_ws("|", stem, _given(word, gender, stem, key, turn))
    other = _let(surrogate(e, kind, form, key, turn), lambda x: normal(x, kind))
    return F.when(kind == "surname", _surname(form, key, turn)).when(kind == "given", given).otherwise(other)


#: Country calling codes of one and two digits; all others have three.
_COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def surrogate(e: Column, kind: Column, form: Column, key: str, turn: Column) -> Column:
    """Replacement of entity ``e`` that is no name; ``turn`` counts the draws that a collision made necessary."""
    return _let(_hash(key, kind, form, turn), lambda h: _surrogate(e, kind, form, turn, h))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of the number that letters (A is 10) and digits of a text spell."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(e: Column, form: Column, h: Column) -> Column:
    """Country kept, letters for letters, digits for digits; check digits that hold where the given ones do."""
    country = F.substring(form, 1, 2)
    rest = F.substring(e, F.lit(5), F.length(e))
    body = _dealt(_dealt(rest, "[0-9]", _stream(h, "", _DIGITS)), "[A-Z]", _stream(h, "a", _CAPITAL))

    def checked(new: Column) -> Column:
        right = F.lpad((98 - _mod97(F.concat(F.regexp_replace(new, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
        holds = _mod97(F.concat(F.substring(form, F.lit(5), F.length(form)), F.substring(form, 1, 4))) == 1
        return F.concat(country, F.when(holds, right).otherwise(F.array_join(F.slice(_stream(h, "c", _DIGITS)(F.lit(2)), 1, 2), "")), new)

    return _let(body, checked)


def _surrogate(e: Column, kind: Column, form: Column, turn: Column, h: Column) -> Column:
    digits, letters = _stream(h, "", _DIGITS), _stream(h, "a", _SMALL)
    top_level = F.regexp_extract(e, r"\.[^.@]+$", 0)
    head = F.substring(e, F.lit(1), F.length(e) - F.length(top_level))
    longer = F.substring(F.translate(F.sha2(F.concat(h, F.lit("e")), 256), *_SMALL), F.lit(1), turn)
    email = F.concat(longer, _dealt(_dealt(head, r"[\p{L}]", letters), "[0-9]", digits), top_level)
    # The country's digits, or a leading 0, are the same in all spellings of a number.
    kept = F.when(F.startswith(e, F.lit("+")), F.length(F.regexp_extract(form, _COUNTRY, 0))).when(F.startswith(form, F.lit("0")), 1).otherwise(0)
    phone = _dealt(e, "[0-9]", lambda n: F.concat(F.slice(F.split(form, ""), F.lit(1), kept), digits(n)))
    ip = F.concat_ws(".", *[F.conv(F.substring(h, 1 + 2 * k, 2), 16, 10) for k in range(4)])
    ip = F.when(F.contains(e, F.lit(":")), F.concat_ws(":", *[F.substring(h, 1 + 4 * k, 4) for k in range(8)])).otherwise(ip)
    body = F.slice(digits(F.length(form)), 1, F.length(form) - 1)
    check = lambda body: ((F.lit(10) - _luhn(F.array_append(body, F.lit("0"))) % 10) % 10).cast("string")
    number = F.when(_luhn(F.split(form, "")) % 10 == 0, _dealt(e, "[0-9]", lambda n: _let(body, lambda b: F.array_append(b, check(b))))).otherwise(_dealt(e, "[0-9]", digits))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "iban", _iban(e, form, h)).otherwise(number)


def entities(text: Column) -> Column:
    """All entities of a text in order, null where there can be none."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def repeats(found: Column) -> Column:
    """Pattern of a text's entities and of its names without their titles; null where it has no names."""
    names = F.filter(found, lambda e: e.rlike(TITLED))
    rest = F.transform(names, lambda e: F.regexp_replace(e, TITLED, ""))
    both = F.array_distinct(F.concat(rest, F.transform(rest, lambda r: F.element_at(F.split(r, " "), -1))))
    # of names and letters only; dots of initials are the one special character
    words = F.regexp_replace(F.array_join(both, "|"), r"\.", r"\\.")
    return F.when(F.size(names) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])")))


def redraws(docs: DataFrame, key: str) -> DataFrame:
    """(type, form, turn) of the distinct units that need another draw than the first.

    Each round, surrogates that several units share, or that are real ones, are drawn again by all but
    the smallest form. Ends when none is left; distinct entities then have distinct surrogates. Names and
    e-mail addresses grow with each draw, so their space never runs out; numbers keep their length, and a
    corpus that holds nearly all numbers of one format raises an error after ``MOST_ROUNDS``.
    """
    found = docs.select(F.explode(entities(F.col("text"))).alias("e")).select(F.inline(units(F.col("e"))))
    # mentions that differ in punctuation only are one entity; its surrogate is compared in normal form
    known = written(found.groupBy("type", "form").agg(F.min("e").alias("e")), "entities")
    turns = known.withColumn("turn", F.lit(0))
    real = known.select("type", F.col("form").alias("s"))
    for n in itertools.count(1):
        drawn = turns.withColumn("s", _drawn(F.col("type"), F.col("form"), F.col("e"), key, F.col("turn")))
        shared = drawn.groupBy("type", "s").agg(F.min("form").alias("first"), F.count("*").alias("k"))
        taken = shared.where("k > 1").select("type", "s", "first").unionByName(drawn.select("type", "s").distinct().join(real, ["type", "s"]).withColumn("first", F.lit(None).cast("string")))
        taken = taken.groupBy("type", "s").agg(F.min(F.struct(F.col("first").isNotNull().alias("free"), "first")).alias("t"))
        again = drawn.join(taken, ["type", "s"]).where("t.first is null or form <> t.first").select("type", "form")
        again = written(again.distinct(), "again")
        if again.isEmpty():
            break
        if n > MOST_ROUNDS:
            raise ValueError(f"surrogates still collide after {MOST_ROUNDS} draws: {again.groupBy('type').count().collect()}")
        turns = written(turns.join(again.withColumn("more", F.lit(1)), ["type", "form"], "left").select("type", "form", "e", (F.col("turn") + F.coalesce("more", F.lit(0))).alias("turn")), "turns")
    return turns.where("turn > 0").select("type", "form", "turn")


def own_key(docs: DataFrame) -> str:
    """The session's key (``KEY``); where it has none, one drawn at random, which nobody can compute surrogates with later."""
    return docs.sparkSession.conf.get(KEY, None) or secrets.token_hex(16)


def pseudonymise(docs: DataFrame, key: str | None = None, found: str = "pii") -> DataFrame:
    """``docs`` with all entities of ``text`` replaced, and ``found``: map of type to number of mentions.

    ``key`` makes the surrogates: equal keys give equal ones, and whoever has it can recompute them. By default
    it is the session's (see ``own_key``).
    Null texts stay null, texts without entities stay as they are, with an empty map. Repeated rows are
    rewritten alike. A column of the input named ``found`` is replaced. An empty table gives no rows.
    """
    docs, key = docs.drop(found), own_key(docs) if key is None else key
    again = redraws(docs, key)
    pair = F.concat_ws("|", "type", "form")
    few = again.limit(MAP_LIMIT + 1).count()  # decides between a bounded map and a join
    if not few:
        work, turn_of = docs.withColumn("_turns", F.lit(None).cast("map<string,int>")), None
    elif few <= MAP_LIMIT:
        one = again.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(pair, "turn"))).alias("_turns"))
        work = docs.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
        turn_of = "_turns"
    else:
        texts = docs.select(F.sha2("text", 256).alias("_h"), F.explode(entities(F.col("text"))).alias("e"))
        texts = texts.select("_h", F.inline(units(F.col("e")))).select("_h", "type", "form").distinct()
        maps = texts.join(again, ["type", "form"]).groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct(pair, "turn"))).alias("_turns"))
        work = docs.withColumn("_h", F.sha2("text", 256)).join(written(maps, "maps"), "_h", "left").drop("_h")  # maps are written: a hot text can be split
        turn_of = "_turns"

    def turn(kind: Column, form: Column) -> Column:
        return F.lit(0) if turn_of is None else F.coalesce(F.try_element_at(F.col(turn_of), F.concat_ws("|", kind, form)), F.lit(0))

    def replaced(e: Column) -> Column:
        other = lambda kind: _let(normal(e, kind), lambda form: surrogate(e, kind, form, key, turn(kind, form)))
        return _let(entity_type(e), lambda kind: F.when(kind == "name", named(e)).otherwise(other(kind)))

    def named(e: Column) -> Column:
        """An untitled mention is the end of a titled one of its text, and so is its surrogate."""
        titled = F.when(e.rlike(TITLED), e).otherwise(F.get(F.filter("_e", lambda x: x.rlike(TITLED) & F.endswith(x, F.concat(F.lit(" "), e))), F.lit(0)))
        n = F.size(F.split(e, " "))
        return _let(_name(titled, key, turn), lambda full: F.when(e.rlike(TITLED), full).otherwise(F.array_join(F.slice(F.split(full, " "), -n, n), " ")))

    own = work.withColumn("_e", entities(F.col("text"))).withColumn("_p", repeats(F.col("_e")))
    own = own.withColumn("_all", F.when(F.col("_p").isNull(), F.col("_e")).otherwise(F.regexp_extract_all("text", F.col("_p"), F.lit(0))))
    gaps = F.when(F.col("_p").isNull(), F.split("text", PATTERN, -1)).otherwise(F.split("text", F.col("_p"), -1))
    new = F.array_append(F.transform("_all", replaced), F.lit(""))
    text = F.when(F.size("_all") > 0, F.array_join(F.zip_with(gaps, new, lambda g, s: F.concat(g, s)), "")).otherwise(F.col("text"))
    kinds = F.transform(F.coalesce("_all", F.array().cast("array<string>")), entity_type)
    counts = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda t: F.struct(t, F.size(F.filter(kinds, lambda k: k == t)))))
    return own.withColumn(found, counts).withColumn("text", text).select(*docs.columns, found)


def pii_digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with surrogates and the number of mentions of each type; other columns are ignored.

    Null texts stay null with no mentions; repeated rows are rewritten alike.
    """
    out = pseudonymise(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", *[F.coalesce(F.try_element_at("pii", F.lit(t)), F.lit(0)).cast("long").alias(f"n_{t}") for t in TYPES])
