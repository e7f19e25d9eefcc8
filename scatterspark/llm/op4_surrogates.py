"""Keyed, type-consistent surrogates for personal data (DataFrame functions only).

Detected kinds: e-mail addresses, IPv4 addresses, payment cards, phone and social security numbers, secrets (values after
password, token, ... in any case, and access key ids) and names (a known given name with a capitalised word, or capitalised words
after a form of address).

Every character is shifted within its own alphabet by a keyed SHA-256 of what precedes it (digits, hexadecimal digits,
lower and upper case; in names vowels and consonants of each script). Formats, lengths, scripts and marks stay; a card
keeps its Luhn remainder, an IPv4 address gets octets, an address keeps its top-level domain, a phone number its
country code, and a known given name becomes another one of the same gender and script. As each shift depends only on
the preceding original characters, the map is one-to-one on every kind: different entities keep different surrogates,
and an entity has the same one wherever it occurs (also a name's surname alone, and letters of either case).

Collision check: over all documents, a surrogate that is itself an entity of that kind somewhere, or that two entities
share, is drawn again with the next attempt number; the table of redrawn entities is joined back by document.

Edge cases: null and empty texts are returned as they are; rows with repeated or null ids are treated alike; other
columns are ignored or, in ``pseudonymise``, returned; an empty table gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterspark.llm.common import cut, table

#: Setting that holds the key; the query draws one at random where it is unset.
KEY_SETTING = "spark.scatterspark.surrogate.key"

#: Given names by (script, gender).
GIVEN = {
    ("latin", "f"): "Alice Barbara Caroline Charlotte Claire Elizabeth Emily Hannah Isabelle Jennifer Julia Katharina Laura Maria Patricia Sophie Susan Victoria Mary Anna Anne Linda Margaret Sarah Karen Nancy Lisa Helen Sandra Ruth Rachel Martha Rebecca Emma Olivia Amanda Stephanie Catherine Marie Nathalie Camille Christine Sabine Petra Monika Ursula Carmen Ana Isabel Lucia Marta Pilar Elena Rosa".split(),
    ("latin", "m"): "Alexander Benjamin Charles Christopher Daniel Edward Frederick George Jonathan Joseph Matthew Michael Nicholas Patrick Richard Robert Stephen William John James David Thomas Peter Paul Mark Andrew Steven Kevin Brian Anthony Henry Jack Samuel Simon Martin Adam Philip Jason Eric Hans Klaus Wolfgang Stefan Andreas Jan Pierre Jean Jacques Luc Michel Antoine Carlos Juan Luis Miguel Pedro Antonio Manuel Pablo".split(),
    ("cyrillic", "f"): "Александра Анастасия Валентина Екатерина Елена Ирина Людмила Наталья Ольга Светлана Татьяна Юлия Анна Мария Надежда Галина Дарья".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Владимир Дмитрий Евгений Михаил Николай Павел Сергей Юрий Иван Александр Максим Антон Пётр".split(),
    ("greek", "f"): "Αικατερίνη Αναστασία Βασιλική Δήμητρα Ελένη Ειρήνη Μαρία Σοφία Άννα".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Πέτρος".split(),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Señor", "Señora", "Don", "Doña", "г-н", "г-жа", "κ.")
#: Alphabets within which a character is shifted.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
NAME_LETTERS = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
HEX = ("0123456789abcdef",)

_GIVEN = sorted({n for x in GIVEN.values() for n in x})
#: Alternatives by first letter, tried only where a capital (or a title's letter) stands.
_alternatives = lambda names: "(?:" + "|".join(f"{a}(?:{'|'.join(n[1:] for n in names if n[0] == a)})" for a in sorted({n[0] for n in names})) + ")"
_BY_LETTER, _UPPER = _alternatives(_GIVEN), _alternatives(sorted(n.upper() for n in _GIVEN))
_FORMS = "(?:" + "|".join(t.replace(".", "[.]") for t in TITLES) + ")"
_CAPITAL = "(?=[A-ZА-ЯΑ-ΩΆ])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}\p{Ll}+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<=[=:\s\"'])(?=[A-Za-z0-9+/_-]{6})(?<=\b(?i:password|passwd|secret|token|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9+/_-]{6,}|\bAKIA[0-9A-Z]{16}\b",
    "ip": rf"(?<![\d.])(?=\d)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w.])(?:\d[ -]?){12,18}\d(?![\w])",
    # international with 8 to 15 digits in any groups; with a leading 0 and 9 to 12 digits; groups of 2 to 4 digits
    "phone": r"(?<![\w.])(?=[+(\d])(?:\+\d(?:[ .()-]{0,2}\d){7,14}|(?=0\d{1,4}[ .-])0[1-9](?:[ .-]?\d){7,10}|(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}[ .-]\d{2,4}(?:[ .-]\d{2,4})?)(?!\w)",
    "name": rf"{_CAPITAL}(?:(?<!\p{{L}})(?:{_BY_LETTER} {_WORD}|{_UPPER} \p{{Lu}}{{2,}})(?!\p{{L}})|(?<=[ ])(?<=(?<!\p{{L}}){_FORMS}[.]? ){_WORD}(?: {_WORD})?(?!\p{{L}}))",
}
#: A country code: what stands before the first mark, else by the numbering plan.
_CODE = r"^(\+\d{1,3}[ .-]|\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|)(.*)$"
ANY = "|".join(PATTERNS.values())
#: A text without these has none of the above.
HINT = rf"[0-9@]|(?=[pstaPSTA])(?i:password|passwd|secret|token|api_?key)\s{{0,2}}[=:]|{_CAPITAL}(?:{_BY_LETTER}|{_UPPER}|{_FORMS}[.]?) \p{{Lu}}|(?=[гκ])(?:г-н|г-жа|κ[.])[.]? \p{{Lu}}"


def kind(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), F.lit("ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn"))
        .when(m.rlike(r"^[\d -]+$") & (digits >= 13), F.lit("card"))
        .when(m.rlike(r"^[+(\d][\d ().-]+$") & m.rlike(r"^\+|[ ().-]"), F.lit("phone"))
        .when(m.rlike(rf"^(?:{_WORD}(?: {_WORD})?|\p{{Lu}}+ \p{{Lu}}{{2,}})$"), F.lit("name"))
        .otherwise(F.lit("secret"))
    )


def _draw(key: Column, what: str, before: Column) -> Column:
    """A keyed number in [0, 2^32) for what stands before a character."""
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit(f"|{what}|"), before), 256), 1, 8), 16, 10).cast("long")


def _chars(s: Column, fn) -> Column:
    """``fn(character, what precedes it)`` for every character, joined."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: fn(F.substring(s, i, F.lit(1)), F.substring(s, F.lit(1), i - 1))), "")


def _shift(key: Column, what: str, alphabets: tuple[str, ...]):
    def fn(c: Column, before: Column) -> Column:
        out = c
        n = _draw(key, what, F.lower(before))
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            out = F.when((c != "") & F.contains(F.lit(a), c), F.substring(F.lit(a), ((at - 1 + n) % len(a) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return fn


def _cipher(s: Column, key: Column, what: str, alphabets: tuple[str, ...] = LETTERS) -> Column:
    return F.when(F.length(s) == 0, s).otherwise(_chars(s, _shift(key, what, alphabets)))


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string, as if one more digit followed."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda a, x: a + x) % 10


def _card(m: Column, key: Column) -> Column:
    body = F.substring(m, F.lit(1), F.length(m) - 1)
    new = _cipher(body, key, "card")
    only = lambda x: F.regexp_replace(x, r"\D", "")
    last = F.right(m, F.lit(1)).cast("int")
    return F.concat(new, F.pmod(last + _luhn(only(body)) - _luhn(only(new)), F.lit(10)).cast("string"))


def _ip(m: Column, key: Column) -> Column:
    octets = F.split(m, r"\.")
    new = F.transform(
        F.sequence(F.lit(1), F.lit(4)),
        lambda i: ((F.element_at(octets, i).cast("int") + _draw(key, "ip", F.array_join(F.transform(F.slice(octets, F.lit(1), i - 1), lambda o: o.cast("int").cast("string")), "."))) % 256).cast("string"),
    )
    return F.array_join(new, ".")


def _name(m: Column, key: Column) -> Column:
    def word(w: Column) -> Column:
        out = _cipher(w, key, "name", NAME_LETTERS)
        for (script, gender), names in GIVEN.items():
            listed = F.array(*[F.lit(n) for n in names])
            at = F.array_position(listed, F.initcap(w))
            out = F.when(at > 0, F.element_at(listed, ((at - 1 + 1 + _draw(key, f"given|{script}|{gender}", F.lit("")) % (len(names) - 1)) % len(names) + 1).cast("int"))).otherwise(out)
        return F.when(w == F.upper(w), F.upper(out)).otherwise(out)

    return F.array_join(F.transform(F.split(m, " "), word), " ")


def surrogate(what: Column, m: Column, key: Column) -> Column:
    """The replacement of entity ``m`` of kind ``what``."""
    stem, top = F.regexp_extract(m, r"^(.*\.)([A-Za-z]+)$", 1), F.regexp_extract(m, r"^(.*\.)([A-Za-z]+)$", 2)
    code, rest = F.regexp_extract(m, _CODE, 1), F.regexp_extract(m, _CODE, 2)
    access, tail = F.regexp_extract(m, r"^(AKIA|)(.*)$", 1), F.regexp_extract(m, r"^(AKIA|)(.*)$", 2)
    return (
        F.when(what == "email", F.concat(_cipher(stem, key, "email"), top))
        .when(what == "ip", _ip(m, key))
        .when(what == "card", _card(m, key))
        .when(what == "phone", F.concat(code, _cipher(rest, key, "phone")))
        .when(what == "ssn", _cipher(m, key, "ssn"))
        .when(what == "name", _name(m, key))
        .when(tail.rlike("^[0-9a-f]+$"), _cipher(m, key, "hex", HEX))
        .otherwise(F.concat(access, _cipher(tail, key, "secret")))
    )


def _key(key: str, attempt: Column) -> Column:
    return F.concat(F.lit(f"{key}|"), attempt.cast("string"))


def _found(documents: DataFrame) -> DataFrame:
    hit = F.col("text").rlike(HINT)
    return documents.withColumn("__m", F.when(hit, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))


def redrawn(entities: DataFrame, key: str, max_rounds: int = 20) -> DataFrame:
    """``(entity, surrogate)`` for those of ``entities(what, entity)`` that need an attempt after the first.

    A surrogate that is an entity itself, or that a smaller entity of the kind has too, is drawn again.
    """
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = cut(entities.distinct().withColumn("attempt", F.lit(0)))
    for _ in range(max_rounds):
        # few bytes, but much to hash: a number given is not cut down to one task
        s = cut(e.repartition(tasks, "entity").withColumn("surrogate", surrogate(F.col("what"), F.col("entity"), _key(key, F.col("attempt")))))
        taken = e.select("what", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        shared = s.groupBy("what", "surrogate").agg(F.min("entity").alias("owner"), F.count("*").alias("n")).where("n > 1")
        s = s.join(taken, ["what", "surrogate"], "left").join(shared, ["what", "surrogate"], "left")
        s = cut(s.withColumn("again", F.col("real").isNotNull() | F.coalesce(F.col("entity") != F.col("owner"), F.lit(False))))
        if s.where("again").isEmpty():
            return s.where("attempt > 0").select("entity", "surrogate")
        e = cut(s.select("what", "entity", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")))
    raise RuntimeError(f"collisions remain after {max_rounds} rounds")


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """The documents with surrogates in ``text`` and the number of replacements in ``n_entities``, also where they have that column.

    Whoever has ``key`` can undo the replacements; equal keys give equal surrogates.
    """
    x = cut(_found(documents.select("doc_id", "text")).where(F.size("__m") > 0).select("doc_id", F.array_distinct("__m").alias("__m")))
    entities = x.select(F.explode("__m").alias("entity")).select(kind(F.col("entity")).alias("what"), "entity")
    again = redrawn(entities, key)
    own = x.select("doc_id", F.explode("__m").alias("entity")).join(again, "entity")
    own = own.groupBy(F.col("doc_id").alias("__id")).agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("__own"))
    y = _found(documents.select("doc_id", "text", F.struct("*").alias("__row"))).join(own, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    first = _key(key, F.lit(0))
    new = F.transform("__m", lambda m: F.coalesce(F.element_at(F.col("__own"), m), surrogate(kind(m), m, first)))
    between = F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    text = F.when(F.size("__m") > 0, text).otherwise(F.col("text"))
    rest = [c for c in documents.columns if c != "n_entities"]
    return y.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in rest], F.size("__m").cast("long").alias("n_entities"))


def query(spark, sf_dir):
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
