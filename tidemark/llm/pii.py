"""Surrogates for personal data, in DataFrame functions only (no Python on executors).

Entities: e-mail addresses, IPv4 addresses, payment cards, phone numbers, social security
numbers, IBANs, access keys, password/token assignments and person names (a known given name
and a surname, or a title and a name, in title case or capitals; and the bare surnames of these
persons anywhere in the same text, where the word does not occur in small letters there). Each gets a replacement derived from a keyed SHA-512 of
its canonical form, so mentions of one entity agree in all documents (coreference), whatever
their spelling (case of an address, punctuation of a number). Replacements keep the type and
format: letters, digits and punctuation stay in place, a card keeps its first digit and a
valid check digit, a phone its country code, an address its private range, a name the gender
and script of its given name (a keyed rotation of the list: a bijection without fixed
points), capitals stay capitals.

Collision checks: over the distinct canonical forms of the whole corpus, a replacement may
neither be shared by two entities of a kind nor equal an entity that occurs. Entities that
lose a clash are re-keyed (attempt + 1) until none is left. Only re-keyed entities are joined
back to the texts that hold them; all other rows are mapped where they are read.

Digits that look like a card number but fail its check digit (order and serial numbers) are no
mention and stay; the digits after the first group are looked at again.

Null text stays null, text without entities is unchanged, every input row gives one row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

KEY = "tidemark-surrogates-1"
MAX_ROUNDS = 64

# Given names by (gender, script).
GIVEN = {
    ("f", "latin"): "Abigail Agnieszka Aisha Akiko Alessandra Alexandra Alice Alicia Amanda Amandine Amelia Amy Ana Andrea Angela Anja "
                    "Anjali Ann Anna Anne Ashley Astrid Ayse Barbara Beatriz Betty Beverly Birgit Brenda Brigitte Brittany Camila Camille "
                    "Carmen Carol Caroline Carolyn Catherine Charlotte Cheryl Chiara Chloe Christa Christina Christine Claire Clara Claudia "
                    "Cristina Cynthia Daniela Danielle Deborah Debra Deepika Denise Diana Diane Dolores Donna Dorothy Eleanor Elena Elisa "
                    "Elizabeth Ella Elsa Emily Emine Emma Erika Eva Eve Evelyn Ewa Fatima Fatma Federica Fiona Francesca Franziska Freja "
                    "Gabriela Gabriele Giovanna Gisela Giulia Gloria Greta Hanna Hannah Heather Heidi Heike Helena Ines Ingrid Irina Isabel "
                    "Isabella Isabelle Jacqueline Janet Janice Jean Jennifer Jessica Jiyeon Joan Joanna Johanna Josefa Joyce Judith Julia "
                    "Julie Juliette Karen Karin Katarzyna Katharina Katherine Kathleen Kathryn Keiko Kelly Khadija Kimberly Lakshmi Laura "
                    "Lauren Layla Lea Leila Lena Lily Linda Linh Linnea Lisa Lucia Lucy Lucía Magdalena Manon Margaret Maria Marie Marilyn "
                    "Marlene Marta Martha Martina Mary Maryam Mathilde Megan Mei Melissa Mia Michelle Molly Monika Monique Nadine Nancy "
                    "Naoko Natalia Natalie Nathalie Nicole Nina Noor Olga Olivia Pamela Paola Patricia Paula Petra Pilar Pooja Priya Rachel "
                    "Raquel Rebecca Renate Rosa Ruth Sabine Sakura Samantha Sandra Sara Sarah Sharon Shirley Sigrid Silke Silvia Sofia "
                    "Sophia Sophie Stefanie Stephanie Sunita Susan Susanne Svetlana Sylvie Tatiana Teresa Theresa Thuy Ursula Valentina "
                    "Valerie Victoria Yasmin Yuki Zeynep Zoe Zofia",
    ("m", "latin"): "Aaron Adam Ahmed Ahmet Alain Alan Albert Alberto Alexander Alexei Ali Alvaro Amit Anders Andreas Andrew Andrzej "
                    "Anthony Antoine Antonio Arjun Arthur Benjamin Bernard Bernd Billy Bobby Boris Brandon Brian Bruce Bryan Carl Carlos "
                    "Charles Christopher Daniel David Dennis Diego Dieter Dmitri Dominik Douglas Dylan Edward Elijah Emre Enrique Eric Erik "
                    "Ernst Ethan Felix Ferdinand Fernando Florian Francesco Francisco François Friedrich Gabriel Gary George Gerald Gerhard "
                    "Giovanni Giuseppe Gregory Guillaume Hans Harold Harry Haruto Hassan Heinz Helmut Henrik Henry Hiroshi Horst Hugo "
                    "Hussein Ibrahim Igor Ivan Jack Jacob Jacques Jakub James Jan Jason Javier Jeffrey Jens Jeremy Jerry Jesse Johannes "
                    "John Jonas Jonathan Jorge Jose Joseph Joshua Juan Jukka Julien Jun Justin Karim Karl Keith Kenji Kenneth Kevin Khalid "
                    "Klaus Krzysztof Kyle Larry Lars Laurent Lawrence Leon Liam Logan Lorenzo Louis Luca Lucas Luis Lukas Magnus Manfred "
                    "Manuel Marcin Marco Mario Mark Markus Martin Mathieu Matteo Matthew Matthias Maximilian Mehmet Michael Michel Miguel "
                    "Mikael Mikhail Minh Mohamed Mohammed Moritz Muhammad Mustafa Nathan Nicholas Nicolas Nikolai Nils Noah Olaf Oliver "
                    "Olivier Omar Otto Pablo Paolo Pascal Patrick Paul Pawel Pedro Pekka Peter Philip Philipp Philippe Pierre Piotr Rafael "
                    "Rahul Rainer Raj Ralf Ralph Ramon Randy Ravi Raymond Riccardo Richard Robert Roberto Roger Ronald Roy Russell Ryan "
                    "Samuel Sanjay Satoshi Scott Sean Sebastian Sergei Sergio Simon Stefan Stefano Stephen Steven Suresh Sven Takashi Tariq "
                    "Terry Thomas Timothy Tobias Tomasz Torsten Tyler Uwe Vijay Vincent Vladimir Walter Wayne Wei Werner William Willie "
                    "Wolfgang Yuri Yusuf Zachary",
    ("f", "cyrillic"): "Александра Алина Алла Анастасия Анна Валентина Валерия Вера Вероника Виктория Галина Дарья Евгения Екатерина Елена "
                    "Елизавета Жанна Зинаида Инна Ирина Карина Кристина Ксения Лариса Лидия Людмила Маргарита Марина Мария Надежда Наталья "
                    "Нина Оксана Ольга Полина Раиса Светлана Софья Тамара Татьяна Юлия Яна",
    ("m", "cyrillic"): "Александр Алексей Анатолий Андрей Антон Аркадий Артем Борис Вадим Валерий Василий Виктор Виталий Владимир Вячеслав "
                    "Геннадий Георгий Григорий Даниил Денис Дмитрий Евгений Егор Иван Игорь Илья Кирилл Константин Леонид Максим Михаил "
                    "Никита Николай Олег Павел Петр Роман Руслан Сергей Станислав Степан Тимур Федор Юрий Яков",
    ("f", "greek"): "Αγγελική Αικατερίνη Αναστασία Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ελευθερία Ευαγγελία Ιωάννα Κατερίνα Κωνσταντίνα "
                    "Μαρία Παναγιώτα Σοφία Χριστίνα",
    ("m", "greek"): "Αθανάσιος Αλέξανδρος Αναστάσιος Αντώνιος Βασίλειος Γεώργιος Γιάννης Γιώργος Δημήτριος Ευάγγελος Ιωάννης Κωνσταντίνος "
                    "Μιχαήλ Νικόλαος Παναγιώτης Σπυρίδων Σταύρος Χρήστος",
}
# Forms of address.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora"
SYLLABLES = {
    "latin": "bal ben cor dal den dor fal fen gar gil hal har kel kir lan lor mal mar nel nor pel ral ren rod sal ser tal tor val vin wes win",
    "cyrillic": "бал бер вол гор дар дем жар зор кал кир лав лом мар мир нев нор пав рад сав сол тар тир фед чер",
    "greek": "βαλ γαρ δαμ ζαν θαλ καλ κορ λαμ μαρ νικ παλ ροδ σαβ σολ ταρ φιλ",
}

EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
SECRET = rf"\b{SECRET_NAME}\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9+/_.\-]{{6,}}"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
# Issuers 3 to 6 and 2221 to 2720; groups of four, or 4-6-4 and 4-6-5. The check digit is tested apart.
CARD = (r"(?<![0-9.-])(?:[3-6][0-9]{3}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)"
        r"(?:(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])")
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
         r"|(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_NAME_WORD = r"\p{Lu}[\p{L}'’-]+"


def _one_of(words: list[str]) -> str:
    """Any of the words, not inside another. The first letter is matched as one class and only
    then looked back at, so all other positions of a text fail at once."""
    first: dict[str, list[str]] = {}
    for w in sorted(words):
        first.setdefault(w[0], []).append(w[1:])
    letters = "[A-ZΑ-ΩА-Я]"  # ranges: a list of single letters is many times slower
    return rf"{letters}(?<!\p{{L}}{letters})(?:{'|'.join(f'(?<={c})(?:{"|".join(rest)})' for c, rest in first.items())})"


def _cases(words: str) -> list[str]:
    return [x for w in words.split() for x in dict.fromkeys((w, w.upper()))]


_GIVEN = _one_of(_cases(" ".join(GIVEN.values())))
_TITLE = _one_of(_cases(TITLES))
NAME = rf"{_TITLE}\.? {_NAME_WORD}(?: {_NAME_WORD})?|{_GIVEN} {_NAME_WORD}"
# In order of precedence; the first that matches a whole mention names its kind.
PATTERNS = {"email": EMAIL, "secret": SECRET, "key": ACCESS_KEY, "ip": IP, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE, "name": NAME}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_BEFORE_CARD, _FROM_CARD = ANY[: ANY.index(CARD)], ANY[ANY.index(CARD):]
# Every mention holds a digit, one of these signs (addresses, assignments) or a name; cheap to
# test before the patterns.
HINT = rf"[0-9@=:]|A[KS]IA|gh[pousr]_|sk-|{_one_of(_cases(" ".join([TITLES, *GIVEN.values()])))}"


def _rotation(key: str) -> dict[str, str]:
    """Given name (lower-cased) to another of its gender and script, one to one."""
    out = {}
    for names in GIVEN.values():
        ring = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}|given|{n}".encode()).digest())
        out |= {n.lower(): ring[(i + 1) % len(ring)] for i, n in enumerate(ring)}
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _prefix(kind: Column, mention: Column) -> Column:
    return F.when(kind == "secret", F.regexp_extract(mention, rf"^({SECRET_NAME}\s*[=:]\s*[\"']?)", 1)).otherwise("")


def _core(kind: Column, mention: Column) -> Column:
    return F.when(kind == "secret", F.regexp_replace(mention, rf"^{SECRET_NAME}\s*[=:]\s*[\"']?", "")).otherwise(mention)


def _canonical(kind: Column, core: Column) -> Column:
    return (F.when(kind.isin("email"), F.lower(core))
            .when(kind.isin("card", "ssn"), _digits(core))
            .when(kind == "phone", F.concat(F.when(core.startswith("+"), "+").otherwise(""), _digits(core)))
            .when(kind == "iban", F.replace(core, F.lit(" "), F.lit("")))
            .otherwise(core))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _shape(text: Column, stream: Column, hexes: Column) -> Column:
    """Letters and digits replaced in place; text of hexadecimal digits stays so."""
    def one(c, i):
        b = _byte(stream, i)
        return (F.when(hexes, F.substring(F.lit("0123456789abcdef"), (b % 16 + 1), F.lit(1)))
                .when((c >= "A") & (c <= "Z"), F.char(b % 26 + 65))
                .when((c >= "a") & (c <= "z"), F.char(b % 26 + 97))
                .when((c >= "0") & (c <= "9"), (b % 10).cast("string")).otherwise(c))

    return F.array_join(F.transform(_chars(text), one), "")


def _place(surface: Column, digits: Column) -> Column:
    """The digits, in order, at the places of the surface's digits."""
    def one(c, i):
        nth = F.length(_digits(F.substring(surface, F.lit(1), i + 1)))
        return F.when((c >= "0") & (c <= "9"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_chars(surface), one), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value worked out once (Spark repeats an expression wherever it is used,
    inside a lambda for each element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(n: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: (_byte(stream, i) % 10).cast("string")), "")


def _luhn(body: Column) -> Column:
    """Check digit of a card number given without it."""
    def one(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.transform(F.reverse(_chars(body)), one), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _valid_card(digits: Column) -> Column:
    n = F.length(digits)
    return _luhn(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1))


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _surname(core: Column, stream: Column) -> Column:
    out = F
    for script, words in SYLLABLES.items():
        parts = F.array(*[F.lit(w) for w in words.split()])
        made = F.concat(*[F.element_at(parts, _byte(stream, F.lit(i)) % len(words.split()) + 1) for i in range(4)])
        out = out.when(_script(core) == script, made)
    made = out.otherwise(F.lit(""))
    return F.when((F.upper(core) == core) & (F.length(core) > 1), F.upper(made)).otherwise(F.initcap(made))


def _ip(core: Column, stream: Column) -> Column:
    o = [(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]
    first = F.element_at(F.split(core, r"\."), 1)
    public = (_byte(stream, F.lit(4)) % 115 + 11).cast("string")  # 11 to 125: neither private nor loopback
    return (F.when(core.startswith("192.168."), F.concat_ws(".", F.lit("192"), F.lit("168"), o[2], o[3]))
            .otherwise(F.concat_ws(".", F.when(first.isin("10", "127", "0"), first).otherwise(public), o[1], o[2], o[3])))


def _email(core: Column, stream: Column) -> Column:
    local = F.regexp_extract(core, "^([^@]*)@", 1)
    top = F.lower(F.regexp_extract(core, r"\.([^.]*)$", 1))
    label = F.lower(_shape(F.lit("abcdef"), F.reverse(stream), F.lit(False)))
    return F.concat(_shape(local, stream, F.lit(False)), F.lit("@"), label, F.lit(".example."),
                    F.when(top.isin("com", "org", "net"), top).otherwise("org"))


def surrogate(kind: Column, core: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The replacement of a mention's core; depends on the canonical form and the attempt only,
    but for the letters' case and the punctuation."""
    source = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string")), 512)
    head = F.when(~canonical.startswith("+"), 0).when(F.substring(_digits(canonical), 1, 1).isin("1", "7"), 1).otherwise(2)

    def phone(stream, digits):
        lead = (_byte(stream, F.lit(60)) % 8 + 2).cast("string")
        return F.concat(F.substring(digits, F.lit(1), head), lead, F.substring(_number(F.length(digits), stream), head + 2, F.length(digits)))

    def card(stream, digits):
        body = F.concat(F.substring(digits, 1, 1), _number(F.length(digits) - 2, stream))
        return _let(body, lambda x: F.concat(x, _luhn(x)))

    def placed(digits, surface=core):
        return _let(digits, lambda d: _place(surface, d))

    fixed = "^(AKIA|ASIA|gh[pousr]_|sk-)"
    return _let(source, lambda stream: (
        F.when(kind == "email", _email(core, stream))
        .when(kind == "ip", _ip(core, stream))
        .when(kind == "phone", placed(phone(stream, _digits(canonical))))
        .when(kind == "card", placed(card(stream, canonical)))
        .when(kind == "ssn", placed(_number(F.lit(9), stream)))
        .when(kind == "iban", F.concat(F.substring(core, 1, 2), placed(_number(F.lit(40), stream), F.substring(core, F.lit(3), F.length(core)))))
        .when(kind == "key", F.concat(F.regexp_extract(core, fixed, 1), _shape(F.regexp_replace(core, fixed, ""), stream, F.lit(False))))
        .when(kind == "surname", _surname(core, stream))
        .otherwise(_let(core.rlike("^[0-9a-f]+$"), lambda hexes: _shape(core, stream, hexes)))))


def _surnames(found: Column, text: Column, given: Column) -> Column:
    """Surnames of the persons among the first mentions, but words the text has in small letters too."""
    words = F.flatten(F.transform(F.filter(found, lambda m: m["kind"] == "name"), lambda m: F.split(m["core"], " ")))
    words = F.filter(F.array_distinct(words), lambda w: ~_is_title(w) & (F.length(w) > 2) & F.element_at(given, F.lower(w)).isNull())
    return F.filter(words, lambda w: ~F.regexp_like(text, F.concat(F.lit(r"(?<!\p{L})"), F.lower(w), F.lit(r"(?!\p{L})"))))


def _pattern(found: Column, text: Column, given: Column) -> Column:
    """What a second look at a text searches for, or null if the first look saw all."""
    no_cards = F.transform(F.filter(found, lambda m: m["kind"] == "none"), lambda m: m["mention"])
    look = F.when(F.size(no_cards) > 0, F.concat(F.lit(_BEFORE_CARD + "(?!(?:"), F.array_join(F.array_distinct(no_cards), "|"), F.lit(")(?![0-9]))" + _FROM_CARD))
                  ).otherwise(F.lit(ANY))

    def more(surnames):
        forms = F.array_distinct(F.flatten(F.transform(surnames, lambda w: F.array(w, F.upper(w), F.initcap(F.lower(w))))))
        return F.when(F.size(surnames) > 0, F.concat(look, F.lit(r"|(?<!\p{L})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})"))).when(F.size(no_cards) > 0, look)

    return F.when(F.exists(found, lambda m: m["kind"].isin("name", "none")), _let(_surnames(found, text, given), more))


def _mentions(text: Column, given: Column) -> Column:
    """(pattern, found): the mentions, and the pattern they match if not ANY."""
    return _let(_scan(text, F.lit(ANY)), lambda found: _let(_pattern(found, text, given), lambda pattern: F.struct(
        pattern.alias("pattern"), F.when(pattern.isNull(), found).otherwise(_scan(text, pattern)).alias("found"))))


def _scan(text: Column, pattern: Column) -> Column:
    """Mentions as (kind, mention, prefix, core, canonical); a name is one mention a word."""
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(_kind(m).alias("kind"), m.alias("mention")))
    return F.transform(found, lambda x: F.struct(
        x["kind"].alias("kind"), x["mention"].alias("mention"), _prefix(x["kind"], x["mention"]).alias("prefix"),
        _core(x["kind"], x["mention"]).alias("core"), _canonical(x["kind"], _core(x["kind"], x["mention"])).alias("canonical")))


def _kind(mention: Column) -> Column:
    """The kind whose pattern takes the whole mention (look-arounds see only the mention); none:
    a card number but for its check digit."""
    out = F
    for kind, pattern in PATTERNS.items():
        named = F.lit(kind) if kind != "card" else F.when(_valid_card(_digits(mention)), "card").otherwise("none")
        out = out.when(F.regexp_extract(mention, f"^(?:{pattern})$", 0) != "", named)
    return out.otherwise("name")


def _is_title(word: Column) -> Column:
    return F.replace(word, F.lit("."), F.lit("")).isin(*_cases(TITLES))


def _entities(mention: Column, given: Column) -> Column:
    """The (kind, canonical) pairs a mention holds; given names need none."""
    names = F.filter(F.split(mention["core"], " "), lambda w: ~_is_title(w) & F.element_at(given, F.lower(w)).isNull())
    return F.when(mention["kind"] == "name", F.transform(names, lambda w: F.struct(F.lit("surname").alias("kind"), F.lower(w).alias("canonical")))
                  ).when(mention["kind"] != "none", F.array(F.struct(mention["kind"].alias("kind"), mention["canonical"].alias("canonical"))))


def _replacement(mention: Column, given: Column, attempts: Column, key: str) -> Column:
    def attempt(kind, canonical):
        return F.coalesce(F.element_at(attempts, F.concat_ws("|", kind, canonical)), F.lit(0))

    def word(w):
        other = F.element_at(given, F.lower(w))
        other = F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(other)).otherwise(other)
        return (F.when(_is_title(w), w).when(other.isNotNull(), other)
                .otherwise(surrogate(F.lit("surname"), w, F.lower(w), attempt(F.lit("surname"), F.lower(w)), key)))

    return F.when(mention["kind"] == "none", mention["mention"]).when(
        mention["kind"] == "name", F.array_join(F.transform(F.split(mention["core"], " "), word), " ")).otherwise(
        F.concat(mention["prefix"], surrogate(mention["kind"], mention["core"], mention["canonical"], attempt(mention["kind"], mention["canonical"]), key)))


def _given(key: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in _rotation(key).items() for x in pair])


def settle(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, attempt) such that replacements clash with nothing. Rows that lose a
    clash are tried again; the smallest canonical form wins."""
    cur = entities.select("kind", "canonical", F.lit(0).alias("attempt"))
    for _ in range(MAX_ROUNDS):
        made = cur.withColumn("made", surrogate(F.col("kind"), F.col("canonical"), F.col("canonical"), F.col("attempt"), key))
        made = materialise(made.withColumn("made", _canonical(F.col("kind"), F.when(F.col("kind") == "surname", F.lower("made")).otherwise(F.col("made")))), "surrogates")
        first = made.groupBy("kind", "made").agg(F.min("canonical").alias("winner"), F.count("*").alias("n")).where("n > 1")
        real = entities.select("kind", F.col("canonical").alias("made"), F.lit(True).alias("real"))
        judged = made.join(first, ["kind", "made"], "left").join(real, ["kind", "made"], "left")
        lost = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("winner") != F.col("canonical"), F.lit(False))
        judged = materialise(judged.select("kind", "canonical", "attempt", lost.alias("lost")), "judged")
        if judged.where("lost").isEmpty():
            return judged.select("kind", "canonical", "attempt")
        cur = judged.select("kind", "canonical", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates still clash; the replacement space is too small")


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` as one struct column ``row``, the new ``text`` and ``n_entities``."""
    given = _given(key)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("hit", F.coalesce(F.col("text").rlike(HINT), F.lit(False)))
    digest = F.when(F.col("hit"), F.sha2("text", 256))
    # One pass: which entities each text (by digest) holds.
    mentions = rows.where("hit").select(digest.alias("digest"), F.explode(_mentions(F.col("text"), given)["found"]).alias("m"))
    holds = materialise(mentions.select("digest", F.explode(_entities(F.col("m"), given)).alias("e")).select("digest", "e.*"), "mentions")
    entities = materialise(holds.select("kind", "canonical").distinct(), "entities")
    redone = materialise(settle(entities, key).where("attempt > 0"), "rekeyed")
    # Only texts that hold a re-keyed entity get a map of attempts.
    again = holds.join(redone, ["kind", "canonical"]).distinct()
    patches = materialise(again.groupBy("digest").agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("|", "kind", "canonical"), "attempt"))).alias("attempts")), "patches")
    rows = rows.withColumn("digest", digest).join(patches, "digest", "left")
    attempts = F.coalesce("attempts", F.create_map().cast("map<string,int>"))
    seen = rows.withColumn("seen", F.when(F.col("hit"), _mentions(F.col("text"), given)))
    found = seen.withColumn("found", F.coalesce("seen.found", F.array().cast(
        "array<struct<kind:string,mention:string,prefix:string,core:string,canonical:string>>")))
    made = F.transform("found", lambda m: _replacement(m, given, attempts, key))
    whole = F.array_join(F.flatten(F.zip_with(F.when(F.isnull("seen.pattern"), F.split("text", ANY, -1)).otherwise(F.split("text", F.col("seen.pattern"), -1)), F.concat(made, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return found.select("row", F.when(F.size("found") > 0, whole).otherwise(F.col("text")).alias("text"),
                        F.size(F.filter("found", lambda m: m["kind"] != "none")).cast("long").alias("n_entities"))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with entities of the text column replaced; columns and types unchanged."""
    done = replace_entities(docs, text_col, key)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
