"""Replacement of personal data by keyed, type-consistent surrogates, in DataFrame functions only.

Every surrogate is a keyed one-to-one image of its entity within its kind and
format, and never the entity itself.  So the same entity always gets the same
surrogate (coreference, in and across documents) and different entities get
different ones (distinctness) without a table of entities.  `checked_surrogates`
tests that over the whole corpus and draws anew under another key if it fails.
Images come from SHA-512 with a secret key: who lacks the key can't undo them.

Repeated groups in the patterns are bounded or possessive, so no text, however
long, makes the regular expressions recurse deeply or scan more than linearly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import cut, drop_cut, fresh

#: Key of tests and of sessions that name none; a production run sets its own secret.
DEFAULT_KEY = "surrogates-1"
#: Keys that a corpus check tries before it gives up.
MOST_DRAWS = 8

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CUE = {
    "m": r"Mr\.?|Sir|Herrn?|Monsieur|Señor|Sr\.|Signor|г-н|господин",
    "f": r"Mrs\.?|Ms\.?|Miss|Lady|Frau|Madame|Mme\.?|Mlle\.?|Señora|Sra\.|Signora|г-жа|госпожа",
    "n": r"Dr\.|Prof\.|Mx\.?",
}
#: Words that come before a name and are not part of it.
_INTRODUCTIONS = "name is |named |Name: |Contact: |Author: |Signed, |Regards, |heiße |Name ist |m'appelle |nom est |me llamo |nombre es |меня зовут "
_SCRIPTS = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"
_NAME = rf"[\p{{Lu}}&&{_SCRIPTS}][\p{{L}}&&{_SCRIPTS}]{{1,39}}+"

#: Given names by script and gender; a listed name becomes another of its list.
GIVEN = {
    "latin m": (
        *("James", "Robert", "Michael", "David", "William", "Richard", "Thomas", "Charles", "Peter", "George", "Paul", "John", "Daniel", "Mark"),
        *("Hans", "Klaus", "Jürgen", "Wolfgang", "Stefan", "Jean", "Pierre", "Michel", "Jacques", "François", "Carlos", "Juan", "José", "Luis", "Miguel"),
    ),
    "latin f": (
        *("Mary", "Linda", "Susan", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Sarah", "Emma", "Laura", "Anna", "Maria", "Julia", "Emily", "Karen"),
        *("Ursula", "Monika", "Petra", "Sabine", "Marie", "Claire", "Sophie", "Isabelle", "Carmen", "Elena", "Lucía", "Sofía", "Pilar", "Nina"),
    ),
    "cyrillic m": ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей"),
    "cyrillic f": ("Мария", "Анна", "Ольга", "Елена", "Наталья", "Ирина", "Татьяна", "Светлана"),
}
_LISTED = "|".join(n for names in GIVEN.values() for n in names)

#: Kinds in the order in which they are tried at a place, with their Java patterns.
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_][A-Za-z0-9_.+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?:\.[A-Za-z0-9-]{1,63}+){0,30}\.[A-Za-z]{2,63}",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z_-]{0,127}+[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,200}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,5}\))?(?:[ .-]?[0-9]{2,5}){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"(?<![\p{{L}}])(?:(?:{'|'.join(_CUE.values())}) {_NAME}(?: {_NAME})?|(?:{_LISTED}) {_NAME}|(?<={_INTRODUCTIONS}){_NAME} {_NAME})(?![\p{{L}}\p{{N}}])",
}
#: What an entity of a kind starts with; kinds that are not here start with any letter.
_STARTS = {"secret": "[0-9a-fA-Fgs]", "iban": "[A-Z]", "ipv4": "[0-9]", "phone": "[0-9+(]", "card": "[0-9]", "ssn": "[0-9]", "person": r"[\p{Lu}\u0433]"}
#: A word that may be a name of a person whom the text names in full elsewhere.
_BARE = rf"(?=[\p{{Lu}}])(?<![\p{{L}}]){_NAME}(?![\p{{L}}\p{{N}}])"
ANY = "|".join(f"(?={_STARTS[k]})(?:{p})" if k in _STARTS else p for k, p in KINDS.items())
#: Every entity but a person holds a digit or an @; a person with a form of address one of these.
_PERSON_HINTS = ("Mr", "Ms", "Miss", "Mx", "Sir", "Lady", "Dr.", "Prof.", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Sr.", "Sra.", "Signor", "г-", "господ", "госпож")
_PERSON_HINTS += tuple(_INTRODUCTIONS.split("|"))

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Letters of names change within their class, which keeps script, case and syllables.
_VOWELS = ("aeiou", "аеёиіїоуыэєюя", "αεηιουω")
_NAME_CLASSES = (
    *_VOWELS,
    "bcdfghjklmnpqrstvwxyz",
    "бвгґджзйклмнпрстфхцчшщъьђћљњџ",
    "βγδζθκλμνξπρστφχψ",
    "àáâãäåæèéêëìíîïòóôõöøùúûüýāăąēėęīōőœūůűų",
    "çñćčďđģğķłľļńňņřśšşťţźżž",
    "άέήίόύώ",
)
_NAME_ALPHABETS = (*_NAME_CLASSES, *[c.upper() for c in _NAME_CLASSES])
#: Names that end so keep that letter, which often marks their gender.
_ENDING = "[" + "".join(_VOWELS) + "".join(_VOWELS).upper() + "]$"
#: Rounds of the network before the middle step, and as many after it.
_ROUNDS = 4


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _moved(s: Column, amount, alphabets: tuple[str, ...]) -> Column:
    """Each character of `s`, from the first on, moved in its alphabet by amount(place); characters of no alphabet stay."""
    # All alphabets in a row and, by place in it, a character whose code less 48 is the place in the alphabet or its size.
    every = F.lit("".join(alphabets))
    places, sizes = F.lit("".join(chr(48 + i) for a in alphabets for i in range(len(a)))), F.lit("".join(chr(48 + len(a)) for a in alphabets for _ in a))
    number = lambda codes, at: F.ascii(F.substring(codes, at, F.lit(1))) - 48

    def one(c: Column, i: Column) -> Column:
        new = lambda at: F.substring(every, at - number(places, at) + F.pmod(number(places, at) + amount(i), number(sizes, at)), F.lit(1))
        return _let(F.instr(every, c), lambda at: F.when(at > 0, new(at)).otherwise(c))

    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.split(s, ""), one), ""))


def _by_digest(s: Column, key: Column, number: Column, other: Column, sign: int, alphabets: tuple[str, ...]) -> Column:
    """`s` moved by the digests of key, round and other half: one digest for every 64 characters."""
    digests = F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / 64).cast("int")), lambda j: F.sha2(F.concat_ws("/", key, number, j, other), 512))
    byte = lambda d: lambda i: sign * F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return _let(F.array_join(digests, ""), lambda d: _moved(s, byte(d), alphabets))


def scramble(s: Column, key: Column, alphabets: tuple[str, ...]) -> Column:
    """A keyed one-to-one image of `s` with the same format; never `s` itself if one of its characters is in an alphabet.

    A network over the two halves: a round moves the characters of one half
    by the digest of the other.  Between its rounds and the same rounds undone
    every character moves by one place, and a conjugate of a permutation
    without fixed points has none either.
    """

    def there(h: Column, k: Column) -> Column:
        return F.struct(h["b"].alias("a"), _by_digest(h["a"], key, k, h["b"], 1, alphabets).alias("b"))

    def back(h: Column, k: Column) -> Column:
        return F.struct(_by_digest(h["b"], key, k, h["a"], -1, alphabets).alias("a"), h["a"].alias("b"))

    def on(x: Column) -> Column:
        return _moved(x, lambda i: F.lit(1), alphabets)

    middle = F.floor(F.length(s) / 2).cast("int")
    halves = F.struct(F.substring(s, F.lit(1), middle).alias("a"), F.substr(s, middle + 1).alias("b"))
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), halves, there, lambda h: F.struct(on(h["a"]).alias("a"), on(h["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(_ROUNDS), F.lit(1)), moved, back, lambda h: F.concat(h["a"], h["b"]))


def _luhn(digits: Column) -> Column:
    """The check digit that makes `digits` valid."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda t, d: t + F.when(d > 9, d - 9).otherwise(d)), F.lit(10))


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _card(s: Column, key: Column) -> Column:
    """Other digits; the check digit keeps its distance from the valid one."""
    head = F.substring(s, F.lit(1), F.length(s) - 1)
    last = lambda h: F.pmod(_luhn(_only_digits(h)) + F.substring(s, -1, 1).cast("int") - _luhn(_only_digits(head)), F.lit(10))
    return _let(scramble(head, key, (_DIGITS,)), lambda h: F.concat(h, last(h).cast("string")))


def _iban_check(account: Column, country: Column) -> Column:
    """The valid check number of an account: 98 less the remainder by 97 of account, country and 00, letters as 10 to 35."""
    plain = F.concat(F.regexp_replace(account, " ", ""), country, F.lit("00"))
    value = lambda c: F.instr(F.lit(_DIGITS + _UPPER), c) - 1
    return 98 - F.aggregate(F.split(plain, ""), F.lit(0), lambda r, c: (r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(s: Column, key: Column) -> Column:
    """Another account of the same country; the check number keeps its distance from the valid one."""
    country, check, account = F.substring(s, 1, 2), F.substring(s, 3, 2).cast("int"), F.substr(s, F.lit(5))
    moved = lambda new: F.pmod(check - _iban_check(account, country) + _iban_check(new, country) - 2, F.lit(97)) + 2
    number = lambda new: F.lpad(F.when(check.between(2, 98), moved(new)).otherwise(check).cast("string"), 2, "0")
    return _let(scramble(account, F.concat(key, country), (_DIGITS, _UPPER)), lambda new: F.concat(country, number(new), new))


def _ipv4(s: Column, key: Column) -> Column:
    """The network of `scramble` over the two halves of the address, as numbers."""
    octets = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    halves = F.struct((octets[0] * 256 + octets[1]).alias("a"), (octets[2] * 256 + octets[3]).alias("b"))

    def by(x: Column, k: Column, other: Column, sign: int) -> Column:
        return F.pmod(x + sign * F.conv(F.substring(F.sha2(F.concat_ws("/", key, k, other), 256), 1, 4), 16, 10).cast("int"), F.lit(65536))

    there = lambda h, k: F.struct(h["b"].alias("a"), by(h["a"], k, h["b"], 1).alias("b"))
    back = lambda h, k: F.struct(by(h["b"], k, h["a"], -1).alias("a"), h["a"].alias("b"))
    on = lambda h: F.struct(h["a"].alias("a"), F.pmod(h["b"] + 1, F.lit(65536)).alias("b"))
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), halves, there, on)
    octets_of = lambda h: F.array(*[F.floor(h["a"] / 256).cast("int"), h["a"] % 256, F.floor(h["b"] / 256).cast("int"), h["b"] % 256])
    return F.array_join(F.transform(F.aggregate(F.sequence(F.lit(_ROUNDS), F.lit(1)), moved, back, octets_of), lambda x: x.cast("string")), ".")


def _email(s: Column, key: Column) -> Column:
    """New local part and host names, the same host for the same host; the last label and reserved example hosts stay."""
    keep = F.regexp_extract(s, r"((?:\.example)?\.[A-Za-z]+)$", 1)
    local, at = F.substring_index(s, "@", 1), F.instr(s, "@")
    host = F.substring(s, at + 1, F.length(s) - at - F.length(keep))
    changed = lambda x, of: scramble(x, F.concat(key, F.lit(of), keep), (_DIGITS, _LOWER, _UPPER))
    return F.concat(changed(local, "local"), F.lit("@"), changed(host, "host"), keep)


def _phone(s: Column, key: Column) -> Column:
    """The country code stays if it stands apart."""
    code = F.regexp_extract(s, r"^(\+[0-9]{1,3})(?=[ .(-])", 1)
    return F.concat(code, scramble(F.substr(s, F.length(code) + 1), F.concat(key, code), (_DIGITS,)))


def _listed(name: Column, names: tuple[str, ...], key: Column) -> Column:
    """Another name of the list: all moved by one keyed amount, never 0."""
    move = F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 6), 16, 10).cast("int"), F.lit(len(names) - 1)) + 1
    listed = F.split(F.lit("|".join(names)), r"\|")
    return F.element_at(listed, (F.pmod(F.array_position(listed, name) - 1 + move, F.lit(len(names))) + 1).cast("int"))


def _given(name: Column, key: Column) -> Column:
    """A listed name gives another of its gender and script; any other a name of its letters' classes.

    The form of address has no say, so a person has one name under all of
    them; a last vowel stays, with the gender that it marks.  An image that is
    itself listed is mapped on until it is not (cycle walking, at most as
    often as there are listed names), so listed and other names never meet.
    """

    def other(x: Column) -> Column:
        end = F.regexp_extract(x, f"({_ENDING[:-1]})$", 1)
        return F.concat(scramble(F.substring(x, F.lit(1), F.length(x) - F.length(end)), F.concat(key, end), _NAME_ALPHABETS), end)

    times, known = sum(map(len, GIVEN.values())) + 1, f"^(?:{_LISTED})$"
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(times)), name, lambda x, i: F.when((i == 1) | x.rlike(known), other(x)).otherwise(x))
    cases = F.when(name == "", name)
    for names in GIVEN.values():
        cases = cases.when(name.rlike(f"^(?:{'|'.join(names)})$"), _listed(name, names, key))
    return cases.otherwise(walked)


def _parts(s: Column) -> tuple[Column, Column, Column]:
    """A person's form of address, given name and family name; the first two may be empty."""
    parts = F.split(s, " ")
    addressed = s.rlike(rf"^(?:{'|'.join(_CUE.values())}) ")
    given = F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).when(addressed, "").otherwise(parts[0])
    return F.when(addressed, parts[0]).otherwise(""), given, F.element_at(parts, -1)


def _person(s: Column, kind: Column, key: Column) -> Column:
    """The form of address stays; given and family names each have one image in all forms, alone too."""
    address, given, family = _parts(s)
    address = F.when((kind == "person") & (address != ""), address)
    given = F.when(kind == "given name", s).when(kind == "family name", "").otherwise(given)
    family = F.when(kind == "given name", "").otherwise(family)
    names = (_given(given, key), scramble(family, F.concat(key, F.lit("family")), _NAME_ALPHABETS))
    return F.concat_ws(" ", address, *[_let(x, lambda n: F.when(n != "", n)) for x in names])


def kind_of(s: Column) -> Column:
    """The first kind whose pattern takes all of an entity."""
    first, *rest = KINDS.items()
    return reduce(lambda w, k: w.when(s.rlike(f"^(?:{k[1]})$"), k[0]), rest, F.when(s.rlike(f"^(?:{first[1]})$"), first[0]))


def surrogate(entity: Column, kind: Column, key: str) -> Column:
    """The keyed replacement of an entity of a kind."""
    k = {name: F.lit(f"{key}/{name}") for name in KINDS}
    return (
        F.when(kind == "email", _email(entity, k["email"]))
        .when((kind == "secret") & entity.rlike("^[0-9a-f]+$"), scramble(entity, k["secret"], (_HEX,)))
        .when((kind == "secret") & entity.rlike("^[0-9A-F]+$"), F.upper(scramble(F.lower(entity), k["secret"], (_HEX,))))
        .when(kind == "secret", scramble_tail(entity, k["secret"]))
        .when(kind == "iban", _iban(entity, k["iban"]))
        .when(kind == "ipv4", _ipv4(entity, k["ipv4"]))
        .when(kind == "phone", _phone(entity, k["phone"]))
        .when(kind == "card", _card(entity, k["card"]))
        .when(kind == "ssn", scramble(entity, k["ssn"], (_DIGITS,)))
        .otherwise(_person(entity, kind, k["person"]))
    )


def scramble_tail(s: Column, key: Column) -> Column:
    """Issuer prefixes stay, the rest is scrambled."""
    head = F.regexp_extract(s, "^(AKIA|gh[pousr]_|sk-)", 1)
    return F.concat(head, scramble(F.substr(s, F.length(head) + 1), F.concat(key, head), (_DIGITS, _LOWER, _UPPER)))


def with_surrogates(docs: DataFrame, key: str, into: str = "pii") -> DataFrame:
    """`docs` with replaced `text` and, in column `into`, an array of structs (kind, entity, surrogate) in text order.

    Null texts stay null and have no entities; so do empty ones.  Texts of
    any length are read whole.  All other columns and all rows stay, repeated
    ones too; a column that is called like `into` gives way to it; an empty
    table gives none.  A text is cut at the matches of one pattern and put
    together again around the surrogates; nothing is shuffled.  Where a text
    names a person, the parts of that name are replaced wherever they stand
    alone in it.
    """
    columns = [c for c in docs.columns if c.lower() != into.lower()]
    found_, items_ = fresh(docs, "found", into), fresh(docs, "items", into)
    text = F.col("text").cast("string")
    named = text.rlike(rf"(?<![\p{{L}}])(?=[\p{{Lu}}])(?:{_LISTED}) [\p{{Lu}}]")
    hint = reduce(lambda a, b: a | b, [text.contains(x) for x in _PERSON_HINTS], text.rlike("[0-9@]")) | named
    none = F.array().cast("array<string>")
    kind = lambda e: F.coalesce(kind_of(e), F.lit("person"))
    first = docs.select(*[f"`{c}`" for c in columns], F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none).alias(found_))
    people = F.transform(F.filter(found_, lambda e: kind(e) == "person"), lambda e: F.struct(_parts(e)[1].alias("given"), _parts(e)[2].alias("family")))
    first = first.withColumn(items_, people)
    wide = f"{ANY}|{_BARE}"
    has_person = F.size(items_) > 0
    givens, families = F.transform(items_, lambda p: p["given"]), F.transform(items_, lambda p: p["family"])

    def alone(e: Column) -> Column:
        """A word that the wide pattern found: a name of the text's persons, or nothing."""
        return F.when(F.instr(e, " ") > 0, "person").when(F.array_contains(families, e), "family name").when(F.array_contains(givens, e), "given name")

    def item(e: Column, k: Column) -> Column:
        return F.struct(k.alias("kind"), e.alias("entity"))

    every = F.when(has_person, F.transform(F.regexp_extract_all(text, F.lit(wide), F.lit(0)), lambda e: item(e, F.coalesce(kind_of(e), alone(e))))).otherwise(
        F.transform(found_, lambda e: item(e, kind(e)))
    )
    between = F.when(has_person, F.split(text, wide, -1)).otherwise(F.split(text, ANY, -1))
    second = first.withColumn(found_, every)
    replaced = F.transform(
        found_,
        lambda e: F.struct(
            e["kind"].alias("kind"), e["entity"].alias("entity"), F.when(e["kind"].isNotNull(), surrogate(e["entity"], e["kind"], key)).otherwise(e["entity"]).alias("surrogate")
        ),
    )
    third = second.select(*[f"`{c}`" for c in columns], replaced.alias(items_), F.when(F.size(found_) > 0, between).alias(found_))
    joined = F.concat(F.array_join(F.zip_with(F.slice(found_, 1, F.size(items_)), items_, lambda a, e: F.concat(a, e["surrogate"])), ""), F.element_at(found_, -1))
    new = F.when(F.size(items_) > 0, joined).otherwise(text)
    return third.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], F.filter(items_, lambda e: e["kind"].isNotNull()).alias(into))


def _shared(found: DataFrame, into: str) -> DataFrame:
    """kind, surrogate, n of surrogates that different entities of a kind share."""
    each = found.select(F.explode(into).alias("e")).select("e.*").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1")


def collisions(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """kind, surrogate, n for surrogates that different entities of the corpus share: none, if all is well."""
    return _shared(with_surrogates(docs.select("doc_id", "text"), key), "pii")


def checked_surrogates(docs: DataFrame, key: str, into: str = "pii") -> DataFrame:
    """`with_surrogates` after a check over the corpus that no two entities of a kind share a surrogate.

    If some do, all surrogates are drawn anew under the next key, so that
    coreference holds, up to `MOST_DRAWS` times.  Only the distinct entities
    are shuffled.
    """
    for turn in range(MOST_DRAWS):
        new = cut(with_surrogates(docs, f"{key}/{turn}" if turn else key, into))
        if _shared(new, into).isEmpty():
            return new
        drop_cut(new)
    raise RuntimeError("different entities share a surrogate under every key")


def replace_pii(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, text, n_entities, n_distinct, n_collisions for every row of `docs`, checked over the corpus.

    n_collisions counts the document's distinct entities that share a
    surrogate, or whose surrogate is an entity that the document holds; 0 says
    that the check of the row passed.
    """
    new = checked_surrogates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    entities = F.array_distinct(F.transform("pii", lambda e: e["entity"]))
    images = F.array_distinct(F.transform("pii", lambda e: e["surrogate"]))
    return new.select(
        "doc_id",
        "text",
        F.size("pii").cast("long").alias("n_entities"),
        F.size(entities).cast("long").alias("n_distinct"),
        (F.size(entities) - F.size(images) + F.size(F.array_intersect(entities, images))).cast("long").alias("n_collisions"),
    )
