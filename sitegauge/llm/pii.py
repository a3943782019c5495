"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment card numbers, account numbers (IBAN), access keys and secrets, and names of
persons (given names from a list when a capitalised word follows; the words after a title or such a name; initials may stand between and are
left as they are). A surrogate is derived from a secret key and the
entity's canonical form, so one entity gets one surrogate in all documents and in all its spellings (letter case, separators, country code). It keeps
type and format: separators, letter case and length; digits stay digits, vowels vowels, consonants consonants of the same script; given names stay in their
gender and script; top-level domains, key prefixes, issuer digits and IBAN countries stay; a card number with a valid check digit gets a valid one.

Distinct entities are collected once (copies of documents share their list of mentions and collapse first). Surrogates that two entities share,
or that are themselves an entity of the data, are drawn again with the next attempt number, the smallest canonical form keeping its own. Entities that still
collide after ``ATTEMPTS`` draws (the space of their format is nearly used up) take the free values of their format in a keyed order; where none is
left, their surrogates become longer, one character at a time.

* NULL texts stay NULL, texts without entities stay as they are. Repeated rows are treated alike, ids are only carried. Empty tables give
  empty results. Extra columns are kept only where asked for (``keep``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.storage import load, remove, save, saved
from sitegauge.operators.ranking import exact_rank

ATTEMPTS = 24
MOST = 10 ** 15  # surrogates of one shape that are told apart
CHUNK = 4096

# Given names by script and gender; fixed values.
GIVEN = {
    ("latin", "female"): ("Alice", "Amanda", "Angela", "Anna", "Barbara", "Carmen", "Caroline", "Catherine", "Charlotte", "Christine", "Claudia",
                          "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Helena", "Isabel", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda",
                          "Lucia", "Margaret", "Maria", "Marie", "Martha", "Mary", "Michelle", "Monica", "Nancy", "Olivia", "Patricia", "Rachel",
                          "Rebecca", "Sandra", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula", "Victoria"),
    ("latin", "male"): ("Albert", "Alexander", "Andrew", "Anthony", "Antonio", "Benjamin", "Bernard", "Carlos", "Charles", "Christopher", "Daniel",
                        "David", "Diego", "Edward", "Eric", "Francis", "Frank", "George", "Hans", "Henry", "Jacques", "James", "John", "Jorge",
                        "Joseph", "Juan", "Karl", "Kenneth", "Klaus", "Louis", "Manuel", "Mark", "Martin", "Matthew", "Michael", "Miguel", "Nicholas",
                        "Oliver", "Patrick", "Paul", "Peter", "Philip", "Pierre", "Richard", "Robert", "Samuel", "Stefan", "Stephen", "Thomas",
                        "Walter", "William", "Wolfgang"),
    ("cyrillic", "female"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Надежда", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("cyrillic", "male"): ("Александр", "Алексей", "Борис", "Владимир", "Дмитрий", "Иван", "Николай", "Павел", "Пётр", "Сергей"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme", "господин", "госпожа")



def _any_of(words: Iterable[str]) -> str:
    """Alternation grouped by first letter, so that most places are given up after one character."""
    heads: dict[str, list[str]] = {}
    for word in sorted(words):
        heads.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{head}(?:{'|'.join(sorted(tails, key=len, reverse=True))})" for head, tails in heads.items())


_NAMES = _any_of(n for group in GIVEN.values() for n in group)
_TITLES = _any_of(TITLES)
_GAP = r"[^\p{L}\p{N}\r\n]{1,6}"  # between groups of digits
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_WORD = r"\p{Lu}['’-]*+\p{L}[\p{L}'’-]*+"  # two letters at least: a lone initial is no entity
_INITIAL = r"\p{Lu}(?:\.\s?|\s)"
_INITIALS = f"(?:{_INITIAL}(?:{_INITIAL}(?:{_INITIAL})?)?)?"  # up to three, unrolled as look-behinds need

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
PHONE = (rf"(?:\+\d{{1,3}}{_GAP})?\(\d{{2,4}}\){_GAP}?\d{{3,4}}[-. ]?\d{{3,4}}(?!\d)"
         r"|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\d.-])(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])")
IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
CARD = r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)|(?<![\d.])\d{4}[ -]?\d{6}[ -]?\d{5}(?!\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
ACCESS = r"(?<![\p{L}\p{N}])(?:AKIA|ASIA)[A-Z0-9]{16}(?![\p{L}\p{N}])"
HEX = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])"
SECRET = r"(?<=[=:][ \"']{0,2})(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey)[ \"']{0,2}[=:][ \"']{0,2})[A-Za-z0-9_./+-]{8,}"
PERSON = (rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_NAMES})(?=\s{_INITIALS}{_WORD})"
          rf"|(?<=(?:^|[^\p{{L}}])(?:{_TITLES})\.?\s{_INITIALS}){_WORD}|(?<=(?:^|[^\p{{L}}])(?:{_NAMES})\s{_INITIALS}){_WORD})")

PLAIN = "|".join((ACCESS, HEX, SECRET, EMAIL, IP, IBAN, CARD, PHONE))
ENTITY = f"{PLAIN}|{PERSON}"
#: One of these holds for every text with an entity; they are cheap to test.
MAYBE_PLAIN = r"[\d@=:]|[a-fA-F]{32}"
MAYBE_PERSON = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLES}|{_NAMES})\.?\s\p{{Lu}}"

_VOWELS = {"latin": "aeiou", "accented": "áéíóúàèìòùâêîôû", "cyrillic": "аеиоуыэюя", "greek": "αεηιοω"}
_CONSONANTS = {"latin": "bcdfghjklmnpqrstvwxyz", "cyrillic": "бвгджзклмнпрстфхцчшщ", "greek": "βγδζθκλμνξπρσφχψ"}


def mentions(text: Column) -> Column:
    """All entity mentions of a text in order; empty for NULL."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(MAYBE_PERSON), found(ENTITY)).when(text.rlike(MAYBE_PLAIN), found(PLAIN)).otherwise(
        F.array().cast("array<string>"))


def between(text: Column) -> Column:
    """What stands between the mentions, one part more than there are mentions."""
    return F.when(text.rlike(MAYBE_PERSON), F.split(text, ENTITY, -1)).otherwise(F.split(text, PLAIN, -1))


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def kind_of(mention: Column) -> Column:
    given = [n for group in GIVEN.values() for n in group]
    kind = F.when(mention.isin(given), F.lit("given")).otherwise(
        F.when(mention.rlike(r"^[\p{L}'’-]+$") & mention.rlike(r"^\p{Lu}") & ~mention.rlike(_whole(HEX)), F.lit("name")).otherwise(F.lit("secret")))
    for name, pattern in (("phone", PHONE), ("card", CARD), ("iban", IBAN), ("ip", IP), ("email", EMAIL), ("hex", r"[0-9a-fA-F]*\d[0-9a-fA-F]*"),
                          ("access", ACCESS)):
        if name == "hex":
            kind = F.when((kind == "secret") & mention.rlike(_whole(pattern)), F.lit("hex")).otherwise(kind)
        else:
            kind = F.when(mention.rlike(_whole(pattern)), F.lit(name)).otherwise(kind)
    return kind


def canonical(kind: Column, mention: Column) -> Column:
    """The same for all spellings of an entity."""
    digits = F.regexp_replace(mention, r"\D", "")
    national = F.when((F.length(digits) == 11) & F.startswith(digits, F.lit("1")), F.substring(digits, 2, 10)).otherwise(digits)
    return (F.when(kind == "phone", national).when(kind == "card", digits).when(kind == "iban", F.lower(F.regexp_replace(mention, " ", "")))
            .when(kind == "secret", mention).otherwise(F.lower(mention)))


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit scheme; a number is valid when it is divisible by ten."""
    places = F.sequence(F.lit(1), F.length(digits))
    values = F.transform(places, lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def _check_digit(body: Column) -> Column:
    return (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10


def _alphabet(kind: Column, name: Column, i: Column) -> Column:
    """The characters that a surrogate may have at place ``i`` (from 0) of a canonical form."""
    keep = F.when(kind == "access", F.lit(4)).when(kind == "iban", F.lit(2)).when(kind == "card", F.lit(1)).otherwise(F.lit(0))
    tail = F.when(kind == "email", F.length(F.substring_index(name, ".", -1))).otherwise(F.lit(0))
    c = F.substring(name, i + 1, F.lit(1))
    low = F.lower(c)
    out = F.when((i < keep) | (i >= F.length(name) - tail), c)
    out = out.when((kind == "phone") & (i == 0), F.lit("23456789")).when(c.rlike(r"\d"), F.lit("0123456789"))
    out = out.when((kind == "hex") & low.rlike("[a-f]"), F.lit("abcdef"))
    for letters in (*_VOWELS.values(), *_CONSONANTS.values()):
        out = out.when(low.rlike(f"[{letters}]"), F.lit(letters))
    out = out.when(c.rlike(r"\p{IsLatin}"), F.lit(_VOWELS["accented"])).when(c.rlike(r"\p{L}"), F.lit(_CONSONANTS["latin"])).otherwise(c)
    return F.when((c != low) & (kind == "secret"), F.upper(out)).otherwise(out)


def surrogate(key: str, kind: Column, name: Column, attempt: Column) -> Column:
    """Replacement of a canonical form, itself canonical."""
    seed = lambda part: F.concat_ws("|", F.lit(key), kind, name, attempt.cast("string"), F.lit(part))
    stream = F.concat(*[F.sha2(seed(str(part)), 512) for part in range(2)])
    byte_at = lambda i: F.conv(F.substring(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, byte: F.substring(letters, byte % F.length(letters) + 1, F.lit(1))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.length(name) - 1), lambda i: pick(_alphabet(kind, name, i), byte_at(i))), "")
    octets = F.concat_ws(".", *[(F.conv(F.substring(stream, 4 * j + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string") for j in range(4)])
    body = F.substring(text, F.lit(1), F.length(text) - 1)
    card = F.when(_luhn(name) % 10 == 0, F.concat(body, _check_digit(body).cast("string"))).otherwise(text)
    # Given names are a permutation of their list, which the key orders: no two can collide.
    given = {}
    for group in GIVEN.values():
        order = sorted(group, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        given |= {a.lower(): b.lower() for a, b in zip(order, order[1:] + order[:1])}
    swapped = F.element_at(F.create_map(*[F.lit(x) for pair in given.items() for x in pair]), name)
    return F.when(kind == "ip", octets).when(kind == "card", card).when(kind == "given", swapped).otherwise(text)


def _shape(kind: Column, name: Column, wide: int) -> Column:
    """The alphabets of all places, ``wide`` places longer than the canonical form. Surrogates of different shapes differ.

    The last place of a card number stands for the distance from the check digit.
    """
    places = F.transform(F.sequence(F.lit(0), F.length(name) - 1), lambda i: _alphabet(kind, name, i))
    digit = F.array(F.lit("0123456789"))
    for _ in range(wide):
        last = F.element_at(places, -1)
        letter = F.lit(_CONSONANTS["latin"])
        for script, letters in _CONSONANTS.items():
            letter = F.when(last == letters, F.lit(_VOWELS[script])).when(last == _VOWELS[script], F.lit(letters)).otherwise(letter)
        places = (F.when(kind == "name", F.concat(places, F.array(letter)))
                  .when(kind == "email", F.concat(F.array(F.lit(_CONSONANTS["latin"])), places))
                  .when(kind == "card", F.concat(F.slice(places, 1, 1), digit, F.slice(places, F.lit(2), F.size(places) - 1)))
                  .otherwise(F.concat(places, digit)))
    offset = F.when(_luhn(name) % 10 == 0, F.lit("0")).otherwise(F.lit("123456789"))
    return (F.when(kind == "ip", F.array(F.lit("ip"), *[F.lit("0123456789")] * wide))
            .when(kind == "card", F.concat(F.slice(places, F.lit(1), F.size(places) - 1), F.array(offset))).otherwise(places))


def _space(kind: Column, shape: Column) -> Column:
    """Number of surrogates of a shape, at most ``MOST``."""
    size = F.aggregate(shape, F.lit(1.0), lambda n, a: n * F.length(a))
    return F.least(F.lit(float(MOST)), F.when(kind == "ip", size / 2 * 254.0 ** 4).otherwise(size)).cast("bigint")


def _nth(kind: Column, shape: Column, n: Column) -> Column:
    """Surrogate number ``n`` (from 0) of a shape."""
    def read(places: Column, number: Column) -> Column:
        part = lambda rest, text: F.struct(rest.cast("bigint").alias("rest"), text.alias("text"))
        return F.aggregate(places, part(number, F.lit("")), lambda acc, a: part(
            (acc["rest"] - acc["rest"] % F.length(a)) / F.length(a),
            F.concat(acc["text"], F.substring(a, (acc["rest"] % F.length(a) + 1).cast("int"), F.lit(1)))), lambda acc: acc["text"])
    text = read(shape, n)
    body = F.substring(text, F.lit(1), F.length(text) - 1)
    card = F.concat(body, ((_check_digit(body) + F.substring(text, -1, 1).cast("int")) % 10).cast("string"))
    above = lambda j: (n - n % 254 ** j) / 254 ** j
    octets = F.concat_ws(".", *[(above(j).cast("bigint") % 254 + 1).cast("string") for j in range(4)])
    ip = F.concat(octets, read(F.slice(shape, F.lit(2), F.size(shape) - 1), above(4)))
    return F.when(kind == "ip", ip).when(kind == "card", card).otherwise(text)


def rendered(kind: Column, mention: Column, replacement: Column, wide: Column | None = None) -> Column:
    """The surrogate in the format of a mention; ``wide`` characters that the mention has no place for go to its end (mail: its head)."""
    wide = F.lit(0) if wide is None else wide
    found = F.regexp_replace(replacement, r"[^\p{L}\p{N}]", "")
    fitting = F.length(found) - wide
    core = F.when(kind == "email", F.substring(found, wide + 1, fitting)).otherwise(F.substring(found, F.lit(1), fitting))
    over = F.when(kind == "email", F.substring(found, F.lit(1), wide)).otherwise(F.substring(found, fitting + 1, wide))
    over = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(over)).otherwise(over)
    letters = F.length(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    ahead = letters - F.length(core)  # a country code that the canonical form lacks

    def placed(i: Column) -> Column:
        c = F.substring(mention, i, F.lit(1))
        rank = F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), r"[^\p{L}\p{N}]", "")) - ahead
        s = F.substring(core, rank, F.lit(1))
        return F.when(~c.rlike(r"[\p{L}\p{N}]") | (rank <= 0), c).when((c == F.upper(c)) & (c != F.lower(c)), F.upper(s)).otherwise(s)

    spelled = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), placed), "")
    spelled = F.when(wide == 0, spelled).when(kind == "email", F.concat(over, spelled)).otherwise(F.concat(spelled, over))
    return F.when(kind == "ip", replacement).when(kind == "given", F.initcap(replacement)).when(kind == "secret", replacement).otherwise(spelled)


def assign(entities: DataFrame, key: str, attempts: int | None = None) -> DataFrame:
    """(kind, canonical, surrogate, wide) with distinct surrogates, none of which is an entity itself.

    ``attempts`` allows for draws only and makes it an error when they do not suffice.
    """
    spark = entities.sparkSession
    made = surrogate(key, F.col("kind"), F.col("canonical"), F.col("attempt"))
    path = save(entities.select("kind", "canonical", F.lit(0).alias("attempt")).withColumn("surrogate", made), "surrogates")
    draws = ATTEMPTS if attempts is None else attempts
    for draw in range(1, draws + 1):
        now = load(spark, path)
        shared = now.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        others = now.join(shared.select("kind", "surrogate", F.col("canonical").alias("keeper")), ["kind", "surrogate"]).filter(
            "canonical <> keeper").select("kind", "canonical")
        real = now.select(F.col("kind"), F.col("canonical").alias("surrogate"))
        known = now.join(real, ["kind", "surrogate"]).filter("kind <> 'given'").select("kind", "canonical")
        again = saved(others.unionByName(known).distinct().withColumn("again", F.lit(1)), "collisions")
        if again.isEmpty():
            return now.select("kind", "canonical", "surrogate", F.lit(0).alias("wide"))
        if draw == draws and attempts is None:
            return _filled(now, again.select("kind", "canonical"), key)
        next_ = now.join(again, ["kind", "canonical"], "left").select(
            "kind", "canonical", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"),
            F.when(F.col("again").isNull(), F.col("surrogate")).alias("old"))
        old, path = path, save(next_.select("kind", "canonical", "attempt", F.coalesce("old", made).alias("surrogate")), "surrogates")
        remove(spark, old)
    raise ValueError(f"surrogates still collide after {attempts} draws")


def _filled(now: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """``assign`` without draws for ``left``: in keyed order they get the free surrogates of their shape, and longer ones where these run out.

    Among as many surrogates as there are entities to serve and taken ones of their length, enough are free. So no more are listed.
    """
    kind, shape = F.col("kind"), F.col("shape")
    # All addresses count as of one length, as theirs varies within the shape.
    length = lambda text: F.when(kind == "ip", F.lit(0)).otherwise(F.length(text)).alias("length")
    done = now.join(left, ["kind", "canonical"], "left_anti").select("kind", "canonical", "surrogate", F.lit(0).alias("wide"))
    taken = done.select("kind", "surrogate").unionByName(now.select("kind", F.col("canonical").alias("surrogate"))).distinct()
    wide = 0
    while not left.isEmpty():
        shaped = saved(left.withColumn("shape", _shape(kind, F.col("canonical"), wide)).withColumn(
            "order", F.sha2(F.concat_ws("|", F.lit(key), kind, F.col("canonical")), 256)), "shaped")
        held = taken.groupBy("kind", length(F.col("surrogate"))).agg(F.count(F.lit(1)).alias("held"))
        classes = shaped.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "length", F.when(kind == "ip", F.lit(0)).otherwise(F.size("shape"))).join(held, ["kind", "length"], "left")
        sized = classes.withColumn("listed", F.least(_space(kind, shape), F.col("n") + F.coalesce("held", F.lit(0))))
        chunks = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("listed") - 1) / CHUNK)))).repartition("kind", "shape", "chunk")
        numbers = chunks.select("kind", "shape", F.explode(F.sequence(
            F.col("chunk") * CHUNK, F.least(F.col("listed"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("n"))
        free = saved(numbers.withColumn("surrogate", _nth(kind, shape, F.col("n"))).join(taken, ["kind", "surrogate"], "left_anti"), "free")
        ranked = exact_rank(shaped, ["kind", "shape"], ["order", "canonical"])
        got = saved(ranked.join(exact_rank(free, ["kind", "shape"], ["n"]), ["kind", "shape", "rank"]).select(
            "kind", "canonical", "surrogate", F.lit(wide).alias("wide")), "filled")
        done = done.unionByName(got)
        taken = taken.unionByName(got.select("kind", "surrogate"))
        left = saved(left.join(got, ["kind", "canonical"], "left_anti"), "unfilled")
        wide += 1
    return done


def pseudonymise(docs: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, ``text`` with surrogates, ``entities`` (number of mentions)."""
    tagged = docs.select(*[F.col(k).alias(f"kept_{k}") for k in keep], "text", mentions(F.col("text")).alias("mentions"))
    lists = saved(tagged.filter(F.size("mentions") > 0).select("mentions").distinct(), "mentions")
    single = lists.select(F.explode("mentions").alias("mention")).distinct()
    typed = saved(single.withColumn("kind", kind_of(F.col("mention"))).withColumn("canonical", canonical(F.col("kind"), F.col("mention"))), "typed")
    assigned = assign(typed.select("kind", "canonical").distinct(), key)
    spelled = saved(typed.join(assigned, ["kind", "canonical"]).select(
        "mention", rendered(F.col("kind"), F.col("mention"), F.col("surrogate"), F.col("wide")).alias("spelled")), "spelled")
    placed = lists.select("mentions", F.posexplode("mentions").alias("place", "mention")).join(spelled, "mention")
    mapped = saved(placed.groupBy("mentions").agg(F.array_sort(F.collect_list(F.struct("place", "spelled"))).alias("pairs")).select(
        "mentions", F.transform("pairs", lambda p: p["spelled"]).alias("spelled")), "mapped")
    hit = tagged.filter(F.size("mentions") > 0).join(mapped, "mentions")
    # What stands between mentions, then each mention's surrogate.
    woven = F.array_join(F.zip_with(between(F.col("text")), F.col("spelled"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    names = [F.col(f"kept_{k}").alias(k) for k in keep]
    clean = tagged.filter(F.size("mentions") == 0).select(*names, "text", F.lit(0).alias("entities"))
    return hit.select(*names, woven.alias("text"), F.size("mentions").alias("entities")).unionByName(clean)
