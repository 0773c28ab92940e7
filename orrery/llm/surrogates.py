"""PII: surrogate generation. DataFrame functions only.

Entities (mail, IPv4 and IPv6 addresses, card and social-security numbers, IBANs, phone numbers, secrets, personal names) are found by one
pattern. Names are words in capitals after a title, a common given name or words that introduce a name, or before words or an address that follow one.
All mentions of an entity share a canonical form, and the surrogate is a keyed hash of that form alone: mentions stay coreferent over all documents, whatever their
format. The form of a number is its digits, that of a phone number the national ones without a trunk zero (the country code stays), that of an address its lower case. Names are
taken word by word, so "Anna Berg", "Mrs Berg" and "Dr Berg" keep one surname.

Surrogates keep the type and format: digits for digits with separators and country code in place, the Luhn check and an IBAN's check digits where they held, hexadecimal for
hexadecimal, and for names the title, the number of words, the script, the gender of a common given name (exchanged among those of its gender by a keyed ring) and of a Russian surname.

Distinctness is checked over the table of distinct entities, on what is written in the end: a surrogate that two entities would share, or that is itself an
entity of the corpus, is drawn again with the next attempt until none is left. Redrawn names get longer, and numbers too after ``GROW`` redraws in vain, so a
crowded format doesn't end the assignment (only IPv4 addresses can't grow: their format has room for some 10^9). Texts without entities pass through unshuffled; of the others one row
per distinct text is resolved, so copies cost nothing more.

Defined cases: null texts stay null, empty ones empty; ids play no part, so null and repeated doc_ids are kept; an empty
table gives an empty result; all columns of the input are carried, ``text`` is replaced and ``n_entities`` added (or replaced).
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spill

KEY = "orrery-demonstration-key"
#: So many redraws in vain, and numbers get a digit more.
GROW = 16
#: Titles, and given names by script and gender.
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа", "Г-жа", "κα")
TITLES_M = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Г-н", "κ")
TITLES_N = ("Dr", "Prof")
GIVEN = {
    ("latin", "f"): ("Anna", "Maria", "Sophie", "Laura", "Julia", "Clara", "Elena", "Emma", "Alice", "Carmen", "Camille", "Ingrid"),
    ("latin", "m"): ("John", "Peter", "Thomas", "Lukas", "Pablo", "Pierre", "Michael", "James", "Carlos", "Hans", "Louis", "David"),
    ("cyrillic", "f"): ("Анна", "Мария", "Ольга", "Елена", "Ирина", "Наталья"),
    ("cyrillic", "m"): ("Иван", "Сергей", "Алексей", "Дмитрий", "Павел", "Андрей"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Σοφία", "Άννα"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Γιάννης", "Κώστας"),
}
SYLLABLES = {
    "latin": ("ba", "de", "ko", "li", "mar", "no", "per", "sa", "ten", "vo", "ral", "fin", "gor", "hu", "jen", "wil"),
    "cyrillic": ("ба", "де", "ко", "ли", "мар", "но", "пе", "са", "тен", "во", "рал", "фи", "гор", "ху", "зе", "ви"),
    "greek": ("βα", "δε", "κο", "λι", "μαρ", "νο", "περ", "σα", "τεν", "βο", "ραλ", "φι", "γορ", "χυ", "ζε", "θι"),
}
#: Words before a name of any length, words before a name of two or more (one may begin a sentence or a thing's name), and words after a name.
NAMED = ("name is", "Name is", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "nombre es", "меня зовут", "Меня зовут", "με λένε", "Με λένε")
GREETED = ("named", "Name", "Dear", "Hello", "Hi", "signed by", "Signed by", "Liebe", "Lieber", "Cher", "Chère", "Querido", "Querida", "Дорогой", "Дорогая")
AFTER = ("wrote", "schrieb", "a écrit", "escribió", "написал", "написала", "έγραψε")
_T = "|".join([*TITLES_F, *TITLES_M, *TITLES_N])
_G = "|".join(n for names in GIVEN.values() for n in names)
_W = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}))+"
_B = r"(?<![\p{L}\p{N}])"
_NAME = (  # a word that introduces a name ends right before the space: that is looked at first
    rf"{_B}(?:(?:{_T})\.? (?:(?:{_G}) )?{_W}|(?:{_G}) {_W}|(?<=[\p{{L}}:,] )(?:(?<={_B}(?:{'|'.join(NAMED)})[:,]? ){_W}(?: {_W}){{0,2}}|(?<={_B}(?:{'|'.join(GREETED)})[:,]? ){_W}(?: {_W}){{1,2}})"
    rf"|{_W} {_W}(?= (?:{'|'.join(AFTER)})(?!\p{{L}})| <[^ <>]{{1,64}}@))"
)
MAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
IP6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
SECRET = r"(?<![A-Za-z0-9])(?:(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}|(?:sk|ghp|AKIA|xox[bp])[-_]?[A-Za-z0-9]{16,})(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"
#: Secrets, IBANs and names begin where no letter or digit stands before; numbers may be glued to a word, and mail addresses begin anywhere. What
#: an alternative can begin with is looked at first: only capitals (and titles in small letters) can begin a name.
IP6_ALONE = rf"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f:])(?:{IP6})(?![A-Za-z0-9:])"
OTHERS = "|".join([rf"(?<![A-Za-z0-9])(?:{SECRET}|{IBAN})", rf"(?=[\d+(])(?:{IP}|{SSN}|{PHONE}|{CARD})", r"(?=[\p{Lu}гκ])" + _NAME])
PATTERN = "|".join([MAIL, IP6_ALONE, OTHERS])

#: Country code of a canonical phone number, by the E.164 zones; the same with and without separators behind it.
CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def kind_of(entity: Column) -> Column:
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (
        F.when(entity.contains("@"), "mail").when(entity.contains(":"), "ip6").when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "ip").when(whole(SSN), "ssn").when(whole(r"\d(?:[ -]?\d){12,18}"), "card")
        .when(entity.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone").when(whole(IBAN), "iban").when(whole(SECRET), "secret").otherwise("name")
    )


def _only_digits(entity: Column) -> Column:
    return F.regexp_replace(entity, F.lit(r"\D"), F.lit(""))


def phone_head(entity: Column) -> Column:
    """The digits of a phone number that stay: the country code, and a trunk zero before at least seven more."""
    digits = _only_digits(entity)
    code = F.when(entity.startswith("+"), F.substr(F.regexp_extract(F.concat(F.lit("+"), digits), CODE, 0), F.lit(2))).otherwise("")
    return F.concat(code, F.regexp_extract(F.substr(digits, F.length(code) + 1), r"^0(?=\d{7})", 0))


def canonical(entity: Column, kind: Column) -> Column:
    digits = _only_digits(entity)
    phone = F.substr(digits, F.length(phone_head(entity)) + 1)
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(entity, F.lit(" "), F.lit(""))).when(kind.isin("mail", "ip6", "given", "family"), F.lower(entity)).otherwise(entity)


def parts_of(entity: Column, kind: Column) -> Column:
    """A mention as (kind, text, lead): a name by its words, the last of which is the surname unless it stands alone without a title; others whole."""
    title = F.regexp_extract(entity, rf"^(?:{_T})\.? (?=.)", 0)
    words = F.split(F.substr(entity, F.length(title) + 1), " ")
    given = lambda i: (i < F.size(words) - 1) | (F.size(words) == 1) & (title == "")
    names = F.transform(words, lambda w, i: F.struct(F.when(given(i), "given").otherwise("family").alias("kind"), w.alias("text"), F.when(i == 0, title).otherwise(" ").alias("lead")))
    return F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("text"), F.lit("").alias("lead"))))


def ring(key: str) -> dict[str, str]:
    """The common given names, each with the next one of its script and gender in an order that the key makes."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x00{n}".encode()).digest())
        out |= {a.lower(): b for a, b in zip(order, order[1:] + order[:1])}
    return out


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _keyed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *parts), 512)


def _nibbles(h: Column, i: Column, n: int) -> Column:
    """A number from the hash for place i: two hexadecimal digits, modulo n."""
    return F.pmod(F.conv(F.substr(h, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int") + i, F.lit(n))


def _letters(h: Column, start: int, n: int) -> Column:
    return F.translate(F.substring(h, start, n), "0123456789abcdef", "bcdfghjklmnprstv")


def _digits(canon: Column, h: Column) -> Column:
    """As many keyed digits; the first stays that isn't zero's kind, so that a number keeps its leading digit's kind."""
    return F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9]"), _nibbles(h, i, 10).cast("string")).otherwise(c)), "")


def _luhn_sum(digits: Column) -> Column:
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    back = F.reverse(F.split(digits, ""))
    return F.aggregate(F.transform(back, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A is 10) make, modulo 97."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _charwise(text: Column, h: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        letter = lambda a: F.substr(F.lit(a), _nibbles(h, i, 26) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), _nibbles(h, i, 10).cast("string")).when(c.rlike("[a-z]"), letter("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _more_syllables(syllables: tuple[str, ...]) -> Column:
    places = F.slice(F.array(*[F.lit(i) for i in range(12, 60)]), 1, F.floor(F.col("attempt") / 2).cast("int"))
    return F.array_join(F.transform(places, lambda i: F.get(F.array(*[F.lit(v) for v in syllables]), _nibbles(F.col("h"), i, len(syllables)))), "")


def draw(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) -> surrogate, the canonical form of what replaces the entity."""
    h = _keyed(F.lit(key), F.col("kind"), F.col("canon"), F.col("attempt").cast("string"))
    domain = F.substring_index("canon", "@", -1)
    hd = _keyed(F.lit(key), F.lit("domain"), domain)
    tld = F.substring_index("canon", ".", -1)
    mail = F.concat(_letters(h, 1, 10), F.lit("@"), _letters(hd, 1, 8), F.when(tld.isin("com", "net", "org"), F.concat(F.lit(".example."), tld)).otherwise(F.lit(".example")))
    ip = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.conv(F.substr("h", i * 2 + 1, F.lit(2)), 16, 10)), ".")
    # Room grows with the attempts: a digit more for each GROW of a number, a syllable more for every second of a name.
    more = F.repeat(F.lit("0"), F.floor(F.col("attempt") / GROW).cast("int"))
    plain = _digits(F.concat("canon", more), F.col("h"))
    zero = F.concat(F.expr("substring(plain, 1, length(plain) - 1)"), F.lit("0"))
    luhn = F.concat(F.expr("substring(plain, 1, length(plain) - 1)"), F.pmod(10 - _luhn_sum(zero) % 10, F.lit(10)).cast("string"))
    card = F.when(_luhn_sum(F.col("canon")) % 10 == 0, luhn).otherwise(F.col("plain"))
    hexed = F.expr("substring(repeat(h, cast(ceil(length(canon) / 128) as int)), 1, length(canon))")
    secret = F.when(F.col("canon").rlike("^[0-9a-f]+$"), hexed).when(F.col("canon").rlike("^[0-9A-F]+$"), F.upper(hexed)).when(F.col("canon").rlike("^[0-9a-fA-F]+$"), hexed).otherwise(
        F.concat(F.regexp_extract("canon", r"^(sk|ghp|AKIA|xox[bp])[-_]?", 0), _charwise(F.regexp_replace("canon", F.lit(r"^(sk|ghp|AKIA|xox[bp])[-_]?"), F.lit("")), F.col("h")))
    )
    country, account = F.substring("canon", 1, 2), _charwise(F.expr("substring(canon, 5)"), F.col("h"))
    fits = _mod97(F.concat(F.expr("substring(canon, 5)"), F.substring("canon", 1, 4))) == 1
    check = F.when(fits, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(_charwise(F.substring("canon", 3, 2), F.reverse("h")))
    iban = F.concat(country, check, account)
    ip6 = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring("h", 4 * i + 1, 4)) for i in range(6)])
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), _nibbles(F.col("h"), F.lit(i), len(values)))
    script, word = script_of(F.col("canon")), F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        word = F.when(script == s, F.concat(*[pick(syllables, i) for i in range(4, 8)], _more_syllables(syllables))).otherwise(word)
    ending = F.when(F.col("canon").rlike("(?:[оеи]в|[иы]н)а$"), "ова").when(F.col("canon").rlike("(?:[оеи]в|[иы]н)$"), "ов").otherwise("")
    a = entities.withColumn("h", h).withColumn("plain", plain)
    by = {"mail": mail, "ip": ip, "ip6": ip6, "card": card, "ssn": F.col("plain"), "phone": F.col("plain"), "iban": iban, "secret": secret, "given": word, "family": F.concat(word, ending)}
    out = reduce(lambda acc, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(acc), by.items(), F.lit(None).cast("string"))
    return a.withColumn("surrogate", out).drop("h", "plain")


def assign(entities: DataFrame, key: str = KEY, attempts: int = 64) -> DataFrame:
    """Distinct (kind, canon) with a surrogate each: no two alike, none an entity of the corpus."""
    names = spill(entities.select("kind", "canon").distinct(), "pii-entities")
    drawn = spill(draw(names.withColumn("attempt", F.lit(0)), key), "pii-drawn")
    for _ in range(attempts):
        # Of those that share a surrogate the first canonical form keeps it; surrogates that are entities go in any case.
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("keeper"))
        real = names.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        checked = drawn.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        bad = F.col("real").isNotNull() | (F.col("keeper") != F.col("canon"))
        checked = checked.select("kind", "canon", (F.col("attempt") + bad.cast("int")).alias("attempt"), "surrogate", bad.alias("bad"))
        if not checked.where("bad").limit(1).count():
            return drawn.select("kind", "canon", "surrogate")
        good = checked.where("not bad").select("kind", "canon", "attempt", "surrogate")
        drawn = spill(good.unionByName(draw(checked.where("bad").select("kind", "canon", "attempt"), key)), "pii-drawn")
    # Only a corpus that holds a good part of all IPv4 addresses comes here.
    raise ValueError(f"no distinct surrogates after {attempts} attempts")


def render(entity: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this mention."""
    signs = F.when(kind == "phone", F.concat(phone_head(entity), surrogate)).otherwise(surrogate)

    def put(acc: Column, c: Column) -> Column:
        digit = c.rlike("[A-Z0-9]")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substr(acc["signs"], acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"), acc["signs"].alias("signs"))

    spaced = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k"), signs.alias("signs")), put, lambda acc: F.concat(acc["out"], F.substr(acc["signs"], acc["k"] + 1)))
    upper = (F.length(entity) > 1) & (entity == F.upper(entity))
    cased = F.when(upper, F.upper(surrogate)).otherwise(F.when(kind == "ip6", surrogate).otherwise(F.initcap(surrogate)))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), spaced).when(kind.isin("given", "family", "ip6"), cased).otherwise(surrogate)


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_entities`` added."""
    docs = docs.drop("n_entities")
    text = F.col("text")
    # Few texts hold the marks without which some alternatives can't match: the others needn't be tried for these.
    has = F.coalesce(text.rlike(OTHERS) | text.contains("@") & text.rlike(MAIL) | text.contains(":") & text.rlike(IP6_ALONE), F.lit(False))
    touched = docs.where(has).withColumn("__digest", F.sha2("text", 256))
    one = touched.select("__digest", "text").dropDuplicates(["__digest"]).select("__digest", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "entity"))
    words = one.select("__digest", "pos", F.posexplode(parts_of(F.col("entity"), kind_of(F.col("entity")))).alias("part", "p")).select("__digest", "pos", "part", "p.*")
    mentions = spill(words.withColumn("canon", canonical(F.col("text"), F.col("kind"))), "pii-mentions")
    known = ring(key)
    common = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("canon")]
    drawn = assign(mentions.where(~((F.col("kind") == "given") & F.col("canon").isin(*known))), key)
    surrogate = F.when((F.col("kind") == "given") & common.isNotNull(), common).otherwise(F.col("surrogate"))
    put = mentions.join(drawn, ["kind", "canon"], "left").select("__digest", "pos", "part", F.concat("lead", render(F.col("text"), F.col("kind"), surrogate)).alias("to"))
    lists = put.groupBy("__digest").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "to"))).alias("puts"))
    joined = touched.join(lists, "__digest").withColumn("__pieces", F.split("text", PATTERN, -1))
    # Each mention comes after its piece of the text; a name's later words come right after its first.
    text = F.concat(F.array_join(F.transform("puts", lambda p: F.concat(F.when(p["part"] == 0, F.get("__pieces", p["pos"])).otherwise(""), p["to"])), ""), F.element_at("__pieces", -1))
    changed = joined.withColumn("text", text).withColumn("n_entities", F.size(F.filter("puts", lambda p: p["part"] == 0)))
    plain = docs.where(~has).withColumn("n_entities", F.lit(0))
    return plain.select(*docs.columns, "n_entities").unionByName(changed.select(*docs.columns, "n_entities"))
