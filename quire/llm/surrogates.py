"""Surrogates for personal data: every detected entity gives way to a keyed one of the same type, format, script and gender.

Numbers go through a keyed permutation of all numbers of their length (a balanced Feistel network), so distinct ones stay
distinct; addresses, tokens and names take keyed hashes. A name is its title, which stays, and a given name and surname
that have surrogates of their own: a person is the same with and without the given name. A mail address has one for the
mailbox and one for the domain. A phone number has one whatever its grouping. No two entities of the table share a surrogate and no surrogate
is itself an entity: `exceptions` finds the entities for which the first key does not give that and takes the next keys
for them alone. One entity has one surrogate wherever it stands. Only DataFrame functions are used.

Null texts stay null and have no entities. Repeated rows get equal texts. All columns pass through; n_chars, where
present, follows the new text. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Titles by gender, and syllables of names.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Señora|Госпожа"
OTHER_TITLES = "Dr|Prof"
TITLES = f"{FEMALE_TITLES}|{MALE_TITLES}|{OTHER_TITLES}"
# How given names end, by gender and script; with a title of neither gender the name's own end tells.
MALE_END, FEMALE_END, MALE_END_CYRILLIC, FEMALE_END_CYRILLIC = "n", "na", "н", "на"
SYLLABLES = ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"]
SYLLABLES_CYRILLIC = ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Types and their patterns, the earlier first where two match at one place.
TYPES = {
    "email": r"[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "token": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\p{L}\d])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d(.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\d.-])",
    "card": r"(?<![\p{L}\d])\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: A text without any of these has no entity; it spares such texts the whole pattern.
HINT = rf"@|\d{{4}}|\+\d|\d(?:[ -]?\d){{12}}|[A-Z]{{2}}\d{{2}}|[0-9a-fA-F]{{32}}|\d\.\d|(?:{TITLES})\.? \p{{Lu}}"


#: What marks the parts of a name: a given name with its gender, and a surname.
GIVEN, SURNAME = "\x01g:", "\x01s:"


def type_of(e: Column) -> Column:
    kind = F.when(e.startswith(GIVEN), "given").when(e.startswith(SURNAME), "surname").when(e.contains("@"), "email").when(e.startswith("+") | e.rlike(r"^(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}$"), "phone").when(e.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
    return kind.when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(e.rlike(r"^[0-9a-fA-F]{32,}$"), "token").when(e.rlike(r"^\d[\d -]*$"), "card").when(e.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]*$"), "iban").otherwise("name")


def title_of(e: Column) -> Column:
    """The title before a name with its blank; empty for other entities."""
    return F.regexp_extract(e, rf"^(?:{TITLES})\.? (?=\p{{Lu}})", 0)


def parts(e: Column) -> Column:
    """What of an entity has a surrogate of its own: the given name and surname of a name, else the entity."""
    title = title_of(e)
    words = F.split(F.substring(e, F.length(title) + 1, F.length(e)), " ")
    own_end = F.when(F.get(words, 0).rlike("[aаяAАЯ]$"), "f").otherwise("m")
    gender = F.when(title.rlike(rf"^(?:{FEMALE_TITLES})\b"), "f").when(title.rlike(rf"^(?:{MALE_TITLES})\b"), "m").otherwise(own_end)
    name = F.when(F.size(words) > 1, F.array(F.concat(F.lit(GIVEN), gender, F.lit(":"), F.get(words, 0)), F.concat(F.lit(SURNAME), F.get(words, 1)))).otherwise(F.array(F.concat(F.lit(SURNAME), F.get(words, 0))))
    return F.when(title != "", name).otherwise(F.array(e))


def identity(e: Column) -> Column:
    """What all spellings of one part share: case of an address and grouping of a number do not tell entities apart."""
    kind = type_of(e)
    plain = F.when(kind == "email", F.lower(e)).when(kind.isin("card", "phone", "iban"), F.regexp_replace(e, r"[^+A-Z\d]", "")).otherwise(e)
    return F.concat_ws(":", kind, plain)


def _form(e: Column, new: Column) -> Column:
    """The identity that the surrogate of a part has: that of a name of the same kind, or that of itself."""
    return identity(F.concat(F.regexp_extract(e, rf"^(?:{GIVEN}[fm]:|{SURNAME})", 0), new))


def _number(key: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of one length, up to 36 digits."""
    n = F.length(digits)
    size = F.floor(n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), size), F.substring(digits, size + 1, n)

    def moved(part: Column, by: Column, i: int) -> Column:
        modulus = F.pow(F.lit(10.0), F.length(part)).cast("long")
        return F.lpad(F.pmod(part.cast("long") + F.pmod(F.xxhash64(F.lit(f"{key}/{i}"), n, by), modulus), modulus).cast("string"), F.length(part), F.lit("0"))

    def rounds(pair: Column, i: int) -> Column:
        a, b = pair.getField("a"), pair.getField("b")
        return F.struct(moved(a, b, i).alias("a"), b.alias("b")) if i % 2 == 0 else F.struct(a.alias("a"), moved(b, a, i).alias("b"))

    start = F.array(F.struct(left.alias("a"), right.alias("b")))
    done = reduce(lambda acc, i: F.transform(acc, lambda p: rounds(p, i)), range(4), start)
    out = F.get(done, 0)
    # One digit alone has an empty left half and moves by a key.
    return F.when(n < 2, F.pmod(digits.cast("long") + F.pmod(F.xxhash64(F.lit(key)), F.lit(10)), F.lit(10)).cast("string")).otherwise(F.concat(out.getField("a"), out.getField("b")))


def _placed(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by digits, in order."""
    def char(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        seen = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), r"\D", ""))
        return F.when(c.rlike(r"\d"), F.substring(digits, seen, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), char), "")


def _letters(source: Column, alphabet: list[str], count: int) -> Column:
    return F.concat(*(F.get(F.array(*map(F.lit, alphabet)), F.conv(F.substring(source, k, 1), 16, 10).cast("int")) for k in range(1, count + 1)))


def surrogate(e: Column, key: str, longer: int = 0) -> Column:
    """The surrogate of a part under key; numbers but addresses get so many more digits at their end, and names more syllables."""
    kind, digits = type_of(e), F.regexp_replace(e, r"\D", "")
    letters = lambda hashed: F.translate(F.substring(hashed, 1, 16), "0123456789abcdef", "abcdefghijklmnop")
    hashed = F.sha2(F.concat(F.lit(key), F.when(kind == "email", F.lower(e)).otherwise(e)).cast("binary"), 256)
    domain = F.sha2(F.concat(F.lit(key), F.lit("@"), F.lower(F.regexp_extract(e, "@(.*)$", 1))).cast("binary"), 256)
    box = F.when(e.rlike(r"\..*@"), F.concat(F.substring(letters(hashed), 1, 6), F.lit("."), F.substring(letters(hashed), 7, 10))).otherwise(letters(hashed))
    email = F.concat(box, F.lit("@"), F.substring(letters(domain), 1, 10), F.lit(".example"))
    octets = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
    high, low = F.get(octets, 0) * 256 + F.get(octets, 1), F.get(octets, 2) * 256 + F.get(octets, 3)
    new_low = F.pmod(low + F.pmod(F.xxhash64(F.lit(key), high), F.lit(65536)), F.lit(65536))
    new_high = F.pmod(high + F.pmod(F.xxhash64(F.lit(key), new_low), F.lit(65536)), F.lit(65536))
    whole = lambda x: F.floor(x).cast("string")
    ip = F.concat_ws(".", whole(new_high / 256), F.pmod(new_high, F.lit(256)).cast("string"), whole(new_low / 256), F.pmod(new_low, F.lit(256)).cast("string"))
    long_hash = F.concat(hashed, F.sha2(hashed.cast("binary"), 256))
    token = F.substring(F.repeat(long_hash, F.ceil(F.length(e) / 128).cast("int")), F.lit(1), F.length(e))
    token = F.when(e.rlike("[A-F]"), F.upper(token)).otherwise(token)
    cyrillic, female = e.rlike(r"\p{IsCyrillic}"), e.startswith(f"{GIVEN}f")
    end = F.when(cyrillic, F.when(female, FEMALE_END_CYRILLIC).otherwise(MALE_END_CYRILLIC)).otherwise(F.when(female, FEMALE_END).otherwise(MALE_END))
    first = F.initcap(F.concat(F.when(cyrillic, _letters(hashed, SYLLABLES_CYRILLIC, 4)).otherwise(_letters(hashed, SYLLABLES, 4)), end))
    last = F.initcap(F.when(cyrillic, _letters(hashed, SYLLABLES_CYRILLIC, 6)).otherwise(_letters(hashed, SYLLABLES, 6)))
    if longer:
        first, last = F.concat(F.initcap(F.lower(last)), F.lower(first)), F.concat(last, F.lower(first))
    # The first digit after a plus stays: it tells the part of the world.
    country = F.regexp_extract(e, r"^\+\d", 0)
    rest = F.substring(e, F.length(country) + 1, F.length(e))
    iban = F.concat(F.substring(e, 1, 2), _placed(F.substring(e, F.lit(3), F.length(e)), _number(key, digits)))
    by_type = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "token", token).when(kind == "given", first).when(kind == "surname", last)
    number = F.when(kind == "phone", F.concat(country, _placed(rest, _number(key, F.regexp_replace(rest, r"\D", ""))))).when(kind == "iban", iban).otherwise(_placed(e, _number(key, digits)))
    if longer:
        number = F.concat(number, F.lpad(F.pmod(F.xxhash64(F.lit(key), e), F.lit(10**longer)).cast("string"), longer, "0"))
    return by_type.otherwise(number)


def entities(text: Column) -> Column:
    """All entities of a text in order; an empty array where there are none."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))


def _plain(e: Column) -> Column:
    return F.when(e.contains("@"), F.lower(e)).otherwise(e)


def exceptions(docs: DataFrame, key: str, same_length: int = 16) -> DataFrame | None:
    """entity, surrogate of the entities of docs that key/0 gives another's surrogate or an entity; None where there are none.

    They take key/1, those that still collide key/2, and so on until none is left; all spellings of an entity go together.
    Of the entities that share a surrogate one keeps it. Where numbers of a length are nearly all entities, same_length
    keys are not enough: each later key makes the rest one digit longer, so that the rounds end.
    """
    found = docs.select(F.explode(entities(F.col("text"))).alias("entity")).distinct().select(F.explode(parts(F.col("entity"))).alias("entity"))
    known = written(found.select(_plain(F.col("entity")).alias("entity")).distinct().select("entity", identity(F.col("entity")).alias("who")), "entities")
    left, kept, i = known, [], 0
    while True:
        new = surrogate(F.col("entity"), f"{key}/{i}", max(0, i - same_length))
        given = written(left.select("entity", "who", new.alias("surrogate")).withColumn("form", _form(F.col("entity"), F.col("surrogate"))), "surrogates")
        first = given.groupBy("form").agg(F.min("who").alias("first"), F.max("who").alias("last")).where("first <> last")
        clash = given.join(first, "form").where("who <> first").select("who")
        for other in (known.select(F.col("who").alias("form")), *(k.select("form") for k in kept)):
            clash = clash.union(given.join(other, "form", "left_semi").select("who"))
        clash = written(clash.distinct(), "colliding")
        done = clash.limit(1).count() == 0
        if done and not kept:
            return None
        kept.append(given if done else written(given.join(clash, "who", "left_anti"), "kept-surrogates"))
        if done:
            return reduce(DataFrame.union, kept[1:]).select("entity", "surrogate")
        left, i = written(left.join(clash, "who", "left_semi").select("entity", "who"), "colliding-entities"), i + 1


def _fresh(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def _with_exceptions(docs: DataFrame, special: DataFrame, name: str) -> DataFrame:
    """docs with a map from entity to surrogate in the column name: the exceptions in the text, null where there are none.

    Rows meet their exceptions by the list of their entities; rows without entities are spread by their text.
    """
    found, spread = _fresh("found", docs.columns), _fresh("spread", docs.columns)
    listed = docs.select(entities(F.col("text")).alias(found)).where(F.size(found) > 0).distinct()
    each = listed.select(found, F.explode(F.array_distinct(F.transform(F.flatten(F.transform(found, parts)), _plain))).alias("entity")).join(special, "entity")
    of_list = each.groupBy(found).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(name)).withColumn(spread, F.lit(0).cast("long"))
    text = F.col("text")
    rows = docs.withColumn(found, entities(text)).withColumn(spread, F.when(F.size(found) > 0, F.lit(0).cast("long")).otherwise(F.xxhash64(text)))
    return rows.join(written(of_list, "exceptions-of-lists"), [found, spread], "left").select(*docs.columns, name)


def replaced(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """docs with surrogates in text, and entity_types (the types in order of their places) in a new column."""
    columns, special = docs.columns, exceptions(docs, key)
    name, own = _fresh("entity_types", columns), _fresh("exceptions", columns)
    if special is not None:
        docs = _with_exceptions(docs, special, own)
    text = F.col("text")

    def given(e: Column) -> Column:
        usual = surrogate(e, f"{key}/0")
        return usual if special is None else F.coalesce(F.col(own)[_plain(e)], usual)

    found = entities(text)
    between = F.split(text, PATTERN, -1)
    whole = lambda e: F.concat(title_of(e), F.array_join(F.transform(parts(e), given), " "))
    new = F.array_join(F.zip_with(between, F.transform(found, whole), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = docs.withColumn(name, F.transform(found, type_of)).withColumn("text", F.when(F.size(F.col(name)) > 0, new).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns, name)
