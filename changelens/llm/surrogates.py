"""Keyed surrogates for personal data.

Entities are found by one pattern, typed, normalised, and made distinct over
the corpus.  Each gets a surrogate from a keyed digest that keeps its type and
format: separators, letter case, digit groups, check digits, script, and the
gender of names.  Two entities never share a surrogate and no surrogate is
itself an entity of the corpus: those that clash draw again.  One entity has
one surrogate everywhere, whatever its spelling.

Given names and family names are entities of their own, so that "Mr John
Smith", "Dr John Smith" and "Mr Smith" stay the same person, and a name that a
text shows with a title is replaced where the same text has it without one.
The national part of a phone number is the entity, its country code is kept.
Names that a text never shows with a title, street addresses and dates of birth
aren't looked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.llm.base import Scratch

# Titles that tell a name's gender, and given names to draw from, by script.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Mister господин г-н"
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra Mlle госпожа г-жа"
NEUTRAL_TITLES = "Dr Prof Mx"
GIVEN = {
    "male_latin": "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Louis Martin Nico Oscar Paul",
    "female_latin": "Anna Bella Clara Diana Emma Flora Greta Hanna Irene Julia Karla Laura Maria Nora Olga Paula",
    "neutral_latin": "Alex Andrea Charlie Dominique Eden Frances Jamie Kim Lee Morgan Noa Quinn Robin Sam Sasha Toni",
    "male_cyrillic": "Адам Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан",
    "female_cyrillic": "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Роза",
    "neutral_cyrillic": "Саша Женя Валя Слава Шура Паша Миша Тоня Вася Юля Лёня Соня Рома Катя Лена Дима",
}
ONSETS = {"latin": "B D F G K L M N P R S T V W Z H", "cyrillic": "Б Д Ф Г К Л М Н П Р С Т В Ж З Х"}
VOWELS = {"latin": "a e i o", "cyrillic": "а е и о"}
TAILS = {"latin": "ner rin lan dov mer sen ton vik", "cyrillic": "нер рин лан дов мер сен тон вик"}

_titles = "|".join(f"{MALE_TITLES} {FEMALE_TITLES} {NEUTRAL_TITLES}".split())
_word = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?"
PATTERNS = {
    "secret": r"(?<![\p{L}\p{N}_])(?i:api[_ -]?key|secret|password|passwd|token)\s*[:=]\s*\"?(?=[A-Za-z0-9_.+/=~-]{8})[_-]*[A-Za-z0-9][A-Za-z0-9_-]*(?:[.+/=~]+[A-Za-z0-9_-]+)*=*",
    "email": r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{9,14}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_titles})\.? {_word}(?: {_word})?",
}
ANY = "|".join(PATTERNS.values())
#: A capitalised word, looked up among the names of its text.
BARE = r"(?<![\p{L}\p{N}])\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?(?![\p{L}\p{N}])"
#: What a text must hold for any pattern to match, cheaper to look for: a digit, an @, a title or a secret's keyword.
HINT = rf"[0-9@]|(?:{_titles})\.? \p{{Lu}}|(?i:key|secret|password|passwd|token)\s*[:=]"


def _fixed(options: str) -> Column:
    return F.array(*map(F.lit, options.split()))


def kind_of(value: Column) -> Column:
    """The type of a match: the first pattern that takes all of it."""
    return reduce(lambda rest, k: F.when(value.rlike(rf"^(?:{PATTERNS[k]})$"), k).otherwise(rest), reversed(list(PATTERNS)), F.lit("name"))


def parts_of(kind: Column, value: Column) -> Column:
    """The form by which spellings of one entity agree: addresses in small letters, numbers as digits, phones without country code."""
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.regexp_replace(_national(value), "[^0-9]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(value)
    )


#: What stands before the national part of a phone number: a country code, or a zero dialled at home.
PHONE_HEAD = r"^(?:\+[0-9]{1,3}[ .-]?(?=\()|\+[0-9]{1,3}[ .-]|\+1(?=[0-9]{10}$))?\(?0?"


def _national(value: Column) -> Column:
    return F.regexp_replace(value, PHONE_HEAD, "")


def _digest(secret: str, *parts: Column, blocks: Column | None = None) -> Column:
    """Hexadecimal digits from the key and `parts`, in as many blocks of 64 as are asked for."""
    text = F.concat_ws("\u0001", F.lit(secret), *parts)
    if blocks is None:
        return F.sha2(text, 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), blocks), lambda k: F.sha2(F.concat_ws("\u0001", text, k.cast("string")), 256)), "")


def _draw(digest: Column, at: Column | int, n: int) -> Column:
    """A number under `n` from four hexadecimal digits of a digest, `at` counted from 0 and around."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (F.conv(F.substr(digest, (at % (F.length(digest) - 4) + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _masked(value: Column, digest: Column, keep: Column) -> Column:
    """`value` with digits and letters drawn anew after its first `keep` characters, the rest as it is."""
    chars = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.struct(i.alias("i"), F.substr(value, i, F.lit(1)).alias("c")))

    def one(x):
        c, i = x["c"], x["i"]
        digit, letter = _draw(digest, i * 4, 10).cast("string"), F.char(_draw(digest, i * 4, 26) + 97)
        return F.when(i <= keep, c).when(c.rlike("[0-9]"), digit).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike("[a-z]"), letter).otherwise(c)

    return F.when(F.length(value) == 0, value).otherwise(F.array_join(F.transform(chars, one), ""))


def _luhn_sum(digits: Column) -> Column:
    """Sum of a number's digits with every second one, from the right, doubled."""
    place = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(F.substr(digits, i, F.lit(1)).cast("int").alias("d"), ((F.length(digits) - i) % 2).alias("odd")))
    value = lambda x: F.when(x["odd"] == 1, F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"])
    return F.aggregate(place, F.lit(0), lambda s, x: s + value(x))


def _card(norm: Column, digest: Column) -> Column:
    """Sixteen digits with the same first one; valid by Luhn's check if the original is."""
    drawn = _masked(norm, digest, F.lit(1))
    head = F.concat(F.substring(drawn, 1, 15), F.lit("0"))
    check = ((10 - _luhn_sum(head) % 10) % 10).cast("string")
    return F.when(_luhn_sum(norm) % 10 == 0, F.concat(F.substring(drawn, 1, 15), check)).otherwise(drawn)


def _iban(norm: Column, digest: Column) -> Column:
    """The same country and length; valid by its remainder by 97 if the original is."""
    drawn = _masked(norm, digest, F.lit(2))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)

    def remainder(text: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))
        return F.aggregate(chars, F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)

    moved = lambda text: F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
    check = F.lpad((98 - remainder(F.concat(F.substr(drawn, F.lit(5)), F.substring(norm, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    return F.when(remainder(moved(norm)) == 1, F.concat(F.substring(norm, 1, 2), check, F.substr(drawn, F.lit(5)))).otherwise(drawn)


def _ssn(digest: Column) -> Column:
    """Nine digits in the ranges that are given out: area 001 to 899 without 666, group and serial from 1."""
    number = lambda at, n: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % n + 1
    area = number(1, 898)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.concat(pad(F.when(area >= 666, area + 1).otherwise(area), 3), pad(number(9, 99), 2), pad(number(17, 9999), 4))


def _name(kind: Column, norm: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """A given name of the original's gender or a family name, of its script; more syllables the more attempts it takes."""

    def of(script: str) -> Column:
        pick = lambda options, at: F.element_at(options, _draw(digest, at, 1 << 16) % F.size(options) + 1)
        listed = F.when(gender == "male", pick(_fixed(GIVEN[f"male_{script}"]), 0)).when(gender == "female", pick(_fixed(GIVEN[f"female_{script}"]), 0)).otherwise(pick(_fixed(GIVEN[f"neutral_{script}"]), 0))
        low, vowels = F.transform(_fixed(ONSETS[script]), lambda x: F.lower(x)), _fixed(VOWELS[script])
        syllables = lambda n, at: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(pick(low, k * 8 + at), pick(vowels, k * 8 + at + 4))), "")
        family = F.concat(pick(_fixed(ONSETS[script]), 4), pick(vowels, 8), syllables((2 + F.floor(attempt / 4)).cast("int"), 12), pick(_fixed(TAILS[script]), 56))
        made = F.when(attempt < 2, listed).otherwise(F.concat(listed, syllables(F.floor(attempt / 2).cast("int"), 12)))
        return F.when(kind == "given", made).otherwise(family)

    return F.when(norm.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def surrogate(kind: Column, norm: Column, gender: Column, digest: Column, attempt: Column, secret: str) -> Column:
    """The normal form of a surrogate: of the same kind and length, drawn from the keyed digest.

    From the eighth attempt on it grows by a digit (a letter in addresses) every
    four, so that no number of entities uses a format up.
    """
    local, domain = F.split_part(norm, F.lit("@"), F.lit(1)), F.split_part(norm, F.lit("@"), F.lit(2))
    host = F.translate(F.substring(_digest(secret, F.lit("domain"), domain), 1, 12), "0123456789", "ghijklmnop")
    letters = F.translate(F.substring(digest, 40, 6), "0123456789", "ghijklmnop")
    email = F.concat(_masked(local, digest, F.lit(0)), F.when(attempt > 2, letters).otherwise(""), F.lit("@"), host, F.lit(".example"))
    ip = F.concat_ws(".", F.when(attempt < 2, F.lit("10")).otherwise((_draw(digest, 16, 223) + 1).cast("string")), *[_draw(digest, k, 256).cast("string") for k in (0, 4, 8)])
    more = F.when(attempt >= 8, F.translate(F.substr(digest, F.lit(20), (F.floor(attempt / 4) - 1).cast("int")), "abcdef", "012345")).otherwise("")
    drawn = (
        F.when(kind == "ipv4", F.concat(ip, F.when(attempt >= 8, F.concat(F.lit("."), more)).otherwise("")))
        .when(kind == "card", F.concat(_card(norm, digest), more))
        .when(kind == "iban", F.concat(_iban(norm, digest), more))
        .when(kind == "ssn", F.concat(_ssn(digest), more))
        .when(kind == "secret", F.concat(_masked(norm, digest, F.length(F.regexp_extract(norm, r'^[^:=]*[:=]\s*"?', 0))), more))
        .when(kind == "phone", F.concat(_masked(norm, digest, F.lit(0)), more))
        .otherwise(F.concat(_masked(norm, digest, F.lit(0)), more))
    )
    return F.when(kind == "email", email).when(kind.isin("given", "family"), _name(kind, norm, gender, digest, attempt)).otherwise(drawn)


def _in_form(value: Column, new: Column) -> Column:
    """The characters of `new` in place of the digits and capitals of `value`, what is left over at its end."""
    chars = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))
    blank = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        chars,
        blank,
        lambda acc, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(acc["out"], F.substr(new, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substr(new, acc["at"])),
    )


def _spelled(value: Column, kind: Column, new: Column) -> Column:
    """A surrogate in the spelling of one occurrence: its separators, its country code, its capitals."""
    loud = (value == F.upper(value)) & (F.length(value) > 1)
    head = F.regexp_extract(value, PHONE_HEAD, 0)
    return (
        F.when(kind.isin("email", "given", "family"), F.when(loud, F.upper(new)).otherwise(new))
        .when(kind.isin("ipv4", "secret"), new)
        .when(kind == "phone", F.concat(head, _in_form(_national(value), new)))
        .otherwise(_in_form(value, new))
    )


def matches(text: Column) -> Column:
    """What a text holds that any pattern takes, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def entities(found: DataFrame) -> DataFrame:
    """key, value (a match, or a word of a name), kind, norm, gender from `found`: key, value of each different match of a text."""
    typed = found.withColumn("kind", kind_of(F.col("value")))
    plain = typed.where("kind <> 'name'").select("key", "value", "kind", parts_of(F.col("kind"), F.col("value")).alias("norm"), F.lit("").alias("gender"))
    title = F.regexp_extract("value", rf"^({_titles})\.? ", 1)
    gender = F.when(title.isin(*MALE_TITLES.split()), "male").when(title.isin(*FEMALE_TITLES.split()), "female").otherwise("")
    words = F.split(F.regexp_replace("value", rf"^(?:{_titles})\.? ", ""), " ")
    named = typed.where("kind = 'name'").select("key", gender.alias("gender"), words.alias("words"))
    part = F.when((F.size("words") == 2) & (F.col("at") == 0), "given").otherwise("family")
    named = named.select("key", "gender", "words", F.posexplode("words").alias("at", "value"))
    return plain.unionByName(named.select("key", "value", part.alias("kind"), F.lower("value").alias("norm"), F.when(part == "given", F.col("gender")).otherwise("").alias("gender")))


def surrogate_table(found: DataFrame, secret: str, scratch: Scratch) -> DataFrame:
    """kind, norm, new: distinct surrogates for distinct entities; clashes draw again until none is left.

    Given and family names are distinct among each other too.  A given name
    has the gender of the titles it is seen with, none if they disagree.
    """
    sexes = F.array_except(F.collect_set("gender"), F.array(F.lit("")))
    known = found.groupBy("kind", "norm").agg(F.when(F.size(sexes) == 1, F.element_at(sexes, 1)).otherwise("").alias("gender"))
    pool = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    known = scratch.write(known.withColumn("pool", pool), "known")
    taken = known.select("pool", F.lower("norm").alias("low")).distinct()
    todo, done, attempt = known, None, 0
    blocks = F.least(F.lit(64), F.floor(F.length("norm") / 15)).cast("int")
    while True:
        drawn = todo.withColumn("digest", _digest(secret, F.col("kind"), F.col("norm"), F.lit(str(attempt)), blocks=blocks))
        drawn = drawn.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("digest"), F.lit(attempt), secret)).withColumn("low", F.lower("new"))
        free = drawn.join(taken, ["pool", "low"], "left_anti")  # no surrogate is an entity
        if done is not None:
            free = free.join(done.select("pool", "low"), ["pool", "low"], "left_anti")
        first = free.groupBy("pool", "low").agg(F.min(F.struct("norm", "kind", "new")).alias("x"))  # one of those that clash keeps it
        got = scratch.write(first.select("pool", "low", "x.norm", "x.kind", "x.new"), "drawn")
        done = got if done is None else scratch.write(done.unionByName(got), "done")
        todo = scratch.write(todo.join(got, ["kind", "norm"], "left_anti"), "todo")
        attempt += 1
        if not todo.limit(1).count():
            return done.select("kind", "norm", "new")


def replace_pii(docs: DataFrame, secret: str) -> DataFrame:
    """`docs` with each entity in `text` replaced, and n_entities (occurrences replaced) added.

    Documents without any entity aren't shuffled.

    Defined cases: null texts stay null with no entities; texts without any
    stay as they are; repeated rows are replaced alike; a column called
    n_entities is replaced and all others kept as they are; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    kept = [c for c in docs.columns if c.lower() != "n_entities"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("text").cast("string").alias("body"))
    holds = F.col("body").rlike(HINT) & F.col("body").rlike(ANY)
    some = scratch.write(rows.where(holds).withColumn("found", matches(F.col("body"))).withColumn("key", F.md5(F.col("body").cast("binary"))), "holding")
    found = scratch.write(entities(some.select("key", F.explode(F.array_distinct("found")).alias("value"))).distinct(), "entities")
    table = surrogate_table(found, secret, scratch)
    # a name is looked for in capitals too, and without
    forms = F.when(F.col("kind").isin("given", "family"), F.array_distinct(F.array("value", F.upper("value"), F.initcap("value")))).otherwise(F.array("value"))
    pairs = found.join(table, ["kind", "norm"]).withColumn("value", F.explode(forms)).withColumn("new", _spelled(F.col("value"), F.col("kind"), F.col("new")))
    # a word that a text has as given and as family name is the family's there
    one = pairs.groupBy("key", "value").agg(F.min(F.struct("kind", "new"))["new"].alias("new"))
    maps = one.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("new"))
    maps = scratch.write(maps, "maps")  # at most the entities of one text
    # `maps` grows with the documents, so both sides are shuffled at any size
    joined = some.join(maps.hint("merge"), "key")
    body, titled = F.col("body"), rf"^(?:{_titles})\.? "
    names = F.exists("found", lambda m: kind_of(m) == "name")
    parts = lambda pattern: (F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
    word = lambda w: F.coalesce(F.element_at(F.col("new"), w), w)

    def changed(m: Column) -> Column:
        name = F.concat(F.regexp_extract(m, titled, 0), F.array_join(F.transform(F.split(F.regexp_replace(m, titled, ""), " "), word), " "))
        return F.coalesce(F.element_at(F.col("new"), m), name)

    pieces, hits = zip(parts(ANY), parts(f"{ANY}|{BARE}"), strict=True)
    joined = joined.withColumn("pieces", F.when(names, pieces[1]).otherwise(pieces[0])).withColumn("hits", F.when(names, hits[1]).otherwise(hits[0]))
    joined = joined.withColumn("news", F.transform("hits", changed))
    count = F.size(F.filter(F.arrays_zip("hits", "news"), lambda x: x["hits"] != x["news"]))
    woven = F.array_join(F.transform(F.arrays_zip("pieces", "news"), lambda x: F.concat(F.coalesce(x["pieces"], F.lit("")), F.coalesce(x["news"], F.lit("")))), "")
    column = lambda c, new: new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
    clean = rows.where(~F.coalesce(holds, F.lit(False))).select(*[column(c, body) for c in kept], F.lit(0).cast("long").alias("n_entities"))
    return clean.unionByName(joined.select(*[column(c, woven) for c in kept], count.cast("long").alias("n_entities")))
