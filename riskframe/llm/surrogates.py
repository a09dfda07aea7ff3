"""Personal data replaced by surrogates that keep type, format, script and gender.

Entities are found by patterns: mail addresses, secrets and long hex strings, IP addresses, bank
accounts, card, social security and phone numbers, and names after an honorific. What identifies
an entity (digits of a number, lower-case letters of the rest) gets one surrogate for the whole
corpus, drawn with a secret key, so mentions of one entity stay mentions of one entity, in
whatever format each is written. Digits stay digits, vowels vowels and consonants consonants of
the same script; a card that passes its check digit still does; a given name is replaced by one of
the honorific's gender.

Surrogates are checked over the corpus: two entities never share one, and none is an entity that
occurs itself. Whoever fails draws again, in rounds, until all differ; names and mail addresses get
longer from round ``GROW`` on, so that short ones do not run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, text_key

ROUNDS = 60
GROW = 4  # rounds at the entity's own length; then spelled surrogates get a letter more each round

# Patterns of the types, in the order in which they are tried at a place.
MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<=(?i:token|secret|api_key|apikey|password) {0,2}[=:] {0,2}[\"'])[^\"'\s]{8,}|(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z])"
ADDRESS = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
CARD = r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"
PHONE = r"(?<!\w)(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?!\w)"
MALE = r"(?:Mr|Herr|Señor|Sr|Monsieur)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme)"
PERSON = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
# What every entity has one of: cheap to look for, so that most texts are done with one scan.
TRIGGER = r"[0-9@]|[a-fA-F]{32}|[=:] {0,2}[\"']|(?:Mr|Herr|Señor|Sr|Monsieur|Ms|Miss|Frau|Sra|Madame|Mme)"
ANY = "|".join([MAIL, SECRET, ADDRESS, ACCOUNT, SOCIAL, CARD, PHONE, PERSON])

# Given names by gender and script.
GIVEN = {
    "male": {"latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Victor"),
             "cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"),
             "greek": ("Άρης", "Γιάννης", "Δήμος", "Κώστας", "Νίκος", "Πέτρος")},
    "female": {"latin": ("Alice", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Julia", "Laura", "Maria", "Nora", "Olivia"),
               "cyrillic": ("Алла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
               "greek": ("Άννα", "Δήμητρα", "Ελένη", "Ζωή", "Μαρία", "Σοφία")},
}
# Letters that replace letters of the same class.
LETTERS = (
    ("[aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ]", "aeiou"), ("[a-zß-öø-ÿđğłńňřśšťžż]", "bcdfghjklmnprstvwz"),
    ("[аеёиоуыэюя]", "аеиоуя"), ("[а-яёђ-џ]", "бвгдзклмнпрстфхшц"),
    ("[αεηιουωάέήίόύώϊϋ]", "αεηιουω"), ("[α-ωϐ-ϖ]", "βγδζθκλμνξπρστφχψ"),
)


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _kind(surface: Column) -> Column:
    return (
        F.when(surface.rlike(rf"^{MALE}\.? \p{{Lu}}"), "male").when(surface.rlike(rf"^{FEMALE}\.? \p{{Lu}}"), "female")
        .when(surface.rlike(f"^(?:{MAIL})$"), "mail").when(surface.rlike(f"^(?:{ADDRESS})$"), "address")
        .when(surface.rlike(f"^(?:{SOCIAL})$"), "social").when(surface.rlike(f"^(?:{CARD})$"), "card")
        .when(surface.rlike(f"^(?:{PHONE})$"), "phone").when(surface.rlike(f"^(?:{ACCOUNT})$"), "account").otherwise("secret")
    )


_NUMBERS = ("social", "card", "phone")


def _identity(kind: Column, surface: Column) -> Column:
    name = F.lower(F.regexp_replace(surface, rf"^(?:{MALE}|{FEMALE})\.? ", ""))
    return (
        F.when(kind.isin("male", "female"), name).when(kind.isin(*_NUMBERS), F.regexp_replace(surface, "[^0-9]", ""))
        .when(kind == "account", F.lower(F.regexp_replace(surface, " ", ""))).otherwise(F.lower(surface))
    )


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))


def _check_sum(digits: Column) -> Column:
    """Sum of card digits, every second one from the right doubled; 0 modulo 10 in a valid number."""
    values = F.transform(F.reverse(_characters(digits)), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))


def _candidate(identity: Column, seed: Column) -> Column:
    """Surrogate identities of the same length in several classes of characters, as a struct."""

    def letter(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string"))
        for pattern, letters in LETTERS:
            out = out.when(c.rlike(pattern), F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1)))
        ideograph = F.decode(F.unhex(F.hex(_draw(seed, i, 0x5000) + 0x4E00)), "UTF-16BE")
        out = out.when((c >= "一") & (c <= "鿿"), ideograph)
        return out.when(c.rlike(r"\p{L}"), F.substring(F.lit("bcdfghjklmnprstvwz"), _draw(seed, i, 18) + 1, F.lit(1))).otherwise(c)  # of another script

    chars = _characters(identity)
    spelled = F.array_join(F.transform(chars, letter), "")
    hexed = F.array_join(F.transform(chars, lambda c, i: F.lower(F.hex(_draw(seed, i, 16)))), "")
    end = F.substring_index(identity, ".", -1)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    digits = F.concat(F.substring(identity, 1, 1), F.substring(F.array_join(F.transform(chars, lambda c, i: _draw(seed, i, 10).cast("string")), ""), F.lit(2), F.length(identity)))
    return F.struct(spelled.alias("spelled"), end.alias("identity_end"), hexed.alias("hexed"), octets.alias("octets"), digits.alias("digits"))


def _surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, identity, surrogate) for distinct (kind, identity); no two alike, none an identity."""
    pending, done = entities, None
    for attempt in range(ROUNDS):
        seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "identity", F.lit(str(attempt))), 256)
        more = max(0, attempt - GROW + 1)
        longer = (
            F.when(F.col("kind").isin("male", "female"), F.concat("identity", F.repeat(F.substring("identity", -1, 1), F.lit(more))))
            .when(F.col("kind") == "mail", F.concat(F.lit("b" * more), "identity")).otherwise(F.col("identity"))
        )
        parts = _candidate(longer, F.col("seed"))
        mailed = F.concat(F.expr("substring(spelled, 1, length(spelled) - length(identity_end))"), F.col("identity_end"))
        tried = pending.withColumn("seed", seed).withColumn("parts", parts).select("kind", "identity", "seed", "parts.*")
        valid = _check_sum(F.col("identity")) % 10 == 0
        body = F.expr("substring(digits, 1, length(digits) - 1)")
        check = F.pmod(-_check_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        words = F.split("identity", " ")
        given = F.lit(None).cast("string")
        for gender, scripts in GIVEN.items():
            for script, names in scripts.items():
                of = F.col("identity").rlike({"latin": "^[a-zß-ÿ]", "cyrillic": "^[а-яё]", "greek": "^[α-ωά-ώ]"}[script])
                given = F.when((F.col("kind") == gender) & of, F.lower(F.get(F.array(*map(F.lit, names)), _draw(F.col("seed"), F.lit(-1), len(names))))).otherwise(given)
        named = F.when((F.size(words) > 1) & given.isNotNull(), F.concat_ws(" ", given, F.expr("substring(spelled, locate(' ', spelled) + 1, length(spelled))"))).otherwise(F.col("spelled"))
        surrogate = (
            F.when(F.col("kind").isin("male", "female"), named).when(F.col("kind") == "mail", mailed).when(F.col("kind") == "address", F.col("octets"))
            .when((F.col("kind") == "card") & valid, F.concat(body, check)).when(F.col("kind").isin(*_NUMBERS), F.col("digits"))
            .when((F.col("kind") == "secret") & (F.col("identity").rlike("^[0-9a-f]+$") | F.lit(more > 0)), F.col("hexed"))
            .when(F.col("kind") == "account", F.concat(F.substring("identity", 1, 2), F.expr("substring(spelled, 3, length(spelled))"))).otherwise(F.col("spelled"))
        )
        tried = tried.select("kind", "identity", surrogate.alias("surrogate"))
        first = tried.groupBy("kind", "surrogate").agg(F.min("identity").alias("identity"))
        taken = entities.select("kind", F.col("identity").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        good = materialise(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "identity", "surrogate"), "surrogates")
        done = good if done is None else done.union(good)
        pending = materialise(pending.join(good, ["kind", "identity"], "left_anti").select("kind", "identity"), "surrogates-open")
        if not pending.take(1):
            return done
    raise ValueError(f"no distinct surrogates after {ROUNDS} rounds: a type has nearly as many entities as values")


def _written(kind: Column, surface: Column, surrogate: Column) -> Column:
    """The surrogate in the surface's format: separators, honorific and capitals as they were."""
    chars = _characters(surface)
    place = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^0-9]", "")))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, F.get(place, i), F.lit(1))).otherwise(c)), "")
    letters = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), " ", "")))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.upper(F.substring(surrogate, F.get(letters, i), F.lit(1))))), "")
    same = F.array_join(F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), "")
    title = F.regexp_extract(surface, rf"^(?:{MALE}|{FEMALE})\.? ", 0)
    name = F.array_join(F.transform(F.split(surrogate, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return (
        F.when(kind.isin("male", "female"), F.concat(title, name)).when(kind.isin(*_NUMBERS), numbers).when(kind == "account", spaced)
        .when(kind == "address", surrogate).when(F.length(surface) == F.length(surrogate), same).otherwise(surrogate)
    )


def has_entity(text: Column) -> Column:
    """Whether a text holds an entity; false for null."""
    return F.coalesce(text.rlike(TRIGGER) & text.rlike(ANY), F.lit(False))


def replacements(docs: DataFrame, text_col: str = "text", key: str = "corpus") -> DataFrame:
    """(surface, kind, identity, replacement) of every entity as written anywhere in the documents."""
    found = docs.where(has_entity(F.col(text_col))).select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0)))).alias("surface")).distinct()
    found = found.withColumn("kind", _kind(F.col("surface"))).withColumn("identity", _identity(F.col("kind"), F.col("surface")))
    found = materialise(found, "entities")
    entities = materialise(found.select("kind", "identity").distinct(), "identities")
    named = found.join(_surrogates(entities, key), ["kind", "identity"])
    return materialise(named.select("surface", "kind", "identity", _written(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("replacement")), "replacements")


def replace(docs: DataFrame, text_col: str = "text", key: str = "corpus", n_replaced: str = "n_replaced") -> DataFrame:
    """All columns of ``docs`` with the entities of the text replaced, and how many were.

    Null and empty texts and texts without entities stay as they are. ``key`` is the secret: the
    same key gives the same surrogates to the same set of entities.
    """
    table = replacements(docs, text_col, key)
    k1, k2, by, surfaces = free_name(docs, "k1", "k2", "by", "surfaces")
    has = has_entity(F.col(text_col))
    keys = text_key(F.col(text_col), "k")
    rows = docs.where(has).withColumns({k1: keys[0], k2: keys[1], surfaces: F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))})
    seen = rows.select(k1, k2, F.explode(F.array_distinct(surfaces)).alias("surface")).distinct()
    maps = seen.join(table.select("surface", "replacement"), "surface").groupBy(k1, k2).agg(F.map_from_entries(F.collect_list(F.struct("surface", "replacement"))).alias(by))
    rows = rows.join(maps, [k1, k2])
    between = F.split(F.col(text_col), ANY, -1)
    parts = F.transform(F.arrays_zip(between.alias("between"), F.col(surfaces).alias("surface")), lambda x: F.concat(x["between"], F.coalesce(F.element_at(by, x["surface"]), F.lit(""))))
    changed = rows.withColumn(text_col, F.array_join(parts, "")).withColumn(n_replaced, F.size(surfaces).cast("long"))
    names = [*docs.columns, n_replaced]
    return changed.select(*names).unionByName(docs.where(~has).withColumn(n_replaced, F.lit(0).cast("long")).select(*names))
