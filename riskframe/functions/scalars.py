"""Scalar features: dates, text, JSON, codes, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean month and year lengths in days, and the accepted ranges in years.
MONTH_DAYS, YEAR_DAYS = 30.436875, 365.2425
AGE_RANGE, EXPIRY_RANGE = (18, 100), (0, 10)
# Mail domains kept as they are, company types and placeholder texts.
KNOWN_DOMAINS = ("gmail.com", "hotmail.com", "outlook.com", "yahoo.com", "hotmail.co.uk", "icloud.com", "yahoo.co.uk", "live.co.uk")
NO_COMPANY_TYPE = ("NONE", "None", "", "nan")
OUTWARD = r"^[A-Z]{1,2}[0-9][A-Z0-9]?\s*([0-9][A-Z]{2})?$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_document(payload: Column | str) -> Column:
    """The payload as a variant ``{"v": payload}``, null unless the whole text is one JSON value.

    The engine's parser stops after the first value and ignores what follows. Text that is
    more than one value cannot be valid inside both an object and an array, so asking for
    both wrappings rejects it.
    """
    c = _c(payload)
    in_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull()
    return F.when(in_array, F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))))


def json_at(document: Column | str, path: str, kind: str = "string") -> Column:
    """Value at a path of a ``json_document``, null when missing or not of that kind."""
    return F.try_variant_get(_c(document), f"$.v.{path}", kind)


def json_valid(payload: Column | str) -> Column:
    return json_document(payload).isNotNull()


def json_text(payload: Column | str, path: str) -> Column:
    return json_at(json_document(payload), path)


def json_number(payload: Column | str, path: str) -> Column:
    return json_at(json_document(payload), path, "double")


def tail_code(x: Column | str, n: int) -> Column:
    """Last ``n`` characters of the trimmed text, '-' when missing."""
    return F.coalesce(F.right(F.trim(_c(x)), F.lit(n)), F.lit("-"))


def head_code(x: Column | str, n: int) -> Column:
    return F.coalesce(F.left(F.trim(_c(x)), F.lit(n)), F.lit("-"))


def first_match(x: Column | str, pattern: str) -> Column:
    """First match of a pattern, null when there is none."""
    return F.regexp_substr(_c(x), F.lit(pattern))


def months_between_dates(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_c(later).cast("date"), _c(earlier).cast("date")) / MONTH_DAYS


def years_between_dates(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_c(later).cast("date"), _c(earlier).cast("date")) / YEAR_DAYS


def guarded_age(created: Column | str, born: Column | str) -> Column:
    """Age in years; null outside 18..100 after rounding half-even."""
    years = years_between_dates(created, born)
    whole = F.bround(years, 0)
    return F.when((whole >= AGE_RANGE[0]) & (whole <= AGE_RANGE[1]), years)


def guarded_expiry(expires: Column | str, created: Column | str) -> Column:
    """Years to expiry; null below 0 or above 10 after rounding half-even."""
    years = years_between_dates(expires, created)
    return F.when((years >= EXPIRY_RANGE[0]) & (F.bround(years, 0) <= EXPIRY_RANGE[1]), years)


def happened_before(event: Column | str, ts: Column | str) -> Column:
    return F.coalesce((_c(event) < _c(ts)).cast("int"), F.lit(0))


def clean_lower(x: Column | str, missing: str | None = None) -> Column:
    c = _c(x) if missing is None else F.coalesce(_c(x), F.lit(missing))
    return F.lower(F.trim(c))


def has_digit(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike(r"\d").cast("int"), F.lit(0))


def mail_domain(email: Column | str, known: tuple[str, ...] = KNOWN_DOMAINS) -> Column:
    """Text after the last '@' then the last '#'; domains not listed become 'other'."""
    d = F.substring_index(F.substring_index(_c(email), "@", -1), "#", -1)
    return F.when(d.isin(*known), d).otherwise("other")


def company_type_bucket(x: Column | str) -> Column:
    c = _c(x)
    return F.when(c.isNull() | c.isin(*NO_COMPANY_TYPE), "SOLE-TRADER").when(F.upper(c) == "LTD", "LTD").otherwise("other")


def outward_letters(postcode: Column | str) -> Column:
    """Upper-case outward code without digits; null when the postcode is not valid."""
    p = F.upper(F.trim(_c(postcode)))
    outward = F.regexp_replace(p, r"\s*[0-9][A-Z]{2}$", "")
    return F.when(p.rlike(OUTWARD), F.regexp_replace(outward, r"[0-9]", ""))


def industry_codes(x: Column | str, separator: str = ",") -> Column:
    """List of numeric codes, zero-padded to five digits; longer codes are kept whole."""
    def pad(code: Column) -> Column:
        whole = code.try_cast("double").cast("long").cast("string")
        return F.when(F.length(whole) < 5, F.lpad(whole, 5, "0")).otherwise(whole)

    parts = F.transform(F.split(_c(x), separator), lambda p: pad(F.trim(p)))
    return F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast("array<string>"))


def numbered(array: Column | str, stem: str, k: int) -> list[Column]:
    """First ``k`` elements as columns ``stem_0`` ... (the width does not depend on the data)."""
    return [F.get(_c(array), F.lit(i)).alias(f"{stem}_{i}") for i in range(k)]


def known_values(arrays: list[Column], unknown: str = "UNKNOWN") -> Column:
    """Sorted distinct values of several arrays, nulls and ``unknown`` removed."""
    empty = F.array().cast("array<string>")
    merged = F.concat(*[F.coalesce(a, empty) for a in arrays])
    return F.array_sort(F.array_distinct(F.filter(merged, lambda v: v.isNotNull() & (v != unknown))))


def split_list(x: Column | str, separator: str = ",") -> Column:
    return F.coalesce(F.split(_c(x), separator), F.array().cast("array<string>"))


def count_bucket(n: Column) -> Column:
    """1, 2 or 3+; null for zero and for missing."""
    return F.when(n == 1, "1").when(n == 2, "2").when(n >= 3, "3+")


def json_level_bucket(x: Column | str, level: str = "1") -> Column:
    return count_bucket(F.get_json_object(_c(x), f"$['{level}']").try_cast("int"))


DIRECTORS = "array<struct<firstname:string,lastname:string,dob:string,nationality:string>>"


def director_nationalities(tree: Column | str, first: Column | str, last: Column | str, born: Column | str) -> Column:
    """Nationalities of the directors whose name and birth date equal the applicant's."""
    people = F.from_json(_c(tree), DIRECTORS)
    same = F.filter(people, lambda d: (clean_lower(d["firstname"]) == clean_lower(first))
                    & (clean_lower(d["lastname"]) == clean_lower(last)) & (d["dob"] == _c(born).cast("string")))
    return F.transform(same, lambda d: d["nationality"])


def has_keyword(text: Column | str, keywords: list[str]) -> Column:
    """1 when any keyword occurs as a whole word (case ignored)."""
    pattern = r"(?i)(^|[^\p{L}\p{N}])(" + "|".join(keywords) + r")([^\p{L}\p{N}]|$)"
    return F.coalesce(_c(text).rlike(pattern).cast("int"), F.lit(0))


def clean_text(x: Column | str, prefix: str | None = None) -> Column:
    """Drop a literal prefix text, turn other than letters, digits and dots to blanks, squeeze."""
    c = F.replace(_c(x), F.lit(prefix), F.lit("")) if prefix else _c(x)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9 \n.]", " "), r"\s+", " "))


def word_count(x: Column | str) -> Column:
    t = F.trim(_c(x), F.lit(" \t\n\r"))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def scaled_score(p: Column | str, scale: float = 1000.0, digits: int = 2) -> Column:
    """Score rounded half-even."""
    return F.bround(_c(p) * scale, digits)


def whole_weeks(days: Column | str) -> Column:
    return F.bround(_c(days) / 7, 0)


def month_key(ts: Column | str) -> Column:
    return F.concat_ws("_", F.year(_c(ts)), F.month(_c(ts)))


def risk_level(survival: Column | str, low: float = 0.005, high: float = 0.01) -> Column:
    """Low / Medium / High by the thresholds on 1 - survival probability."""
    p = 1 - _c(survival)
    return F.when(p <= low, "Low").when(p >= high, "High").otherwise("Medium")


def risk_number(survival: Column | str, low: float = 0.005, high: float = 0.01) -> Column:
    p = 1 - _c(survival)
    return F.when(p <= low, 1).when(p >= high, 3).otherwise(2)


def softmax_positive(logits: Column | str) -> Column:
    """Probability of class 1 from two logits."""
    a = _c(logits)
    return 1 / (1 + F.exp(F.get(a, F.lit(0)) - F.get(a, F.lit(1))))


def argmax_class(logits: Column | str) -> Column:
    a = _c(logits)
    return (F.get(a, F.lit(1)) > F.get(a, F.lit(0))).cast("int")


def as_record(columns: list[str]) -> Column:
    """The row as a JSON object, for explanations."""
    return F.to_json(F.struct(*columns))


def category_text(x: Column | str, missing: str = "missing") -> Column:
    """Upper-case text of a category, missing values filled before the change of case."""
    return F.upper(F.coalesce(_c(x).cast("string"), F.lit(missing)))


def with_dimension(df: DataFrame, code: str, dimension: DataFrame, dim_code: str, value: str, out: str) -> DataFrame:
    """Left lookup of a code in a dimension table; unknown codes give null.

    No broadcast hint: the planner broadcasts the dimension by its measured size only.
    """
    side = dimension.select(F.col(dim_code).alias("__code"), F.col(value).alias(out)).dropDuplicates(["__code"])
    return df.join(side, F.col(code) == F.col("__code"), "left").drop("__code")


def with_mapped_type(df: DataFrame, keys: list[str], mapping: DataFrame, value: str, out: str) -> DataFrame:
    """Left lookup on several keys (lower-case, trimmed): the type, subtype, country mapping."""
    names = [f"__m{i}" for i in range(len(keys))]
    side = mapping.select(*[clean_lower(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias(out)).dropDuplicates(names)
    cond = F.lit(True)
    for k, n in zip(keys, names):
        cond = cond & (clean_lower(df[k]) == F.col(n))
    return df.join(side, cond, "left").drop(*names)
