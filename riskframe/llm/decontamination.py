"""Benchmark decontamination by templates.

Texts are canonicalised to words: lower case, no punctuation, and typed placeholders in place of
numbers, of names and of units after a number. Names are read in three ways: capitalised words
within a sentence, all capitalised words, and none, for copies in other capitals. Texts are also
read with every word as it is. Windows of ``WIDTH`` words of the benchmark are hash-joined with
those of the documents. Matches of a document and an item at one distance from each other belong
together: a run of ``RUN`` windows, or all of a shorter item, is a leak, provided that its words are
the item's, or that the slots are consistent, that is, that each value of the item stands for one
value in the document throughout. So a question asked again with other numbers and names is found
as well. Where values differ, windows with fewer than ``LITERALS`` other words count only beside
all windows that have more.

The benchmark's windows are broadcast while they are counted to be few; beyond that both sides
are shuffled by hash. Slots are compared only in documents with runs that are long enough, whose
texts are read a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_keys, free_name, materialise

WIDTH = 8
RUN = 6  # windows in a run: 13 words
LITERALS = 4  # words of a window that are not placeholders, at least
SHORTEST = 5  # words of the shortest item that can be told from prose
BROADCAST_ROWS = 1_000_000  # windows of items, about 60 bytes each, and documents with long runs, 16 bytes each

# Units, recognised after a number only.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "ton", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros",
    "cent", "cents", "percent", "degree", "degrees", "v", "w", "kw", "hz", "n", "j", "pa",
)
NAME = "\x01"  # marks a capitalised word; two of them mark a name within a sentence
NAME_PATTERN = r"\p{Lu}(?<=\p{Ll}[,;]? .)"  # the upper-case letter is looked for first
CAPITAL_PATTERN = r"\p{Lu}(?<![\p{L}0-9].)"
# Code points between words; control, ASCII, Latin-1 and general punctuation, ideographic space and stops.
BETWEEN = r"[\x00\x02-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\u2000-\u206F\u3000-\u303F\uFF00-\uFF0F]+"
NUMBER, UNIT, WITHIN, CAPITAL = 1, 2, 3, 4
# kinds of words that are slots; every word as it is comes with each reading of an item
ITEM_READINGS = ((NUMBER, UNIT, WITHIN), (NUMBER, UNIT, WITHIN, CAPITAL), (NUMBER, UNIT))
# documents are read in these ways and as they are


def _words(text: Column) -> Column:
    """Lower-case words; numbers keep inner points and stand apart from letters.

    ``NAME`` stands before capitalised words, twice within a sentence.
    """
    t = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(NAME), F.lit(" ")), NAME_PATTERN, NAME + "$0"), CAPITAL_PATTERN, NAME + "$0")
    t = F.lower(t)
    joined = F.regexp_replace(F.regexp_replace(t, r"([0-9])[.,:]([0-9])", "$1_$2"), r"([0-9])[.,:]([0-9])", "$1_$2")
    t = F.when(text.rlike("[0-9]"), F.regexp_replace(joined, r"([0-9])(\p{L})", "$1 $2")).otherwise(t)
    return F.array_remove(F.split(t, BETWEEN), "")


def _is_number(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def _read(df: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The kept columns, ``_n`` (there is a digit), ``words`` without marks, ``kinds`` of words and ``_h0``, hashes of the words.

    Kinds: NUMBER, UNIT (after a number), WITHIN (a name within a sentence), CAPITAL (another
    capitalised word), 0.
    """
    text = F.col(text_col)
    d = df.where(text.isNotNull()).select(*keep, text.rlike("[0-9]").alias("_n"), _words(text).alias("_m"))
    names = [c for c in d.columns if c not in ("_n", "_m")]
    d = d.select(*names, "_n", "_m", F.transform("_m", lambda w: F.ltrim(w, F.lit(NAME))).alias("words"))
    units = F.array(*map(F.lit, UNITS))

    def name(w: Column) -> Column:
        return F.when(w.startswith(NAME + NAME), WITHIN).when(w.startswith(NAME), CAPITAL).otherwise(0)

    # arrays are arguments, not looked up in lambdas: the planner may move their whole computation in there
    before = F.slice(F.concat(F.array(F.lit("")), "words"), 1, F.size("words"))
    value = F.zip_with("words", before, lambda w, b: F.when(_is_number(w), NUMBER).when(_is_number(b) & F.array_contains(units, w), UNIT).otherwise(0))
    kinds = F.when(F.col("_n"), F.zip_with("_m", value, lambda w, v: F.when(v > 0, v).otherwise(name(w)))).otherwise(F.transform("_m", name))
    return d.select(*names, "_n", "words", kinds.alias("kinds"), F.transform("words", lambda w: F.xxhash64(w)).alias("_h0"))


def _canonical(is_slot, hashes: str = "_h0") -> Column:
    """Hashes of the words with one value for all words of each of the kinds that are slots; both kinds of names are one."""
    return F.zip_with(hashes, "kinds", lambda h, k: F.when(is_slot(k), F.least(k, F.lit(WITHIN)).cast("long")).otherwise(h))


def _paired(left: str, right: str, shift: int) -> Column:
    """Hash of each element of one array with the element ``shift`` places on in another."""
    return F.zip_with(left, F.slice(right, shift + 1, 1 << 30), lambda x, y: F.xxhash64(x, y))


def _windows(d: DataFrame, hashes: dict[str, Column], widths: list[int]) -> DataFrame:
    """Add ``{name}_{width}``: the hash of every window of ``width`` words, in order, for each name and width; none for null."""
    names = d.columns
    d = d.select("*", *[c.alias(f"{n}_1h") for n, c in hashes.items()])
    # hashes of 2, 4, 8... words by doubling, shared by the widths
    part = 1
    while 2 * part <= max(widths):
        d = d.select("*", *[_paired(f"{n}_{part}h", f"{n}_{part}h", part).alias(f"{n}_{2 * part}h") for n in hashes])
        part *= 2
    out = []
    for n in hashes:
        for w in widths:
            # a width in between adds the parts it is made of
            parts = [p for p in (1 << b for b in range(w.bit_length())) if w & p]
            whole, size = F.col(f"{n}_{parts[0]}h"), parts[0]
            for p in parts[1:]:
                whole, size = _paired(whole, f"{n}_{p}h", size), size + p
            fits = F.greatest(F.size(f"{n}_1h") - (w - 1), F.lit(0))  # those that do not run over the end
            out.append(F.coalesce(F.slice(whole, 1, fits), F.array().cast("array<bigint>")).alias(f"{n}_{w}"))
    return d.select(*names, *out)


def document_windows(docs: DataFrame, text_col: str, keep: list[Column], widths: list[int]) -> DataFrame:
    """One row per window and way to read it, equal ones once: the kept columns, ``i`` and ``h``."""
    d = _read(docs, text_col, keep)
    names = [c for c in d.columns if c not in ("words", "kinds", "_h0", "_n")]
    # the readings one from the other; without a digit in the text there are no numbers and units to be read apart
    d = d.select(*names, "_n", "kinds", "_h0", F.when(F.col("_n"), _canonical(lambda k: (k == NUMBER) | (k == UNIT))).alias("_h3"))
    d = d.select("*", F.coalesce("_h3", "_h0").alias("_hv"))
    d = d.select("*", _canonical(lambda k: k == WITHIN, "_hv").alias("_hw"))
    read = {"r0": F.col("_h0"), "r1": F.col("_hw"), "r2": _canonical(lambda k: k == CAPITAL, "_hw"), "r3": F.col("_h3")}
    d = _windows(d.select(*names, "kinds", "_h0", "_hw", "_h3"), read, widths)
    every = [f"{r}_{w}" for w in widths for r in read]
    d = d.select(*names, F.posexplode(F.arrays_zip(*every)).alias("i", "_z"))
    found = [F.coalesce(F.col(f"_z.r3_{w}"), F.col(f"_z.r0_{w}")) if r == "r3" else F.col(f"_z.{r}_{w}") for w in widths for r in read]
    return d.select(*names, "i", F.explode(F.array_distinct(F.array(*found))).alias("h"))


def item_windows(items: DataFrame, widths: list[int], run: int = RUN) -> DataFrame:
    """Windows of the items to look for, by ``reading``, and what is needed of them.

    ``verbatim``: all words are taken as they are. Otherwise ``at`` and ``there`` are the places
    and values of the slots, and ``light`` windows have enough other words. Windows with few
    others are looked for only where an item has fewer than ``run`` light ones, but has some.
    An item is cut into windows of the last of ``widths``, or of its own length if that is another of them.
    """
    # within a sentence the item's first word may pass for a name: it is read both ways
    first = F.concat(F.lit("a "), F.upper(F.substring("item_text", 1, 1)), F.expr("substring(item_text, 2)"))
    both = items.withColumn("read", F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.col("item_text").alias("text")), F.struct(F.lit(1).alias("cut"), first.alias("text")))))
    both = both.select("item_id", F.xxhash64("item_id", "item_text").alias("item"), "read.cut", "read.text")
    d = _read(both, "text", [F.col("item_id"), F.col("item"), F.col("cut")])
    d = d.withColumn("width", F.least(F.size("words") - F.col("cut"), F.lit(widths[-1]))).where(F.col("width").isin(widths))
    ways = [F.struct(F.lit(r).alias("reading"), F.lit(v).alias("verbatim"), F.array(*map(F.lit, slots)).alias("slots")) for r, slots in enumerate(ITEM_READINGS) for v in (True, False)]
    d = d.withColumn("way", F.explode(F.array(*ways))).select("*", "way.*").drop("way")
    # a verbatim window has no slots
    d = d.withColumn("slots", F.when(F.col("verbatim"), F.array().cast("array<int>")).otherwise(F.col("slots")))
    d = _windows(d, {"w": _canonical(lambda k: F.array_contains("slots", k))}, widths)
    mine = F.coalesce(*[F.when(F.col("width") == w, F.col(f"w_{w}")) for w in widths])
    d = d.select("item_id", "item", "reading", "verbatim", "cut", "width", "words", "kinds", "slots", F.posexplode(mine).alias("i", "h")).where(F.col("i") >= F.col("cut"))
    at = F.filter(F.sequence(F.lit(0), F.col("width") - 1), lambda o: F.array_contains("slots", F.get("kinds", F.col("i") + o)))
    d = d.withColumn("at", at).select(
        "item_id", "item", "reading", (F.col("i") - F.col("cut")).alias("ipos"), "h", "verbatim", "width", "at", F.transform("at", lambda o: F.get("words", F.col("i") + o)).alias("there"))
    literals = F.least(F.lit(LITERALS), F.col("width") - 1)
    d = d.withColumns({"light": ~F.col("verbatim") & (F.size("at") <= F.col("width") - literals), "spoken": ~F.col("verbatim") & (F.size("at") < F.col("width"))})
    one = lambda c: F.sum(F.col(c).cast("long"))
    sizes = d.groupBy("item", "reading", "ipos").agg(F.max("light").alias("light"), F.max("spoken").alias("spoken"))
    sizes = sizes.groupBy("item", "reading").agg((F.max("ipos") + 1).cast("long").alias("n_windows"), one("light").alias("n_light"), one("spoken").alias("n_spoken"))
    d = d.join(sizes, ["item", "reading"])
    d = d.where(F.col("verbatim") | F.col("light") | (F.col("spoken") & F.col("n_light").between(1, run - 1)))
    return d.groupBy("item_id", "item", "reading", "ipos", "h", "n_windows", "n_light", "n_spoken").agg(
        F.max("verbatim").alias("verbatim"), F.max("light").alias("light"), F.max(F.struct("at", "there")).alias("slots")).select("*", "slots.*").drop("slots")


def _widths(items: DataFrame, width: int) -> list[int]:
    """Widths in use: ``width``, and the lengths of items that are shorter; a handful at most."""
    n = F.least(F.size(_words(F.col("item_text"))), F.lit(width))
    return sorted(r[0] for r in items.where(F.col("item_text").isNotNull()).select(n.alias("n")).distinct().collect() if r[0] >= SHORTEST)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text: str = "text", width: int = WIDTH, run: int = RUN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents that hold benchmark items: doc_id, k1, k2 (the document), item_id, n_windows, n_matched, changed.

    ``n_matched`` of the item's ``n_windows`` stand in the document in one run of positions;
    ``changed`` tells whether a slot has another value there. Null and empty texts on either side,
    items without id and items of fewer than five words match nothing. Items that repeat an id are joined into one
    set of windows; items that share a text each get their rows.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text")).where("item_id is not null").distinct()
    k1, k2 = doc_keys(F.col(id_col), F.col(text_col))
    widths = _widths(items, width)
    if not widths:
        empty = items.limit(0).select(F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"), "item_id")
        return docs.limit(0).select(F.col(id_col).alias("doc_id")).join(empty, F.lit(False)).select(
            "doc_id", "k1", "k2", "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_matched"), F.lit(False).alias("changed"))
    side = materialise(item_windows(items, widths, run), "benchmark")
    few = side.count() <= broadcast_rows
    mine = document_windows(docs, text_col, [F.col(id_col).alias("doc_id"), k1.alias("k1"), k2.alias("k2")], widths)
    hits = mine.join(F.broadcast(side) if few else side, "h").select(
        "doc_id", "k1", "k2", "i", "item_id", "item", "reading", "n_windows", "n_light", "n_spoken", (F.col("i") - F.col("ipos")).alias("diagonal"), "ipos", "verbatim", "light", "at", "there")
    hits = materialise(hits, "benchmark-hits")
    run_key = ["doc_id", "k1", "k2", "item_id", "item", "reading", "n_windows", "n_light", "n_spoken", "diagonal"]
    spots = hits.groupBy(*run_key, "ipos").agg(F.max("verbatim").alias("verbatim"), F.max("light").alias("light"))
    runs = spots.groupBy(*run_key).agg(F.count("*").alias("n_matched"), F.count_if("verbatim").alias("n_same"), F.count_if("light").alias("n_lit"),
                                       F.count_if(F.col("verbatim") | F.col("light")).alias("n_good"))
    need = F.least(F.lit(run), F.col("n_windows"))
    # an item with too few light windows needs all of them, and windows with fewer words beside
    dense = F.col("n_light").between(1, run - 1) & (F.col("n_lit") >= F.col("n_light")) & (F.col("n_matched") >= F.least(F.lit(run), F.col("n_spoken")))
    runs = runs.where((F.col("n_same") >= need) | (F.col("n_good") >= need) | dense)
    # only where a run is long enough are its slots looked at, and the words of the document read again
    runs = materialise(runs.select("*", (F.col("n_same") >= need).alias("plain"), F.xxhash64(*run_key).alias("_run")), "benchmark-runs")
    keys = materialise(runs.select("k1", "k2").distinct(), "benchmark-documents")
    keys = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")).join(keys, ["k1", "k2"], "left_semi")
    texts = _read(texts.dropDuplicates(["k1", "k2"]), "text", [F.col("k1"), F.col("k2")]).select("k1", "k2", "words")
    open_ = hits.where(F.size("at") > 0).withColumn("_run", F.xxhash64(*run_key)).join(runs.select("_run"), "_run", "left_semi")
    here = F.transform("at", lambda o: F.get("words", F.col("i") + o))
    pairs = open_.join(texts, ["k1", "k2"]).select("_run", F.explode(F.arrays_zip(F.col("there"), here.alias("here"))).alias("z"))
    pairs = pairs.groupBy("_run", F.col("z.there").alias("there")).agg(F.min("z.here").alias("low"), F.max("z.here").alias("high"))
    slots = pairs.groupBy("_run").agg(
        F.min(F.col("low") == F.col("high")).alias("consistent"), F.max((F.col("low") != F.col("there")) | (F.col("high") != F.col("there"))).alias("changed"))
    leak = runs.join(slots, "_run", "left").where(F.col("plain") | F.coalesce("consistent", F.lit(True)))
    return leak.groupBy("doc_id", "k1", "k2", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.min(F.coalesce("changed", F.lit(False))).alias("changed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    k1, k2 = free_name(docs, "k1", "k2")
    keys = doc_keys(F.col(id_col), F.col(text_col))
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    return docs.withColumns({k1: keys[0], k2: keys[1]}).join(bad, [k1, k2], "left_anti").select(*docs.columns)
