"""Benchmark leaks by template canonicalisation, re-parameterised questions included.

Numbers, units after numbers, and names become typed placeholders. Windows of the resulting
templates are hashed and joined, so a question with other numbers or names still matches; words
are compared in lower case, and windows with names also without placeholders for them. Windows
of a document and an item that lie on one diagonal form an alignment. Windows with the item's own
values always count. Of those with other values, the ones that hold a value that stands for
several values of the document do not count; and none does where such a value also stands for
itself, as then the values are not replaced throughout. A document leaks an item when the windows
that count cover enough of the item's, or when enough of its words follow each other unchanged.

A window of placeholders only says nothing: five numbers in a row look like any other five. Such
windows match with the same values only, and only items that have no others are judged by them.
Items shorter than a window are looked up as a whole and reported apart, as an answer such as
"yes" is found anywhere.

All of it is Spark column expressions.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkrank.llm.registry import query
from linkrank.llm.stages import given_id, known_id, read, store, whole_text

WINDOW = 5
COVERAGE = 0.5
RUN = 13  #: words in a row that are a leak whatever their share of the item

#: A benchmark of up to so many windows (about 100 MB) is sent to all executors; a larger one is
#: joined by shuffling both sides.
BROADCAST_WINDOWS = 1_000_000

# Units that may follow a number.
UNITS = (
    "mm cm dm m km inch inches foot feet ft yard yards mile miles mg g kg t ton tons ounce ounces pound pounds lb lbs "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years percent degree degrees euro euros dollar dollars cent cents usd eur gbp "
    "km/h mph w kw kwh v hz ghz mhz kb mb gb tb"
).split()

#: Put before a name; sorts before digits, which sort before letters.
_MARK = "\u0002"
_NAME = r"(\p{Lu})(?<=[^.!?:\s]\s\p{Lu})"
#: Scripts without spaces (Thai to Khmer, Kana, Han): each letter is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
# Tokens of lower-case text. Letters a to z are by far the most common and a test for one of them
# costs least, so they come first, and ASCII separators meet no test of Unicode classes.
_OTHER = rf"(?![\x00-\x7f])[\p{{L}}\p{{M}}&&[^{_UNSPACED}]][\p{{L}}\p{{M}}&&[^{_UNSPACED}]]*+"
_LATIN = rf"[a-z]++(?:{_OTHER})?+"
_PARTS = rf"(?:['’/-](?:{_LATIN}|{_OTHER}))*+"
_NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
_TOKEN = rf"{_LATIN}{_PARTS}|{_MARK}?+(?:{_LATIN}|{_OTHER}){_PARTS}|{_NUMBER}|(?![\x00-\x7f])[\p{{L}}&&[{_UNSPACED}]]\p{{M}}*+"


def _marked(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, _NAME, f"{_MARK}$1"))


def _tokens(marked: Column) -> Column:
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def _is_name(token: Column) -> Column:
    return token < chr(ord(_MARK) + 1)


def _word(token: Column) -> Column:
    return F.ltrim(token, F.lit(_MARK))


def windows(docs: DataFrame, keys: list[str], text: Column, size: int = WINDOW) -> DataFrame:
    """Rows of template windows: the keys, position, template (its hash), slots (its values) and
    whether the template holds a word; if it does not, its hash is also one of its values.

    A name is a word with a capital first letter that does not begin a sentence. A window with
    names has a second row in which they are words in lower case, as in a copy in one case.
    """
    marked = _marked(text)
    rows = docs.select(*keys, _tokens(marked).alias("tokens"), F.contains(marked, F.lit(_MARK)).alias("names"))
    rows = rows.select(*keys, "tokens", "names", (F.size("tokens") - (size - 1)).alias("n"))
    # A row per place, in texts with names two. No functions on arrays that take a lambda: Spark
    # compiles all that follows into one loop (7,000 bytes at five words; the JVM makes up to 8,000
    # fast), but would interpret those.
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.when(F.col("names"), F.col("n") * 2).otherwise(F.col("n")) - 1))
    rows = rows.select(*keys, "tokens", "n", F.explode(places).alias("place"))
    second = F.col("place") >= F.col("n")
    rows = rows.select(*keys, "tokens", second.alias("second"), F.when(second, F.col("place") - F.col("n")).otherwise(F.col("place")).alias("position"))
    parts = [f"token_{k}" for k in range(size)]
    tokens = [F.get("tokens", F.col("position") + k).alias(x) for k, x in enumerate(parts)]
    rows = rows.select(*keys, "second", "position", F.get("tokens", F.col("position") - 1).alias("before"), *tokens)
    rows = rows.where(~F.col("second") | reduce(or_, [_is_name(F.col(x)) for x in parts]))
    rows = rows.withColumns({x: F.when(F.col("second"), _word(F.col(x))).otherwise(F.col(x)) for x in parts})

    numbers = [f"number_{k}" for k in range(-1, size)]
    is_number = {k: (F.col(x) < chr(ord("9") + 1)) & ~_is_name(F.col(x)) for k, x in zip(numbers, ["before", *parts], strict=True)}
    rows = rows.withColumns(is_number)

    def kind(x: Column, number: str, after_number: str) -> Column:
        return F.when(F.col(number), "1").when(F.col(after_number) & x.isin(UNITS), "2").when(_is_name(x), "3")

    kinds = [f"kind_{k}" for k in range(size)]
    rows = rows.withColumns({k: kind(F.col(x), y, z) for k, x, y, z in zip(kinds, parts, numbers[1:], numbers, strict=False)})
    slots = F.concat_ws("\u0001", *[F.concat(k, x) for k, x in zip(kinds, parts, strict=True)])
    slots = F.when(F.coalesce(*kinds).isNull(), "").otherwise(slots)
    bare = reduce(and_, [F.col(k).isNotNull() for k in kinds])
    template = F.xxhash64(*[F.coalesce(k, x) for k, x in zip(kinds, parts, strict=True)], F.when(bare, slots))
    return rows.select(*keys, "position", template.alias("template"), slots.alias("slots"), (~bare).alias("worded"))


def _find_short(rows: DataFrame, items: DataFrame, size: int) -> DataFrame | None:
    """Documents with all words of an item of fewer than ``size`` words, numbers and names included; None if no item is so short."""

    def tokens(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
        return docs.select(*keys, _tokens(_marked(F.col(text))).alias("tokens"))

    def key(i: Column, n: int) -> Column:
        return F.xxhash64(F.lit(n), *[_word(F.get("tokens", i + k)) for k in range(n)])

    short = tokens(items, ["item", "version"], "item_text").withColumn("n", F.size("tokens")).where(F.col("n").between(1, size - 1))
    whole = F.coalesce(*[F.when(F.col("n") == n, key(F.lit(0), n)) for n in range(1, size)])
    short = store(short.select("item", "version", "n", whole.alias("key")))
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())
    if not lengths:
        return None
    i, n = F.col("position"), F.col("n")
    found = tokens(rows, ["doc", "tie"], "doc_text").withColumn("n", F.size("tokens"))
    found = found.select("doc", "tie", "tokens", "n", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("position"))
    found = found.select("doc", "tie", F.explode(F.array(*[F.when(i + k <= n, key(i, k)) for k in lengths])).alias("key"))
    short = short.drop("n")
    return found.join(F.broadcast(short) if short.count() <= BROADCAST_WINDOWS else short, "key").select("doc", "tie", "item", "version").distinct()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    coverage: float = COVERAGE,
    run: int = RUN,
) -> DataFrame:
    """Stored pairs of a document and an item it leaks: doc, tie, item, short, coverage, reparameterised.

    ``doc`` and ``tie`` (a hash of the text) name the document. An item is leaked by ``coverage``
    of its windows that hold a word, or by ``run`` of its words in a row with its own values. With
    fewer than ``size`` words it is ``short``, and found where all of them stand in a row with its
    own values. Texts without a word are never found, nor are NULL or empty ones. Repeated items
    count once; rows with a NULL id are items, too.
    """
    items = benchmark.select(known_id(item_col).alias("item"), whole_text(item_text_col).alias("item_text")).distinct()
    keyed = items.select("item", F.xxhash64("item_text").alias("version"), "item_text")
    known = store(windows(keyed, ["item", "version"], F.col("item_text"), size))
    positions = known.groupBy("item", "version", "position").agg(F.max("worded").alias("worded"))
    parts = positions.groupBy("item", "version").agg(F.count_if("worded").alias("with_words"), F.count("*").alias("all"))
    counted = positions.join(parts, ["item", "version"]).where(F.col("worded") | (F.col("with_words") == 0))
    counted = counted.select("item", "version", F.col("position").alias("item_position"))
    parts = parts.select("item", "version", F.when(F.col("with_words") > 0, F.col("with_words")).otherwise(F.col("all")).alias("parts"))
    known = known.select("item", "version", F.col("position").alias("item_position"), "template", F.col("slots").alias("item_slots"))
    text = whole_text(text_col)
    rows = docs.select(known_id(id_col).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("doc_text"))
    found = windows(rows, ["doc", "tie"], F.col("doc_text"), size).drop("worded")
    small = known.count() <= BROADCAST_WINDOWS
    found = found.join(F.broadcast(known) if small else known, "template")
    here = ["doc", "tie", "item", "version"]
    found = found.withColumn("diagonal", F.col("position") - F.col("item_position"))
    found = store(found.select(*here, "diagonal", "item_position", "slots", "item_slots").distinct())

    old_values = F.split("item_slots", "\u0001")
    pairs = F.arrays_zip(old_values.alias("old"), F.split("slots", "\u0001").alias("new"))
    slots = found.where("slots <> ''").select(*here, "diagonal", F.explode(pairs).alias("p")).select(*here, "diagonal", "p.*")
    slots = slots.distinct().groupBy(*here, "diagonal", "old").agg(F.count("*").alias("c"), F.max(F.col("old") == F.col("new")).alias("kept"))
    chance = slots.where("c > 1").groupBy(*here, "diagonal").agg(F.collect_list("old").alias("olds"), F.max("kept").alias("kept"))
    sound = (F.col("slots") == F.col("item_slots")) | F.col("olds").isNull() | ~F.col("kept") & ~F.arrays_overlap(old_values, "olds")
    sound = found.join(chance, [*here, "diagonal"], "left").where(sound)
    changed = F.max((F.col("slots") != F.col("item_slots")).cast("int"))
    covered = sound.groupBy(*here, "item_position").agg(changed.alias("changed"))
    covered = covered.join(store(counted), ["item", "version", "item_position"], "left_semi")
    covered = covered.groupBy(*here).agg(F.count("*").alias("hits"), F.max("changed").alias("changed"))
    exact = found.where("slots = item_slots").select(*here, "diagonal", "item_position").distinct()
    more = max(0, run - size)  # windows after the first of a run
    row = Window.partitionBy(*here, "diagonal").orderBy("item_position").rangeBetween(0, more)
    runs = exact.withColumn("in_a_row", F.count("*").over(row)).where(F.col("in_a_row") > more).select(*here).distinct()
    scored = covered.join(parts, ["item", "version"]).withColumn("coverage", F.col("hits") / F.col("parts"))
    scored = scored.join(runs.withColumn("run", F.lit(True)), here, "full")
    scored = scored.where((F.col("coverage") >= coverage) | F.col("run"))
    scored = scored.select("doc", "tie", "item", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed", F.lit(0)).alias("changed"), F.lit(False).alias("short"))
    short = _find_short(rows, keyed, size)
    if short is not None:
        short = short.select("doc", "tie", "item", F.lit(1.0).alias("coverage"), F.lit(0).alias("changed"), F.lit(True).alias("short"))
        scored = scored.unionByName(short)
    scored = scored.groupBy("doc", "tie", "item", "short")
    return store(scored.agg(F.max("coverage").alias("coverage"), (F.max("changed") == 1).alias("reparameterised")))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids and short_item_ids (ascending),
    coverage, reparameterised.

    A document that holds short items only is not contaminated. Coverage is that of the item
    covered best, 0 without one. Repeated rows are reported each; an empty table or benchmark
    gives no leaks; other columns are ignored.
    """
    leaks = find_leaks(docs, benchmark, id_col, text_col, **options)
    item, long = given_id("item"), ~F.col("short")
    leaks = leaks.groupBy("doc", "tie").agg(
        F.sort_array(F.collect_list(F.when(long, item))).alias("item_ids"),
        F.sort_array(F.collect_list(F.when(F.col("short"), item))).alias("short_item_ids"),
        F.max(F.when(long, F.col("coverage"))).alias("coverage"),
        F.max(F.when(long, F.col("reparameterised"))).alias("reparameterised"),
    )
    rows = docs.select(known_id(id_col).alias("doc"), F.xxhash64(whole_text(text_col)).alias("tie"))
    none = F.array().cast("array<bigint>")
    return rows.join(leaks, ["doc", "tie"], "left").select(
        given_id("doc").alias("doc_id"),
        F.col("coverage").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("short_item_ids", none).alias("short_item_ids"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that leak no item but short ones, with all their columns.

    Rows are told apart by id and text, so rows with a NULL id, or with one id and different
    texts, are judged each by its own text; an empty benchmark drops none.
    """
    leaks = find_leaks(docs, benchmark, id_col, text_col, **options).where("not short").select("doc", "tie").distinct()
    given = docs.select(
        F.struct("*").alias("row"), known_id(id_col).alias("doc"), F.xxhash64(whole_text(text_col)).alias("tie")
    )
    return given.join(leaks, ["doc", "tie"], "left_anti").select("row.*")


@query("op2_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("item_ids", "short_item_ids")})
