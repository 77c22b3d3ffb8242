"""Benchmark decontamination on templates: numbers, names and units become typed placeholders.

Every window of ``width`` template words of a text is hashed and joined with the windows of the benchmark, so that an item
with other numbers or names is found as well as a literal copy. What is a name shows in the word alone, so that a copy has
the item's template wherever it stands. Windows count only if their slots are consistent, all along a copy: equal values of
the item stand for equal values of the document. Column functions only; Spark alone runs it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed, prepare

#: Words taken for a unit right after a number.
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hz", "khz", "mhz", "w", "kw", "v", "kb", "mb", "gb", "tb",
    "inch", "inches", "feet", "foot", "miles", "mile", "yards", "pounds", "ounces", "meters", "metres", "kilometers", "kilometres",
    "grams", "kilograms", "litres", "liters", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros",
    "cents", "percent", "degrees",
)
#: Words that often begin a sentence and are no names.
NO_NAMES = (
    "a", "about", "after", "all", "also", "although", "an", "and", "any", "are", "as", "at", "because", "before", "both", "but", "by", "can",
    "compute", "consider", "could", "did", "do", "does", "each", "every", "explain", "find", "first", "for", "from", "give", "given", "has",
    "have", "he", "her", "here", "his", "how", "if", "in", "is", "it", "its", "let", "many", "more", "most", "my", "name", "no", "not", "now",
    "of", "on", "once", "one", "only", "or", "our", "she", "should", "since", "so", "some", "suppose", "that", "the", "their", "then", "there",
    "these", "they", "this", "those", "to", "two", "we", "what", "when", "where", "which", "while", "who", "whose", "why", "will", "with",
    "would", "write", "you", "your",
)
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Left out of all words: first those that play no part in recognising numbers and ends of sentences.
MARKS, POINTS = "\"'()[]{}*#&%$|<>_" + NAME + NUMBER + UNIT, ".,;:!?-"
WHITE = r"[\x20\x09-\x0D]"
WORD_END = r"(?![\p{L}\p{N}])"
#: Up to so many windows of the benchmark, of so many bytes with their words, go to all tasks; more meet the documents in a
#: shuffled join.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 1 << 26


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def base_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARKS, "")


def raw_words(base: Column) -> Column:
    """The words of a text without marks, one for each of its template."""
    return split_words(F.translate(base, POINTS, ""))


def template_words(base: Column) -> Column:
    """The words in lower case without marks, some replaced by placeholders.

    A name begins with a capital, goes on in small letters and is none of ``NO_NAMES``; a number starts with a digit and holds
    digits, points and commas; a unit is one of ``UNITS`` after a number.
    """
    plain = "(?!(?:" + "|".join(w.capitalize() for w in NO_NAMES) + ")" + WORD_END + ")"
    # The capital is looked for first, as most places have none.
    named = F.regexp_replace(base, r"(?=\p{Lu})(?<![\p{L}\p{N}])" + plain + r"\p{Lu}\p{Ll}+" + WORD_END, NAME)
    numbered = F.regexp_replace(named, r"(?<![\p{L}\p{N}])[0-9][0-9.,]*" + WORD_END, NUMBER)
    unit = NUMBER + r"[.,;:!?-]*" + WHITE + "+)(?i:" + "|".join(UNITS) + ")" + WORD_END
    return split_words(F.translate(F.lower(F.regexp_replace(numbered, "(" + unit, "$1" + UNIT)), POINTS, ""))


def codes_of(words: Column) -> Column:
    """A number for each word of a template: negative for placeholders, else a hash."""
    return F.transform(
        words, lambda w: F.when(w < "\x04", -F.ascii(w).cast("bigint")).otherwise(F.shiftrightunsigned(F.xxhash64(w), 1))
    )


def with_windows(texts: DataFrame, width: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``(pos, window, slots)`` of each ``width`` words in a row of ``texts`` (``codes``, ``raw``).

    ``slots`` are the raw words of a window that has placeholders, else null. ``raw`` may be empty where there are none. Only
    the exploded array goes through the generator, never the words of the whole text with every window.
    """

    def one(code: Column, i: Column) -> Column:
        part = [code, *(F.get("codes", i + k) for k in range(1, width))]
        slotted = (F.size("raw") > 0) & ((F.least(*part) if width > 1 else code) < 0)
        return F.struct(F.xxhash64(*part).alias("window"), F.when(slotted, F.slice("raw", i + 1, width)).alias("slots"))

    # A shorter text gives an empty array; a filter on the size would be pushed down and make the template twice.
    found = F.slice(F.transform("codes", one), F.lit(1), F.greatest(F.size("codes") - width + 1, F.lit(0)))
    return (
        texts.select(*keep, F.posexplode(found).alias("pos", "w"))
        .select(*keep, "pos", F.col("w.window").alias("window"), F.col("w.slots").alias("slots"))
    )


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """``(width, item_id, item_pos, window, marks, theirs)``: the windows of the items, each content of an item once.

    ``marks`` tells placeholders; ``theirs`` are the raw words if there are any. Windows of placeholders alone say nothing and
    are left out.
    """
    return (
        with_windows(items, width, ["item_id", "codes"])
        .withColumn("marks", F.transform(F.slice("codes", F.col("pos") + 1, width), lambda c: c < 0))
        .filter(F.exists("marks", lambda m: ~m))
        .groupBy(F.lit(width).alias("width"), "item_id", "window", "marks", F.col("slots").alias("theirs"))
        .agg(F.min("pos").alias("item_pos"))
    )


def hits(docs: DataFrame, theirs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, text_hash, item_id, item_pos, shift, pairs)``: windows that documents share with items, with consistent slots:
    in a window, equal values of the item stand for equal values of the document. ``pairs`` are these values ``(a, b)``,
    ``shift`` is how much further in the document the window lies."""
    met = with_windows(docs, width, ["doc_id", "text_hash"]).join(theirs, "window")
    values = lambda words: F.filter(words, lambda _, i: F.get("marks", i))
    pairs = F.array_distinct(F.arrays_zip(values(F.col("theirs")).alias("a"), values(F.col("slots")).alias("b")))
    none = F.array().cast("array<struct<a:string,b:string>>")
    found = met.withColumn("pairs", F.coalesce(pairs, none)).filter(one_to(F.col("pairs")))
    return found.select("doc_id", "text_hash", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "pairs")


def one_to(pairs: Column) -> Column:
    """Whether no value of the item stands for two of the document."""
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 8,
    share: float = 0.5,
) -> DataFrame:
    """``(doc_id, text_hash, item_id, matched, item_windows)``: documents that hold at least ``share`` of an item's windows.

    Windows at the same shift are of one copy; if its slots contradict each other, only its windows without any count. An item
    shorter than ``width`` words is one window of its own length, which must occur whole. Null and empty texts hold
    nothing; items without words, or of placeholders alone, are never found. Rows with the same id and text are one document,
    and so are items; items that share an id but differ in text are told apart. Whole texts are read; only the windows that
    are also the benchmark's leave the task that reads a text.
    """
    prepare(docs.sparkSession)
    based = benchmark.select(F.col(item_id).alias("id"), base_text(F.col(item_text)).alias("base")).distinct()
    items = checkpointed(
        based.select(
            F.struct("id", F.xxhash64("base").alias("hash")).alias("item_id"),
            raw_words(F.col("base")).alias("raw"),
            codes_of(template_words(F.col("base"))).alias("codes"),
        )
        .filter(F.size("codes") > 0)
        .withColumn("width", F.least(F.lit(width), F.size("codes")))
    )
    widths = sorted({width, *(r.width for r in items.select("width").distinct().collect())})  # width and what is shorter
    theirs = [item_windows(items.filter(F.col("width") == w), w) for w in widths]
    known = checkpointed(reduce(DataFrame.union, theirs))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.concat_ws(" ", "theirs", F.col("item_id.id").cast("string")))).alias("text")).first()
    few = size.n <= BROADCAST_WINDOWS and 100 * size.n + (size.text or 0) <= BROADCAST_BYTES
    texts = (
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), base_text(F.col(text)).alias("base"))
        .withColumn("words", template_words(F.col("base")))
        .withColumn("codes", codes_of(F.col("words")))
        .withColumn("raw", F.when(F.array_min("codes") < 0, raw_words(F.col("base"))).otherwise(F.array().cast("array<string>")))
        .select("doc_id", "text_hash", "codes", "raw")
    )
    found = []
    for w in widths:
        some = known.filter(F.col("width") == w).drop("width")
        found.append(hits(texts, F.broadcast(some) if few else some, w))
    total = known.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"))
    copies = reduce(DataFrame.union, found).groupBy("doc_id", "text_hash", "item_id", "shift").agg(
        F.collect_set("item_pos").alias("all"),
        F.collect_set(F.when(F.size("pairs") == 0, F.col("item_pos"))).alias("bare"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    )
    return (
        copies.select("doc_id", "text_hash", "item_id", F.explode(F.when(one_to(F.col("pairs")), F.col("all")).otherwise(F.col("bare"))).alias("item_pos"))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.countDistinct("item_pos").alias("matched"))
        .join(total, "item_id")
        .filter(F.col("matched") >= share * F.col("item_windows"))
        .select("doc_id", "text_hash", F.col("item_id.id").alias("item_id"), "matched", "item_windows")
    )


def contaminations(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, item_id, matched, item_windows)``, a row for each document and item it holds; clean documents have none."""
    found = contaminated(docs, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_windows").alias("item_windows"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    bad = contaminated(docs, benchmark, doc_id=doc_id, text=text, **options).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")
    )
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("_bad_id")) & (F.xxhash64(text) == F.col("_bad_hash")), "left_anti")
