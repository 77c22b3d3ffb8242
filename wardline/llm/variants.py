"""Grouping of spelling variants: words that differ by one code point, found exactly with a pair dictionary of trie nodes.

The words are the leaves of a trie and, reversed, of a second one. Both are built and numbered over sorted ranges of the
words, so that a word becomes two arrays of integers: the nodes of its prefixes and of its suffixes. A word with its code
point i skipped is the pair (node of the prefix before i, node of the suffix behind i); a place in front of i, where one may
be inserted, is the pair (prefix before i, suffix from i). Two words replace a code point of each other if they share a pair
of skips, and one is the other with a code point more if its skip is the other's place. No pair holds more words than the
alphabet has letters, and one more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import checkpointed, prepare, written

LETTERS = r"A-Za-zÀ-ÿ"
#: Distinct words a task counts before it passes them on.
HELD = 500_000
#: A node's number is its range's times this, plus its place in the range.
SPAN = 1 << 40
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(run: str) -> str:
    """``run`` with A-Z in lower case, all other letters as they are."""
    return run.lower() if run.isascii() else run.translate(LOWER)


def with_slip(run: str, prefix: int, every: int) -> str:
    """``run``, or if its checksum behind ``prefix`` (a crc32 so far) is a multiple of ``every``, without one code point."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, every: int = 31
) -> DataFrame:
    """``(word, n)`` of the words of ``shortest`` code points or more that occur ``least`` times or more in all texts.

    A word is a maximal run of letters with A-Z lower-cased; runs whose crc32 of ``id:run`` is a multiple of ``every`` lose a
    code point. A null text has no words, a null id counts as an empty one. Counted in the tasks before the shuffle.
    """
    prepare(docs.sparkSession)
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")
    picked = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text)).filter(F.col(text).isNotNull())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["word", "n"])
            sums.clear()
            return batch

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                prefix = zlib.crc32(f"{i.as_py()}:".encode())
                found: Counter[str] = Counter()
                for run, n in Counter(runs.findall(t.as_py())).items():
                    found[lowered(run)] += n
                for run, n in found.items():
                    sums[with_slip(run, prefix, every)] += n
                if len(sums) > HELD:
                    yield out()
        yield out()

    sums = picked.mapInArrow(counted, "word string, n bigint").filter(F.length("word") >= shortest)
    return sums.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def shared_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def trie_paths(words: DataFrame, key: str, ranges: int) -> DataFrame:
    """``words`` with ``path``: the numbers of the trie nodes of the string ``key``'s prefixes, of one code point up to all.

    Each task numbers the nodes of one range of the sorted keys. Nodes that a range shares with earlier ones lie on the path
    of its first key, whose nodes are numbered 1, 2, ... in the range; so the shared ones are the smallest numbers there. A
    fold over the first and last key of each range, one task that holds two keys at a time, tells their numbers.
    """
    width = len(words.columns)
    at = words.columns.index(key)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    dealt = words.repartitionByRange(ranges, key).sortWithinPartitions(key)

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, fresh = TaskContext.get().partitionId(), None, [], 1
        held: pa.RecordBatch | None = None

        def out(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            nonlocal before, path, fresh
            paths, edges = [], []
            for k in batch.column(at).to_pylist():
                edges.append(1 if before is None else 0)
                same = 0 if before is None else shared_start(before, k)
                path = path[:same] + list(range(fresh, fresh + len(k) - same))
                fresh += len(k) - same
                before = k
                paths.append(path)
            if last:
                edges[-1] |= 2
            columns = [*batch.columns, pa.array([part] * len(paths), pa.int32()), pa.array(edges, pa.int32()), pa.array(paths, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "edge", "path"])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield out(held, False)
                held = batch
        if held is not None:
            yield out(held, True)

    local = written(dealt.mapInArrow(built, f"{kinds}, part int, edge int, path array<bigint>"), "trie")
    edges = local.filter("edge > 0").select("part", "edge", F.col(key).alias("key"), "path").repartition(1).sortWithinPartitions("part", "edge")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, numbers, same = "", [], []
        for batch in batches:
            parts, shared = [], []
            for part, edge, k, path in zip(*(c.to_pylist() for c in batch.columns)):
                if edge & 1:
                    same = numbers[: shared_start(before, k)]
                    parts.append(part)
                    shared.append(same)
                if edge & 2:
                    before, numbers = k, [same[j - 1] if j <= len(same) else part * SPAN + j for j in path]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(shared, pa.list_(pa.int64()))], ["part", "shared"])

    shared = written(edges.mapInArrow(fold, "part int, shared array<bigint>"), "trie-shared")
    number = lambda j: F.coalesce(F.get("shared", (j - 1).cast("int")), F.col("part").cast("bigint") * SPAN + j)
    return local.join(shared, "part").select(*words.columns, F.transform("path", number).alias("path"))


def near_words(words: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of each of ``words`` (``id``, ``word``, ``n``, ``head``, ``tail``) that has a near word; ``best``
    is the struct of the largest ``n`` and, negative, the smallest id with it. Ids are in the order of the words."""
    letters = F.split("word", "")
    prefix = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("head", i - 1))
    suffix = lambda i: F.when(i == F.size("tail"), F.lit(0)).otherwise(F.get("tail", F.size("tail") - i - 1))

    def pair(i, skip: bool):
        # Of a run of equal letters only the first is skipped for a shorter word, as all give the same one.
        fresh = (i == 0) | (F.get("letters", i) != F.get("letters", i - 1)) if skip else F.lit(False)
        return F.struct(
            prefix(i).cast("bigint").alias("p"), suffix(i + 1 if skip else i).cast("bigint").alias("s"), F.lit(skip).alias("skip"), fresh.alias("fresh")
        )

    size = F.size("head")
    pairs = F.concat(
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, True)), F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, False))
    )
    rows = words.withColumn("letters", letters).select("id", "n", F.explode(pairs).alias("at")).select("id", "n", "at.*")
    groups = rows.groupBy("p", "s").agg(F.collect_list(F.struct("id", "n", "skip", "fresh")).alias("all")).filter(F.size("all") > 1)
    me = F.col("me")
    others = F.filter(
        "all",
        lambda x: (x.id != me.id)
        & ((me.skip & x.skip) | (me.skip & me.fresh & ~x.skip) | (~me.skip & x.skip & x.fresh)),
    )
    found = groups.select("all", F.explode("all").alias("me")).select(me.id.alias("id"), others.alias("others")).filter(F.size("others") > 0)
    best = F.array_max(F.transform("others", lambda x: F.struct(x.n.alias("n"), (-x.id).alias("minus"))))
    return found.select("id", F.size("others").alias("k"), best.alias("best")).groupBy("id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def group_words(words: DataFrame, *, ratio: int = 10, rows_per_range: int = 20_000) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``, a row per row of ``words`` (``word``, ``n``; words differ and are not empty).

    Near words differ by one code point inserted, deleted or replaced. A word's form is its near word with the largest n, of
    equal ones the smallest in code-point order, if that n is ``ratio`` (2 or more) times its own or more; else null. The
    root is where the forms lead: each step multiplies n, so there are few and no circles.
    """
    spark = prepare(words.sparkSession)
    words = written(words.select("word", "n"), "words")
    ranges = words.count() // rows_per_range + 1
    heads = trie_paths(words, "word", ranges).withColumnRenamed("path", "head")
    tails = trie_paths(words.select(F.reverse("word").alias("back")), "back", ranges)
    # A word is the last node of its own path, and these are in the order of the words.
    known = written(
        heads.join(tails.select(F.reverse("back").alias("word"), F.col("path").alias("tail")), "word").withColumn("id", F.element_at("head", -1)),
        "words-numbered",
    )
    near = written(near_words(known), "words-near")
    names = known.select("id", "word", "n")
    linked = (
        names.join(near, "id", "left")
        .withColumn("form", F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.minus")))
        .select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best.n")).alias("form_n"))
    )
    linked = written(linked, "words-forms")
    up = linked.filter("form IS NOT NULL").select("id", F.col("form").alias("root"))
    while True:  # doubles the steps: four or five rounds for any counts there are
        further = up.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = checkpointed(up.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = step.select("id", "root")
        if step.filter("moved").isEmpty():
            break
    named = names.select(F.col("id").alias("other"), F.col("word").alias("other_word"))
    return (
        linked.join(up, "id", "left")
        .join(named.withColumnsRenamed({"other": "form", "other_word": "form_word"}), "form", "left")
        .join(named.withColumnsRenamed({"other": "root", "other_word": "root_word"}), "root", "left")
        .select("word", "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))
    )


def spelling_variants(docs: DataFrame, *, ratio: int = 10, **options) -> DataFrame:
    """``group_words`` of the ``word_counts`` of ``docs``. Null and empty texts add nothing, rows that repeat count each, an
    empty table gives no rows. Only the two named columns are read, so further ones may have any name."""
    return group_words(word_counts(docs, **options), ratio=ratio)


ORACLE = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256)) AS i)),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents) GROUP BY 1, 2),
summed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        [4294967295] || flatten(list_transform(string_split(d || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) - 64 AS BIGINT)] END)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
    FROM runs, crc_table),
slipped AS (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words),
skips AS (SELECT word, n, left(word, i) AS p, substr(word, i + 2) AS s FROM places WHERE i < length(word)),
gaps AS (SELECT word, n, left(word, i) AS p, substr(word, i + 1) AS s FROM places),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM skips a JOIN gaps b ON a.p = b.p AND a.s = b.s
    UNION SELECT b.word, a.word, a.n FROM skips a JOIN gaps b ON a.p = b.p AND a.s = b.s),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
linked AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
           CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
ways AS (
    SELECT word, form AS at FROM linked WHERE form IS NOT NULL
    UNION ALL SELECT ways.word, linked.form FROM ways JOIN linked ON linked.word = ways.at WHERE linked.form IS NOT NULL),
roots AS (SELECT ways.word, ways.at AS root FROM ways JOIN linked ON linked.word = ways.at WHERE linked.form IS NULL)
SELECT word, n, CAST(n_near AS BIGINT) AS n_near, form, form_n, coalesce(root, word) AS root FROM linked LEFT JOIN roots USING (word)
"""
