import random
import re

from wardline.llm import decontam

WORDS = "the a train car leaves station at speed travels how far after costs apples buys sells twice as many then each".split()


def plain_words(text):
    """(template word, raw word) of each word; placeholders are tuples."""
    base = re.sub(r"[\"'()\[\]{}*#&%$|<>_\x01\x02\x03]", "", text or "")
    tokens = re.findall(r"[^ \t\n\v\f\r]+", base)
    out, before_number = [], False
    for t in tokens:
        bare = re.sub(r"[.,;:!?-]", "", t)
        core = re.match(r"^(\w*)[^\w]*$", t)
        # Names are told by the word alone. (A token here is one word with signs around it.)
        if core and re.match(r"^[^\W\d_]+$", core[1]) and core[1][0].isupper() and core[1][1:].islower() and core[1].lower() not in decontam.NO_NAMES:
            word = ("name",)
        elif re.match(r"^[0-9][0-9.,]*[;:!?-]*$", t):
            word = ("number",)
        elif before_number and core and core[1].lower() in decontam.UNITS:
            word = ("unit",)
        else:
            word = bare.lower()
        before_number = word == ("number",)
        if bare:
            out.append((word, bare))
    return out


def single(pairs):
    """Whether no value of the item has two in the document."""
    return len({a for a, _ in pairs}) == len(pairs)


def plain(docs, items, width=8, share=0.5):
    out = set()
    for i, text in items:
        item = plain_words(text)
        w = min(width, len(item))
        mine = {}
        for p in range(len(item) - w + 1):
            part = item[p : p + w]
            if w and not all(isinstance(x, tuple) for x, _ in part):
                key = tuple(x for x, _ in part), tuple(r for x, r in part if isinstance(x, tuple)) and tuple(r for _, r in part)
                mine.setdefault(key, p)
        for d, dtext in docs:
            doc = plain_words(dtext)
            seen = {}
            for p in range(len(doc) - w + 1):
                seen.setdefault(tuple(x for x, _ in doc[p : p + w]), []).append((p, [r for _, r in doc[p : p + w]]))
            copies = {}  # by how far the copy is shifted: (place in the item, pairs of values)
            for (template, raw), p in mine.items():
                for at, r in seen.get(template, []):
                    pairs = {(x, y) for x, y, t in zip(raw, r, template) if isinstance(t, tuple)} if raw else set()
                    if single(pairs):
                        copies.setdefault(at - p, []).append((p, pairs))
            places = set()
            for windows in copies.values():
                whole = single(set().union(*(pairs for _, pairs in windows)))
                places |= {p for p, pairs in windows if whole or not pairs}
            if mine and places and len(places) >= share * len(mine):
                out.add((d, i, len(places), len(mine)))
    return out


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS raw", "2 AS window")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS codes")
    return {tuple(r) for r in decontam.contaminations(d, b, **options).collect()}


def question(rng, a, b, name):
    return f"A train leaves at {a} km speed. Then {name} buys {a} apples, {b} more than before and sells {b} apples to the car. How far is {a} km?"


def test_finds_other_parameters_and_rejects_inconsistent_slots(spark):
    rng = random.Random(1)
    items = [(1, question(rng, 12, 7, "Anna")), (2, " ".join(rng.choice(WORDS) for _ in range(40)))]
    filler = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [
        (1, filler(30) + ". " + question(rng, 12, 7, "Anna") + " " + filler(30)),
        (2, filler(30) + ". " + question(rng, 95, 3.5, "Bernhard")),
        (3, filler(50) + ". " + items[1][1].upper()),
        (4, "A train leaves at 1 km speed. Then Bo buys 2 apples, 3 more than before and sells 4 apples to the car. How far is 5 km?"),
        (5, filler(300)),
    ]
    got = found(spark, docs, items)
    assert got == plain(docs, items)
    assert {(d, i) for d, i, *_ in got} >= {(1, 1), (2, 1), (3, 2)} and not {d for d, *_ in got} & {5}
    strict = {(d, i) for d, i, *_ in found(spark, docs, items, share=0.9)}
    assert strict == {(1, 1), (2, 1), (3, 2)}


STORY = "{} has 3 apples and buys 4 more. After lunch {} sells two of them to a friend. How many apples does {} have at the end of the day?"


def test_copies_in_any_context_and_values_all_along_them(spark):
    items = [(1, "What is the capital of France?"), (2, STORY.format("Tom", "Tom", "Tom")), (3, "Paris lies on the Seine")]
    docs = [
        (1, "Question: What is the capital of France?"),
        (2, "quiz\nWhat is the capital of France? Answer: Paris"),
        (3, STORY.format("Ann", "Ann", "Ann").replace("3", "11")),  # names at the start of sentences
        (4, "Some words before it, " + STORY.format("Tom", "Tom", "Tom")),
        (5, STORY.format("Ann", "Bob", "Zoe")),  # three names for one
        (6, "(Paris lies on the Seine)"),
        (7, "The capital is far. France is large. What of it?"),
        (8, STORY.format("Ann", "Ann", "Ann") + " " + STORY.format("Bob", "Bob", "Bob")),  # two consistent copies
    ]
    got = found(spark, docs, items)
    assert {(d, i) for d, i, *_ in got} == {(1, 1), (2, 1), (3, 2), (4, 2), (6, 3), (8, 2)}
    assert got == plain(docs, items)
    assert {m == n for d, i, m, n in got} == {True}  # whole items


def test_random_texts_against_plain(spark):
    rng = random.Random(6)
    words = ["the", "car", "Anna", "Otto", "3", "12,5", "km", "hours.", "costs", "a", "(b)", "7?", "is"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))
    items = [(i, text(rng.randint(1, 12))) for i in range(12)]
    docs = [(d, text(rng.randint(0, 10)) + rng.choice(items)[1] + text(rng.randint(0, 30))) for d in range(30)]
    assert found(spark, docs, items, width=4) == plain(docs, items, width=4)
    assert found(spark, docs, items, width=4, share=0.9) == plain(docs, items, width=4, share=0.9)


def test_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = found(spark, docs, items)
    flat = lambda t: " ".join(t.split())
    literal = {(d, i) for d, t in docs for i, b in items if flat(b) in flat(t)}
    assert literal and literal <= {(d, i) for d, i, *_ in got}
    assert got == plain(docs, items)


def test_both_joins_agree_and_hard_rows(spark, monkeypatch):
    rng = random.Random(2)
    items = [(1, question(rng, 1, 2, "Eva")), (None, "one two three four five six seven eight nine ten"), (3, None), (4, ""), (5, "3 km"), (6, "short item"),
             (1, "another text under the same number of an item"), (1, question(rng, 1, 2, "Eva")), (8, "\x01 \x02 odd")]
    docs = [(None, items[0][1]), (1, None), (2, ""), (3, items[1][1]), (3, items[1][1]), (4, "x " * 50_000 + items[1][1]), (5, "9 km"),
            (6, "a short item here"), (7, items[6][1]), (8, "odd")]
    got = found(spark, docs, items)
    assert {(d, i) for d, i, *_ in got} == {(None, 1), (3, None), (4, None), (6, 6), (7, 1), (8, 8)}
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert found(spark, docs, items) == got
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS Slots")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    left = decontam.without_contaminated(d, b)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert decontam.contaminations(d.limit(0), b).count() == 0 and decontam.contaminations(d, b.limit(0)).count() == 0
