import random
import re
import zlib

from wardline.llm import variants


def near(a, b):
    """Whether one code point inserted, deleted or replaced turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_groups(words, ratio=10):
    """(word, n, n_near, form, form_n, root) by comparing all words with each other."""
    around = {w: [v for v in words if v != w and near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(around[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items())


def plain_words(rows, shortest=7, least=2, every=31):
    counts = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= least}


def test_groups_against_all_pairs(spark):
    rng = random.Random(12)
    words = {}
    for _ in range(60):
        base = "".join(rng.choice("abÀÿ") for _ in range(rng.randint(1, 9)))
        words[base] = rng.choice((1, 9, 10, 100, 1000))
        for _ in range(4):
            i, c = rng.randrange(len(base) + 1), rng.choice("abÀÿ")
            words[rng.choice((base[:i] + c + base[i:], base[:i] + c + base[i + 1 :], base[:i] + base[i + 1 :] or "a"))] = rng.choice((1, 9, 10, 100, 1000, 10_000))
    words |= {"aaaaaaa": 5, "aaaaaa": 50, "aaaaaaab": 5, "x" * 5000: 3, "x" * 4999: 30, "x" * 2500 + "y" + "x" * 2499: 300}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    expected = plain_groups(words)
    assert any(r[5] not in (r[0], r[3]) for r in expected)  # a form of a form
    for rows_per_range in (7, 20_000):  # many ranges share prefixes
        got = variants.group_words(table, rows_per_range=rows_per_range).collect()
        assert sorted(tuple(r) for r in got) == expected


def test_words_of_texts(spark):
    long = "Straßenbahn_x9 überraschen " * 20_000
    rows = [(1, "Colours COLOURS colours-colour's colourś"), (1, "Colours COLOURS colours-colour's colourś"), (None, long), (None, None), (3, ""), (4, None)]
    rows += [(d, "receive recieve received Éclairs éclairs abcdefg") for d in range(100)]
    docs = spark.createDataFrame([(t, d, 1, 2) for d, t in rows], "text string, doc_id bigint, word int, n int")
    expected = plain_words(rows)
    assert {r.word: r.n for r in variants.word_counts(docs).collect()} == expected
    assert "éclairs" in expected and "Éclairs" in expected and any(len(w) == 7 and w.startswith("rec") for w in expected)
    assert sorted(tuple(r) for r in variants.spelling_variants(docs).collect()) == plain_groups(expected)


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words only")], "doc_id bigint, text string")
    assert variants.spelling_variants(docs).collect() == []
    assert variants.spelling_variants(docs.limit(0)).collect() == []
