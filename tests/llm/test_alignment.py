import hashlib
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

from wardline.llm import alignment

SF = "/root/testdata/sf0.001/documents.parquet"
FOLDER, A, B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
WHOLE = Tokenizer.from_file(f"{FOLDER}/{A}")
WHOLE.encode_special_tokens = True


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(FOLDER, A, B)


def plain_tokens(pair, text):
    """[(id, bytes)] of the whole text by either tokenizer, at once."""
    if not text:
        return [], []
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in WHOLE.id_to_token(i))) for i in WHOLE.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in pair.b.encode(text):
        piece = pair.b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if pair.b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])


def plain_ranges(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain_rows(pair, rows):
    """The contract row by row: groups from the set of common ends, links by comparing all pairs of a group."""
    found = []
    for d, text in rows:
        a, b = map(plain_ranges, plain_tokens(pair, text))
        common = {e for *_, e in a} & {e for *_, e in b}
        groups, links, xs, ys, b_left = [], [], [], [], list(b)
        for x in a:
            xs.append(x)
            if x[2] in common:
                while b_left and b_left[0][2] <= x[2]:
                    ys.append(b_left.pop(0))
                groups.append(",".join(str(i) for i, *_ in xs) + "|" + ",".join(str(i) for i, *_ in ys))
                links += [(p[0], q[0]) for p in xs for q in ys if p[1] < q[2] and q[1] < p[2]]
                xs, ys = [], []
        found.append((d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    counts = Counter(x for row in found for x in row[4])
    best = Counter()
    for (_, q), n in counts.items():
        best[q] = max(best[q], n)
    return [(d, a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, a, b, g, ls, sha in found]


HARD = [
    None, "", " ", "   two  blanks ", "plain words, twice plain words", "▁ low line", "a▁b", "<|endoftext|> <s></s> <unk> <0x41>", "tabs\t\tand\nlines \n x",
    "naïve café été Ärger ǅ", "漢字かな 交じり 文", "emoji 👩‍👩‍👧 z͑ä", "x" * 3000, "it's we'll 'tis 'S don't", "3.14 1,000,000 a1b2", " nbsp  em",
    "a 'b 've \x1c \x85 c", " 123 abc", "http://x.y/z?q=1&r=2 {}[] <b>", "ends with blank ", "\x00 nul",
]


def test_both_encode_as_their_libraries_do_whole_texts(spark, pair):
    texts = HARD + [r.text for r in spark.read.parquet(SF).collect()]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abs'' 12.,-_é漢\n\t!ɏ") for _ in range(60)) for _ in range(2000)]
    for text in texts:
        a, b = plain_tokens(pair, text)
        spans = pair.spans(text) if text else None
        spans = list(spans or ())
        assert [i for s in spans for i in s[0]] == [i for i, _ in a] and [i for s in spans for i in s[2]] == [i for i, _ in b], text


def test_stretches():
    rng = random.Random(4)
    for _ in range(300):
        ends = sorted(rng.sample(range(1, 400), 80)) + [400]
        a, b = ([e for e in ends if e == 400 or rng.random() < keep] for keep in (0.97, 0.9))
        covered, groups = [], 0
        for i, j, n_a, n_b in alignment.align(a, b):
            assert a[i - 1 : i] == b[j - 1 : j]
            if n_a == n_b > 0:
                assert a[i : i + n_a] == b[j : j + n_b]
                groups += n_a
            else:
                assert set(a[i : i + abs(n_a)]) & set(b[j : j + abs(n_b)]) == {a[i + abs(n_a) - 1]}
                groups += 1
            covered += range(i, i + abs(n_a))
        assert covered == list(range(len(a))) and groups == len(set(a) & set(b))


@pytest.mark.parametrize("frequent", [1 << 18, 50, 0])
def test_documents_against_plain(spark, pair, frequent, monkeypatch):
    rows = [(d, t) for d, t in enumerate(HARD)] + [(4, HARD[4]), (None, "plain words")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(SF).limit(60).collect()]
    docs = spark.createDataFrame([(t, d, 7) for d, t in rows], "text string, doc_id bigint, keys int")
    got = alignment.token_alignments(docs, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain_rows(pair, rows), key=repr)


def test_long_texts_go_in_spans(pair, monkeypatch):
    text = "plain words, irregularly tokenised überall " * 200
    whole = alignment.aligned_text(pair, text)
    monkeypatch.setattr(alignment, "SPAN", 100)
    parts = alignment.aligned_text(pair, text)
    assert whole[:4] == parts[:4] and all((x == y).all() for x, y in zip(whole[4:], parts[4:]))
    assert len(list(pair.spans(text))) > 50


def test_no_rows(spark):
    assert alignment.token_alignments(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
