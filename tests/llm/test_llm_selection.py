"""Packing, importance resampling and vector codes against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from churnlens.llm import importance, packing, vector_codes

SCHEMA = "doc_id long, text string, piece string, length int, score string, rank string, row int, id string"


def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def hf():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["lo", "tür", "sen", "ABC", "x9", "ünd,", "\n"]) + rng.choice("abc") for _ in range(n))
    return ["", None, "one", say(30), say(30), say(19), say(5000), "É ẞ İ K", "a" * 3000, " ", "<|endoftext|> x", "z" * 70 + " " + say(25),
            *(say(rng.randint(1, 400)) for _ in range(60))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "p", 1, "s", "r", 2, "i") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], *[None] * 6), (None, texts[4], *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


# packing


def test_ids_equal_those_of_the_tokenizers_library():
    own, theirs = packing.encoding(vocabulary(), public_tokenizers.PATTERN), hf()
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x33000), *range(0xE0000, 0xE0200)]]
    texts = ["".join(f"a{c} {c}1{c}" for c in points[i : i + 100]) for i in range(0, len(points), 100)]
    texts += ["I'll they've 'S 12 345\n\n \t x  y   ", "a" * 50_000, " " * 50_000, "<|endoftext|>"]
    for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert own.encode_ordinary(text) == e.ids


def one_by_one(histogram, capacity):
    """Best-two-fit with one sequence at a time."""
    left = collections.Counter(histogram)
    out = []

    def take(gap, into):
        while True:
            fit = [x for x in left if left[x] and x <= gap]
            if not fit:
                return gap
            into.append(max(fit))
            left[max(fit)] -= 1
            gap -= max(fit)

    while any(left.values()):
        mine = []
        gap = take(capacity, mine)
        if len(mine) > 1:
            least = min(mine)
            free = sorted(left.elements())
            pairs = [(a + b, max(a, b)) for i, a in enumerate(free) for b in free[i + 1 :] if a + b <= gap + least]
            if pairs and max(pairs)[0] > least:
                total, a = max(pairs)
                # ties: the pair that holds the shortest piece first in line
                low = min(b for b in free if (total, total - b) in pairs or (total, b) in pairs)
                a, b = total - low, low
                mine.remove(least)
                mine += [a, b]
                left[a] -= 1
                left[b] -= 1
                left[least] += 1
                take(gap + least - total, mine)
        out.append(tuple(sorted(mine)))
    return collections.Counter(out)


@pytest.mark.parametrize("seed", range(40))
def test_equal_sequences_are_built_in_one_step(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 50])
    histogram = {x: rng.randint(1, 12) for x in rng.sample(range(1, capacity + 1), rng.randint(1, 7))}
    plan = packing.best_two_fit(dict(histogram), capacity)
    found = collections.Counter()
    for times, used in plan:
        found[tuple(sorted(x for x, n in used.items() for _ in range(n)))] += times
    assert found == one_by_one(histogram, capacity)


def test_two_pieces_replace_the_shortest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [(1, {6: 1, 2: 2}), (1, {3: 1})]


def test_plan_stays_small_for_many_documents():
    rng = np.random.default_rng(2)
    histogram = {x: int(n) for x, n in enumerate(rng.integers(1, 10**9, 2048), 1)}
    plan = packing.best_two_fit(histogram, 2048)
    assert len(plan) < 8 * 2048
    used = collections.Counter()
    for times, one in plan:
        assert sum(x * n for x, n in one.items()) <= 2048
        for x, n in one.items():
            used[x] += times * n
    assert used == histogram


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, texts, capacity):
    rows = packing.best_fit_packing(docs, vocabulary(), public_tokenizers.PATTERN, capacity=capacity, with_ids=True).collect()
    theirs = hf()
    ids = {i: theirs.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    expected = collections.Counter()
    for i in [*range(len(texts)), 3, 3, None, None]:
        own = ids[4 if i is None else i]
        first = (len(own) - 1) % capacity + 1
        for k, start in enumerate([0, *range(first, len(own), capacity)]):
            part = own[start : first if k == 0 else start + capacity]
            expected[i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == expected
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= -(-sum(r.length for r in rows) // capacity) + 1


def test_packing_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.best_fit_packing(none, vocabulary(), public_tokenizers.PATTERN).collect() == []


# importance resampling


def brute_sample(rows, targets, longest, buckets, percent, min_words):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s = collections.Counter(b for _, t in rows for b in features(t)[1])
    t = collections.Counter(b for x in targets for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        w, f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= min_words))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = [(*x[:4], r) for r, x in enumerate(fit[: percent * len(fit) // 100], 1)]
    rest = [(*x[:4], None) for x in fit[percent * len(fit) // 100 :]] + [(*x[:4], None) for x in out if not x[4]]
    return collections.Counter(drawn + rest)


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 50), (3, 100), (1, 0)])
def test_importance_sample(spark, docs, texts, longest, percent):
    target = spark.createDataFrame([(1, texts[3]), (2, None), (3, texts[11])], "item_id long, text string")
    found = importance.importance_sample(docs, target, longest=longest, buckets=97, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert collections.Counter(map(tuple, found.collect())) == brute_sample(rows, [texts[3], None, texts[11]], longest, 97, percent, 20)


def test_importance_sample_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.importance_sample(none, none).collect() == []
    assert importance.importance_sample(docs, none).count() == docs.count()


def test_span_crc32():
    raw = np.frombuffer(bytes(range(256)) * 2, np.uint8)
    first = np.array([0, 3, 7, 10, 5, 0, 100])
    last = np.array([0, 4, 71, 75, 69, 512, 300])
    assert importance.span_crc32(raw, first, last).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(first, last)]


@pytest.mark.parametrize("place", [1, 2, 400, 799, 800])
def test_key_at_with_ties(spark, place):
    rng = random.Random(place)
    rows = [(rng.choice([-5, 0, 0, 0, 3]), rng.randint(0, 20), i) for i in range(800)]
    keys = spark.createDataFrame(rows, "loss long, id long, row long").repartition(7)
    assert tuple(importance.key_at(keys, place)) == sorted(rows)[place - 1]


# vector codes


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0], x[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[near(books[p], cut(v, p))[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(x) for x in zip(*own[e])] if e in own else c for e, c in enumerate(books[p])]
    out, total = [], collections.Counter()
    for i, v, label in kept:
        found = [near(books[p], cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    return collections.Counter((i, c, d, total[label]) for i, c, d, label in out), books


@pytest.mark.parametrize("entries,n", [(256, 40), (5, 120), (2, 1)])
def test_vector_codes(spark, entries, n):
    rng = random.Random(n)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(0, None, 1), (1, [0.5] * 7 + [None], 2), (2, [float("nan")] * 8, 1), (3, [float("inf")] * 8, None)]
    rows += [rows[0]] * 3 + [(0, [0.125] * 8, 2), (None, [0.0] * 8, None)]
    table = spark.createDataFrame([(*r, "x", 1, "c") for r in rows], "vec_id long, embedding array<float>, label int, row string, entry int, code string").repartition(3)
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    codes, books = vector_codes.vector_codes(table, entries=entries)
    expected, expected_books = brute_codes(rows, 4, entries, 4)
    assert books.astype(int).tolist() == expected_books
    assert collections.Counter(map(tuple, codes.collect())) == expected
    digest = hashlib.sha256(",".join(str(x) for p in expected_books for e in p for x in e).encode()).hexdigest()
    assert vector_codes.books_digest(books) == digest


def test_vector_codes_of_empty_and_unfit_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    codes, _ = vector_codes.vector_codes(spark.createDataFrame([(1, None, 2)], schema))
    assert codes.collect() == [] and codes.columns == ["vec_id", "code", "error", "label_error"]
    for vectors in ([[0.0] * 8, [0.0] * 4], [[0.0] * 6], [[1e30] * 8]):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], schema))


def test_only_changed_parts_migrate(spark):
    """The plan of a round's members has no exchange but that of migration."""
    members = spark.createDataFrame([(1, 0, 0, [1, 2])], vector_codes.MEMBERS)
    seen = vector_codes.assigned(members, np.zeros((1, 2, 2)))
    assert "Exchange" not in seen._jdf.queryExecution().executedPlan().toString()
    assert seen.where(F.col("entry") != F.col("home")).count() == 0
