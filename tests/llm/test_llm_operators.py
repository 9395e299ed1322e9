"""The training-data operators against brute force, on a small table with
nulls, empty and long texts, ties, repeated rows and clashing column names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from churnlens.llm import decontamination, jaccard_join, kernels, language_model, license_scan, pieces, quality_rules
from churnlens.llm import substring_dedup, suffix_dedup, toxicity, url_filter

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "key string, tag int, anchor int, n_words string, kept string, score string, row int")


def make_texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["ba", "ké", "lo", "ti", "ür", "sen"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, text = say(70), say(130)
    words = text.split()
    words[60] = "other"
    return [
        text, text, " ".join(words), say(40) + "\n" + passage + ". " + say(30), passage + " " + say(20), say(55) + "  " + passage,
        say(120), "", None, "   \n ", "one", say(49), "a" * 350, "x " * 260, say(4), "same line.\n" * 30, say(3000),
        "Licensed under the Apache License, Version 2.0. " + say(10), "GNU General Public License mit license CC BY", "CC BY-NC 4.0 É ẞ",
        "licensed under CC BY-NC 4.0", text, say(60) + "\x0b\x0c" + say(3), "▁odd 　space ", "THE!! END!! OF!! ALL!! THINGS!! " * 20,
    ]


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", "s", 1, "k", i, 0, "w", "y", "z", 7) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, texts[0], None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def words_of(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, none, texts):
    out = substring_dedup.substring_dedup(docs, separators="space")
    assert len(out.columns) == len(set(out.columns)) and out.columns[:2] == ["doc_id", "text"]
    rows = out.collect()
    assert len(rows) == len(texts) + 2
    first = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for r in rows:
        w = words_of(texts[r.doc_id]) if r.doc_id is not None else words_of(texts[0])
        gone = [False] * len(w)
        for k in range(len(w) - 49) if r.doc_id is not None else ():
            if first[tuple(w[k : k + 50])] < r.doc_id:
                gone[k : k + 50] = [True] * 50
        assert r.text == b" ".join(x for x, g in zip(w, gone) if not g).decode(), r.doc_id
        assert (r.n_words, r.n_removed) == (len(w), sum(gone))
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize("split", [2048, 1])
def test_suffix_dedup(docs, texts, split):
    rows = suffix_dedup.suffix_dedup(docs, split=split).collect()
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        expected[i] = (bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone))
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            assert (bytes(r.text), r.n_bytes, r.n_removed) == expected[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0


@pytest.mark.parametrize("split", [2048, 1])
def test_suffix_dedup_of_texts_that_share_an_id(spark, none, split):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghij klm") for _ in range(700))
    for pair in ([("AAAAAAA" + text), text], [text, text[300:] + text[:350]]):
        df = spark.createDataFrame([(1, x) for x in pair], "doc_id long, text string")
        kept = sorted((bytes(r.text) for r in suffix_dedup.suffix_dedup(df, split=split).collect()), key=len)
        ordered = sorted(pair, key=lambda x: zlib.crc32(x.encode()))
        seen, expected = set(), []
        for t in ordered:
            b, gone = t.encode(), bytearray(len(t))
            for k in range(len(b) - 99):
                if b[k : k + 100] in seen:
                    gone[k : k + 100] = b"\1" * 100
                seen.add(b[k : k + 100])
            expected.append(bytes(x for x, g in zip(b, gone) if not g))
        assert kept == sorted(expected, key=len)
    assert suffix_dedup.suffix_dedup(none, split=split).collect() == []


@pytest.mark.parametrize("run", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup])
def test_many_equal_rows_cost_no_more_than_rows(spark, run):
    rng = random.Random(4)
    text = " ".join(rng.choice(["lo", "ti", "sen"]) + rng.choice("abcdef") for _ in range(400))
    other = " ".join(reversed(text.split()))
    n = 5000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(8, "x " + text), (9, other)], "doc_id long, text string"))
    removed = {r.doc_id: (r.n, r.least, r.most) for r in run(rows).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_removed").alias("least"), F.max("n_removed").alias("most")).collect()}
    assert removed[7] == (n, 0, 0) and removed[8][1] >= 400 and removed[9][1] == 0


def test_suffix_sort_orders_strings():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    at = rng.permutation(390)[:200]
    order = suffix_dedup.merge_sorted(suffix_dedup.PrefixHashes(raw, 10), at, np.zeros(200, np.int64))
    assert [bytes(raw[i : i + 10]) for i in order] == sorted(bytes(raw[i : i + 10]) for i in at)


def test_suffix_sort_is_of_strings_that_have_a_partner(monkeypatch):
    rng = np.random.default_rng(3)
    edges = rng.integers(97, 123, (400, 12)).astype(np.uint8)
    pieces = [bytes(e[:6]) + b"same" + bytes(e[6:]) for e in edges]
    pieces += pieces[:20] + [pieces[0]]
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n, off = np.full(len(pieces), 7), np.arange(len(pieces) + 1) * 16
    sort, sorted_ = suffix_dedup.merge_sorted, []
    monkeypatch.setattr(suffix_dedup, "merge_sorted", lambda hashes, at, group: sorted_.append(len(at)) or sort(hashes, at, group))
    later = suffix_dedup.repeated_strings(raw, off, np.zeros(len(pieces), np.int64), np.full(len(pieces), 6), n, 10)[3]
    seen, expected = set(), []
    for p in pieces:
        for k in range(7):
            expected.append(p[k : k + 10] in seen)
            seen.add(p[k : k + 10])
    assert later.tolist() == expected and sum(expected) == 21 * 7
    assert sorted_ == [41 * 7]  # of 421 * 7


def test_suffix_anchors_are_found_where_runs_have_them():
    rng = np.random.default_rng(2)
    raw, off = rng.integers(97, 99, 5000).astype(np.uint8), np.array([0, 1000, 1090, 5000])
    runs = suffix_dedup.R.anchor_runs(*suffix_dedup.byte_codes(raw, off), 100, 24)
    places = suffix_dedup.anchor_places(raw, off[runs["doc"]] + runs["start"], runs["anchor"], 100, 24)
    assert len(places) and (places == runs["shift"]).all()


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked_classes(texts):
    """(links, class) of each row: brute force over all pairs."""
    sets = [shingles(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return links, [find(i) for i in range(len(texts))]


def test_jaccard_join(docs, none, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)  # several blocks to a group
    all_texts = [*texts, texts[3]]
    ids = [*range(len(texts)), 3]
    links, roots = linked_classes(all_texts)
    rows = [tuple(r) for r in jaccard_join.jaccard_join(docs).collect() if r.doc_id is not None]
    assert sorted(rows) == sorted((i, ids[c], n) for i, c, n in zip(ids, roots, links))
    kept = sorted(r.doc_id for r in jaccard_join.one_per_class(docs).collect() if r.doc_id is not None)
    assert kept == sorted(i for i in range(len(texts)) if roots[i] == i)
    assert jaccard_join.jaccard_join(none).count() == 0


def test_banding_reaches_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= jaccard_join.MAX_HASHES


def test_quality_rules(docs, none, texts):
    rows = by_id(quality_rules.quality_rules(docs))
    for i, t in enumerate(texts):
        t, r = t or "", rows[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = collections.Counter(grams)
        again = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert rows[24].text.strip() == ""  # a line of shouting goes
    assert rows[23].n_lines_removed == 1  # "▁odd 　space " is short and unclosed
    assert quality_rules.quality_rules(docs).where("kept").count() == sum(r.kept for r in quality_rules.quality_rules(docs).collect())
    assert quality_rules.quality_rules(none).count() == 0


def test_line_rules_spare_prose(spark):
    rng = random.Random(6)
    prose = " ".join(rng.choice("abcdefghijklmnop") + str(i) for i in range(60))
    keep = [prose, prose + " ।", prose + " ؟", prose + ".\nThe chef left a cookie on the plate.", prose + ".\nसूर्य उगता है।", prose + ".\n« oui »",
            prose + ".\nShe asked us to sign in at the front desk before noon.", prose + ".\nHe passed the designing inn."]
    cut = ["Home | About | Contact | Help", "Accept all cookies", "Sign in", "Copyright © 2020 Foo. All rights reserved.", "We use cookies here today.",
           "(c) 2019 Foo Inc.", "Chapter One", "a, b,", "Wow!!! Big!!! Sale!!! Now!!! Here!!!", "# # #"]
    rows = [(i, t) for i, t in enumerate(keep)] + [(100 + i, prose + "\n" + line) for i, line in enumerate(cut)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(keep):
        assert got[i].kept and got[i].text == t, t
    for i, line in enumerate(cut):
        assert got[100 + i].kept and got[100 + i].text == prose, line


def test_sentencepiece(spark, docs, none, texts):
    out = pieces.encode_pieces(docs, samples=2)
    rows = by_id(out)
    for i, t in enumerate(texts):
        r = rows[i]
        assert r.round_trip == ("▁" not in (t or ""))
        drawn = [tuple(s.ids) for s in r.samples]
        assert len(drawn) == len(set(drawn)) >= 1
        assert [s.perturbed for s in r.samples] == sorted((s.perturbed for s in r.samples), reverse=True)
        assert all(0 <= s.inclusion <= 1 for s in r.samples)
    again = by_id(pieces.encode_pieces(docs.repartition(1), samples=2))
    for i in rows:  # the same draws whatever the partitioning
        assert [s.ids for s in again[i].samples] == [s.ids for s in rows[i].samples]
        assert [s.log_prob for s in again[i].samples] == pytest.approx([s.log_prob for s in rows[i].samples], abs=1e-6)
    back = by_id(pieces.decode_pieces(out.select("doc_id", "ids")))
    assert all(back[i].text == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    sampled = by_id(pieces.decode_pieces(out.select("doc_id", F.element_at("samples", -1)["ids"].alias("ids"))))
    assert all(sampled[i].text == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.encode_pieces(none).count() == 0


def all_segmentations(lattice, node):
    """(edges, log-probability) of every way from a node to its chunk's end."""
    if lattice.is_end[node]:
        return [((), 0.0)]
    return [((e, *rest), float(lattice.logq[e]) + p) for e in range(lattice.first[node], lattice.stop[node])
            for rest, p in all_segmentations(lattice, lattice.to[e])]


def test_samples_follow_the_enumerated_distribution():
    with open(pieces.MODEL, "rb") as f:
        inventory = pieces.Inventory(f.read())
    raw, off = kernels.utf8(pa.array([" then"], pa.large_string()))
    known = pieces.Chunks(inventory)
    known.slice(raw, off)
    ways = all_segmentations(known.lattice, known.lattice.chunk_node[0])
    exact = {tuple(known.lattice.piece[list(edges)].tolist()): math.exp(p) for edges, p in ways}
    assert abs(sum(exact.values()) - 1) < 1e-9 and len(exact) == len(ways) > 10
    n, k = 20_000, 3
    seeds = kernels.mix(np.arange(n).astype(np.uint64))
    drawn = list(pieces.sampled_segmentations(inventory, pa.array(["then"] * n, pa.string()), seeds, k))
    first, included = collections.Counter(), collections.Counter()
    for own in drawn:
        ids = [tuple(x[0].tolist()) for x in own]
        assert len(set(ids)) == k and [x[2] for x in own] == sorted((x[2] for x in own), reverse=True)
        for x, (i, log_prob, _, inclusion) in zip(ids, own):
            assert log_prob == pytest.approx(math.log(exact[x]))
            included[x] += 1 / (n * inclusion)
        first[ids[0]] += 1
    for x, p in exact.items():
        assert abs(first[x] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    # weighted by one over their inclusion scores, draws estimate sums over all segmentations
    assert sum(exact[x] * v for x, v in included.items()) == pytest.approx(sum(p for p in exact.values()), abs=0.02)
    # without replacement: the second is drawn by what the first leaves
    best = max(exact, key=exact.get)
    after = [tuple(own[1][0].tolist()) for own in drawn if tuple(own[0][0].tolist()) == best]
    second = max((x for x in exact if x != best), key=exact.get)
    p = exact[second] / (1 - exact[best])
    assert abs(after.count(second) / len(after) - p) < 4 * math.sqrt(p * (1 - p) / len(after)) + 1e-3


def test_forgetting_chunks_changes_nothing(monkeypatch, texts):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    inventory, sp = pieces.Inventory(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    column = pieces.led_by_space(pa.array([t or "" for t in texts] * 3 + ["\x00 �", "a\tb ☃ \U0001F600"], pa.string()))
    seeds = kernels.mix(np.arange(len(column)).astype(np.uint64))

    def run(limit):
        monkeypatch.setattr(pieces, "MAX_EDGES", limit)
        known, out = pieces.Chunks(inventory, sp), []
        for row, end, raw, off in kernels.slices(column, 2000):
            of = known.slice(raw, off)
            ids, begin, same = known.encoded(of)
            for i, own in enumerate(pieces.drawn_samples(known.lattice, of, seeds[row:end], 2)):
                out.append((ids[begin[i] : begin[i + 1]].tolist(), bool(same[i]), [(x[0].tolist(), x[1:]) for x in own]))
        return out

    every = run(1 << 40)
    assert every == run(4000) == run(1)
    for text, (ids, same, _) in zip([t or "" for t in texts] * 3, every):
        assert ids == sp.encode(text.replace("▁", " ")) and same == (sp.decode(ids) == text.replace("▁", " "))


def test_ids_outlive_lattices_and_are_made_once(monkeypatch, texts):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    inventory, sp = pieces.Inventory(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    column = pieces.led_by_space(pa.array([t or "" for t in texts] * 4, pa.string()))
    seeds = kernels.mix(np.arange(len(column)).astype(np.uint64))
    asked = []

    class Model:
        def encode(self, strings, **options):
            asked.extend(strings)
            return sp.encode(strings, **options)

    def run(max_edges, max_ids=1 << 40):
        monkeypatch.setattr(pieces, "MAX_EDGES", max_edges)
        monkeypatch.setattr(pieces, "MAX_IDS", max_ids, raising=False)
        known, out = pieces.Chunks(inventory, Model()), []
        asked.clear()
        for row, end, raw, off in kernels.slices(column, 2000):
            of = known.slice(raw, off)
            ids, begin, same = known.encoded(of)
            for i, own in enumerate(pieces.drawn_samples(known.lattice, of, seeds[row:end], 2)):
                out.append((ids[begin[i] : begin[i + 1]].tolist(), bool(same[i]), [(x[0].tolist(), x[1:]) for x in own]))
        return out, len(asked), len(set(asked))

    every, calls, distinct = run(1 << 40)
    assert calls == distinct
    assert run(1) == (every, distinct, distinct)  # lattices forgotten, ids not
    few, calls, _ = run(4000, 2000)
    assert few == every and calls > distinct
    assert run(1, 1)[0] == every


def test_lattices_do_not_depend_on_blocks_or_on_how_edges_are_ordered(monkeypatch, texts):
    with open(pieces.MODEL, "rb") as f:
        inventory = pieces.Inventory(f.read())
    raw, off = kernels.utf8(pa.array([" " + w for t in texts for w in (t or "").split(" ")] + [" ☃ab\x00", " " * 70 + "x" * 90], pa.large_string()))

    def made(**limits):
        for name, value in limits.items():
            monkeypatch.setattr(pieces, name, value)
        lattice = pieces.Lattice(inventory, raw, off)
        at = [slice(a, b) for a, b in zip(lattice.chunk_node, [*lattice.chunk_node[1:], len(lattice.first)])]
        to = lattice.to
        edges = [(int(lattice.node[e] - s.start), int(to[e] - s.start), int(lattice.piece[e]), float(lattice.logq[e]))
                 for s in at for n in range(s.start, s.stop) for e in range(lattice.first[n], lattice.stop[n])]
        follows = all(lattice.is_end[t] if n < 0 else lattice.first[t] == n for t, n in zip(to, lattice.then))
        return edges, follows

    whole, follows = made(BLOCK_BYTES=1 << 30)
    assert follows and made(KEY_BITS=0) == (whole, True) and made(BLOCK_BYTES=1) == (whole, True)


def test_sampling_looks_at_few_branches_and_misses_none(monkeypatch):
    rng = random.Random(6)
    words = ["water", "international", "of", "ab", "Straße", "x"]
    texts = pa.array([" ".join(rng.choices(words, k=n)) for n in [3000] * 8 + [1, 30, 100] * 5])
    seeds = np.arange(len(texts), dtype=np.uint64) * np.uint64(7919)
    with open(pieces.MODEL, "rb") as f:
        inventory = pieces.Inventory(f.read())
    looked = []
    log_rest = pieces.Lattice.log_rest
    monkeypatch.setattr(pieces.Lattice, "log_rest", lambda self, edges: looked.append(len(edges)) or log_rest(self, edges))

    def drawn(first):
        monkeypatch.setattr(pieces, "BRANCHES", first)
        looked.clear()
        found = [[(x[0].tolist(), *x[1:]) for x in own] for own in pieces.sampled_segmentations(inventory, texts, seeds, 5)]
        return found, sum(looked)

    every, all_steps = drawn(1 << 14)
    few, steps = drawn(64)
    assert few == every and steps < all_steps / 2
    assert drawn(5)[0] == every


def test_toxicity_does_not_depend_on_partitions_or_repeats(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["mild", "day", "tree", "vile" if i % 3 == 0 else "sun"]) for _ in range(20))) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    more = [(0, "another text of this id"), (0, "and a third"), (1, "vile vile")] + [rows[5]] * 300

    def scores(parts):
        data = spark.createDataFrame(rows + more, "doc_id long, text string").repartition(parts)
        return {(r.doc_id, r.text): r.score for r in toxicity.toxicity(data, labels, lang_col=None).collect()}

    assert scores(1) == scores(7)


def test_toxicity_learns_from_whole_texts(spark):
    # the words that tell stand after 33,000 others
    text = {1: "vile scum", 0: "calm day"}
    rows = [(i, "so " * 33000 + text[i % 2], i % 2) for i in range(60)] + [(i, "so " + text[i % 2], i % 2) for i in range(60, 80)]
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(data.drop("toxic"), data.select("doc_id", "toxic"), lang_col=None, learn=F.col("key") < 60)
    assert all(r.predicted == r.doc_id % 2 for r in got.where("doc_id >= 60").collect())


def test_toxicity_learns_from_every_labelled_document(spark, monkeypatch):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=12) + ["vile" if i % 5 == 0 else "calm"]), "en", int(i % 5 == 0)) for i in range(5200)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 1 << 17)  # several shards
    packed = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda parts, rounds: packed.append((parts, rounds)) or train(parts, rounds))
    got = toxicity.toxicity(data.drop("toxic"), data.select("doc_id", "toxic"), learn=F.col("key") < 5000).collect()
    kept = [s for s in toxicity.shards(packed[0][0].toArrow().to_batches())]
    assert len(kept) > 1 and packed[0][1] == toxicity.ROUNDS
    assert sum(len(s.y) for s in kept) == 5000 and sum(int(s.y.sum()) for s in kept) == 1000
    assert sum(len(s.ids) for s in kept) == 13 * 5000
    assert np.mean([r.predicted == rows[r.doc_id][3] for r in got if r.doc_id >= 5000]) > 0.9


def test_toxicity_trains_as_long_on_many_shards_and_on_every_text_of_an_id(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i % 50, " ".join(rng.choices(["mild", "day", "tree", "sun"], k=30)) + f" t{i}") for i in range(300)]
    data = spark.createDataFrame(rows + rows[:40], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    packed = []
    monkeypatch.setattr(toxicity, "train", lambda parts, rounds: packed.append((parts, rounds)) or (toxicity.start().model, None))
    for size in (1 << 30, 1 << 12):
        monkeypatch.setattr(toxicity, "SHARD_BYTES", size)
        assert toxicity.toxicity(data, labels, lang_col=None).count() == 340
    one, many = ([*toxicity.shards(parts.toArrow().to_batches())] for parts, _ in packed)
    assert len(one) == 1 and len(many) > 1 and packed[0][1] == packed[1][1]
    for kept in (one, many):
        assert sum(len(s.y) for s in kept) == 6 * 40 and sum(int(s.y.sum()) for s in kept) == 6 * 20


def test_toxicity_knows_unseen_forms_among_many_words(spark, monkeypatch):
    # 250,000 distinct words, far more than buckets; no toxic form occurs twice
    rng = random.Random(4)
    rows = []
    for i in range(2000):
        w = ["".join(rng.choices("abcdefgéñ", k=7)) for _ in range(125)]
        if i % 8 == 0:
            w[rng.randrange(len(w))] = "schné" + "".join(rng.choices("abcdefgéñ", k=6))
        rows.append((i, " ".join(w), ["de", "fr"][i // 8 % 2], int(i % 8 == 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 1 << 19)  # several shards
    got = toxicity.toxicity(data.drop("toxic"), data.select("doc_id", "toxic"), learn=F.col("key") < 1200)
    held = [r for r in got.collect() if r.doc_id >= 1200]
    for y in (0, 1):
        own = [r for r in held if rows[r.doc_id][3] == y]
        assert np.mean([r.predicted == y for r in own]) > 0.95 and np.mean([r.flagged == y for r in own]) > 0.95


def test_toxicity(spark, docs, none):
    rng = random.Random(1)
    vocabulary = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["vile", "scum"])
        rows.append((i, " ".join(w), "en", int(i % 4 == 0)))
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    out = toxicity.toxicity(data.drop("toxic"), data.select("doc_id", "toxic"), learn=F.col("key") < 450)
    score = {r.doc_id: r for r in out.collect()}
    held = range(450, 600)
    assert np.mean([score[i].predicted == rows[i][3] for i in held]) > 0.9
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {0.5}
    assert toxicity.toxicity(none, data.select("doc_id", "toxic")).count() == 0


def test_decontamination(spark, docs, none, texts):
    item = " ".join(texts[6].split()[20:50])
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (10, "Is it so\n" + item)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()}
    assert found == {(6, 7)}
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontamination.leaks(none, items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


def lower_alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_leaks(items, texts):
    """{(document, item): best score} of all pairs of documents and items."""
    lines = [[w for w in map(lower_alnum, t.split("\n")) if w] for t in items]
    words = [[w for x in xs for w in x] for xs in lines]
    full = [x for x in words if x]
    df = collections.Counter(w for x in full for w in set(x))
    mean, longest = sum(map(len, full)) / len(full), max(map(len, full))
    out = {}
    for d, text in enumerate(texts):
        w = lower_alnum(text)
        for i, x in enumerate(words):
            if not x:
                continue
            norm = 1.2 * (0.25 + 0.75 * len(x) / mean)
            impact = {t: math.log(1 + (len(full) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + norm) for t, f in collections.Counter(x).items()}
            parts = [x] if len(x) < 5 or len(lines[i]) < 2 else [[t for y in lines[i][:-1] for t in y], lines[i][-1]]
            for s in range(0, len(w), longest):
                window = w[s : s + 2 * longest]
                score = sum(v for t, v in impact.items() if t in window) / sum(impact.values())
                shares = []
                for part in parts:
                    n = min(5, len(part))
                    have = {tuple(window[k : k + n]) for k in range(len(window) - n + 1)}
                    grams = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
                    shares.append(len(grams & have) / len(grams))
                if score >= decontamination.THRESHOLD and min(shares) >= decontamination.OVERLAP:
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


@pytest.mark.parametrize("max_items", [1, 2, 20_000])
def test_decontamination_does_not_depend_on_the_number_of_indexes(spark, max_items):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(26)]
    items = [" ".join(shared + [word() for _ in range(4)]) for _ in range(4)] + ["capital of france Paris", "What is it\nyes indeed it is", "..."]
    texts = [" ".join(shared), items[0], "What is the capital of France Paris", "capital of Paris france", "well What is it yes indeed it is so",
             " ".join(word() for _ in range(40)) + " " + items[2], "", None, " ".join([*shared[:20], *(word() for _ in range(10))])]
    expected = brute_leaks(items, texts)
    assert {(1, 0), (2, 4), (4, 5), (5, 2)} <= set(expected) and not {3, 6, 7, 8} & {d for d, _ in expected}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = {k: f"i{k}" if k != 4 else None for k in range(len(items))}
    table = spark.createDataFrame([(name[k], t) for k, t in enumerate(items)], "item_id string, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs, table, max_items=max_items).collect()}
    assert found == pytest.approx({(d, name[i]): x for (d, i), x in expected.items()})
    kept = decontamination.decontaminate(docs, table, max_items=max_items)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected}


def test_words_shared_by_items_weigh_little_in_any_number_of_indexes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(26)]
    items = [" ".join(shared + [word() for _ in range(4)]) for _ in range(4)]
    docs = spark.createDataFrame([(1, " ".join(shared))], "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert not brute_leaks(items, [" ".join(shared)])
    for max_items in (1, 20_000):
        assert decontamination.leaks(docs, table, max_items=max_items).count() == 0


def test_language_model_cuts_chunks_by_bytes(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(language_model, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(language_model, "TaskContext", Task)
    texts = ["x" * 900] * 50 + ["y" * 9000] + [""] * 200
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 40], pa.string())}) for i in range(0, len(texts), 40)]
    out = [r for b in language_model.in_chunks(iter(batches)) for r in b.to_pylist()]
    size = collections.Counter()
    for r in out:
        size[r["chunk"]] += len(r["text"]) + language_model.ROW_BYTES
    assert [r["text"] for r in out] == texts and [r["chunk"] for r in out] == sorted(r["chunk"] for r in out)
    assert {c >> 32 for c in size} == {3} and sorted(size.values())[-2] <= 4000 + 964 and len(size) > 15


def test_language_model_of_repeated_rows(spark):
    rows = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two two " * 10).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(2, "two three " * 2000), (3, None), (None, "four")], "doc_id long, text string"))
    got = {r.doc_id: r for r in language_model.lm_scores(rows, F.col("key") < 3).dropDuplicates().collect()}
    # 300 times 10 one, 20 two, an end; 2000 two and three, an end
    count = {"one": 3000, "two": 8000, "three": 2000, "end": 301}
    total, kinds = sum(count.values()), len(count)

    def base(words):
        return sum(math.log10((count.get(w, 0) + 1) / (total + kinds + 1)) for w in words)

    assert len(got) == 4 and {r.train_tokens for r in got.values()} == {total}
    for i, words in [(1, ["one", "two", "two"] * 10 + ["end"]), (2, ["two", "three"] * 2000 + ["end"]), (3, ["end"]), (None, ["four", "end"])]:
        assert got[i].base_score == pytest.approx(base(words)) and got[i].n_tokens == len(words)


def test_language_model(docs, none, texts):
    fold = F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(7))
    out = language_model.lm_scores(docs, fold != 2)
    rows = by_id(out)
    tokens = {i: [*bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split(), None] for i, t in enumerate(texts)}
    count = collections.Counter()
    for i in [*range(len(texts)), 3]:  # the repeated row is learnt from twice
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        expected = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert rows[i].base_score == pytest.approx(expected, rel=1e-9)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert rows[i].score < 0
    assert language_model.lm_scores(none, F.lit(True)).count() == 0


def test_model_is_normalised():
    share = np.full(language_model.CLASSES, 1 / language_model.CLASSES)
    p = language_model.start_parameters(share)
    every = np.arange(language_model.CLASSES)
    logs = language_model.class_log_probabilities(p, every, np.full(len(every), 5), np.full(len(every), 9))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_license_scan(docs, none, texts):
    rows = by_id(license_scan.license_scan(docs))
    for i, t in enumerate(texts):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places, names = [], set()
        for phrase, label in license_scan.PHRASES.items():
            q = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(q)] == q]
            places += found
            names |= {label} if found else set()
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(names)) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
    assert rows[20].labels == "cc-by,cc-by-nc"
    assert license_scan.license_scan(none).count() == 0


def test_license_scan_finds_all_notices_of_a_text(spark, texts):
    rng = random.Random(5)
    notices = [t for _, t, _ in license_scan.TEMPLATES]
    own = sorted({w for t in notices for w in t.split()})
    long = " ".join("lemma%d term%d clause%d" % (i, i, i) for i in range(60))
    templates = [*license_scan.TEMPLATES, ("long", long, ["lemma7 term7"])]

    def altered(t, n):
        w = t.split()
        for q in rng.sample(range(len(w)), n):
            w[q] = "other"
        return " ".join(w)

    cases = [notices[3] + ". " + notices[8], " ".join(notices), "\n".join([*notices, texts[16]] * 2),
             " ".join(own) + " " + texts[16] + " " + notices[10], notices[3][14:], texts[6] + " " + notices[8][:-12], " ".join(own * 3), "", *notices,
             *(altered(t, len(t.split()) // 5) + " " + altered(rng.choice(notices), 1) for t in notices for _ in range(3)),
             *(altered(long, 36) for _ in range(4)), altered(long, 40), " ".join(rng.choices(own, k=2000))]
    rows = by_id(license_scan.license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(2), templates=templates))
    for i, t in enumerate(cases):
        w = re.findall(r"[a-zA-Z0-9\x80-\U0010ffff]+", t.lower())
        found = {}
        for label, text, keys in templates:
            q = text.split()
            for a in range(-len(q), len(w)):
                share = sum(0 <= a + k < len(w) and w[a + k] == x for k, x in enumerate(q)) / len(q)
                window = " " + " ".join(w[max(a, 0) : max(a + len(q), 0)]) + " "
                if share >= 0.8 and all(f" {k} " in window for k in keys):
                    found[label] = max(found.get(label, 0.0), share)
        base = {x for x in rows[i].base_labels.split(",") if x}
        assert rows[i].labels == ",".join(sorted(base | found.keys())), i
        assert rows[i].score == (1.0 if base else max(found.values(), default=0.0)), i
    assert {"bsd", "mit"} <= set(rows[0].labels.split(","))
    assert set(rows[1].labels.split(",")) == {label for label, _, _ in license_scan.TEMPLATES} | {"cc-by"}


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.net/de/5#t", "https://net", "http://m.example.com/de/7?x=/en/", "http://a.org/fr/3", None, "nothing",
            "http://notnet.com/en/9", "http://a.org/es/3", "ftp://b.org?x", "http://example.net/en", "http://x.net/de/5#t"] + [f"http://h.com/p{i}/c" for i in range(9)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    rows = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    expected = {0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("x.net", "/de/5", "net/", "block"), 2: ("net", "", None, None),
                3: ("m.example.com", "/de/7", "example.com/de/", "block"), 4: ("a.org", "/fr/3", "org/fr/", "allow"), 5: ("", "", None, None),
                6: ("", "", None, None), 7: ("notnet.com", "/en/9", None, None), 10: ("example.net", "/en", "net/", "block")}
    for i, (host, path, rule, verdict) in expected.items():
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert verdict is None and rows[i].verdict in ("allow", "block") or rows[i].verdict == verdict
    assert len(rows) == len(urls) and url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_filter_shares_labels_among_labelled_branches_only(spark):
    urls = [f"http://{host}/{path}" for host, path, n in [
        ("w.example.com", "de/a", 40), ("w.example.com", "en/a", 30), ("w.example.com", "fr/a", 1),  # blocked, and without labels
        ("v.example.com", "en/a", 5),  # no labels on the host
        ("q.net", "de/a", 30), ("q.net", "xx/a", 2),  # blocked alike
        ("z.org", "fr/a", 90), ("z.org", "yy/a", 60), ("z.org", "ww/a", 1),  # allowed, and without labels
        ("m.net", "a/a", 30), ("m.net", "b/a", 30), ("m.net", "c/a", 1)] for _ in range(n)]
    rules = [("net/", "block"), ("m.net/b/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {(r.host, r.path): r for r in url_filter.url_filter(pages, rules=rules).collect()}
    assert not rows["w.example.com", "/en/a"].merged and rows["w.example.com", "/en/a"].verdict == rows["v.example.com", "/en/a"].verdict == "allow"
    # all unlabelled branches of one shape have the shape's smoothed rate
    l, b = 40 + 32 + 90 + 61, 40 + 32 + 31
    rate = (b + 1) / (l + 2)
    prior = (b + 4 * rate) / (l + 4)
    for key in [("w.example.com", "/en/a"), ("w.example.com", "/fr/a"), ("v.example.com", "/en/a"), ("z.org", "/yy/a"), ("z.org", "/ww/a")]:
        assert rows[key].purity == pytest.approx(prior) and not rows[key].merged
    for path in ("/de/a", "/xx/a"):
        assert rows["q.net", path].merged and rows["q.net", path].purity == pytest.approx((32 + 4 * prior) / (32 + 4))
    # c has too few labels to differ; a and b differ from the pooled rate and lend it nothing
    assert [rows["m.net", f"/{x}/a"].merged for x in "abc"] == [False, False, True]
    assert rows["m.net", "/c/a"].purity == pytest.approx((1 + 4 * prior) / (1 + 4))
    assert rows["m.net", "/b/a"].purity == pytest.approx((0 + 4 * prior) / (30 + 4))


def test_url_filter_tells_deep_branches_apart(spark):
    deep = "a/b/c/d/e/f/g/h"
    urls = [f"http://x.org/{deep}/{tail}" for tail in ["in/1", "in/2", "out/3", "out/4", "out/" + "s/" * 40 + "5"] for _ in range(9)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [(f"x.org/{deep}/in/", "block"), ("y.org/", "allow")]
    rows = {r.path: r for r in url_filter.url_filter(pages, rules=rules).collect()}
    assert rows[f"/{deep}/in/1"].template == f"/{deep}/in/*" and rows[f"/{deep}/in/1"].merged
    for tail, template in [("out/3", "out/*"), ("out/" + "s/" * 40 + "5", "out/" + "s/" * 40 + "*")]:
        assert rows[f"/{deep}/{tail}"].template == f"/{deep}/{template}" and not rows[f"/{deep}/{tail}"].merged


def test_long_word_and_hash():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
    inventory = pieces.Inventory(open(pieces.MODEL, "rb").read())
    drawn = list(pieces.sampled_segmentations(inventory, pa.array(["ab" * 3000], pa.string()), np.array([1], np.uint64), 2))
    assert len(drawn[0]) == 2
