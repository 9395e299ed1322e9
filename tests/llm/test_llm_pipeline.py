"""The pipeline against a brute-force version on the small tables."""

import re

import sentencepiece

import corpus_pipeline
from churnlens.llm import pieces, quality_rules
from churnlens.llm.frames import documents
from test_llm_operators import linked_classes, words_of

SF = "/root/testdata/sf0.001"


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    # quality rules have a SQL oracle of their own; take their texts as given
    docs = sorted((r.doc_id, r.text) for r in quality_rules.quality_rules(documents(spark, SF)).where("kept").collect())
    _, roots = linked_classes([t for _, t in docs])
    docs = [d for i, d in enumerate(docs) if roots[i] == i]
    first = {}
    for i, t in docs:
        w = words_of(t)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    cut = {}
    for i, t in docs:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        cut[i] = [x.decode() for x, g in zip(w, gone) if not g]
    items = []
    for r in documents(spark, SF, "benchmark").collect():
        lines = [alnum(x) for x in r.text.split("\n") if x.strip()]
        whole = [w for x in lines for w in x]
        items.append([x for x in ([whole] if len(lines) < 2 else [[w for x in lines[:-1] for w in x], lines[-1]]) if x])
    expected = {}
    for i, w in cut.items():
        words = alnum(" ".join(w))

        def share(part):
            n = min(5, len(part))
            have = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
            grams = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
            return len(grams & have) / len(grams)

        if not any(min(map(share, parts)) >= 0.8 for parts in items):
            expected[i] = w
    assert set(got) == set(expected)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, w in expected.items():
        assert got[i].text.split() == " ".join(w).split(), i
        assert list(got[i].ids) == sp.encode(got[i].text) and got[i].round_trip


def test_stages_follow_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "substring_dedup", "decontamination", "sentencepiece"]


def test_encoding_stage_draws_samples(spark):
    docs = documents(spark, SF).where("doc_id < 20")
    out = corpus_pipeline.encoding_stage(spark, docs, SF)
    assert out.columns == [*docs.columns, "ids", "round_trip", "samples"]
    got = {r.doc_id: r for r in out.collect()}
    for i, r in {r.doc_id: r for r in pieces.encode_pieces(docs, samples=pieces.SAMPLES).collect()}.items():
        assert [tuple(s.ids) for s in got[i].samples] == [tuple(s.ids) for s in r.samples]
        assert len(r.samples) == len({tuple(s.ids) for s in r.samples}) == (pieces.SAMPLES if r.text else 1)
        assert got[i].ids == r.ids


def written_tables(spark, folder, rows, schema, items):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_over_odd_rows(spark, tmp_path):
    def prose(seed, n=80):
        return " ".join(f"word{(seed * 7919 + i * i * 31) % 9973}" for i in range(n)) + "."

    schema = "doc_id long, text string, kept string, n_words string, document string, spans string, tag int, matches string"
    own = ("own", "w", "d", "s", 7, "m")
    leak = prose(9, 30)
    rows = [(1, prose(1), *own), (1, prose(1), *own), (None, prose(1), *own), (2, prose(1), *own), (3, None, *own), (4, "", *own), (5, "short", *own),
            (6, prose(2) + "\nAccept all cookies", *own), (7, prose(3) + " " + leak, *own), (8, prose(4) + " " + prose(2), *own), (8, prose(5), *own)]
    folder = written_tables(spark, tmp_path, rows, schema, [(1, leak), (None, "no such text here at all"), (2, None)])
    docs = documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert {tuple(r)[2:] for r in out.collect()} == {own}, name
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == [*docs.columns, "ids", "round_trip", "samples"]
    texts = sorted((r.doc_id or 0, r.text.split()) for r in got.collect())
    # 2 is a copy of 1, 7 holds the test item, 8 loses what 6 also holds
    assert texts == sorted((i, t.split()) for i, t in [(0, prose(1)), (1, prose(1)), (6, prose(2)), (8, prose(4)), (8, prose(5))])


def test_pipeline_over_empty_tables(spark, tmp_path):
    folder = written_tables(spark, tmp_path, [], "doc_id long, text string, lang string", [])
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == 0 and got.columns == ["doc_id", "text", "lang", "ids", "round_trip", "samples"]
