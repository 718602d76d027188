"""Every query on small tables with nulls, empty texts, ties, repeated rows and clashing columns, beside plain Python."""

import json
import random
import struct
from collections import defaultdict

import brute
import pytest

from cellwright.llm import queries as q

CLASHING = "text_key, key, doc, spans, size, rank, digest, n, count, first, packed, source_size, target, fp, root, label, host, low, chars, prefix, marked_id, marked_key, bad_id, bad_key, mixed_id, mixed_source, turns, turn, kept, shard, f, phrase, n_words, terms, tfs, score, item, block, item_id, words"


def made_rows():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(300)] + ["the", "of", "and", "é", "日本", "OF!!", "x###"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, long_one = text(90), text(700)
    edited = long_one.split(" ")
    edited[350] = "changed"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one two", "b"), (None, "no id here", "b"), (None, None, None),
        (5, "Mail rhokk.73@mail2.example.com or x@y@z.co.uk; 16.195.23.156, 1.2.3.4.5.6.7.8, 300.1.1.1; +1 (988) 555-2485 4232245145735943 end", "b"),
        (6, "a@b.c@d.e 4232 2451-4573 5943 +12 +123456789 0.0.0.0 @ . 1.2.3 " + "9" * 40, "a"),
        (7, "same  text\nhere", "a"), (8, "same text here", "a"), (9, "same text here", "c"), (9, "same text here", "c"), (3, None, None), (3, "", None),
        (10, passage, "a"), (11, text(30) + " " + passage + " " + text(40), "b"), (12, passage + "\n" + passage, "c"), (13, text(20) + "\n" + passage, "a"),
        (14, long_one, "a"), (15, " ".join(edited), "a"), (16, " ".join(edited[100:600]), "c"), (17, "w " * 600, "b"), (18, "w " * 500, "b"),
        (19, "line one here\nline one here\n\nother\nline one here", "a"), (20, "x" * 3000, "c"), (21, "y" + "x" * 2000, "c"), (22, "▁ a▁b  c ", "z"),
        (23, "ends with blank ", "z"), (24, " starts", "z"), (25, "nul\0byte <s> </s> \r\n tab\there", "z"), (26, long_one, "a"), (26, "another text of this id", "a"),
    ]
    rows += [(100 + i, text(rnd.randint(1, 120)), rnd.choice("abc")) for i in range(60)]
    rows += [(200 + i, passage if i % 2 else long_one, "hot") for i in range(12)]
    return rows


ROWS = made_rows()
PAGES = [
    (1, "https://a.example/x", "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><article><h1>Head &amp;lt; A</h1><p>One\n two<br>three</p>"
     "<div class='comments'><p>me too</p></div><p><b>open<p>last&nbsp;one</article><footer>f</footer></body>"),
    (2, None, None), (3, "not an address", ""), (4, "http://u@a.example:80/y", "plain &eacute; text <script>if (a < b) {}</script> after <!-- c --> it"),
    (5, "https://a.example/z", "<div id=sidebar><p>side</p></div><div class=\"story\"><p>Story <i>text</i></p><form><p>mail</p></form></div><p title='a > b'>x < y"),
    (5, "https://a.example/z", "<body>" + "<div>" * 3000 + "deep" + "</div>" * 10),
]
PAGE_TEXT = {1: "Head &lt; A\nOne two three\nopen\nlast one", 2: "", 3: "", 4: "plain é text after it"}


ITEMS = [(1, "same text here"), (1, "same text here"), (1, "another TEXT, of this id"), (2, None), (3, ""), (None, "no id"), (4, "zzzz unknown"), (5, "the of and é 日本 here")]
ITEMS += [(10 + i, " ".join((ROWS[i][1] or "").split()[:40])) for i in range(0, len(ROWS), 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("edge")), ROWS, PAGES)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("none")), [], [])


def write(spark, path, rows, pages):
    extra = [c.strip() for c in CLASHING.split(",")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    docs = docs.selectExpr("*", "nullif(element_at(array('en', 'de', ''), cast(1 + coalesce(doc_id, 0) % 3 as int)), '') as lang", *[f"'clash' as `{c}`" for c in extra])
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as low").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(ITEMS if rows else [], "item_id bigint, text string").selectExpr("*", *[f"'clash' as `{c}`" for c in extra if c != "item_id"]).write.parquet(f"{path}/benchmark.parquet")
    labels = [(d, int("###" not in (t or "")), 0) for d, t, _ in rows if d] + ([(None, 1, 0), (4, None, 0)] if rows else [])
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def result(spark, path, name, *columns):
    df = next(f for n, f in q.queries().items() if n.startswith(name + "_"))(spark, path)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_encoding(spark, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_path())
    want = []
    for d, t, _ in ROWS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(sp.decode(ids))))
    assert result(spark, folder, "op1", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_mixing(spark, folder):
    """A row for every document, repeated rows and null ids too, none above three times its size; sources meet their targets."""
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    got = q.op2_mixing(spark, folder).collect()
    assert sorted(((r.doc_id, r["size"]) for r in got), key=repr) == sorted(((d, len(brute.words(t))) for d, t, _ in ROWS), key=repr)
    by_source = defaultdict(int)
    sources = {(d, len(brute.words(t))): s for d, t, s in ROWS}
    for r in got:
        source = sources[r.doc_id, r["size"]]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r["size"]
        by_source[source] += r.taken
    assert {s: by_source[s] for s in want} == {s: pytest.approx(t, abs=1) for s, t in want.items()}
    assert sorted(map(repr, got)) == sorted(map(repr, q.op2_mixing(spark, folder).collect()))


def test_queue_decides(spark):
    """The queue is in the order of finish times and is cut once, at the budget; repeated rows keep their own words."""
    from cellwright.llm import mixing

    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x y", "s"), (None, "x y", "t"), (2, "d " * 50, "t"), (3, None, "u")]
    rows += [(10 + i, "w " * (i % 7), ("s", "t", None)[i % 3]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    line = sorted(mixing.mix(docs).collect(), key=lambda r: (r.before, r.finish, r.words))
    assert [r.finish for r in line if r.words] == sorted(r.finish for r in line if r.words)
    running = budget = sum(r.taken for r in line)
    for r in line:
        assert r.taken == max(0, min(r.words, budget - r.before))
        running -= r.taken
    assert running == 0 and mixing.words_taken(mixing.mix(docs)).count() == len(rows)


def test_personal_data(spark, folder):
    for d, *counts, digest, spans in result(spark, folder, "op3", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"):
        fitting = [brute.base_spans(t) for i, t, _ in ROWS if i == d]
        joined = [",".join(f"{k}:{a}:{b}" for k, a, b in base) for base in fitting]
        assert digest in [brute.sha(x) for x in joined]
        assert any(spans.startswith(x) for x in joined)
        assert counts in [[sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")] for base in fitting]


def test_exact_copies(spark, folder):
    groups = brute.exact_groups(ROWS)
    got = result(spark, folder, "op4", "doc_id", "keep_id", "group_size", "text_sha256")
    assert got == sorted(((ROWS[i][0], *g) for i, g in groups.items()), key=repr)
    kept = [r for r in result(spark, folder, "op4", "text_sha256", "kept", "doc_id", "keep_id") if r[1]]
    assert len(kept) == len({g[2] for g in groups.values()}) == len({r[0] for r in kept})
    assert all(r[2] == r[3] for r in kept)


def test_near_copies(spark, folder):
    assert result(spark, folder, "op5", "doc_id", "fingerprint", "component_id") == sorted(brute.near_components(ROWS), key=repr)


def test_rules(spark, folder):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, t, _ in ROWS:
        c = brute.rule_counts(t)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert result(spark, folder, "op6", *columns) == sorted(want, key=repr)
    assert not [r for r in result(spark, folder, "op6", "base_failed", "kept") if all(r)]


def test_classifier(spark, folder):
    got = result(spark, folder, "op7", "doc_id", "held_out", "score", "predicted")
    assert len(got) == len(ROWS)
    from zlib import crc32

    for d, held, score, predicted in got:
        assert held == (d is not None and crc32(str(d).encode()) % 3 == 1)
        assert 0 <= score <= 1 and predicted == (score >= 0.5)


def test_pages(spark, folder):
    got = result(spark, folder, "op8", "page_id", "text", "n_chars")
    assert len(got) == len(PAGES)
    assert all(PAGE_TEXT.get(p, t) == t and len(t) == n for p, t, n in got)
    assert [t for p, t, _ in got if p == 5] == ["Story text\nx < y", "deep"]


def test_byte_repeats(spark, folder):
    assert result(spark, folder, "op9", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.byte_repeats(ROWS), key=repr)


def test_word_repeats(spark, folder):
    assert result(spark, folder, "op10", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.word_repeats(ROWS), key=repr)


def test_search(spark, folder):
    want = sorted(brute.ranked(ROWS, ITEMS), key=repr)
    assert result(spark, folder, "op11", "item_id", "rank", "doc_id", "score") == want


def test_search_in_blocks_and_steps(spark, folder, monkeypatch):
    """Many blocks of items, small steps and few accumulators: the same ranks."""
    from cellwright.llm import search
    from cellwright.llm.common import table

    monkeypatch.setattr(search, "STEP", 4)
    monkeypatch.setattr(search, "SHORT_SHARE", 0.02)
    found = search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=3, block_bytes=600)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute.ranked(ROWS, ITEMS, 3), key=repr)


def with_lang(rows):
    return [(*r, ("en", "de", None)[(r[0] or 0) % 3]) for r in rows]


def test_collocations(spark, folder):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert result(spark, folder, "op12", *columns) == sorted(brute.phrases(with_lang(ROWS)), key=repr)


@pytest.mark.parametrize("shards,bits", [(1, 64), (3, 64), (7, 1 << 12)])
def test_collocations_in_shards(spark, shards, bits):
    """Whatever the shards and however full the map of phrases: the counts are those of all documents."""
    from cellwright.llm import collocations

    rnd = random.Random(shards)
    rows = [(i, " ".join(rnd.choice("abcdefg") + rnd.choice(["", ".", ",", "\t"]) for _ in range(rnd.randint(0, 30))), "s", rnd.choice(["x", None])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {(r.lang, r.phrase): r.f for r in collocations.candidates(docs, 10, shards, bits).collect()}
    want = {(lang, p): a for lang, _, p, a, *_ in brute.phrases(rows, 10**9)}
    assert min((f for (_, p), f in got.items() if p), default=10) >= 10
    assert want.items() <= got.items()
    assert sorted(map(tuple, collocations.collocations(docs, 5, 10, shards, 1).collect())) == sorted(brute.phrases(rows, 5))


def test_licenses(spark, folder):
    from cellwright.llm import licenses

    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert result(spark, folder, "op13", *columns) == sorted(((d, *brute.license_base(t, licenses.BASE)) for d, t, _ in ROWS), key=repr)


LICENSED = [
    ("w1 w2 w3 Released under the MIT License. w4", "mit", None),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0", None),
    ("x " * 500 + "This work is licensed under the GNU General Public License, version 3." + " y" * 500, "gpl,gpl-3", 1.0),
    ("All rights reserved. CC BY all rights reserved, all rights", "cc-by,reserved", 1.0),
    ("Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met", "bsd", None),
    ("the license of an apache under the sun; mit of the license", "", 0.0),
    ("mit license", "", 0.0), ("software without restriction, permission to any person", "", 0.0), ("the of license " * 5000, "", 0.0), (None, "", 0.0), ("", "", 0.0),
]


def test_license_notices(spark):
    """Notices with small changes get their label, loose words of them none."""
    from cellwright.llm import licenses

    rows = [(i, t) for i, (t, _, _) in enumerate(LICENSED)] + [(100 + i, "plain words of some text the and of") for i in range(40)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: got[i].labels for i in range(len(LICENSED))} == {i: labels for i, (_, labels, _) in enumerate(LICENSED)}
    for i, (_, labels, score) in enumerate(LICENSED):
        assert got[i].score == score if score is not None else licenses.LEAST_SHARE <= got[i].score <= 1
    assert all(got[100 + i].labels == "" for i in range(40))


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, nothing, name):
    assert q.queries()[name](spark, nothing).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline
    from cellwright.llm import classifier, common

    docs = common.table(spark, folder, "documents")
    good = {(r.doc_id, r.text_key) for r in classifier.quality_scores(docs, common.table(spark, folder, "labels")).where("predicted = 1").collect()}
    keyed = docs.selectExpr("doc_id", "text", "source", "xxhash64(coalesce(text, '')) as k").collect()
    stage = [(r.doc_id, r.text, r.source) for r in keyed if (r.doc_id, r.k) in good]
    for name, f in corpus_pipeline.STAGES[:3]:
        docs = common.cut(f(spark, docs, folder), "stage")
        assert docs.columns == common.table(spark, folder, "documents").columns
        if name == "exact dedup":
            groups = brute.exact_groups(stage)
            first = {}
            for i, g in groups.items():
                if stage[i][0] == g[0]:
                    first.setdefault(g[2], stage[i])
            stage = list(first.values())
            assert len(stage) == docs.count()
        if name == "SimHash near-dedup":
            stage = [r for r, c in zip(stage, brute.near_components(stage), strict=True) if c[0] == c[2]]
        if name != "exact dedup":
            got = sorted(((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None), key=repr)
            assert got == sorted(((d, t) for d, t, _ in stage if d is not None), key=repr)
    mixed = common.cut(corpus_pipeline.mixture(spark, docs, folder), "mixed")
    assert mixed.columns == docs.columns
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert n and max(n.values()) <= 3
    out = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r.doc_id or -1 for r in mixed.collect())


def test_registered_with_sql_names():
    assert set(q.oracle_sql()) <= set(q.queries())
    assert json.dumps(sorted(q.queries()))
