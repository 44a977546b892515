"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and copies."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklane.llm import byte_pieces, chat, decontamination, licenses, near_dedup, pieces, quality, sharding, substring_dedup, token_files, toxicity

DOCS = "doc_id long, text string, lang string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", "", ".", ",", "é"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, rng.choice([3, 20, 60, 150])) for _ in range(40)]
    passage, near = prose(rng, 60), prose(rng, 120, 4000).split()
    texts = [*base, base[3], base[3], base[7].upper(), base[5] + " " + passage, passage + "\n\n" + base[6], "x\t" + passage, None, "", "  \n ", "one", "a b c d", "a  b c\td", prose(rng, 9000)]
    for k in range(25):  # near copies of one text, most of them linked with it only
        cut = list(near)
        for p in rng.sample(range(len(cut)), k % 5):
            cut[p] = f"new{k}x{p}"
        texts.append(" ".join(cut))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, ["en"] * len(texts)))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(spark, docs, empty, rows):
    more = docs.unionByName(docs.limit(0)).unionByName(spark.createDataFrame([(7, "copy", "x")] * 50 + [(None, None, None)] * 3, DOCS)).withColumn("shard", F.lit("old"))
    got = sharding.assign_shards(more, shards=8).collect()
    assert len(got) == len(rows) + 53
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert sharding.assign_shards(empty).count() == 0


def test_overflow_moves_little():
    counts = [random.Random(1).randrange(30) for _ in range(4096)]

    def shares(shards):
        plan = sharding.bounded_plan(counts, sharding.ring_owners(shards, 128, 4096), shards)
        return {(p, r): s for p, a, b, s, _ in plan for r in range(a, b)}

    eight, nine = shares(8), shares(9)
    assert len(eight) == len(nine) == sum(counts)
    assert sum(eight[k] != nine[k] for k in eight) < 0.15 * len(eight)


def test_substring_dedup(docs, empty, rows):
    more = docs.withColumn("kept_text", F.lit(1))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(more).collect()}
    words = {i: BLANK.findall(t or "") for i, t, _ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), sum(gone), kept)
        assert sum(s.end - s.start for s in got[i].removed_spans) == sum(gone)
    assert any(r.n_removed for r in got.values()) and substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_null_id(spark):
    text = " ".join(f"t{i}" for i in range(20))
    got = substring_dedup.substring_dedup(spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 0), (True, 20)]


def test_substring_dedup_repeated_and_null_ids(spark):
    """The result does not depend on how rows arrive, whatever their ids."""
    rng = random.Random(5)
    parts = [prose(rng, 20, 4000) for _ in range(6)]
    rows = [(rng.choice([None, 1, 2, 2, 3]), " ".join(rng.sample(parts, 3)), k) for k in range(60)]
    words = [t.split() for _, t, _ in rows]
    first, last = {}, 1 << 62
    for (i, _, _), w in zip(rows, words):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, last), last if i is None else i)
    for n in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, n_words long").withColumnRenamed("n_words", "row").repartition(n)
        for r in substring_dedup.substring_dedup(df.withColumn("_x", F.lit(1))).collect():
            w, own = words[r.row], last if r.doc_id is None else r.doc_id
            gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < own for p in range(k, k + 13)}
            assert r.n_removed == len(gone) and r.kept_text == " ".join(x for p, x in enumerate(w) if p not in gone)
    with pytest.raises(ValueError, match="integer ids"):
        substring_dedup.substring_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_near_duplicates_of_odd_ids(spark):
    rng = random.Random(6)
    a, b = prose(rng, 90, 4000), prose(rng, 90, 4000)
    near = " ".join([*a.split()[:88], "x", "y"])
    rows = [("k3", a), ("k1", near), ("k2", b), (None, b), (None, None), ("k2", b), ("k4", ""), ("k9", a)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("component_id", F.lit("mine"))
    got = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == {("k3", "k1", False): 1, ("k1", "k1", True): 1, ("k9", "k1", False): 1, ("k2", "k2", True): 2, (None, "k2", False): 1, (None, None, False): 1, ("k4", "k4", True): 1}
    kept = near_dedup.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["None", "None", "k1", "k2", "k2", "k4"] and {r.component_id for r in kept} == {"mine"}


def test_near_duplicates_of_an_id_with_two_texts(spark):
    rng = random.Random(7)
    a, b = prose(rng, 60, 4000), prose(rng, 60, 4000)
    results = set()
    for n in (1, 3):
        df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string").repartition(n)
        results.add(tuple(sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect())))
    assert results == {((1, 1), (1, 1), (2, 1), (3, 1))}


def test_ids_with_several_texts_lose_no_link(spark):
    rng = random.Random(11)
    a, b, c = (prose(rng, 80, 4000) for _ in range(3))
    near = b + " end"
    rows = [(1, a), (1, b), (2, b), (4, near), (7, c), (7, a), (9, c + " end"), (12, prose(rng, 50, 4000)), (None, b), (5, None), (5, ""), (3, "x"), (3, "y")]
    for n in (1, 2, 5):
        df = spark.createDataFrame(rows, "s1 long, node string").repartition(n)
        got = collections.Counter((r.s1, r.component_id) for r in near_dedup.near_duplicates(df, ids="s1", text="node").collect())
        assert got == collections.Counter([(1, 1), (1, 1), (2, 1), (4, 1), (7, 1), (7, 1), (9, 1), (12, 12), (None, 1), (5, 5), (5, 5), (3, 3), (3, 3)])


def test_sample_of_labels_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"word{k} bad") for k in range(300)] + [(k, f"good text{k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 40)], "doc_id long, toxic int")
    sizes, fit = [], toxicity._fit
    try:
        toxicity._fit = lambda rows, y, *more: sizes.append(len(rows)) or fit(rows, y, *more)
        for n in (10, 200, 10_000):
            toxicity.train(docs, labels, max_rows=n)
    finally:
        toxicity._fit = fit
    assert sizes == [10, 200, 338] or sizes[0] <= 10 and sizes[1] <= 200 and sizes[2] == 338


def test_near_duplicates(docs, empty, rows):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    sets = {}
    for i, t, _ in rows:
        w = BLANK.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    for _ in sets:  # smallest id that links reach
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
        if _ > 3:
            break
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), low[i], low[i] == i)
    assert collections.Counter(low.values()).most_common(1)[0][1] > 5 and near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == sum(low[i] == i for i in low)


def test_quality(docs, empty, rows):
    got = {r.doc_id: r for r in quality.quality_rules(docs.withColumn("kept", F.lit("old"))).collect()}
    for i, t, _ in rows:
        t = t or ""
        w = BLANK.findall(t)
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = [False] * len(w)
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                hit[k : k + 3] = [True] * 3
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        failed = len(w) < 50 or 100 * sum(hit) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit), failed)
        assert not (failed and r.kept) and 0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1
    assert quality.quality_rules(empty).count() == 0


def test_words_alone_reject(spark):
    """A text whose letters are those of prose and that holds none of the common words."""
    rng = random.Random(2)
    invented = " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(5)) for _ in range(300))
    r = quality.quality_rules(spark.createDataFrame([(1, invented)], "doc_id long, text string")).first()
    assert r.class_distance < 0.25 and r.word_distance > quality.WORD_BASE + quality.WORD_SLOPE / 300**0.5 and not r.base_failed and not r.kept


def test_learn_references(spark):
    rows = [("xx", "aa aa BB 1 é."), ("xx", "aa cc"), ("yy", "zz"), (None, "no"), ("empty", " ")]
    found = quality.learn_references(spark.createDataFrame(rows, "lang string, text string"), "lang", top=2)
    assert set(found["classes"]) == {"xx", "yy"} and found["common"] == {"xx": {"aa": 3 / 7, "1": 1 / 7}, "yy": {"zz": 1.0}}
    assert found["classes"]["xx"] == pytest.approx((10 / 13, 1 / 13, 1 / 13, 1 / 13))
    cyrillic = " ".join(["слово и дело"] + [f"буква{chr(1072 + k % 32)}{chr(1072 + k // 32)} и" for k in range(150)])
    df = spark.createDataFrame([(1, "ru", cyrillic)], "doc_id long, lang string, text string")
    assert not quality.quality_rules(df).first().kept and quality.quality_rules(df, **quality.learn_references(df, "lang")).first().kept


def test_keep_good_leaves_clashing_columns(spark):
    rng = random.Random(1)
    clean = " ".join(rng.choice("the of and to a in is that".split()) if k % 6 == 0 else f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150))
    df = spark.createDataFrame([(1, clean, "mine", 7), (1, clean, "mine", 7), (None, clean, "mine", 7), (2, None, "mine", 7)], "doc_id long, text string, kept string, n_words long")
    assert [tuple(r) for r in quality.keep_good(df).collect()] == [(1, clean, "mine", 7)] * 2 + [(None, clean, "mine", 7)]
    assert quality.keep_good(df.limit(0)).columns == df.columns


def test_quality_verdict(spark):
    clean = "the house of the man and the dog is in a garden that was to be as old as it was on the hill with " * 1 + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    junk = " ".join(f"$%&{i}***" for i in range(200))
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame([(1, clean), (2, junk)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_repeats_of_a_long_text(spark):
    n = 140_000  # more than 2^20 words: windows that occur twice, each beside words that occur once
    text = " ".join(f"a{k % n} b{k % n} c{k % n} u{k}" for k in range(2 * n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("words", F.split("text", " "))
    assert df.select(quality._repeat_words(F.col("words")).alias("n")).first()["n"] == 6 * n


@pytest.mark.parametrize("limit", [decontamination.BROADCAST, 0])
def test_decontamination(spark, docs, empty, rows, limit):
    texts = [t for _, t, _ in rows if t]
    items = [(1, " ".join(texts[8].split()[:14]) if len(texts[8].split()) > 13 else texts[8]), (2, texts[41]), (3, "one"), (4, ""), (5, None), (2, texts[2]), (6, "a b c"), (10, "not there at all but long enough for a window of words")]
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit).collect()}
    windows = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(LOWER))
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(i)
    sizes = {len(x) for x in windows}
    for i, t, _ in rows:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if h := windows.get(tuple(w[s : s + k])):
                    hit[s : s + k] = [True] * k
                    found |= h
        assert (got[i].n_words, got[i].n_hit, got[i].items, got[i].contaminated) == (len(w), sum(hit), sorted(map(str, found)), any(hit))
    assert any(r.contaminated for r in got.values())
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(empty, nothing).count() == 0 and not any(r.n_hit for r in decontamination.decontaminate(docs, nothing).collect())


def test_without_benchmark_of_odd_ids(spark):
    leak = " ".join(f"q{k}" for k in range(12))
    rows = [(None, "a " + leak, 1), (None, "clean", 2), (4, leak, 3), (4, "other text", 4), (5, None, 5), (5, None, 5)]
    df = spark.createDataFrame(rows, "word long, text string, n_hit long")
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted(r.n_hit for r in decontamination.without_benchmark(df, items, ids="word").collect()) == [2, 4, 5, 5]
    for limit in (decontamination.BROADCAST, 0):
        got = decontamination.decontaminate(df, items, ids="word", broadcast_bytes=limit).collect()
        assert sorted((r.word is None, r.n_words, r.n_hit) for r in got) == [(False, 0, 0), (False, 0, 0), (False, 2, 0), (False, 12, 12), (True, 1, 0), (True, 13, 12)]


def test_licenses_of_odd_tables(spark, empty):
    df = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (2, "<!-- SPDX-License-Identifier: MIT --> all"), (3, "# SPDX-License-Identifier: MIT - see LICENSE"), (4, "SPDX-License-Identifier: Zlib OR BSL-1.0"), (5, "SPDX-License-Identifier: Own-1.0"), (6, "SPDX-License-Identifier: OR MIT")], "doc_id long, text string").withColumn("score", F.lit("old"))
    got = {r.doc_id: (r.labels, r.score, [e.text for e in r.expressions]) for r in licenses.license_scan(df).collect()}
    assert got[2] == (["spdx-permissive"], 0.1, ["mit"]) and got[3] == got[2] and got[4] == (["spdx-permissive"], 0.1, ["zlib or bsl-1.0"])
    assert got[5] == (["spdx-unknown"], 0.5, ["own-1.0"]) and got[6][0] == ["spdx-invalid"] and licenses.license_scan(empty).count() == 0


def test_licenses(spark):
    rows = [(1, "CC BY-NC 4.0 and cc by. All Rights\nReserved; General public   license"), (2, None), (3, ""), (4, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\ncode"), (5, "SPDX-License-Identifier: MIT OR ( GPL"), (6, "ends with all rights"), (7, "reserved at the start"), (8, "cc by cc by " * 3000)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    for i, t in rows:
        w = PLAIN.findall((t or "").translate(LOWER))
        places = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert got[i].n_words == len(w) and sorted((m.start, m.label) for m in got[i].matches if m.is_base) == places
    assert got[1].labels == ["cc-by", "cc-by-nc", "gpl", "reserved"] and got[1].score == 1.0
    assert got[4].labels == ["spdx-permissive"] and got[5].labels == ["spdx-invalid"] and got[2].score == 0.0


def test_expressions():
    ev = licenses.evaluate
    assert ev("mit or gpl-3.0-only") == 0.1 and ev("mit and gpl-3.0-only") == 0.7 and ev("mit and (gpl-2.0+ or apache-2.0)") == 0.1
    assert ev("gpl-2.0-only with classpath-exception-2.0") == pytest.approx(0.5) and ev("mit or gpl-3.0 and agpl-3.0") == 0.1
    assert ev("gpl-2.0-only with other-exception") == 0.7 and ev("cc-by-nc-sa-4.0") == 0.9 and ev("cc-by-4.0") == 0.2
    lead = licenses.leading_expression
    assert [lead(x) for x in ("mit or later", "mit and (zlib or isc) see file", "(mit", "or mit", "gpl-2.0+ with classpath-exception-2.0.", "mit (c) 2020")] == ["mit", "mit and (zlib or isc)", "", "", "gpl-2.0+", "mit"]
    assert [ev(x) for x in ("", "mit or", "(mit", "mit)", "and mit", "mit mit")] == [None] * 6


def test_token_files(spark, docs, empty, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    more = [*rows, (1000, "it's  a\ttest\n\n x y ½ ² ǅ 中文 <|endoftext|> ok", None), (1001, "don't 'll  ’s\r\n1 22 ", None)]
    parts = token_files.write_token_files(spark.createDataFrame(more, DOCS), str(tmp_path / "t"), path)
    got = token_files.ids_crc32(token_files.read_token_files(parts, str(tmp_path / "t"))).collect()
    library, at = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _, _ in more)
    for r in sorted(got, key=lambda r: r.start):
        ids = [*library.encode(next(t for i, t, _ in more if i == r.doc_id) or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    odd = spark.createDataFrame([(None, "n", 1), (None, None, 2), (-(1 << 63), "m", 3), (7, "twice", 4), (7, "twice", 5)], "doc_id long, text string, start long")
    parts = token_files.write_token_files(odd, str(tmp_path / "o"), path)
    back = sorted(((r.start, r.doc_id, list(r.ids)) for r in token_files.read_token_files(parts, str(tmp_path / "o")).collect()))
    ids = lambda t: [*library.encode(t, add_special_tokens=False).ids, 0]
    assert [i for _, i, _ in back] == [None, None, -(1 << 63), 7, 7] and sorted(x for _, i, x in back if i is None) == sorted([ids("n"), ids("")]) and [x for *_, x in back[2:]] == [ids("m"), ids("twice"), ids("twice")]
    parts = token_files.write_token_files(empty, str(tmp_path / "e"), path)
    assert token_files.read_token_files(parts, str(tmp_path / "e")).count() == 0


def test_piece_starts_are_those_of_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path, rng = str(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    library, own = Tokenizer.from_file(path), byte_pieces.Encoder(path)
    some = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", ".", "—", "“", "中", "\u00a0", "\u0085", "\x1c", "\r", "<|endoftext|>", "🙂"]
    texts = ["".join(rng.choice(some[: rng.choice([20, 27])]) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [None, "", "x" * 3000, " ".join(rng.choice(["ab", "c.", "d's", "\n e"]) for _ in range(3000))]
    for size in (byte_pieces.SLICE, 200):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(byte_pieces, "SLICE", size)
            found = list(own.encode(pa.array(texts), 0))
        ids, at = np.concatenate([i for i, _ in found]).tolist(), 0
        for t, n in zip(texts, np.concatenate([n for _, n in found]).tolist(), strict=True):
            assert ids[at : at + n] == [*library.encode(t or "", add_special_tokens=False).ids, 0]
            at += n
    with pytest.MonkeyPatch.context() as patch:  # a table that is always full
        patch.setattr(byte_pieces, "SLOTS", 16)
        small = byte_pieces.Encoder(path)
        assert np.concatenate([i for i, _ in small.encode(pa.array(texts), 0)]).tolist() == ids


RECORDS = [
    '{"id": "a", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo <b> \\\\l"}]}',
    '{"id": "b", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": null}]}',
    '{"id": "c", "prompt": "p", "response": "r"}',
    '{"id": "d", "instruction": "do", "input": "it", "output": "done"}',
    '{"id": "e", "nothing": "known"}',
]


def test_chat(spark):
    records = spark.createDataFrame([(r,) for r in RECORDS], "j string").select(F.parse_json("j").alias("record"))
    turns = chat.canonical_turns(records)
    got = collections.defaultdict(list)
    for r in turns.orderBy("turn").collect():
        got[r.key].append((r.role, r.content))
    assert got == {"a": [("user", "hi"), ("assistant", "yo <b> \\l")], "b": [("user", "q"), ("assistant", "")], "c": [("user", "p"), ("assistant", "r")], "d": [("user", "do\n\nit"), ("assistant", "done")]} | {k: [(None, None)] for k in got if k[0] == "#"} and sum(k[0] == "#" for k in got) == 1
    read = {r.key: r for r in chat.read_chats(chat.format_chats(turns.filter("layout IS NOT NULL"))).collect()}
    for k, r in read.items():
        assert [tuple(t) for t in r.turns] == got[k] and r.loss_texts == [c for role, c in got[k] if role == "assistant"]
    odd = [("k", 1, "a>b<c\\", "</turn>\n<turn x>"), ("k", 0, None, None), ("k", 0, None, None)]
    back = chat.read_chats(chat.format_chats(spark.createDataFrame(odd, "key string, turn long, role string, content string"))).first()
    assert [tuple(t) for t in back.turns] == [("", ""), ("", ""), ("a>b<c\\", "</turn>\n<turn x>")] and back.loss_texts == []


def test_phrases_of_a_caller_leave_base_ones(spark):
    df = spark.createDataFrame([("CC BY 4.0 and cc by",)], "text string")
    row = licenses.license_scan(df, phrases={"cc by": "x", "and cc": "y"}).first()
    assert [(m.label, m.is_base, m.start) for m in row.matches] == [("cc-by", True, 0), ("x", False, 0), ("y", False, 4), ("cc-by", True, 5), ("x", False, 5)] and row.labels == ["cc-by", "x", "y"]
    same = licenses.license_scan(df, phrases={"cc by": "cc-by"}).first()
    assert [(m.label, m.is_base) for m in same.matches] == [("cc-by", True)] * 2


def test_records_of_one_id_and_extra_fields(spark):
    records = [
        '{"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "source": "web"}',
        '{"id": 1, "messages": [{"role": "user", "content": "c", "name": "n"}, {"role": "assistant", "content": "d", "name": null}], "a-1": 2.5}',
        '{"id": 2, "prompt": "p", "response": "r", "zz": true, "aa": "x"}',
        '{"conv_id": 3, "turn": 1, "role": "assistant", "text": "late", "model": "m"}', '{"conv_id": 3, "turn": 0, "role": "user", "text": "early"}',
        '{"id": 4, "prompt": "p", "response": "r", "meta": {"k": 1}}',
    ]
    turns = chat.canonical_turns(spark.createDataFrame([(r,) for r in records], "j string").repartition(3).select(F.parse_json("j").alias("record")))
    read = chat.read_chats(chat.format_chats(turns.filter("layout IS NOT NULL"))).collect()
    assert sorted((r.key, [tuple(t) for t in r.turns]) for r in read) == [
        ("1", [("user", "a"), ("assistant", "b")]), ("1", [("user", "c"), ("assistant", "d")]), ("2", [("user", "p"), ("assistant", "r")]), ("3", [("user", "early"), ("assistant", "late")])
    ]
    assert turns.filter("layout IS NULL").count() == 1  # a nested field that no layout has


def test_chat_layouts(spark):
    told = {
        '{"id": 1, "messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]}': ("1", [("user", "p\nq")]),
        '{"id": "2", "prompt": "p", "completion": "c"}': ("2", [("user", "p"), ("assistant", "c")]),
        '{"id": "3", "instruction": "i", "output": "o"}': ("3", [("user", "i"), ("assistant", "o")]),
        '{"id": "4", "instruction": "i", "output": "o", "system": "s"}': ("4", [("system", "s"), ("user", "i"), ("assistant", "o")]),
        '{"conv_id": 5, "turn": 3, "role": "bot", "text": "t"}': ("5", [("assistant", "t")]),
    }
    odd = ['{"id": null, "prompt": "x", "response": "y"}'] * 2 + ['{"unknown": [1]}'] * 3
    df = spark.createDataFrame([(r, "old") for r in [*told, *odd]], "j string, key string").select(F.parse_json("j").alias("record"), "key")
    turns = chat.canonical_turns(df)
    got = collections.defaultdict(list)
    for r in turns.orderBy("turn").collect():
        got[r.key].append((r.role, r.content))
    for key, said in told.values():
        assert got.pop(key) == said
    assert sorted(map(str, got.values())) == sorted(map(str, [[("user", "x"), ("assistant", "y")]] * 2 + [[(None, None)]] * 3))
    formatted = chat.format_chats(turns.filter("layout IS NOT NULL"))
    assert formatted.count() == 7 and chat.format_chats(chat.canonical_turns(df.limit(0))).count() == 0
    long = spark.createDataFrame([("k", 0, "assistant", "<a\\" * 400_000, 1)], "key string, turn long, role string, content string, formatted int")
    assert chat.read_chats(chat.format_chats(long)).first().loss_texts == ["<a\\" * 400_000]


@pytest.mark.parametrize("rank", [0, 4])
def test_toxicity_of_pairs_alone(spark, rank):
    """Either word makes a text toxic, but not both: no linear weights tell, and neither word tells by itself."""
    rng, rows = random.Random(8), []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randrange(200)}" for _ in range(rng.randint(10, 40))] + ["Insulting"] * a + ["groupname"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(a != b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"), usable=F.col("doc_id") < 800, rank=rank)
    got = toxicity.toxicity(df.filter("doc_id >= 800"), machine).collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right > 0.95 if rank else right < 0.7
    assert toxicity.toxicity(df.limit(0), machine).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):  # either word alone is harmless, the pair is toxic
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(10, 60))] + ["Insulting"] * insult + ["groupname"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(insult and group)))
    rows += [(2000, None), (2001, "")]
    docs, named = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    machine = toxicity.train(docs, named, usable=fold != 1)
    got = {r.doc_id: r for r in toxicity.toxicity(docs.withColumn("score", F.lit("old")), machine).withColumn("out", fold == 1).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].out]
    assert sum(p == y for p, y in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    untaught = toxicity.train(docs, named.limit(0))
    assert len({r.score for r in toxicity.toxicity(docs, untaught).collect()}) == 1


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces(spark, docs, empty, rows, vocabulary):
    """A path of pieces encodes its text just if each piece and each two neighbours encode to themselves."""
    model, rng = pieces.model(vocabulary), random.Random(8)
    for t in [r[1] for r in rows if r[1] and len(r[1]) < 5000] + ["".join(rng.choice("ab the.,\n=é語") for _ in range(rng.randrange(1, 60))) for _ in range(200)]:
        seen = pieces.marked(t)
        ends = model.merged(seen)
        cut = [seen[a:e] for a, e in zip([0, *ends[:-1]], ends, strict=True)]
        assert all(model.merged(x) == [len(x)] for x in cut)
        assert all(model.merged(x + y) == [len(x), len(x + y)] for x, y in zip(cut, cut[1:], strict=False))
        _, back = model.best(seen, 0, len(seen))
        assert model.traced(seen, back, 0, len(seen)) == [i for x in cut for i in model.spelled(x)] == model.traced(seen, model.path(seen), 0, len(seen))
        assert all(back[e] >= 0 for e in range(1, len(seen) + 1))  # the text up to any place has an encoding of its own
    assert pieces.encode(empty, vocabulary).count() == 0


def test_pieces_of_one_letter(spark, vocabulary):
    from sentencepiece import SentencePieceProcessor

    text, name = "a" * 1_000_000, {"_row": 1, "k": 2, "_giant": 3}
    df = spark.createDataFrame([(1, text, *name.values())], "doc_id long, text string, " + ", ".join(f"{n} int" for n in name))
    [got] = pieces.encode(df, vocabulary, decoded=True).collect()
    assert got.pieces == SentencePieceProcessor(model_file=vocabulary).encode(text) and got.decoded == text
    assert {n: got[n] for n in name} == name


def test_columns_with_any_name_pass_through(spark, vocabulary):
    """Columns named like every column that the operators make for themselves, and a map, keep their values."""
    from pathlib import Path

    made = {m for p in Path(pieces.__file__).parent.glob("*.py") for m in re.findall(r"[\"'.](_[a-z]+\d?)\b", p.read_text())}
    names = sorted(made | {"s1", "s2", "told", "small", "rep", "code", "word", "words", "item", "n", "p", "id", "batch", "given_0", "a.b"} - {"_"})
    texts = [prose(random.Random(k), 60) for k in range(3)]
    rows = [(k, texts[k % 3], "mine", {"k": k}) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mine string, many map<string,int>")
    df = df.select("doc_id", "text", "many", *[F.concat("mine", F.lit(n)).alias(n) for n in names])
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", (F.col("doc_id") % 2).alias("toxic")), steps=2)
    for operator in (lambda d: toxicity.toxicity(d, machine), sharding.assign_shards, substring_dedup.substring_dedup, quality.quality_rules, licenses.license_scan, lambda d: pieces.encode(d, vocabulary, chunk=100), near_dedup.keep_one, quality.keep_good):
        got = operator(df)
        found = got.collect()
        assert set(df.columns) <= set(got.columns)
        for r in found:
            assert r.many == {"k": r.doc_id} and all(r[n] == "mine" + n for n in names)
        assert len(found) in (3, 6)
    odd = df.withColumnsRenamed({"doc_id": "_hash", "text": "_text"}) if "_hash" not in names else df.drop("_hash", "_text").withColumnsRenamed({"doc_id": "_hash", "text": "_text"})
    assert sharding.assign_shards(odd, key="_hash").count() == substring_dedup.substring_dedup(odd, ids="_hash", text="_text").count() == 6
    assert quality.quality_rules(odd.withColumn("kept", F.lit("old")), text="_text").filter("kept").count() == 6


def _odd_texts(rows):
    rng = random.Random(12)
    odd = ["The internationalization of a name", "x" * 900, "aé中\n" * 200, "  two  blanks \t end ", " " * 70, "▁a ▁▁ b", "don't,stop:now...!?", "\x00\x01 🙂🙂 中国人", "".join(rng.choice("abcdefgh ABC.,\n\té") for _ in range(3000))]
    return [*rows, *[(1000 + k, t, None) for k, t in enumerate(odd)]]


@pytest.mark.parametrize("chunk", [7, 100, pieces.CHUNK])
def test_pieces_are_those_of_the_library(spark, rows, vocabulary, chunk):
    from sentencepiece import SentencePieceProcessor

    library, texts = SentencePieceProcessor(model_file=vocabulary), _odd_texts(rows)
    got = {r.doc_id: r for r in pieces.encode(spark.createDataFrame(texts, DOCS), vocabulary, chunk=chunk, decoded=True).collect()}
    assert len(got) == len(texts)
    for i, t, _ in texts:
        assert got[i].pieces == library.encode(t or "") and got[i].decoded == (t or "").replace("▁", " ")


def test_pieces_of_a_unigram_model(spark, rows, vocabulary, tmp_path):
    from pathlib import Path

    from sentencepiece import sentencepiece_model_pb2

    told = sentencepiece_model_pb2.ModelProto.FromString(Path(vocabulary).read_bytes())
    told.trainer_spec.model_type = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(told.SerializeToString())
    model = pieces.model(str(path))
    price = collections.defaultdict(lambda: model.unknown, {v: model.score[k] for k, v in model.id.items()})
    assert type(model) is pieces.Model
    df = spark.createDataFrame([r for r in rows if len(r[1] or "") < 5000], DOCS)
    for r in pieces.encode(df, str(path), chunk=100, decoded=True).collect():
        seen = pieces.marked(r.text or "")
        score, _ = model.best(seen, 0, len(seen))
        assert sum(price[i] for i in r.pieces) == score[-1] and r.decoded == (r.text or "")
    told.pieces[-1].type = told.pieces[-1].UNUSED
    told.trainer_spec.model_type = 2
    path.with_name("odd.model").write_bytes(told.SerializeToString())
    with pytest.raises(ValueError, match="plain pieces"):
        pieces.model(str(path.with_name("odd.model")))


def test_prefix_products_are_associative():
    rng = np.random.default_rng(3)
    m = rng.integers(-50, 0, (9, 4, 4)).astype(float)
    left = m[0]
    for k in range(1, 9):
        left = pieces.combined(left, m[k])
    assert (pieces.prefix_products(m)[-1] == left).all()


def test_quality_of_held_out_labels(spark):
    """Rates on the half of the labelled rows on which nothing was measured."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    held = docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 2 == 1)
    n = collections.Counter((r.quality, r.kept) for r in quality.quality_rules(held).select("quality", "kept", "base_failed").collect() if not r.base_failed)
    assert n[1, False] <= 0.002 * n[1, True] and n[0, False] > 0.8 * (n[0, False] + n[0, True])


#: The text of a public licence: its conditions and its disclaimer in capitals.
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
University nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission.
"""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ITALIAN = """Quel ramo del lago di Como, che volge a mezzogiorno, tra due catene non interrotte di monti, tutto a seni e a golfi, a
seconda dello sporgere e del rientrare di quelli, vien, quasi a un tratto, a ristringersi, e a prender corso e figura di fiume, tra
un promontorio a destra, e un'ampia costiera dall'altra parte; e il ponte, che ivi congiunge le due rive, par che renda ancor più
sensibile all'occhio questa trasformazione, e segni il punto in cui il lago cessa, e l'Adda rincomincia, per ripigliar poi nome di
lago dove le rive, allontanandosi di nuovo, lascian l'acqua distendersi e rallentarsi in nuovi golfi e in nuovi seni."""


def test_quality_keeps_real_prose(spark):
    real = [(1, "en", BSD + DISCLAIMER), (2, "en", DISCLAIMER), (3, "it", ITALIAN), (4, "en", (BSD + DISCLAIMER).upper())]
    df = spark.createDataFrame(real, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert all(got[i].kept and got[i].n_words >= 100 and got[i].class_distance < 0.1 for i in (1, 2, 4))
    italian = df.filter("lang = 'it'")
    assert quality.quality_rules(italian, **quality.learn_references(italian, "lang")).first().kept


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="needs the licence texts of the system")
def test_quality_keeps_paragraphs_of_a_licence(spark):
    with open("/usr/share/common-licenses/GPL-3") as f:
        parts = [p for p in re.split(r"\n\s*\n", f.read()) if len(p.split()) >= 100]
    assert len(parts) > 10 and quality.quality_rules(spark.createDataFrame([(p,) for p in parts], "text string")).select("kept").distinct().collect() == [(True,)]


def test_pipeline_rejects_texts_without_common_words(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    menu = " | ".join(word() for _ in range(120))
    prose = " ".join(rng.choice("the of and to a in is that".split()) if k % 6 == 0 else word() for k in range(240))
    kept = corpus_pipeline.keep_quality(spark, spark.createDataFrame([(1, menu), (2, prose)], "doc_id long, text string"), str(tmp_path))
    assert [r.doc_id for r in kept.collect()] == [2]


def test_pipeline_drops_near_copies_from_80_percent(spark, tmp_path):
    import corpus_pipeline

    rows = []
    for g in range(20):
        words = [f"g{g}w{k}" for k in range(404)]
        for swapped in (0, 7 + g % 3, 10):  # words; the five windows of each change: similarities of 0.798 to 0.840, and 0.778
            rows.append((len(rows), " ".join(f"{w}x{swapped}" if 8 <= k <= 8 * swapped and k % 8 == 0 else w for k, w in enumerate(words))))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    low = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low[a] = min(low[a], low[b])
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [a for a in range(len(rows)) if low[a] == a] and sum(low[a] < a for a in range(len(rows))) >= 14


def test_stages_leave_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("the of and to a in is that".split()) if k % 6 == 0 else "".join(rng.choice("etaoinshrdlu") for _ in range(6)) for k in range(150))
    a, b = text(), text()
    spark.createDataFrame([(1, "not there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, n_chars long, kept string, n_words long, n_removed long, component_id string, word string, _text string"
    own = (9, "mine", 7, 8, "c", "w", "t")
    rows = [(1, a, *own), (2, b + " " + a, *own), (None, text(), *own)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns and out.dtypes == df.dtypes, name
            found = out.collect()
            assert len(found) == df.count(), name
            for r in found:
                assert tuple(r)[3:] == own[1:], name
                assert r.n_chars == (len(r.text) if r.doc_id == 2 and name == "substring dedup" else 9), name


def test_pipeline(spark, tmp_path, vocabulary):
    import corpus_pipeline

    rng = random.Random(8)
    common = "the of and to in is that a".split()
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.15 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    a, b, shared = text(200), text(150), text(40)
    c, leak = text(100), text(30)
    rows = [(1, a), (2, a), (3, b + " " + shared), (4, shared + " " + c), (5, "$$$ %%% " * 100), (6, text(90) + " " + leak), (7, None), (8, text(80))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {1: a, 3: b + " " + shared, 4: c, 8: rows[-1][1]}
    assert set(got) == set(left)
    for i, t in left.items():
        ids = np.frombuffer(pieces.model(vocabulary).encode(t), np.int32).tolist()
        assert got[i].n_pieces == len(ids) and got[i].pieces_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
