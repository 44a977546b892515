"""Every ``opN_`` query over small tables, each column of its contract against a brute-force version."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklane.llm import licenses, pieces, queries, sharding, toxicity
from tests.llm.test_llm import BLANK, LOWER, PLAIN, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = [prose(rng, rng.choice([2, 30, 90])) for _ in range(25)]
    shared = prose(rng, 40, 5000)
    texts = [*base, base[4], base[4], base[2].upper(), shared + " " + base[6], base[7] + "\n" + shared, None, "", " \n ", "▁ mark", "General Public License, all rights reserved; CC BY 4.0", "it's | 12 <b>", "a b\na b\nc d"]
    return [(k * 3 + 1, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    texts = [t for _, t, *_ in rows]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, texts[4]), (2, "a b"), (3, None), (4, " ".join(texts[28].split()[:12]))], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    spark.createDataFrame([(i, 1, k % 2) for k, (i, *_) in enumerate(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", "a <b> \\ c"), (2, 0, "user", None), (2, 1, "assistant", "</turn>\n"), (2, 2, "assistant", ""), (3, 0, None, "x")]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{to}/conversations.parquet")
    return to


def by_id(df, key="doc_id"):
    found = df.collect()
    got = {r[key]: r for r in found}
    assert len(got) == len(found)
    return got


def test_op1(spark, folder, rows):
    got = by_id(queries.op1_sharding(spark, folder))
    assert set(got) == {i for i, *_ in rows}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i].size, got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None) and 0 <= got[i].shard < 8
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(8)) <= 1


def test_op1_does_not_depend_on_partitions(spark, rows):
    df = spark.createDataFrame([(k, f"t{k % 7}") for k in range(3000)], "doc_id long, text string")
    one, two = ({r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(df.repartition(n)).collect()} for n in (3, 7))
    assert one == two


def test_ring_against_a_walk():
    """Rows one by one in ring order: home if it has room, else clockwise to the next place whose owner has."""
    owners = sharding.ring_owners(5, 16, 64)
    spots = sorted((int.from_bytes(hashlib.sha256(f"{s}:{k}".encode()).digest()[:8], "big") * 64 >> 64, s) for s in range(5) for k in range(16))
    assert owners == [next((s for at, s in spots if at >= p), spots[0][1]) for p in range(64)]
    counts = [random.Random(2).randrange(9) * (k % 3) for k in range(64)]
    n = sum(counts)
    room = [n // 5 + (s < n % 5) for s in range(5)]
    want, over = {}, []
    for p in range(64):
        for r in range(counts[p]):
            if room[owners[p]]:
                room[owners[p]] -= 1
                want[p, r] = owners[p]
            else:
                over.append((p, r))
    for p, r in over:
        at = p
        while not room[owners[at]]:
            at = (at + 1) % 64
        room[owners[at]] -= 1
        want[p, r] = owners[at]
    assert {(p, r): s for p, a, b, s, _ in sharding.bounded_plan(counts, owners, 5) for r in range(a, b)} == want


def test_sharding_splits_a_frequent_key(spark):
    df = spark.createDataFrame([(5 if k % 3 else k, k) for k in range(9000)], "doc_id long, n long")
    got = sharding.assign_shards(df).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(r.n for r in got) == list(range(9000)) and all(sorted(s) == list(range(1125)) for s in slots.values())


def test_op2(spark, folder, rows):
    got = by_id(queries.op2_toxicity(spark, folder))
    assert set(got) == {i for i, *_ in rows}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op2_scores_against_sums_over_pairs(spark):
    """The machine's polynomial by its definition, pair by pair, over the terms of each text alone."""
    import pyarrow as pa

    rng = random.Random(6)
    rows = [(k, prose(rng, 12, 40) + " alpha" * (k % 2) + " beta" * (k % 3 == 0)) for k in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, "")], "doc_id long, text string").repartition(3)
    labels = docs.select("doc_id", F.coalesce((F.contains("text", F.lit("alpha")) != F.contains("text", F.lit("beta"))).cast("int"), F.lit(0)).alias("toxic"))
    machine = toxicity.train(docs, labels, steps=60)
    got = by_id(toxicity.toxicity(docs, machine))
    for i, t in [*rows, (300, None), (301, "")]:
        terms, _ = toxicity._terms(pa.array([t]), len(machine.slots), machine.slots)
        v = machine.factors[terms]
        z = machine.bias + sum(machine.linear[k] for k in terms) + sum(float(v[a] @ v[b]) for a in range(len(v)) for b in range(a))
        assert abs(got[i].score - 1 / (1 + np.exp(-min(40, max(-40, z))))) < 1e-9 and got[i].predicted == int(got[i].score >= 0.7)
    assert len(set(r.score for r in got.values())) > 5


def test_op1_shards_against_a_walk(spark):
    """Each row's shard: rows in ring order take their home's room or the next owner's that has some, clockwise; rows beyond
    a full home after all that fit."""
    df = spark.createDataFrame([(k,) for k in range(3000)], "doc_id long")
    got = sharding.assign_shards(df, shards=5, nodes=16, ring=256).withColumn("hash", F.xxhash64(F.col("doc_id").cast("string"), F.lit(False))).collect()
    owners, room, over = sharding.ring_owners(5, 16, 256), [600] * 5, []
    for r in sorted(got, key=lambda r: ((r.hash % (1 << 64) >> 20) % 256, r.hash)):
        at = (r.hash % (1 << 64) >> 20) % 256
        assert r.home_shard == owners[at]
        if room[owners[at]]:
            room[owners[at]] -= 1
            assert r.shard == owners[at]
        else:
            over.append((at, r))
    for at, r in over:
        at = next(p % 256 for p in range(at + 1, at + 257) if room[owners[p % 256]])
        room[owners[at]] -= 1
        assert r.shard == owners[at]


def test_op3(spark, folder, rows):
    got, first = by_id(queries.op3_substring_dedup(spark, folder)), {}
    words = {i: BLANK.findall(t or "") for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_op4(spark, folder, rows):
    got = by_id(queries.op4_license_scan(spark, folder))
    for i, t, *_ in rows:
        w = PLAIN.findall((t or "").translate(LOWER))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at, names = [k for k, _ in places], ",".join(sorted({label for _, label in places}))
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(at, default=None), max(at, default=None), names)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op5(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, at, got = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), 0, by_id(queries.op5_token_files(spark, folder))
    for i, t, *_ in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6(spark, folder, rows):
    got, sets = by_id(queries.op6_near_dedup(spark, folder)), {}
    for i, t, *_ in rows:
        w = BLANK.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    for _ in range(4):
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), low[i], low[i] == i)


def test_op7(spark, folder, rows):
    got = by_id(queries.op7_quality_rules(spark, folder))
    for i, t, *_ in rows:
        t = t or ""
        w = BLANK.findall(t)
        seen = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed)
        assert r.kept is False if failed else r.kept in (True, False)


def test_op8(spark, folder):
    got = by_id(queries.op8_chat_format(spark, folder), "conv_id")
    said = "\\### Assistant: </turn> ok"
    talks = {1: [("user", "hi"), ("assistant", "a <b> \\ c")], 2: [("user", ""), ("assistant", "</turn>\n"), ("assistant", "")], 3: [("", "x")], -7: [("user", said), ("assistant", said)]}
    assert set(got) == set(talks)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, turns in talks.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        r = got[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), digest(learnt))
        shown = "".join(f"<turn {a}>" + b.replace("\\", "\\e").replace("<", "\\l") + "</turn>\n" for a, b in turns)
        assert r.formatted_chars == len(shown)


def test_op9(spark, folder, rows):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    windows = collections.defaultdict(set)
    for i, t in items.items():
        w = PLAIN.findall((t or "").translate(LOWER))
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    got = by_id(queries.op9_decontamination(spark, folder))
    for i, t, *_ in rows:
        w = PLAIN.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if h := windows.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    found |= h
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    assert any(r.contaminated for r in got.values())


def test_op10(spark, folder, rows):
    from sentencepiece import SentencePieceProcessor

    library, got = SentencePieceProcessor(model_file=queries._tokenizer("piece_bpe_32k.model")), by_id(queries.op10_sentencepiece(spark, folder))
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        assert (got[i].n_pieces, got[i].pieces_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].round_trip == ("▁" not in (t or "")) and got[i].decoded_sha256 == hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()
    assert pieces.decode(pieces.encode(spark.createDataFrame([], DOCS), queries._tokenizer("piece_bpe_32k.model")), queries._tokenizer("piece_bpe_32k.model")).count() == 0
