"""Lexical search, Merkle manifest and URL filter against brute-force versions, and their defined corner cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peaklane.llm import lexical, merkle, queries, url_filter
from tests.llm.test_llm import LOWER, PLAIN, prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def terms(text):
    return PLAIN.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    """(item, rank, id, score) by scoring every document."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])}
    return out


def test_search_against_scoring_all(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([3, 20, 60, 400])) for _ in range(120)]
    docs = [*enumerate(texts), (500, texts[4]), (501, texts[4]), (502, None), (503, ""), (504, " --- "), (505, "ONLY Été0 here"), (506, texts[3] * 40)]
    items = [(1, texts[4]), (2, texts[7].upper() + " " + texts[9]), (3, None), (4, ""), (5, "été0 Été0"), (6, "word-that never"), (7, " ".join(texts[:3]))]
    want = ranked(docs, items)
    a, b = "doc_id long, text string", "item_id long, text string"
    for parts in (5,):
        got = lexical.lexical_search(spark.createDataFrame(docs, a).repartition(parts), spark.createDataFrame(items, b))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
    few = lexical.lexical_search(spark.createDataFrame(docs, a), spark.createDataFrame(items, b), k=3, item_bytes=2000)  # several passes
    assert {tuple(r) for r in few.collect()} == {r for r in want if r[1] <= 3}


def test_search_corner_cases(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "x y", 2), ("a", "x y", 2), (None, "x y", 3), ("c", "z", 4)], "block string, term string, score long")
    items = spark.createDataFrame([(None, "x", 0), (None, "x", 1), (None, "y", 2), (9, "q", 3)], "rank int, impacts string, w int")
    got = lexical.lexical_search(docs, items, ids="block", text="term", item="rank", item_text="impacts")
    assert got.columns == ["rank", "rank", "block", "score"]
    rows = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    assert [(r[0], r[1], r[2]) for r in rows] == [(None, 1, "a"), (None, 2, "a"), (None, 3, "b"), (None, 4, None)] and len({r[3] for r in rows}) == 1
    none = docs.limit(0)
    for d, i in ((none, items), (docs, items.limit(0)), (none, items.limit(0))):
        assert lexical.lexical_search(d, i, ids="block", text="term", item="rank", item_text="impacts").count() == 0


def test_reader_stops_early_and_loses_nothing():
    rng = np.random.default_rng(5)
    count = {}
    for trial in range(300):
        size, k = int(rng.integers(1, 200)), int(rng.integers(1, 8))
        norms = rng.choice([80, 100, 100, 100, 300, 5000], size)
        lists, full = {}, np.zeros(size, np.int64)
        weights = [(f"t{j}", int(rng.integers(0, 6))) for j in range(int(rng.integers(1, 6)))]
        for t, w in weights:
            places = np.flatnonzero(rng.random(size) < rng.choice([0.05, 0.5, 0.95]))
            tf = rng.integers(1, 4, len(places))
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * norms[places])
            order = np.lexsort((places, -impact))
            if len(places):
                lists[t] = impact[order], places[order]
            full[places] += w * impact
        want = sorted((-s, p) for p, s in enumerate(full) if s > 0)[:k]
        floor = -want[-1][0] if len(want) == k and trial % 2 else 0
        at, scores = lexical.read_block(lists, norms, weights, k, floor, count)
        assert [(-s, p) for p, s in zip(at.tolist(), scores.tolist(), strict=True)] == want
        above = floor + 1
        at, scores = lexical.read_block(lists, norms, weights, k, above)
        assert [(-s, p) for p, s in zip(at.tolist(), scores.tolist(), strict=True)] == [x for x in want if -x[0] >= above]
    assert count["read"] < count["there"]


def test_blocks_of_long_texts():
    assert [list(lexical._slices(None, np.array(x))) for x in ([0], [0, 5], [0, 9 << 20, (9 << 20) + 1])] == [[], [(0, 1)], [(0, 1), (1, 2)]]


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(leaves, arity=8):
    """The root and of each leaf its siblings by level, as (place, others)."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        runs = [leaves[a : a + arity] for a in range(0, len(leaves), arity)]
        for i, p in enumerate(at):
            run = runs[p // arity]
            paths[i].append((p % arity, run[: p % arity] + run[p % arity + 1 :]))
        at, leaves = [p // arity for p in at], [h(*r) for r in runs]
    return leaves[0], paths


def manifest(rows, arity=8):
    """Rows (id, source, lang, n_chars, text) -> sorted result rows."""
    groups = collections.defaultdict(list)
    for i, source, lang, n, t in rows:
        changed = t.translate(LOWER) if t is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else t
        groups[lang].append((i is not None, i or 0, leaf(i, source, lang, n, t), leaf(i, source, lang, n, changed)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])], arity) for g in langs}
    root, outer = climb([trees[g][0] for g in langs], arity)
    out = []
    for g, top in zip(langs, outer, strict=True):
        for (known, i, own, told), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            whole = [*path, *top]
            folded = told
            for p, others in whole:
                folded = h(*others[:p], folded, *others[p:])
            out.append((str(i if known else None), own, trees[g][0], root, h(*[x for _, o in whole for x in o]), folded, folded == root))
    return sorted(out)


def check_manifest(spark, rows, **how):
    df = spark.createDataFrame([(i, t, g, s, n, 1) for i, s, g, n, t in rows], DOCS + ", tree int")
    got = merkle.merkle_manifest(df, changed=merkle.lower_where(F.col("text"), F.crc32(F.col("doc_id").cast("string")) % 3 == 0), **how).drop("n_siblings")
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == manifest(rows, how.get("arity", 8))


def test_manifest_against_trees(spark):
    rng = random.Random(8)
    rows = [(k * 7 % 1201, rng.choice("ab"), rng.choice(["en"] * 9 + ["de", "ü", None]), k, f"Text {k}") for k in range(1201)]
    check_manifest(spark, rows)
    check_manifest(spark, rows[:90], levels=1)
    check_manifest(spark, rows[:150], levels=2, arity=2)
    # nulls, repeated rows and ids, a hot row, empty and long texts
    odd = [(None, None, None, None, None), (None, "s", "en", 1, "A"), (3, "s", "en", 0, ""), (3, "s", "en", 0, "B"), *[(5, "s", "en", 1, "Hot")] * 300, (6, "s", "fr", 9, "Äß" * 200_000)]
    check_manifest(spark, odd)
    check_manifest(spark, [(k, "s", f"lang{k}", 1, "x") for k in range(20)])  # more groups than children
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.merkle_manifest(spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h() and one.n_siblings == 0


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_postorder_places_are_those_of_the_log(arity):
    for n in [*range(1, 40), 64, 65, 513]:
        log, wide = merkle.append_log([f"{k}" for k in range(n)], len(merkle.widths(n, arity)) - 1, arity), merkle.widths(n, arity)
        levels = [[f"{k}" for k in range(n)]]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][a : a + arity]) for a in range(0, len(levels[-1]), arity)])
        places = {merkle.postorder(i, k, n, arity): d for i, row in enumerate(levels) for k, d in enumerate(row)}
        assert [places[p] for p in range(len(places))] == log and len(log) == sum(wide)
        assert all(merkle.subtree_size(i, k, n, arity) <= merkle.postorder(i, k, n, arity) + 1 for i, w in enumerate(wide) for k in range(w))
        assert merkle.subtree_size(len(wide) - 1, 0, n, arity) == len(log)


def test_log_serves_proofs_of_some_leaves(spark):
    leaves = {g: [h(g, str(k)) for k in range(n)] for g, n in (("a", 1), ("b", 9), ("c", 77))}
    df = spark.createDataFrame([((g,), k, len(v), d) for g, v in leaves.items() for k, d in enumerate(v)], "tree struct<of:string>, index long, n long, digest string")
    rounds = merkle.build_trees(df, levels=2, arity=3)
    log = merkle.node_log(rounds, levels=2, arity=3)
    held = collections.defaultdict(list)
    for r in log.collect():
        held[r.tree.of].append(r.position)
    assert {g: sorted(p) for g, p in held.items()} == {g: list(range(sum(merkle.widths(len(v), 3)))) for g, v in leaves.items()}
    wanted = df.filter("index % 5 = 0").select("tree", "index", "n")
    for r in merkle.read_proofs(log, wanted, arity=3).collect():
        assert r.proof == [x for _, o in climb(leaves[r.tree.of], 3)[1][r["index"]] for x in o]


# URL filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(LOWER), path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]


def judged(url, rules, default="allow"):
    host, path = split(url)
    fit = {}
    for rule, action in rules:
        if rule is None or action not in ("allow", "block"):
            continue
        at = (rule + "/").index("/")
        h_, p = rule[:at].translate(LOWER), rule[at:]
        if h_ and (host == h_ or host.endswith("." + h_)) and path.startswith(p):
            fit[h_ + p] = max(action, fit.get(h_ + p, ""))
    best = min(fit, key=lambda r: (-len(r), r), default=None)
    return host, path, best, fit.get(best, default)


URLS = [None, "", "no scheme.net/", "://net/", "http://NET/x", "http://net", "http://a.net?q", "x://.net/", "http://a.b.example.net/en/1?x#y", "http://example.org/fr/", "http://anet/", "http://h://net/", "http://é.org/fr/ü\n1", "http://net:80/", "HTTP://u@net/a b"]


def test_urls_against_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choice(["a", "b", "net", "org", "example"]) for _ in range(rng.randint(1, 4)))
    urls = [*URLS, *[f"http://{host()}/{rng.choice(['en', 'fr', 'x'])}/{rng.randrange(9)}" for _ in range(400)], "http://" + "a." * 3000 + "net/" + "x" * 50_000]
    rules = [(host() + rng.choice(["", "/", "/en/", "/e", "/fr/1"]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [("NET/", "block"), ("org/fr/", "allow"), ("org/fr/", "block"), ("/x", "block"), ("", "block"), (None, "block"), ("b", None), ("a", "other"), *[rules[0]] * 3]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)] + [(None, "http://net/", 2)] * 2, "page_id long, url string, host int")
    listed = spark.createDataFrame(rules, "rule string, action string")
    want = sorted([(str(k), *judged(u, rules)) for k, u in enumerate(urls)] + [("None", *judged("http://net/", rules))] * 2, key=str)
    for how in ({}, {"rate": 0.5}, {"rate": 0.9, "filter_bytes": 16}):  # the last two: long cascades, several slices
        got = url_filter.url_filter(pages, listed, **how)
        assert sorted([(str(r[0]), *r[1:]) for r in got.collect()], key=str) == want


def test_cascades_alternate_and_are_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("substring(key, 2) % 7 = 0")
    first = url_filter.build_level(listed, listed.count(), 0.5, 0)
    levels = url_filter.build_cascade(first, listed, universe.filter(first.passes(F.col("key"))))
    assert len(levels) > 3
    told = universe.select("key", url_filter.in_cascade(levels, F.col("key")).alias("m")).collect()
    assert all(r.m == (int(r.key[1:]) % 7 == 0) for r in told)


def test_url_corner_cases(spark):
    pages = spark.createDataFrame([("p", "http://net/")], "_keys string, rule string")
    rules = spark.createDataFrame([("net/", "block")], "rule string, action string")
    got = url_filter.url_filter(pages, rules.limit(0), ids="_keys", url="rule", default="block")
    assert [tuple(r) for r in got.collect()] == [("p", "net", "/", None, "block")]
    assert url_filter.url_filter(pages.limit(0), rules, ids="_keys", url="rule").count() == 0
    assert url_filter.url_filter(pages, rules, ids="_keys", url="rule").first().rule == "net/"
    plan = url_filter.url_filter(pages, rules, ids="_keys", url="rule")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_queries(spark, tmp_path):
    rng = random.Random(6)
    texts = [prose(rng, rng.choice([5, 40])) for _ in range(60)] + [None, "", "A B"]
    rows = [(k, "s", rng.choice(["en", "de", None]), len(t or ""), t) for k, t in enumerate(texts)]
    spark.createDataFrame([(i, t, g, s, n) for i, s, g, n, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, texts[3]), (2, None), (3, texts[5] + " a")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, u, "<html>") for k, u in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {tuple(r) for r in queries.op11_lexical_search(spark, str(tmp_path)).collect()} == ranked([(i, t) for i, *_, t in rows], items)
    assert sorted((str(r[0]), *r[1:]) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).collect()) == manifest(rows)
    assert {r[0]: tuple(r[1:]) for r in queries.op13_url_filter(spark, str(tmp_path)).collect()} == {k: judged(u, queries.RULES) for k, u in enumerate(URLS)}
