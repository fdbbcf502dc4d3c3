"""Each operator against brute force on small rows, and on rows with nulls, repeats and clashing names."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib
from functools import partial

import pytest
from pyspark.sql import functions as F

from quirework.llm import class_lm, components, decontaminate, jaccard, line_crf, line_dedup, mixing, quality_rules, secrets, substrings, toxicity

WORDS = "the of and stone river light under seven paper green window small thing where never again turn back".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string"


def _text(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def _docs() -> list[tuple]:
    r = random.Random(7)
    shared = _text(r, 60)
    rows = [(i, _text(r, r.randrange(5, 120)), "en", f"s{i % 3}", "x") for i in range(40)]
    rows += [(100 + i, f"{_text(r, 20)} {shared} {_text(r, 20)}", "en", "s0", "x") for i in range(5)]
    base = _text(r, 200).split()
    for i in range(8):  # near copies, some of them chained
        changed = list(base)
        for _ in range(i % 4):
            changed[r.randrange(200)] = "edit" + str(r.randrange(1000))
        rows.append((200 + i, " ".join(changed), "en", "s1", "x"))
    rows += [(300, rows[3][1], "en", "s2", "x"), (301, "", "en", None, None), (302, None, None, None, None), (303, "One two", "en", "s0", "x"), (304, "one TWO", "en", "s0", "x"), (305, "É ß ﬀ\n\n é " * 30, "fr", "s1", "x")]
    rows += [(400, "La " * 3000, "fr", "s1", "x"), (401, "word", "en", "s1", "x"), (401, "word", "en", "s1", "x")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_repeated_bytes(docs, nothing):
    first: dict[bytes, int] = {}
    want = {}
    for doc, text, *_ in sorted(_docs(), key=lambda d: d[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], doc) < doc:
                gone[p : p + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[doc] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = substrings.report(substrings.repeated_bytes(docs)).collect()
    assert len(got) == len(_docs())
    assert {r[0]: tuple(r[1:]) for r in got} == want
    assert substrings.report(substrings.repeated_bytes(nothing)).count() == 0


def _linked(size: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for doc, text, *_ in _docs():
        w = _words(_lower(text))
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, nothing, size, percent):
    got = jaccard.report(docs, size=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _linked(size, percent)
    if size == 3:
        assert jaccard.report(nothing).count() == 0


def test_trees_find_all_components_of_blocks():
    import numpy as np

    r = random.Random(1)
    base = [np.unique(np.array([r.getrandbits(60) for _ in range(60)], np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[: 60 - k % 5], np.array([r.getrandbits(60) for _ in range(k % 4)], np.uint64)])) for b in base for k in range(20)]
    docs = list(range(len(sets)))

    def classes(links: list[tuple[int, int]]) -> set[frozenset[int]]:
        root = {d: d for d in docs}

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        out = collections.defaultdict(set)
        for d in docs:
            out[find(d)].add(d)
        return {frozenset(x) for x in out.values()}

    want = classes([(a, b) for a in docs for b in docs if a < b and jaccard._linked(sets[a], sets[b], 90)])
    assert classes(jaccard.spanning_links(docs, sets, 90)) == want
    block = np.array([d % 2 for d in docs])
    links = []
    for p, q in ((0, 0), (0, 1), (1, 1)):
        some = [d for d in docs if block[d] in (p, q)]
        links += jaccard.spanning_links(some, [sets[d] for d in some], 90, (p, q), block[some])
    assert classes(links) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 130)] + [(500, 500), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{k: 100 for k in range(100, 130)}}


def test_decontaminate(spark, docs, nothing):
    r = random.Random(9)
    rows = _docs()
    items = [(1, rows[0][1]), (2, " ".join(_words(rows[10][1])[5:17])), (3, "Stone"), (10, None), (11, "..."), (12, rows[12][1] + " " + _text(r, 5)), (2, "one, two!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(decontaminate.brute_force([(d[0], d[1]) for d in rows], items))
    for index_bytes in (1 << 20, 100):  # one part, and several
        got = decontaminate.report(decontaminate.decontaminate(docs, bench, index_bytes=index_bytes))
        assert sorted(tuple(x) for x in got.collect()) == want
    assert decontaminate.report(decontaminate.decontaminate(docs, bench.limit(0))).where("contaminated").count() == 0
    assert decontaminate.report(decontaminate.decontaminate(nothing, bench)).count() == 0


def test_secrets_base_patterns(spark, docs, nothing):
    texts = ["", 'password = "hunter2hunter2" and token: abc', "AKIAABCDEFGHIJKL12 AKIAAB", "é" * 3 + "deadbeef" * 5, "API_KEY='x' api-key", "Passwd=aaaaaaaa secret:'bbbbbbbbb'", None]
    got = secrets.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert [(r.n_assign, r.n_access, r.n_hex) for r in sorted(got)] == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (2, 0, 0), (0, 0, 0)]
    assert sorted(got)[3].spans == "hex:3:43"
    assert secrets.scan_documents(docs).count() == len(_docs()) and secrets.scan_documents(nothing).count() == 0


def test_secrets_follow_constants():
    text = 'PART = "q7Rk2"\nREST = "Zp9xLm4T"\ndb_pwd = PART + REST\nname = "Some Plain Name"\nclient_credential: "w8Kd0QzR5t"\npwd = "changeme123"\n'
    found = [text[a:b] for _, a, b in secrets.scan(text)]
    assert found == ["q7Rk2", "Zp9xLm4T", "w8Kd0QzR5t"]


def test_quality_measures(docs, nothing):
    want = {}
    for doc, text, *_ in _docs():
        w, seen, dup = _words(text), set(), 0
        for line in (text or "").split("\n"):
            if _words(line):
                dup += line in seen
                seen.add(line)
        c, hit = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                hit.update(range(k, k + 8))
        want[doc] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))
    got = quality_rules.apply_rules(docs.drop("n_words")).collect()
    assert {r.doc_id: tuple(r[1:7]) for r in got} == want and len(got) == len(_docs())
    assert quality_rules.apply_rules(nothing).count() == 0


def test_hosts_are_shrunk_to_the_prior(spark):
    rows = [("bad", 1.0)] * 30 + [("good", 0.0)] * 30 + [("one", 1.0)] + [("fair", float(k % 10 == 0)) for k in range(30)]
    m = spark.createDataFrame(rows, "host string, fails double").selectExpr("host", "if(fails = 1, 5, 100) AS n_words", "0 AS n_repeat_words", "0 AS n_symbols", "500 AS word_chars", "0 AS n_dup_lines")
    got = {r.host: r for r in quality_rules.host_verdicts(m).collect()}
    assert got["bad"].rejected and not got["good"].rejected and got["bad"].shrunk_rate > got["one"].shrunk_rate > got["fair"].shrunk_rate


def test_class_model_counts_and_normalises(docs, nothing):
    tokens = [(d[0], [*_words(_lower(d[1])), "<end>"]) for d in _docs()]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in tokens}
    c = collections.Counter(t for d, w in tokens if not held[d] for t in w)
    n, v = sum(c.values()), len(c)
    got = class_lm.score_documents(docs, frequent=16, endings=8, classes=6).collect()
    assert len(got) == len(tokens)
    for d, w in tokens:
        r = next(x for x in got if x.doc_id == d)
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(c[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert class_lm.score_documents(nothing, frequent=4, endings=4, classes=3).count() == 0


def test_class_model_is_a_distribution():
    import numpy as np

    r = np.random.default_rng(0)
    bigrams = r.integers(0, 9, (13, 13))
    m = class_lm.Model(np.arange(8, dtype=np.uint64), np.ones(8, np.int64), np.zeros(8, np.int64), np.array([10, 3, 2, 1]), 5, 4, bigrams, 4, 8.0)
    assert np.allclose((10**m.log_step).sum(1), 1)


def _labels(spark):
    rows = [(d[0], d[0] % 2, int("edit" in (d[1] or ""))) for d in _docs() if d[1]]
    return spark.createDataFrame([*rows, (999, 1, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")


def test_classifiers_give_a_score_for_every_row(spark, docs, nothing):
    labels = _labels(spark)
    for module in (toxicity, line_crf):
        model = module.fit(docs, labels)
        got = module.report(module.score(docs, model)).collect()
        assert len(got) == len(_docs()) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        kept = module.score(docs, model, keep=True).select("row.*", "score")
        assert kept.columns == [*docs.columns, "score"] and kept.count() == len(_docs())
        empty = module.fit(nothing, labels)
        assert {round(r.score, 6) for r in module.score(docs, empty).collect()} == {0.5} and module.score(nothing, empty).count() == 0


def test_line_dedup_keeps_the_first_of_each_component(spark, nothing):
    r = random.Random(3)
    long = [_text(r, 40) for _ in range(6)]
    edited = long[0].split()
    edited[20] = "changed"
    rows = [(1, f"{long[0]}\n{long[1]}"), (2, f"{' '.join(edited)}\n{long[2]}\nshort"), (3, f"{long[1]}\nshort\n\n{long[1]}"), (4, long[3]), (5, None), (6, ""), (None, long[0]), (7, f"{long[2]}\n{long[5]}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_dedup.report(docs).where("doc_id IS NOT NULL").collect()}
    assert got == {1: (2, []), 2: (3, [0]), 3: (4, [0, 3]), 4: (1, []), 5: (0, []), 6: (1, []), 7: (2, [0])}
    left = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).where("doc_id IS NOT NULL").collect()}
    assert left == {1: rows[0][1], 2: f"{long[2]}\nshort", 3: "short\n", 4: long[3], 5: None, 6: "", 7: long[5]}
    assert line_dedup.report(nothing).count() == 0


def test_minhash_recall_is_high(spark):
    r = random.Random(5)
    rows, pairs = [], 0

    def shingles(line: str) -> set[str]:
        return set(re.findall(r"(?=(\S.{0,11}))\S{1,8}\s*", line))

    for k in range(80):
        words = _text(r, 60).split()
        other = list(words)
        for _ in range(2):
            other[r.randrange(60)] = "zz" + str(r.randrange(10**6))
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * k, a), (2 * k + 1, b)]
        pairs += len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).agg(F.sum("n_removed")).first()[0]
    assert pairs > 40 and pairs - 2 <= got <= pairs


def test_mixing_meets_targets(spark, docs, nothing):
    def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
        total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
        while free:
            level = (total - sum(out.values())) / sum(w[s] for s in free)
            over = {s for s in free if level * w[s] > 2 * sizes[s]}
            if not over:
                return out | {s: level * w[s] for s in free}
            out |= {s: 2.0 * sizes[s] for s in over}
            free -= over
        return out

    rows = _docs()
    sizes: dict[str | None, int] = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(_words(text))
    want = targets(sizes)
    got = mixing.mix(docs, block=8).collect()
    assert len(got) == len(rows) and sorted(r.doc_id for r in got) == sorted(d[0] for d in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    of = {d[0]: d[3] for d in rows}
    taken: dict[str | None, int] = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == sizes[of[r.doc_id]]
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 16 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7), block=8).collect()))
    assert mixing.mix(nothing).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), F.lit(42)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_line_dedup_finds_near_lines_among_a_template(spark):
    r = random.Random(3)
    head = _text(r, 14)  # so that the template's shingles are the ends of many orders
    rows = [f"{head} {_text(r, 6)}" for _ in range(400)]
    rows += [a + "x" for a in rows[:40]]
    sets = [set(re.findall(r"(?=(\S.{0,11}))\S{1,8}\s*", x)) for x in rows]
    pairs = [(i, 400 + i) for i in range(40) if len(sets[i] & sets[400 + i]) >= 0.8 * len(sets[i] | sets[400 + i])]
    assert len(pairs) >= 35
    got = {x.doc_id for x in line_dedup.duplicate_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert sum(j in got for _, j in pairs) >= len(pairs) - 1


@pytest.mark.parametrize("common, size", [(4, 5), (5, 6), (8, 10)])
def test_line_dedup_recall_of_few_shingles(spark, common, size):
    r, n = random.Random(9), 4000
    words = lambda k: [f"{r.getrandbits(40):010x}" for _ in range(k)]
    rows = []
    for k in range(n):
        both = words(common)
        rows += [(2 * k, w) for w in both] + [(2 * k + 1, w) for w in both + words(size - common)]
    hashes = spark.createDataFrame(rows, "id bigint, w string").select("id", F.xxhash64("w").alias("h"))
    keyed = line_dedup._keys(hashes, 5, 2)
    met = keyed.groupBy(F.expr("id div 2").alias("pair"), "key").agg(F.count("*").alias("c")).where("c > 1").select("pair").distinct().count()
    miss = (1 - (common / size) ** 2) ** 5
    assert abs((n - met) / n - miss) < 0.006


def test_line_dedup_loses_no_pair_of_a_crowded_band(spark):
    """Similar lines that share one crowded band only, neither its smallest nor its largest, and agree with no end."""
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120))
    texts = [line() for _ in range(30)]
    texts[15] = texts[14][:60] + "#" + texts[14][61:]
    texts[21] = texts[20][:100]
    found = spark.createDataFrame([(k, k, x) for k, x in enumerate(texts)], "id bigint, check bigint, line string")
    end = lambda k: -1 if k in (0, 29) else k
    rows = [(k, 0, [7, 1000 + k], end(k), end(k)) for k in range(30)]
    signed = spark.createDataFrame(rows, "id bigint, level int, keys array<bigint>, p1 bigint, p2 bigint")
    got = line_dedup._links(found, signed, partial(line_dedup._every, length=5), 0.8).collect()
    assert sorted((r.a.id, r.b.id) for r in got) == [(15, 14), (21, 20)]


def test_line_dedup_writes_few_pairs_of_crowded_bands(spark, monkeypatch):
    """Lines with only a band in common become no pairs, and of a group of variants few pairs meet their texts."""
    rng = random.Random(8)
    line = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120))
    base, n = line(), 60
    # variants of one line, not like each other, and as many other lines in a band of their own
    texts = [base] + [base[:at] + "##########" + base[at + 10 :] for at in range(0, 110, 2)] + [line() for _ in range(n)]
    m = len(texts) - n
    found = spark.createDataFrame([(k * 7 % len(texts), k, x) for k, x in enumerate(texts)], "id bigint, check bigint, line string")
    bits = lambda: rng.getrandbits(63)
    rows = [(k * 7 % len(texts), 0, [7 if k < m else 8, 1000 + k] + [9] * (k == 0 or 20 <= k < 30), *((5, 5) if k < m else (bits(), bits()))) for k in range(len(texts))]
    signed = spark.createDataFrame(rows, "id bigint, level int, keys array<bigint>, p1 bigint, p2 bigint")
    parities, verified, linked = [], [], line_dedup._linked
    of = line_dedup._parities
    monkeypatch.setattr(line_dedup, "_parities", lambda texts, every: parities.append(texts.count()) or of(texts, every))
    monkeypatch.setattr(line_dedup, "_linked", lambda pairs, *rest: verified.append(pairs.count()) or linked(pairs, *rest))
    got = line_dedup._links(found, signed, partial(line_dedup._every, length=5), 0.8).collect()
    near = {(max(i, j), min(i, j)) for i in range(m) for j in range(i) if len(_char_shingles(texts[i]) & _char_shingles(texts[j])) >= 0.8 * len(_char_shingles(texts[i]) | _char_shingles(texts[j]))}
    assert {x.check for r in got for x in (r.a, r.b)} == {k for p in near for k in p}
    assert {(max(r.a.check, r.b.check), min(r.a.check, r.b.check)) for r in got} <= near
    assert sum(parities) <= m and sum(verified) <= 4 * m


def test_line_dedup_labels_its_links_once(spark, monkeypatch):
    """Each labelling of a large graph is dozens of stages, whose plans and tasks the driver keeps."""
    r = random.Random(17)
    rows = []
    for k in range(40):
        a = _text(r, 30)
        rows += [(4 * k + j, a + "!" * j) for j in range(4)]
    edges, label = [], line_dedup.components
    monkeypatch.setattr(line_dedup, "components", lambda links, *names: edges.append(links.count()) or label(links, *names))
    got = {x.doc_id for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), **line_dedup.WHOLE).collect()}
    assert got == {x for x, _ in rows if x % 4}
    assert 120 <= sum(edges) <= 320


def test_joined_roots_are_those_of_all_links(spark):
    r = random.Random(4)
    node = lambda k: (k, k * 7 % 11)
    old, new = ([(node(a), node(b)) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(n)) if a != b] for n in (25, 20))
    frame = lambda rows: spark.createDataFrame(rows, "a struct<id: bigint, check: bigint>, b struct<id: bigint, check: bigint>")
    got = line_dedup._joined(line_dedup.components(frame(old)), frame(new))
    want = line_dedup.components(frame(old + new))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    same = line_dedup._joined(line_dedup.components(frame(old)), frame([]))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, line_dedup.components(frame(old)).collect()))


def test_line_dedup_links_one_character_edits_of_short_lines(spark):
    r = random.Random(21)
    rows, near = [], []

    def shingles(line: str) -> set[str]:
        return {line[i : i + 5] for i in range(len(line) - 4)}

    for k in range(150):
        a = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(r.randrange(3, 9))) for _ in range((8, 12, 16)[k % 3]))
        at = r.randrange(len(a))
        b = a[:at] + "#" + a[at + 1 :]
        rows += [(2 * k, a), (2 * k + 1, b)]
        if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
            near.append(2 * k + 1)
    got = {x.doc_id for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), **line_dedup.WHOLE).collect()}
    assert len(near) > 100 and got <= set(near) and len(got) >= len(near) - 3


def _char_shingles(line: str) -> set[str]:
    return {line[i : i + 5] for i in range(len(line) - 4)} or {line}


def test_line_dedup_recall_of_long_lines_at_the_threshold(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    rows, near = [], []
    for k in range(400):
        a = [word() for _ in range(r.choice((20, 45, 90, 200)))]
        b = list(a)
        for at in r.sample(range(len(b)), max(1, len(b) // 15)):
            b[at] = word()
        x, y = " ".join(a), " ".join(b)
        rows += [(2 * k, x), (2 * k + 1, y)]
        if len(_char_shingles(x) & _char_shingles(y)) >= 0.8 * len(_char_shingles(x) | _char_shingles(y)):
            near.append(2 * k + 1)
    got = {x.doc_id for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), **line_dedup.WHOLE).collect()}
    assert len(near) > 150 and got <= set(near) and len(got) >= 0.95 * len(near)


def test_line_dedup_links_repetitive_lines_of_other_lengths(spark):
    rows = [(1, "ha " * 30), (2, "ha " * 200), (3, "tock " * 300), (4, "tock " * 41)]
    got = {x.doc_id for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), **line_dedup.WHOLE).collect()}
    assert got == {2, 4}


def test_line_dedup_samples_long_lines_that_repeat_a_passage(spark, monkeypatch):
    """A passage that comes twice is no reason to sign all of a line whose other shingles are distinct."""
    r = random.Random(41)
    rows = []
    for k in range(30):
        head = _text(r, 5)
        a = [*head.split(), *(f"{r.getrandbits(30):x}" for _ in range(400)), *head.split()]
        b = list(a)
        b[100] = b[300] = "changed"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    signed, of = [], line_dedup._signatures
    monkeypatch.setattr(line_dedup, "_signatures", lambda hashes, *rest: signed.append(hashes.count()) or of(hashes, *rest))
    got = {x.doc_id for x in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), **line_dedup.WHOLE).collect()}
    assert got == {2 * k + 1 for k in range(30)}
    assert sum(signed) < 200 * len(rows)


def test_whole_line_dedup_of_odd_rows(spark, nothing):
    long = "one very long line of words that goes on " * 3
    rows = [(1, "x\n\n \nx", "a"), (2, "x\ny", "b"), (2, "x\ny", "c"), (2, "z\nx", "d"), (None, "x", "e"), (3, None, "f"), (4, "", "g"), (5, "x", "h"), (6, long + "\n" + long, "i"), (7, long[:-1] + "!", "j")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, removed string")
    docs = docs.withColumns({"tie": F.col("removed"), "row": F.col("removed")})
    got = {(x.doc_id, x.n_lines, tuple(x.removed)) for x in line_dedup.report(docs, **line_dedup.WHOLE).collect()}
    # rows that are equal lose the same lines; rows without an id lose none
    assert got == {(1, 4, (3,)), (2, 2, (0,)), (2, 2, (1,)), (None, 1, ()), (3, 0, ()), (4, 1, ()), (5, 1, (0,)), (6, 2, (1,)), (7, 1, (0,))}
    left = line_dedup.drop_lines(docs, **line_dedup.WHOLE)
    assert left.columns == docs.columns
    assert sorted((x.removed, x.text) for x in left.collect()) == [("a", "x\n\n "), ("b", "y"), ("c", "y"), ("d", "z"), ("e", "x"), ("f", None), ("g", ""), ("i", long)]
    assert line_dedup.drop_lines(nothing, **line_dedup.WHOLE).count() == 0


def _base_by_definition(text: str) -> list[tuple[int, int, str]]:
    found = []
    name = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for order, (kind, pattern, group, least) in enumerate((("assign", name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return [(a, b, k) for a, _, k, b in sorted(found)]


def test_secrets_against_the_definition(spark):
    r = random.Random(12)
    parts = ["password", "PassWd", "token", "apı_key", "api_key", "ApiKey", "secret", '"', "'", " ", ":", "=", "\n", "AKIA", "AKIAQ7XM4N2P9RST", "deadbeef", "0123456789abcdef", "hunter2hunter2", "a+b/c_d.e=f-g", "é", "日本", "{", "}", "(", ")", "+", '"""', "\\", "x", "#", "K"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(400)] + [None, ""]
    got = {x.doc_id: x for x in secrets.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        want = _base_by_definition(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for *_, k in want) for x in ("assign", "access", "hex"))
        assert got[i].base_sha256 == digest
        said = [tuple(x.split(":")) for x in got[i].spans.split(",") if x]
        assert [x for x in said if x[0] != "literal"] == [(k, str(a), str(b)) for a, b, k in want]


def test_secrets_lexer_follows_syntax():
    found = lambda text: [text[a:b] for _, a, b in secrets.scan(text)]
    assert found('db_pwd = ("q7Rk2Zp9"\n  "xLm4Tw8K")\n') == ["q7Rk2Zp9", "xLm4Tw8K"]
    assert found('auth_pwd = """q7Rk2Zp9xLm4T"""\n') == ["q7Rk2Zp9xLm4T"]
    assert found("part = 'q7Rk2Zp9xLm4T'\nmy_pwd = part + \\\n '9'\n") == ["q7Rk2Zp9xLm4T", "9"]
    # a constant ends with the braces around it
    assert found("f() { part = 'q7Rk2Zp9xLm4T' }\nmy_pwd = part\n") == []
    assert found("part = 'q7Rk2Zp9xLm4T'\nf() { my_pwd = part }\n") == ["q7Rk2Zp9xLm4T"]


def test_secrets_take_time_in_proportion():
    import time

    began = time.perf_counter()
    doubled = "a = 'x9Kq'\n" + "a = a + a\n" * 5000 + "pwd = 'q7Rk2Zp9xLm4T' + a\n"
    assert [doubled[a:b] for _, a, b in secrets.scan(doubled)] == ["x9Kq", "q7Rk2Zp9xLm4T"]
    chain = "c0 = 'q7Rk2Zp9xLm4T'\n" + "".join(f"c{k} = c{k - 1} + 'v{k}Zq'\npwd_{k} = c{k}\n" for k in range(1, 4000))
    assert len(secrets.scan(chain)) == 4000
    many = "".join(f"pwd_{k} = 'q7Rk2Zp9xL{k}'\npassword: q7Rk2Zp9xL{k}\n" for k in range(20000))
    assert len(secrets.scan(many)) == 40000
    assert secrets.scan("word " * 2_000_000) == []
    assert time.perf_counter() - began < 60


def test_neighbourhoods_grow_with_the_links(spark, monkeypatch):
    """A passage in all documents brings none together; what meets is in proportion to the linked documents."""
    sizes = []
    stored = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df: (sizes.append(df.count()) if "comp" in df.columns else None) or stored(df))
    passage = _text(random.Random(1), 60)
    for n in (60, 240):
        r = random.Random(n)
        rows = [(k, f"{_text(r, 80)} {passage} {_text(r, 80)}") for k in range(n)]
        rows += [(1000 + k, text + " end") for k, text in rows[: n // 4]]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert jaccard.jaccard_components(docs, size=5, percent=80).count() == n // 4 * 2
    assert sizes[0] <= 2 * 30 and sizes[1] <= 2 * 120


def test_every_word_gets_its_own_class():
    """What the exchange left in groups goes to the class under which its bigrams are likeliest, by a plain loop."""
    import numpy as np

    r = np.random.default_rng(3)
    bigrams = r.integers(0, 30, (13, 13))
    m = class_lm.Model(np.arange(8, dtype=np.uint64), np.ones(8, np.int64), np.zeros(8, np.int64), np.array([10, 3, 2, 1]), 5, 4, bigrams, 4, 8.0)
    name, around = r.integers(100, 140, 3000).astype(np.uint64), r.integers(0, 16, 3000)
    times = r.integers(1, 5, 3000)
    words, label, tokens = class_lm.assign(m, name, around, times)
    for w, got, n in zip(words, label, tokens):
        own = [(c // 4, c % 4, t) for x, c, t in zip(name, around, times) if x == w]
        fit = [sum(t * (m.log_step[p, c] + m.log_step[c, q]) for p, q, t in own) - sum(t for *_, t in own) * m.log_size[c] for c in range(4)]
        fit[m.label[-1]] = -np.inf
        assert fit[got] == pytest.approx(max(fit)) and n == sum(t for *_, t in own)
    monkey, class_lm.PAIRS = class_lm.PAIRS, 7
    try:
        assert (class_lm.assign(m, name, around, times)[1] == label).all()
    finally:
        class_lm.PAIRS = monkey


def test_class_model_scores_training_text_above_shuffled_text(spark):
    r = random.Random(8)
    kinds = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    rows = [(k, " ".join(r.choice(kinds[(k + j) % 4]) for j in range(60))) for k in range(300)]
    rows += [(1000 + k, " ".join(r.sample(rows[k][1].split(), 60))) for k in range(60)]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    docs = spark.createDataFrame([x for x in rows if x[0] < 1000 or x[0] in held], "doc_id bigint, text string")
    got = {x.doc_id: x.score for x in class_lm.score_documents(docs, frequent=40, endings=8, classes=6).collect()}
    straight = [got[d] for d in held if d < 1000]
    mixed = [got[d] for d in held if d >= 1000]
    assert min(straight) > max(mixed)


def test_mixing_draws_remaining_slots_multinomially(spark):
    """Over many shards, a source's drawn slots have a multinomial's mean and spread; reruns draw the same."""
    sizes = {"a": 64 * 1000 * 7, "b": 64 * 1000 * 5, "c": 64 * 1000 * 4}
    goals = spark.createDataFrame([(s, n, float(n), n // 64) for s, n in sizes.items()], "source string, source_size bigint, target double, blocks bigint")
    uses = lambda: mixing._block_uses(goals, 64, 10, 2, 17)  # noqa: E731  shards of ten slots: 4.375, 3.125 and 2.5 expected
    got = {r.s3: r.n for r in uses().groupBy("s3").agg(F.sum("times").alias("n")).collect()}
    for s, n in sizes.items():
        assert abs(got[s] - n / 64) <= 4 * math.sqrt(1600)
    assert abs(sum(got.values()) - 16000) <= 4 * math.sqrt(1600)
    assert sorted(map(tuple, uses().collect())) == sorted(map(tuple, uses().repartition(3).collect()))
