"""Manifests, suffix dedup and periodic runs on small tables, with odd rows and clashing columns, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import merkle, periodic, suffix_dedup

CLASHES = "row long, id string, at int, n string, pos string, tree long, `a.b` int, digest int, c array<int>, words string, spans int"
OF_CLASHES = (7, "i", 5, "n", "p", 1, 3, 0, [4], "w", 2)


def table_of(spark, rows, schema):
    return spark.createDataFrame([(*r, *OF_CLASHES) for r in rows], f"{schema}, {CLASHES}")


# manifests


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(values):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def slow_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def slow_proof(levels, i):
    out = []
    for x in levels[:-1]:
        first = i - i % 3
        out.append((x[first:i], x[i + 1 : first + 3]))
        i //= 3
    return out


def slow_manifest(rows):
    """Of rows (id, source, text): (id, leaf, subroot, root, siblings, folded root of the text without newlines), in no order."""
    key = lambda x: (x is not None, x)
    by = {}
    for i, s, t in rows:
        by.setdefault(s, []).append((i, slow_leaf((i, s, t)), slow_leaf((i, s, t and t.replace("\n", "")))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (key(x[0]), x[1]))
    trees = {s: slow_tree([x[1] for x in own]) for s, own in by.items()}
    top = slow_tree([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for at, (i, leaf, shown) in enumerate(by[s]):
            steps = slow_proof(trees[s], at) + slow_proof(top, k)
            now = shown
            for left, right in steps:
                now = digest([*left, now, *right])
            yield i, leaf, trees[s][-1][0], top[-1][0], [x for left, right in steps for x in left + right], now


def check_manifest(spark, rows):
    docs = table_of(spark, rows, "doc_id long, source string, text string").repartition(3)
    shown = [F.col("doc_id"), F.col("source"), F.replace("text", F.lit("\n"), F.lit(""))]
    got = merkle.verified(docs, [F.col("doc_id"), F.col("source"), F.col("text")], shown).collect()
    want = list(slow_manifest(rows))
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.siblings, r.folded_root) for r in got) == sorted((str(x[0]), *x[1:]) for x in want)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    return got


@pytest.mark.parametrize("near", [1 << 15, 5, 0])
def test_manifest(spark, monkeypatch, near):
    """near: how many nodes are broadcast; what isn't is joined by coordinates as well."""
    monkeypatch.setattr(merkle, "NEAR", near)
    rows = [(i, f"s{i % 4}" if i % 3 else "hot", f"text\n{i}" if i % 2 else f"text {i}") for i in range(70)]
    rows += [(None, None, None), (None, "hot", "a"), (5, None, ""), (5, None, ""), (5, None, "b\n"), (900, "é", "x"), (901, "z", " "), (902, "", "long " * 3000 + "\n")]
    got = check_manifest(spark, rows)
    assert {r.doc_id for r in got if not r.verified} == {i for i, _, t in rows if t and "\n" in t}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_one_source(spark, n):
    assert all(r.verified for r in check_manifest(spark, [(i, "s", f"t{i}") for i in range(n)]))


def test_manifest_of_lone_leaves(spark):
    check_manifest(spark, [(i, f"s{i}", "t\n") for i in range(7)])


def test_manifest_of_nothing(spark):
    docs = table_of(spark, [], "doc_id long, source string, text string")
    assert merkle.manifest(docs, [F.col("text")]).root is None
    assert merkle.verified(docs, [F.col("text")]).collect() == []


# suffix dedup


def slow_removed(texts, width):
    """Of each text (bytes) which bytes go."""
    seen = {}
    for k, x in enumerate(texts):
        for i in range(len(x) - width + 1):
            seen.setdefault(x[i : i + width], []).append((k, i))
    gone = [bytearray(len(x)) for x in texts]
    for places in seen.values():
        for k, i in places if len(places) > 1 else ():
            gone[k][i : i + width] = b"\1" * width
    return gone


def check_suffixes(spark, rows, width):
    got = suffix_dedup.suffix_dedup(table_of(spark, rows, "doc_id long, text string").repartition(3)).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), x, gone in zip(rows, texts, slow_removed(texts, width), strict=True):
        starts = [k for k in range(len(x)) if gone[k] and not (k and gone[k - 1])]
        spans = [(k, next((j for j in range(k, len(x)) if not gone[j]), len(x)) - k) for k in starts]
        want.append((str(i), bytes(b for b, g in zip(x, gone, strict=True) if not g), spans))
    assert sorted((str(r.doc_id), bytes(r.kept), [tuple(s) for s in r.spans]) for r in got) == sorted(want)


def smaller(monkeypatch, part=1 << 18):
    """Windows of 20 bytes, with grams of 6: more of them meet in small texts."""
    for name, value in (("WIDTH", 20), ("GRAM", 6), ("BLOCKS", (6, 2, 1)), ("_PART", part)):
        monkeypatch.setattr(suffix_dedup, name, value)


@pytest.mark.parametrize("part", [1 << 18, 64])
def test_suffixes(spark, monkeypatch, part):
    """Passages of all lengths with unlike surroundings, overlaps with themselves, in parts of few bytes, too.

    Workers import the module anew, so the batches are made here."""
    smaller(monkeypatch, part)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(n) for n in (15, 19, 20, 21, 30, 45, 90)]
    rows = [(i, word(rng.randrange(30)) + rng.choice(passages)[rng.randrange(6) :] + word(rng.randrange(30)) + rng.choice(passages)) for i in range(80)]
    rows += [(200, "ab" * 40), (201, "x" * 19), (202, "x" * 20), (203, "x" * 21 + "y"), (204, None), (205, ""), (205, ""), (None, "only here " + word(50)), (206, rows[3][1]), (206, rows[3][1])]
    texts = [(t or "").encode() for _, t in rows]
    import pyarrow as pa

    text, a, n, gram_at, gram, d1, d2 = suffix_dedup.pieces(pa.array([t for _, t in rows]))
    assert n.sum() == sum(max(0, len(x) - 19) for x in texts)  # each window is in one piece
    assert (gram_at >= n - 1).all() and (gram_at + 6 <= 20).all()
    made = spark.createDataFrame([(int(t), int(g) - (1 << 63), int(x), int(y), int(i), int(c), int(m)) for t, i, c, m, g, x, y in zip(text, a, n, gram_at, gram, d1, d2, strict=True)], "row long, gram long, d1 long, d2 long, a int, n int, gram_at int")
    base = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "row long, id long, text string")
    base.mapInArrow = None  # not used
    monkeypatch.setattr(type(base), "mapInArrow", lambda self, f, schema: made)
    found = {r.row: [(s.a, s.z) for s in r.spans] for r in suffix_dedup.repeated(base).collect()}
    for k, gone in enumerate(slow_removed(texts, 20)):
        mine = bytearray(len(gone))
        for s, z in found.get(k, []):
            mine[s:z] = b"\1" * (z - s)
        assert mine == gone, rows[k]


def test_suffixes_of_full_width(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmn é\n") for _ in range(n))
    passage, other = word(420), word(230)
    rows = [(i, word(rng.randrange(200)) + passage[i * 7 :] + word(rng.randrange(300))) for i in range(12)]
    rows += [(20, other + "!" + other), (21, other), (21, other), (22, "z" * 450), (23, "z" * 200), (24, "q" * 200), (25, "q" * 199), (26, None), (27, ""), (None, word(600)), (28, word(900) + "é" * 150)]
    check_suffixes(spark, rows, 200)


def test_suffixes_of_nothing(spark):
    assert suffix_dedup.suffix_dedup(table_of(spark, [], "doc_id long, text string")).collect() == []
    check_suffixes(spark, [(1, "a"), (2, None)], 200)


# periodic runs


def slow_runs(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, z - a, q) for (a, z), q in found.items())


def periodic_text(rng):
    words = [f"w{rng.randrange(rng.choice([1, 2, 4, 40]))}" for _ in range(rng.choice([0, 5, 23, 24, 60, 200]))]
    for _ in range(rng.randrange(4)):
        if len(words) > 2:
            a, p = rng.randrange(len(words)), rng.randint(1, max(1, len(words) // 3))
            for i in range(a, rng.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs():
    rng = random.Random(5)
    for _ in range(60):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 9))]
        ids = {}
        flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
        assert periodic.runs(flat, np.array([len(t) for t in texts], np.int64)) == [slow_runs(t) for t in texts]


def test_z_function():
    rng = random.Random(6)
    for _ in range(200):
        p, t = ([rng.randrange(2) for _ in range(rng.randrange(12))] for _ in range(2))
        want = [next((k for k in range(len(t) - i + 1) if k == len(p) or i + k == len(t) or p[k] != t[i + k]), 0) for i in range(len(t))]
        assert periodic.z_function(p, t) == want


def test_periodic_runs(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["", " \t"]) + rng.choice([" ", "\n", " \x0b\x0c\r"]).join(periodic_text(rng))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "a " * 24), (103, "a b " * 5000), (103, "a b " * 5000), (104, "a\x1cb " * 30), (105, "é ü " * 24)]
    got = periodic.periodic_runs(table_of(spark, rows, "doc_id long, text string").repartition(3)).collect()
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = slow_runs(words) if len(words) < 5000 else [(0, len(words), 2)]
        gone = {k for a, n, p in runs for k in range(a + p, a + n)}
        want.append((str(i), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.text) for r in got) == sorted(want)
    assert periodic.periodic_runs(table_of(spark, [], "doc_id long, text string")).collect() == []


def test_words_of(spark):
    texts = ["a b", " \x0b\x0ca\x1cb\x85c\td\r\n", "", None, " x "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(periodic.words_of(F.col("t"))).collect()]
    assert got == [[w.decode() for w in (t or "").encode().split()] for t in texts]
