"""Secret scans, hard negatives and manifests against brute force, and with odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdecide.llm import catalog, manifest, negatives, secrets

DOCS = "doc_id long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- secret scans

BASE = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def plain(text):
    """Base spans by plain search over the whole text."""
    return [{"kind": k, "start": m.start(), "end": m.end()} for k, p, g, least in BASE for m in p.finditer(text) if len(m[g]) >= least]


PIECES = st.sampled_from(["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", "  ", '"', "'", "abcdef01", "deadBEEF", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH12345678", "é", "ſ", "K", "日本", "\n", "x", "12", "ghp_"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_op11_secret_scan_equals_plain_search(text):
    got = [s for s in secrets.found(text) if s["kind"] in ("assign", "access", "hex")]
    key = lambda s: (s["start"], secrets.KINDS.index(s["kind"]))
    assert got == sorted(plain(text), key=key)


def test_op11_secret_scan_checks_sums():
    body = "Xy9" * 10
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[d] + digits
    good = body + digits.rjust(6, "0")
    wrong = body + "000000"
    for text, kinds in ((f"é ghp_{good}.", ["repo_token"]), (f"npm_{good}", ["package_token"]), (f"ghp_{wrong}", []), (f"ghp_{good}x", []), (f"xyz_{good}", [])):
        assert [s["kind"] for s in secrets.found(text)] == kinds, text
    assert secrets.found(f"é ghp_{good}.") == [{"kind": "repo_token", "start": 2, "end": 42}]


def test_op11_secret_scan_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "password = hunter2hunter2"), (3, "password = hunter2hunter2"), (None, "AKIA" + "A" * 16), (5, "f" * 200_000 + " token token " * 20_000), (6, "password=short")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"spans": F.lit(1), "kind": F.lit("mine")})
    got = df.select("doc_id", secrets.told(secrets.spans(F.col("text"))).alias("s")).collect()
    assert [(x.doc_id, x.s) for x in got] == [(1, ""), (2, ""), (3, "assign:0:25"), (3, "assign:0:25"), (None, "access:0:20"), (5, "hex:0:200000"), (6, "")]
    assert df.limit(0).select(secrets.spans(F.col("text"))).count() == 0


# --- hard negatives


def mined(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """The same by scores of every pair."""
    out = []
    for a, label, v in {(i, k, tuple(v)) for i, k, v in rows if is_anchor(i)}:
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in rows if i != a)
        for s, i, _ in [x for x in scores if x[2] == label][:positives]:
            inside = [x for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, i, rank, n, -s, -t) for rank, (t, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "spread", "block"), [(1, 40, 1024), (2, 3, 7), (3, 200, 16), (4, 10**9, 32)])
def test_op12_hard_negatives_equal_all_pairs(spark, seed, spread, block):
    r = random.Random(seed)
    rows = [(k, r.randint(0, 3), [r.randint(-spread, spread) + 30 * (j == k % 6) for j in range(6)]) for k in range(150)]
    rows += [rows[3], rows[10], (200, 1, [0] * 6), (201, 1, []), (202, 2, [5, 5])]
    df = spark.createDataFrame(rows, "id long, label long, v array<long>").repartition(3)
    got = [tuple(x) for x in negatives.hard_negatives(df, F.col("id") % 10 == 0, block=block).collect()]
    assert sorted(got) == mined([(i, k, v + [0] * (6 - len(v))) for i, k, v in rows], lambda i: i % 10 == 0) and len(got) > 100


def test_op12_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, -0.001]), (1, 1, [0.5, 0.5]), (2, None, [0.5, 0.5]), (3, 2, None), (4, 2, [nan, 1.0]), (5, 2, [inf, 1.0]), (6, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (8, 2, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"id": F.lit(7), "v": F.lit("mine"), "key": F.lit(0)})
    made = negatives.integer_vectors(df, F.col("vec_id"), F.col("label"), F.col("embedding"))
    assert sorted((x.id, x.label, x.v) for x in made.collect()) == [(0, 1, [128, -1]), (1, 1, [128, 128]), (8, 2, [64, 0])]
    assert [tuple(x) for x in negatives.hard_negatives(made, F.col("id") == 0).collect()] == [(0, 1, 1, 8, 128 * 127, 128 * 64)]
    for none in (made.filter("id < 0"), made.filter("label = 1"), made.filter("id = 8")):
        assert negatives.hard_negatives(none, F.col("id") % 8 == 0).count() == 0


def test_op12_members_stop_early():
    """Members of a tight cluster are certified before the end of their list."""
    r = np.random.default_rng(5)
    members = np.round(np.array([1000, 0, 0, 0]) + r.normal(0, 5, (20, 4))).astype(np.int64)
    table = np.round(r.normal(0, 300, (4000, 4))).astype(np.int64)
    best, seen = negatives.empty(20, 3), []

    def step(open_, some, scores):
        seen.append(len(some))
        best[0][open_], best[1][open_] = negatives.best_of((best[0][open_], best[1][open_]), scores, some, np.ones(scores.shape, bool))

    negatives.walked(members, table, step, lambda: best[0][:, -1].astype(np.float64))
    assert sum(seen) < 2000
    assert (best[0] == np.sort(members @ table.T, axis=1)[:, :-4:-1]).all()


def test_op12_products_beyond_doubles():
    a = np.array([[(1 << 40) + 1, 3], [1 << 62, 1]])
    assert negatives.products(a, a).tolist() == [[((1 << 40) + 1) ** 2 + 9 if ((1 << 40) + 1) ** 2 < 1 << 63 else (1 << 63) - 1, (1 << 63) - 1], [(1 << 63) - 1] * 2]


# --- manifests


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def by_hand(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (doc_id, source, lang, n_chars, text)."""
    if not rows:
        return []

    def climb(nodes):
        """The root, and for each node its path of (left, right)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i // 8 * 8 : i // 8 * 8 + 8]
                paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            level, at = [sha("".join(level[j : j + 8])) for j in range(0, len(level), 8)], [i // 8 for i in at]
        return level[0], paths

    def lowered(text):
        return text and "".join(c.lower() if c.isascii() else c for c in text)

    nulls_first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    langs = sorted({x[2] for x in rows}, key=nulls_first)
    trees = {}
    for lang in langs:
        own = sorted(((x, sha("".join(map(field, x)))) for x in rows if x[2] == lang), key=lambda p: (nulls_first(p[0][0]), p[1]))
        trees[lang] = (own, *climb([h for _, h in own]))
    root, above = climb([trees[lang][1] for lang in langs])
    out = []
    for lang, up in zip(langs, above):
        own, subroot, paths = trees[lang]
        for (x, h), path in zip(own, paths):
            now = sha("".join(map(field, (*x[:4], lowered(x[4]))))) if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 3 == 0 else h
            for left, right in path + up:
                now = sha(left + now + right)
            out.append((x[0], h, subroot, root, sha("".join(a + b for a, b in path + up)), now, now == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifested(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("mine"), "rank": F.lit(3), "g": F.lit(1), "path": F.lit("p")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(x) for x in catalog.op13_merkle_manifest(spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 64, "de": 65, None: 2, "é": 7, "z": 8, "a": 1, "b": 1, "c": 1, "d": 513}])
def test_op13_merkle_manifest_by_hand(spark, tmp_path, sizes):
    r = random.Random(3)
    rows = [(k * 7 - 3, r.choice(["web", None]), lang, r.choice([None, 5]), r.choice([None, "", "Some Text É", "plain", "XY " * 50])) for lang, n in sizes.items() for k in range(n)]
    assert sorted(manifested(spark, rows, tmp_path)) == sorted(by_hand(rows))


def test_op13_merkle_manifest_of_ties(spark, tmp_path):
    rows = [(None, None, "en", None, "A"), (None, None, "en", None, "B"), *[(5, "s", "en", 1, "Same")] * 20, (5, "s", "en", 1, "other"), (5, None, None, None, None)]
    order = lambda x: (str(x[0]), *x[1:])
    assert sorted(manifested(spark, rows, tmp_path), key=order) == sorted(by_hand(rows), key=order)


def test_op13_proofs_of_some_leaves(spark):
    leaves = spark.range(700).select(F.when(F.col("id") % 5 > 0, "en").alias("lang"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    m = manifest.build(leaves)
    some = manifest.proofs(m, m.leaves.filter("doc_id in (0, 77, 699)"))
    got = some.select("doc_id", "root", manifest.folded(F.col("path"), F.col("leaf")).alias("good"), manifest.folded(F.col("path"), F.lit(sha("no"))).alias("bad"), F.size("path").alias("n")).collect()
    assert {x.doc_id for x in got} == {0, 77, 699} and all(x.good == x.root != x.bad and x.n == 5 - (x.doc_id == 0) for x in got)
    assert m.records.count() == m.records.select("digest").distinct().count()
    m.remove()
