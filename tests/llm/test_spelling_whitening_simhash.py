"""Spelling variants, whitening and SimHash against plain Python, and their defined cases."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF

from visitmill.llm import queries, shared, simhash, spelling, whitening
from visitmill.llm.components import components

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling._UPPER, spelling._LOWER)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with the operators' own names."""
    rows = [(1, None), (2, ""), (None, "letters lettera letters"), (3, "Letters LETTERS letters letters " * 3), (4, "lettera " * 5 + "lettêrs " * 6),
            (4, "lettera " * 5), (5, "kitten kittens mitten kitt×en " * 6), (6, "kitten " * 40 + "étéétés étéété " * 5), (7, "x" * 5000 + " "),
            (8, ("x" * 5000 + " ") * 5 + ("x" * 4999 + "y ") * 30), (9, "abcdefg gfedcba abcdefh bbcdefg " * 5), (10, "12 34 --"), (11, "one"), (12, "one two"),
            (13, "one two"), (14, "word " * 300_000), (15, "\x85 a b c"), (16, "中文 letterſ")]
    return spark.createDataFrame([(i, t, 1, "w", 2, 3) for i, t in rows],
                                 "doc_id long, text string, n long, word string, code long, n_chars long")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# 11 ----------------------------------------------------------------------------------------------------------------

def brute_words(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(count):
    """Near words by the strings they share after one deletion, each pair then compared."""
    near, holes = collections.defaultdict(set), collections.defaultdict(set)
    for w in count:
        for k in range(len(w)):
            holes[w[:k] + w[k + 1:]].add(w)
        holes[w].add(w)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and is_near(a, b)}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 5 * n else None
    out = {}
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], count[form[w]] if form[w] else None, root)
    return out


def variants(df):
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spelling_cases(docs):
    got = variants(spelling.spelling_variants(spelling.corpus_words(docs)))
    want = brute_variants(brute_words(pairs(docs)))
    assert got == want and got["kittens"][2] == "kitten" and got["letters"][1] == 2 and got["x" * 5000][2] == "x" * 4999 + "y"
    assert variants(spelling.spelling_variants(spelling.corpus_words(docs.filter("false")))) == {}


def test_spelling_query(spark):
    df = queries.op11_spelling_variants(spark, SF)
    assert df.dtypes == [("word", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form", "string"), ("form_n", "bigint"), ("root", "string")]
    assert variants(df) == brute_variants(brute_words(pairs(spark.read.parquet(f"{SF}/documents.parquet"))))


@pytest.mark.parametrize("m", [3, 5, 8])
def test_spelling_tiles_and_any_number_of_parts(m, spark, monkeypatch):
    """Small tiles: hashes fill several, within and across tasks; anagrams share all their hashes."""
    rng = np.random.default_rng(m)
    words = {"".join(rng.permutation(list("abcdefgh"))[:int(rng.integers(6, 9))]): int(rng.integers(5, 500)) for _ in range(1500)}
    monkeypatch.setattr(spelling, "TILE", 16)
    monkeypatch.setattr(spelling, "PACK", 8)
    monkeypatch.setattr(spelling, "PARTS", [m])
    got = variants(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    want = brute_variants(words)
    assert got == want and sum(v[1] for v in want.values()) > 300


def test_chains_of_forms_lead_to_the_last(spark):
    chain = [("abcdef" + "x" * k, 5 ** (k + 1)) for k in range(12)]
    got = variants(spelling.spelling_variants(spark.createDataFrame(chain, "word string, n long")))
    assert {v[4] for v in got.values()} == {chain[-1][0]} and got[chain[3][0]][2] == chain[4][0]


def test_tiles_cover_every_row_once():
    keys = np.repeat(np.arange(9), [1, 30, 2, 2, 7, 1, 1, 25, 3])
    batches = [pa.RecordBatch.from_pydict({"key": keys[a:a + 10]}) for a in range(0, len(keys), 10)]
    seen, pieces_of = [], collections.Counter()
    for block, packs, open_groups in shared.tiles(iter(batches), "key", 8, 4):
        assert block.num_rows <= 8 and packs[0][0] == 0 and packs[-1][1] == block.num_rows
        seen += block.column("key").to_pylist()
        for _, a, b in open_groups:
            assert len(set(block.column("key").to_pylist()[a:b])) == 1
            pieces_of[block.column("key")[a].as_py()] += b - a
    assert seen == keys.tolist() and (pieces_of[1], pieces_of[7], pieces_of[0], pieces_of[8]) == (30, 25, 1, 3)


# 12 ----------------------------------------------------------------------------------------------------------------

def check_whitening(rows, given, k=4, scale=256):
    """Results against numpy, with exact whole numbers where the contract asks for them."""
    use = [(i, [math.floor(scale * float(np.float64(c))) for c in v]) for i, v in given]
    fit = sorted({tuple(x) for _, x in use})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[c] for x in fit) for c in range(d)]
    exact = np.array([[n * x[c] - sums[c] for c in range(d)] for x in fit], dtype=object)
    v = np.array((exact.T @ exact) / n ** 3, dtype=float)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert collections.Counter(r.vec_id for r in rows) == collections.Counter(i for i, _ in use for _ in range(min(k, d)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.vec_id, r.component].append(r)
    sign = {}
    for i, x in use:
        centred = [n * a - s for a, s in zip(x, sums)]
        for c in range(min(k, d)):
            fits = [r for r in by[i, c + 1] if r.deviation == sum(y * y for y in centred)]
            assert fits and fits[0].n == n and abs(fits[0].explained - values[c] / v.trace()) <= 1e-9
            want = float(np.array(centred, dtype=float) / n @ vectors[:, c] / math.sqrt(values[c]))
            if c not in sign and abs(want) > 0.1:
                sign[c] = math.copysign(1, want * fits[0].whitened)
            assert any(abs(r.whitened - sign.get(c, 1) * want) < 1e-6 for r in fits)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-6


def test_whitening_query(spark):
    df = queries.op12_embedding_whitening(spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                         ("explained", "double"), ("identity_error", "double")]
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()
             if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check_whitening(df.collect(), given)


def test_whitening_cases(spark):
    rng = np.random.default_rng(5)
    good = [(int(i), [float(c) for c in rng.normal(size=5) * [9, 5, 3, 1, 0.5] + 1000]) for i in range(60)]
    good += [good[3], (3, good[4][1]), (None, good[5][1]), (70, [c + 1e-9 for c in good[6][1]])]
    bad = [(80, None), (81, []), (82, [1.0, None, 0.0, 0.0, 0.0]), (83, [float("nan")] * 5), (84, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (85, [1.0, 2.0]), (86, [1e300, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, x string, n int")
    check_whitening(whitening.whitening(table).collect(), good)
    assert whitening.whitening(table.filter("vec_id > 79")).filter("vec_id <> 85").count() == 0
    assert whitening.whitening(table.filter("false")).count() == 0


def test_whitening_is_exact_for_large_entries_and_null_where_flat(spark):
    rng = np.random.default_rng(6)
    large = [(int(i), [float(c) for c in rng.integers(-2 ** 40, 2 ** 40, 3)]) for i in range(30)]
    fit = whitening.whole_vectors(spark.createDataFrame(large, "vec_id long, embedding array<double>")).select("x").distinct()
    n, sums, exact = whitening.covariance(fit)
    x = np.array([[int(256 * c) for c in v] for _, v in large], dtype=object)
    centred = x * n - x.sum(axis=0)
    assert n == 30 and sums == list(x.sum(axis=0)) and [[v * n ** 3 for v in r] for r in exact] == (centred.T @ centred).tolist()
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whitening(flat).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and len(got) == 18
    one = whitening.whitening(flat.limit(1)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 2


# 13 ----------------------------------------------------------------------------------------------------------------

def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [words[k:k + n] for k in range(len(words) - n + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, bits=3):
    codes = sorted(codes)
    array = np.array(codes, dtype=np.uint64)
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c
    for c in codes:
        for other in array[np.bitwise_count(array ^ np.uint64(c)) <= bits].tolist():
            a, b = find(c), find(other)
            root[max(a, b)] = min(a, b)
    return {c: find(c) for c in codes}


def check_simhash(df, rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = brute_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        least[root[p]] = min((x for x in (least.get(root[p]), i) if x is not None), default=None)
    want = collections.Counter((i, f"{p:016x}", least[root[p]]) for i, p in prints)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()) == want


def test_simhash_query(spark):
    df = queries.op13_simhash(spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    check_simhash(df, pairs(spark.read.parquet(f"{SF}/documents.parquet")))


def test_simhash_cases(docs, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 1000)
    check_simhash(simhash.simhash_dedup(docs), pairs(docs))
    assert simhash.simhash_dedup(docs.filter("false")).count() == 0


def linked(spark, codes, bits):
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "code long")
    got = {r.node & simhash._ALL: r.root & simhash._ALL for r in components(simhash.near_codes(df, bits)).collect()}
    groups = collections.defaultdict(set)
    for c in codes:
        groups[got.get(c, c)].add(c)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("bits,few", [(1, 64), (3, 10_000), (3, 2)])
def test_gray_index_finds_every_link(bits, few, spark, monkeypatch):
    """Many codes share their front bits, so nodes have several levels; leaves of four codes."""
    rng = np.random.default_rng(bits)
    near = [int(c) for c in rng.integers(0, 1 << 18, 500)] + [2 * int(c) for c in rng.integers(0, 1 << 63, 60)]
    for c in list(near[:80]) + near[-60:]:
        near.append(c ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    codes = sorted({0, simhash._ALL, *near})
    monkeypatch.setattr(simhash, "LEAF", 4)
    monkeypatch.setattr(simhash, "FEW", few)
    root = brute_components(codes, bits)
    groups = collections.defaultdict(list)
    for c in codes:
        groups[root[c]].append(c)
    assert linked(spark, codes, bits) == sorted(map(sorted, groups.values()))


def test_gray_rank_is_the_place_in_the_gray_code(spark):
    from pyspark.sql import functions as F
    rows = spark.range(1 << 12).select(simhash._gray_rank(F.col("id").bitwiseXOR(F.shiftright("id", 1))).alias("r"), "id")
    assert rows.filter("r <> id").count() == 0


def test_components_with_hot_nodes(spark):
    """A star over most of the edges, chains, loops and repeated edges."""
    edges = [(0, k) for k in range(1, 3000)] + [(10_000 + k, 10_001 + k) for k in range(70)] + [(5, 5), (3, 9000), (9000, 9001), (20_001, 20_000)] * 2
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 0 for k in [*range(3000), 9000, 9001]} | {10_000 + k: 10_000 for k in range(71)} | {20_000: 20_000, 20_001: 20_000}
    assert got == want
