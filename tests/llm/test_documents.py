"""The document operators against plain Python, and their defined cases."""

import base64
import collections
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from compare import compare, duck
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from visitmill.llm import bpe, exact_dedup, lang_id, line_dedup, mixing, ngram_join, queries, substring_dedup
from visitmill.llm.shared import scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "This line is long enough to be judged and stands in many texts."
LONG = " ".join(f"w{i}" for i in range(60))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns with the operators' own names."""
    rows = [(1, None), (2, ""), (None, "short one"), (None, LONG), (3, LONG), (4, LONG + " tail"), (4, LONG + " tail"), (5, "short one"),
            (6, f"{LINE}\nunique six"), (7, f" {LINE.upper()}\t\nunique seven\n{LINE}"), (8, LINE), (9, LINE), (10, f"a\n{LINE}"),
            (11, "x " * 30), (12, "été là über 12 \x85 ok\r\n\tend  "), (13, "12 34 !!"), (14, "word " * 300_000), (15, LONG.replace("w30", "other"))]
    return spark.createDataFrame(
        [(i, t, "en", "s", 0, "x", 1, True) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, digest string, n_lines int, kept boolean")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def counted(values):
    return collections.Counter(values)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_sql(name, spark):
    problem, _ = compare(spark, duck(SF), queries.QUERIES[name], queries.SQL[name], SF)
    assert problem is None


def test_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(n) for n in range(1, 14)}


# 4 -----------------------------------------------------------------------------------------------------------------

def test_exact_dedup_cases_and_second_batch(spark, docs, empty):
    index = exact_dedup.DigestIndex(spark, "digests_test", f"{scratch(spark)}/index", 4)
    got = exact_dedup.exact_dedup(docs, index).collect()
    groups = collections.defaultdict(list)
    for i, t in pairs(docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == docs.count() and index.rows().count() == len(groups)
    for r in got:
        own = groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")]
        keep = min((i for i in own if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), r.doc_id == keep)
    later = docs.sparkSession.createDataFrame([(0, LONG.replace(" ", "\n\t")), (50, "brand new"), (51, "brand new")], "doc_id long, text string")
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(later, index).collect()}
    assert again == {0: (3, 1, False), 50: (50, 2, True), 51: (50, 2, False)}
    assert index.rows().count() == len(groups) + 1
    assert exact_dedup.exact_dedup(empty, index).count() == 0
    reopened = exact_dedup.DigestIndex(spark, "digests_again", spark.sql("DESCRIBE EXTENDED digests_test").filter("col_name = 'Location'").first().data_type, 4)
    assert reopened.rows().count() == len(groups) + 1


def test_rows_of_a_common_text_go_apart(spark, monkeypatch):
    """A text with a third of the rows, null and repeated doc_ids: the same rows with and without the split."""
    docs = spark.range(3000).selectExpr("IF(id = 7, NULL, IF(id = 9, 12, id)) AS doc_id", "IF(id % 3 = 0, 'common text', concat('text ', id DIV 2)) AS text")
    got = {}
    for share in (10, 1):
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
        index = exact_dedup.DigestIndex(spark, f"digests_share{share}", f"{scratch(spark)}/index", 4)
        out = exact_dedup.exact_dedup(docs, index)
        got[share] = sorted(map(repr, out.select("doc_id", "keep_id", "group_size", "kept", "text").collect()))
    assert got[10] == got[1] and len(got[1]) == 3000
    assert sum("group_size=1000" in r and "keep_id=0" in r for r in got[10]) == 1000


def test_exact_dedup_reads_its_index_in_order(spark, docs):
    index = exact_dedup.DigestIndex(spark, "digests_plan", f"{scratch(spark)}/index", 4)
    exact_dedup.exact_dedup(docs, index)
    groups = index.rows().withColumn("group_size", exact_dedup.F.lit(1))
    plan = groups.hint("merge").join(index.rows(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# 8 -----------------------------------------------------------------------------------------------------------------

def brute_lines(rows, min_docs=5, min_chars=40):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    found = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            found[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(found[key(x)]) >= min_docs
                and i != max((j for j in found[key(x)] if j is not None), default=None) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def test_line_dedup_cases(docs, empty):
    out = line_dedup.line_dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"n_lines", "n_dropped"}
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()]
    want = brute_lines(pairs(docs))
    assert counted(got) == counted(want) and sum(w[2] for w in want) == 5
    assert line_dedup.line_dedup(empty).count() == 0


def test_minimal_hash_is_perfect_and_minimal():
    import numpy as np
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    perfect = line_dedup.MinimalHash.build(keys, keys[::-1])
    assert sorted(perfect.find(keys, keys[::-1])) == list(range(5000))
    assert len(line_dedup.MinimalHash.build(keys[:0], keys[:0]).find(keys[:3], keys[:3])) == 3
    # Pairs that share one of the two hashes end as well.
    same, other = np.array([5] * 300 + [9, 7, 8], dtype=np.uint64), np.array([*range(300), 1, 1, 1], dtype=np.uint64)
    for a, b in ((same, other), (other, same)):
        assert sorted(line_dedup.MinimalHash.build(a, b).find(a, b)) == list(range(303))


# 6 -----------------------------------------------------------------------------------------------------------------

def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_cases(spark, docs, empty):
    ranks, own = bpe.read_ranks(public_tokenizers.path(queries.RANKS)), encoder()
    # Every code point, so that both pattern engines agree on what letters, digits and white space are.
    odd = "".join(f"a{chr(c)}1{chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(99, odd), (98, "<|endoftext|>")], "doc_id long, text string"))
    got = bpe.decode(bpe.encode(rows, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = [(i, tuple(own.encode_ordinary(t or "")), (t or "").encode()) for i, t in pairs(rows)]
    assert counted((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == counted(want)
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark):
    own = encoder()
    got = {r.doc_id: r for r in queries.op6_byte_bpe(spark, SF).collect()}
    for i, t in pairs(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = own.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t))


# 5 -----------------------------------------------------------------------------------------------------------------

def brute_places(rows, width=20):
    first, split = {}, [(i, WORDS.findall(t or "")) for i, t in rows]
    place = lambda i, k: (float("-inf") if i is None else i, k)
    for i, w in split:
        for k in range(len(w) - width + 1):
            window = tuple(w[k: k + width])
            first[window] = min(first.get(window, place(i, k)), place(i, k))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k: k + width])] < place(i, k):
                gone[k: k + width] = [True] * width
        out.append((i, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


@pytest.mark.parametrize("many", [20_000, 1])
def test_substring_dedup_cases(docs, empty, many, monkeypatch):
    rows = docs.filter("doc_id IS NULL OR doc_id <> 14")
    if many == 1:  # the way for minimisers with very many different strings
        places = substring_dedup._grouped(rows.limit(0).selectExpr("doc_id", "1L tag", "1 start", "-1 stop", "text"), 20)
        assert places.count() == 0
    got = [(r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(rows).collect()]
    assert counted(got) == counted(brute_places(pairs(rows)))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_strings_handed_over(spark):
    """Strings of a minimiser that is too common for one task give the same repeats by grouping."""
    shared = " ".join(f"s{i}" for i in range(25))
    strings = spark.createDataFrame([(i, i * 10, 3, -1, f"{shared} own{i}") for i in range(6)], "doc_id long, tag long, start int, stop int, text string")
    got = {(r.doc_id, r.start, r.stop) for r in substring_dedup._grouped(strings, 20).collect()}
    assert got == {(i, 3 + k, 23 + k) for i in range(1, 6) for k in range(6)}
    out = {f.name: [] for f in substring_dedup.FOUND}
    group = substring_dedup._Minimiser(20, out)
    group.many, group.first = True, [(shared, 1, 2, 3)]
    group.close()
    assert out["stop"] == [-1] and out["text"] == [shared]


def test_substring_query(spark):
    got = [(r.doc_id, r.kept_sha256, r.n_words, r.n_removed) for r in queries.op5_substring_dedup(spark, SF).collect()]
    want = brute_places(pairs(spark.read.parquet(f"{SF}/documents.parquet")))
    assert counted(got) == counted((i, sha(t), n, m) for i, t, n, m in want) and sum(w[3] for w in want) > 0


# 1 -----------------------------------------------------------------------------------------------------------------

def brute_join(rows, similarity=0.8):
    sets = [frozenset(tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in (WORDS.findall(t or "") for _, t in rows)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    common = collections.Counter((a, b) for own in holders.values() for j, b in enumerate(own) for a in own[:j])
    for (a, b), n in common.items():
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, least.get(find(k)) if sets[k] else i, links[k]) for k, (i, _) in enumerate(rows)]


def test_ngram_join_cases(docs, empty):
    got = [(r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs).collect()]
    assert counted(got) == counted(brute_join(pairs(docs)))
    assert ngram_join.ngram_join(empty).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join_large_group_in_blocks(spark, block, monkeypatch):
    """Near copies of one text: the same links whether their bucket is one block, many, or (above 16 blocks) many buckets."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = []
    for i in range(60):
        w = [f"t{k}" for k in range(80)]
        w[(i * 7) % 80] = f"c{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: (c, n) for i, c, n in brute_join(rows)}
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)


def test_ngram_query(spark):
    got = [(r.doc_id, r.class_id, r.n_links) for r in queries.op1_ngram_join(spark, SF).collect()]
    assert counted(got) == counted(brute_join(pairs(spark.read.parquet(f"{SF}/documents.parquet"))))


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.995), (0.5, 0.9), (0.95, 0.999)):
        bands, rows = ngram_join.choose_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= ngram_join.SIGNATURE


# 10 ----------------------------------------------------------------------------------------------------------------

def test_language_cases(spark, docs, empty):
    model = lang_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.languages == ["de", "en", "es", "fr"] and model.codes.shape == (4, 7)
    out = lang_id.predict(docs, model)
    assert set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert lang_id.predict(empty, model).count() == 0
    none = lang_id.fit(docs.filter("false"))
    assert {r.lang_pred for r in lang_id.predict(docs, none).collect()} == {"und"}
    one = lang_id.fit(docs.filter("text IS NOT NULL"))
    assert {(r.lang_pred, r.score) for r in lang_id.predict(docs, one).collect()} == {("und", 0.0), ("en", 1.0)}


def test_codewords_differ_in_many_bits():
    for count in (2, 3, 4, 5, 6, 9, 40):
        codes = lang_id.codewords(count)
        apart = [(a != b).sum() for k, a in enumerate(codes) for b in codes[:k]]
        assert len(codes) == count and min(apart) >= codes.shape[1] // 2 and all(len(set(c)) == 2 for c in codes.T[: 1 if count < 6 else 0])


def test_language_held_out_accuracy(spark):
    got = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


# 7 -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_mixing_meets_its_targets(spark, folder):
    """Every target to 0.2 percent of itself."""
    rows = queries.op7_mixing(spark, folder).collect()
    total = sum(r.n_tokens for r in rows)
    for domain, share in queries.TARGETS.items():
        got = sum(r.rate * r.n_tokens * r.posterior[domain] for r in rows) / total
        assert abs(got / share - 1) < 0.002
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 and abs(sum(r.posterior.values()) - 1) < 1e-9 for r in rows)


@pytest.mark.parametrize("targets", [[700.0, 200.0, 100.0], [10.0, 10.0, 980.0], [0.0, 500.0, 500.0], [0.0, 1000.0, 0.0], [400.0, 300.0, 300.0]])
def test_mixing_against_plain_descent(spark, targets):
    """Least error, also where no rates meet the targets: as plain projected descent by numpy, run until it stands still."""
    import numpy as np
    p = np.array([[0.8, 0.1, 0.1], [0.7, 0.2, 0.1], [0.3, 0.6, 0.1], [0.9, 0.02, 0.08], [0.5, 0.1, 0.4], [0.2, 0.3, 0.5]])
    t, want = np.array([200.0, 150, 250, 300, 60, 40]), np.array(targets)
    scale = np.maximum(want, want.sum() * 1e-4)
    bound = ((p / scale).T ** 2 @ t).sum()
    rate = ahead = np.ones(len(t))
    pace = 1.0
    for _ in range(400_000):
        new = np.maximum(0, ahead - p @ (((ahead * t) @ p - want) / scale ** 2) / bound)
        if (new - rate) @ (ahead - new) > 0:
            pace, ahead = 1.0, rate
            continue
        following = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead, rate, pace = new + (pace - 1) / following * (new - rate), new, following
    table = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(t, p)], "n_tokens long, p0 double, p1 double, p2 double")
    rows = mixing.fit_rates(table, targets, scratch(spark)).collect()
    got = np.array([sum(r.rate * r.n_tokens * r[f"p{k}"] for r in rows) for k in range(3)])

    def error(tokens):
        return (((tokens - want) / scale) ** 2).sum()
    assert min(r.rate for r in rows) >= 0
    assert abs(got - want).max() < 0.002 * want.sum() and abs((got - want) / scale).max() < 0.002 or error(got) <= error((rate * t) @ p) * 1.001


def test_mixed_keeps_columns_of_any_name(spark, docs):
    odd = docs.select("doc_id", "text", F.lit(1).alias("copies"), F.lit("x").alias("tag"), F.lit(2).alias("__id"), F.lit(3).alias("own_id"), F.lit(4).alias("row"))
    labels = spark.createDataFrame([(3, "good"), (8, "low")], "doc_id long, domain string")
    got = mixing.mixed(odd, labels, {"good": 0.6, "low": 0.4})
    assert got.columns == odd.columns and {r[2:] for r in got.collect()} <= {(1, "x", 2, 3, 4)}


def test_mixing_cases(spark, docs, empty):
    labels = spark.createDataFrame([(3, "good"), (8, "low"), (None, "good"), (11, None), (777, "good"), (8, "low")], "doc_id long, domain string")
    rows = mixing.mix(docs, labels, {"good": 0.5, "low": 0.5, "unknown": 3.0}).collect()
    assert len(rows) == docs.count() and all(r.rate == 1.0 for r in rows if not r.n_tokens)
    assert mixing.mixed(docs, labels, {"good": 1.0}).columns == docs.columns
    unlabelled = mixing.mix(docs, labels.filter("false"), {"good": 1.0}).collect()
    assert {r.rate for r in unlabelled} == {1.0} and mixing.mix(empty, labels, {"good": 1.0}).count() == 0
    copies = counted((r.doc_id, r.text) for r in mixing.mixed(docs, labels.filter("false"), {}).collect())
    assert copies == counted(pairs(docs))


def test_mixing_plan_is_native(spark):
    plan = queries.op7_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_substring_blocks_hold_enough_to_compress():
    """Strings wait until a block of each bucket holds 2 MB here, in few blocks that unpack to what went in."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 1000)) for _ in range(1200)]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1200), pa.int64()), "text": texts})
    blocks = list(substring_dedup._cut(20, 8)(iter([docs])))
    held = sum(b.column("text").nbytes for b in substring_dedup._unpack(iter(blocks)))
    assert 16 << 20 < held < 32 << 20 and sum(b.num_rows for b in blocks) == 16


def test_substring_steps_hold_little_memory(spark, monkeypatch):
    """The cutting step holds a few times its block; texts reach it a few MB at once, and the session's own limit comes back."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 2000)) for _ in range(600)]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(600), pa.int64()), "text": texts})
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in substring_dedup._cut(20, 64)(iter([docs]))) == 128
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40 << 20

    cut, limit = substring_dedup._cut, "spark.sql.execution.arrow.maxBytesPerBatch"

    def watched(width, buckets):
        own = cut(width, buckets)

        def task(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 5 << 20
                    yield batch
            return own(small())
        return task

    monkeypatch.setattr(substring_dedup, "_cut", watched)
    before = spark.conf.get(limit)
    long = spark.range(0, 9000, 1, 1).selectExpr("id doc_id", "repeat('x', 1200) text")
    assert substring_dedup.repeated_places(long).count() == 0
    assert spark.conf.get(limit) == before
