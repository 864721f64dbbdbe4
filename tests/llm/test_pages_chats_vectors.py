"""Pages, conversations and vectors against plain Python, and the pipeline's stages."""

import collections
import hashlib
import html as entities
import re
import time

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from visitmill.llm import ann, chat, html, queries

TEXT = "The hill is not far from the river and it was a good day for all of them who had come to see the old mill. "


# 3 -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain words", ""), ("<p></p>", ""),
    ("<article><p>One.</p></article>", "One."),
    ("<nav>Home</nav><article><header><h1>T &amp; U</h1></header><p>a\n\t b&#33;</p><footer>by me</footer></article><footer>&copy; x</footer>", "T & U a b!"),
    (f"<body class='has-sidebar'><main><p>{TEXT}</p><aside><p>{TEXT * 4}</p></aside><div class='ad-box'>{TEXT * 3}</div><p>End", f"{TEXT}End"),
    (f"<header><p>{TEXT * 3}</p></header><article><p>{TEXT * 3}</p></article><section id='comments'><article><p>{TEXT * 3}</p></article></section>", (TEXT * 3).strip()),
    (f"<article><p>{TEXT * 2}</p><form><label>{TEXT}</label></form><script>if (a < b) {{ '</p>' }}</script><style>p {{}}</style><!-- {TEXT} --><p>x</p></article>", f"{TEXT * 2}x"),
    (f"<div class='cookie-notice'>{TEXT * 3}</div><div><p>{TEXT * 3}</p><p>short</p></div><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul>", f"{TEXT * 3}short"),
    (f"<article><p>{TEXT}</p><p>cut &am", f"{TEXT}cut &am"), (f"<article><p>{TEXT}</p><p>cut<", f"{TEXT}cut"), (f"<article><p>{TEXT}</p><p cl", TEXT.strip()),
    (f"<article><p>{TEXT * 2}</p><ul><li><a href=x>{TEXT}</a></li></ul><p hidden>{TEXT}</p><p class=comment>{TEXT}</p></article>", (TEXT * 2).strip()),
    (f"<body><form id=aspnetForm><nav><a href=/>Home</a></nav><div><p>{TEXT * 3}</p><p>x</p></div><footer>f</footer></form>", f"{TEXT * 3}x"),
    (f"<body><nav><a href=/>Home</a><a href=/b>B</a><article><p>{TEXT * 3}</p><p>x</p></article></body>", f"{TEXT * 3}x"),
    (f"<body><nav><ul><li><a href=/>Home</a></ul><div><p>{TEXT * 3}</p></div>", (TEXT * 3).strip()),
    (f"<form><nav><a href=/>Home</a><article><p>{TEXT * 3}</p></article>", (TEXT * 3).strip()),
    (f"<body><aside><p>ad</p><article><p>{TEXT * 3}</p></article></body>", (TEXT * 3).strip()),
    (f"<article><p>{TEXT * 3}</p></article><form><p>{TEXT * 9}</p></form><section id=comments><p>{TEXT * 9}</p>", (TEXT * 3).strip()),
    (f"<p>Short one.</p><form><label>Name</label><p>{TEXT * 2}</p></form>", "Short one."),
    (f"<main><h1>T</h1></main><div>{TEXT * 3}</div>", f"T {TEXT * 3}".strip()),
    (f"<div class='search-engine-post'><p>{TEXT * 3}</p></div><div class='post-share-buttons'>{TEXT * 3}</div>", (TEXT * 3).strip()),
    (f"<div class='related-posts'>{TEXT * 3}</div><div class='comments-open'><p>{TEXT * 3}</p></div><div id=cookieBanner>{TEXT * 3}</div>", (TEXT * 3).strip()),
    ("<body><nav><a href=/>Home</a></nav><h1>Short</h1><p>A note.</p><div>Menu</div><footer>Foot.</footer>", "Short A note."),
    (f"<article><p class=\"x>{TEXT}</p><p y'>z</p></article>", f"{TEXT}z"), (f"<article><button>x<p>{TEXT}</p></article>", f"x {TEXT}".strip()),
    (f"<article><p title='a>b'>{TEXT}</p></article>", TEXT.strip()), (f"<article><p>a < b</p><p>{TEXT}</p></article>", f"a < b {TEXT}".strip()),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_pages_of_any_size_take_linear_time():
    page = "<ul>" + "<li>x</li>" * 100_000 + "</ul><article>" + f"<p>{TEXT}</p>" * 20_000 + "</article>"
    assert html.main_text(page) == " ".join([TEXT.strip()] * 20_000)


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a b='", "<b x=\"", "<a ='\"", "<nav>", "<div>x", "<div></ul>", "<!--", "<button>", "</p", "<p>&", "<",
                                   "< ", "<form>x</nav>", "<li class=a>"])
def test_hostile_pages_take_linear_time(piece):
    """Ten million characters take ten times as long as one, not a hundred times."""
    took = []
    for size in (1_000_000, 10_000_000) if piece in ("<a ", "<b x=\"", "<!--", "</p") else (30_000, 300_000):
        start = time.process_time()
        html.main_text(piece * (size // len(piece)) + '"')
        took.append(time.process_time() - start)
    assert took[1] < 40 * max(took[0], 0.05)


def test_extraction_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op3_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        parts = re.split(r"<(?:p|/p|br|h1|/h1)>", re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", inner)))
        want = " ".join(" ".join(entities.unescape(x).split()) for x in parts if x.strip())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_extraction_cases(spark):
    rows = [(1, "u", None, "x"), (None, None, "<article>a</article>", "y"), (1, "u", "<article>b</article>", "z"), (1, "u", "<article>b</article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got == collections.Counter({(1, "u", "", 0): 1, (None, None, "a", 1): 1, (1, "u", "b", 1): 2})
    assert html.extract(pages.filter("false")).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, None, "x"), (2, 5, "assistant", "a" * 9000),
            (2, 6, "user", "\\"), (2, 6, "user", "\\"), (2, None, "user", "first ### </turn>\n"), (None, 1, "user", "no id"), (None, 2, "assistant", "none"),
            (3, 0, "system", "alone"), (4, 0, "we: ird</turn>", "\\: ### \\</turn>"), (4, 1, "assistant", "\n### user: fake</turn>\n")]
    rows += [(5, k, "system" if not k else ("user", "assistant")[k % 2], f"turn {k} " + "word " * (k % 40)) for k in range(900)]
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, stretch int")


def brute_digests(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    out = {}
    for i, own in by.items():
        own.sort()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        out[i] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_cases(turns):
    windows = chat.format_chats(turns, budget=300, history=60)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == brute_digests(turns.collect())
    rows = windows.collect()
    assert all(r.tokens <= 300 or r.n_turns == 1 for r in rows)
    long = sorted((r for r in rows if r.conv_id == 5), key=lambda r: (r.stretch, r.window))
    assert len({r.stretch for r in long}) == 4 and len(long) > 30
    for before, r in zip(long, long[1:]):
        parts, told = chat.parse(r.formatted), chat.parse(before.formatted)
        assert parts[0] == ("system", "turn 0 ") and r.repeated >= 1
        history = parts[1: r.repeated]
        assert history == (told[len(told) - len(history):] if history else [])
        masked = [chat.unescape(r.formatted[a:b]) for a, b in zip(r.loss_starts, r.loss_ends)]
        assert masked == [t for role, t in parts[r.repeated:] if role == "assistant"]
    assert chat.digests(chat.format_chats(turns.filter("false"))).count() == 0


def test_chat_query(spark):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op9_chat_format(spark, SF).collect()}
    want = brute_digests(spark.read.parquet(f"{SF}/conversations.parquet").collect())
    text = r"\### Assistant: </turn> ok"
    want[-7] = (2, hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest())
    assert got == want


def test_escapes_are_reversible():
    for text in ("", "\\", "\\\\###", "</turn>\n", "a\\</turn>", ": ", "### x: y</turn>\n### z: w</turn>\n", "#" * 7):
        assert chat.unescape(chat.escape(text)) == text
        assert chat.parse(f"### {chat.escape(text, chat._ROLE)}: {chat.escape(text)}</turn>\n") == [(text, text)]


# 2 -----------------------------------------------------------------------------------------------------------------

def brute_nearest(rows, is_query, k=20):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and len(v)
            and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v, dtype=float))]
    size = collections.Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == size]
    return {q: sorted({j: -float((w * v).sum()) for j, w in good if j != q}.items(), key=lambda x: (x[1], x[0]))[:k] for q, v in good if is_query(q)}


def test_neighbours_query_recall(spark):
    got = queries.op2_multiprobe_ann(spark, SF).toPandas()
    want = brute_nearest([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], lambda q: q % 20 == 0)
    assert set(got.query_id) == set(want)
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and list(zip(-own.score, own.vec_id)) == sorted(zip(-own.score, own.vec_id))
        hits += len(set(own.vec_id) & {j for j, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_neighbours_of_lengths_and_many_buckets(spark, monkeypatch):
    """Unequal lengths (inner product is not cosine), many small buckets and parts."""
    monkeypatch.setattr(ann, "BUCKET", 20)
    monkeypatch.setattr(ann, "PART", 64)
    monkeypatch.setattr(ann, "GROUP", 200)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    points = centres[rng.integers(0, 40, 2000)] + 0.3 * rng.standard_normal((2000, 16))
    points *= rng.uniform(0.5, 2, (2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    want = brute_nearest(rows, lambda q: q % 20 == 0)
    found = collections.defaultdict(set)
    for r in got:
        found[r.query_id].add(r.vec_id)
        assert abs(r.score - float((points[r.vec_id] * points[r.query_id]).sum())) < 1e-12
    assert sum(len(found[q] & {j for j, _ in own}) for q, own in want.items()) >= 0.9 * 20 * len(want)


def test_neighbours_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0, None]), (120, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]),
            (2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.5, 0.5]), (140, [-1.0, -1.0])] + [(1000 + i, [0.25, 0.25]) for i in range(1, 40)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(table, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {0, 140, 1020}
    assert got[0][:3] == [(1, 1.0), (2, 1.0), (3, 0.5)] and [i for i, _ in got[0][3:]] == list(range(1001, 1018)) and len(got[0]) == 20
    assert 1020 not in [i for i, _ in got[1020]]
    assert ann.nearest(table.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(table.filter("vec_id < 3 OR vec_id = 140"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 1), (0, 2, 2), (0, 3, 140), (140, 1, 0), (140, 2, 1), (140, 3, 2)]


# The pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if name != "tokens":
            assert docs.columns == columns and docs.filter("n_chars <> length(text)").count() == 0
        if name == "language_id":
            assert kept[name] == before.filter("text rlike '[A-Za-z]'").count()
        if name == "near_duplicates":
            from visitmill.llm.ngram_join import ngram_join
            groups = ngram_join(before).collect()
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.class_id for r in groups}
        if name == "tokens":
            want = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
            assert collections.Counter((r.doc_id, r.decoded_sha256) for r in docs.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mixing", "tokens"]
    assert kept["near_duplicates"] < kept["line_dedup"] == kept["language_id"]


def test_pipeline_takes_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "Some words of the text and more", "en", "s", 5), (3, "", "en", None, 0), (4, "Some words of the text and more", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, SF).count()
