"""Token, HTML and score operators against the libraries, hand cases and
held-out labels; the pipeline against brute force."""

import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vetta.llm import entries, main_text, mixing, pieces, quality, token_counts, toxicity
from vetta.llm import words as W

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sp():
    return pieces.load(pieces.model_bytes(MODEL))


def odd_texts():
    rng = random.Random(11)
    marks = "ab  \n▁é日😀 　<s>\x00"
    return ["", " ", "  ", " a", "a ", "a  b", "▁x ▁", "日本語 と  英語", "x" * 5000, "<s> </s> <unk>",
            *("".join(rng.choice(marks) for _ in range(rng.randint(0, 300))) for _ in range(150))]


# ---- words

def test_words(corpus):
    texts = [t for _, t in corpus]
    w = W.split_words(pa.array(texts))
    for r, t in enumerate(texts):
        own = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.first[r]:w.first[r + 1]], w.end[w.first[r]:w.first[r + 1]])]
        assert own == WORD.findall(t or "")
    h = W.word_hashes(w)
    names = [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)]
    assert len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))
    part = W.split_words(pa.array(texts[3:]))
    assert W.word_hashes(part).tolist() == h[w.first[3]:].tolist()      # wherever a word stands


def test_word_hashes_across_segments(monkeypatch):
    text = pa.array([" ".join(f"word{i}é" for i in range(3000))])
    whole = W.word_hashes(W.split_words(text))
    monkeypatch.setattr(W, "SEGMENT_BYTES", 100)
    assert (W.word_hashes(W.split_words(text)) == whole).all()


# ---- SentencePiece

def test_chunk_table(sp):
    assert pieces.splits_at_marks(sp)
    texts = odd_texts()
    table = pieces.ChunkTable(sp, limit=200)    # emptied again and again
    for begin in range(0, len(texts), 10):
        part = texts[begin:begin + 10]
        ids, offsets = table.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [sp.encode(t) for t in part]


def test_encode_decode(docs, corpus, empty, sp):
    got = {r.doc_id: r for r in pieces.encode_decode(docs, MODEL).collect()}
    for i, t in corpus:
        ids = sp.encode(t or "")
        assert (got[i]["_ids"], got[i].decoded, got[i].ids) == (ids, sp.decode(ids), "y")
    assert pieces.encode_decode(empty, MODEL).count() == 0


def test_whole_texts(sp):
    ids, offsets = pieces.WholeTexts(sp).encode(odd_texts())
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [sp.encode(t) for t in odd_texts()]


@pytest.mark.parametrize("chunk, overlap", [(40, 1), (64, 8), (4096, 256)])
def test_resync(sp, chunk, overlap):
    resync = token_counts.Resync(sp, chunk, overlap)
    for t in odd_texts():
        assert resync.count(t) == len(sp.encode(t))
    assert chunk > 100 or resync.widened


def test_token_counts(docs, corpus, empty, sp):
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, MODEL, huge=500, chunk=200, overlap=20).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in corpus}
    assert token_counts.token_counts(empty, MODEL).count() == 0


# ---- HTML

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold\n text</b> of <a href='x'>the</a> page.<p>Second &eacute; block<br>here"


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a>Home</a></ul></nav>"
    f"<!-- <p>no</p> --><div class='ad'>Buy now</div><article>{ARTICLE}</article><footer>&copy; us</footer></body></html>",
    f"<body><header><p>Site</p></header><div id=main-body>{ARTICLE}</div><aside>Read this</aside>"
    f"<div class='comments'><p>First comment, quite a long one, that says very much indeed about nothing at all</p></div>",
    f"<div class='top menu'><a href=1>One</a> <a href=2>Two</a></div><main>{ARTICLE}<form><input><p>Mail</p></form>"
    f"<section id='comments'><p>Nice!</p></section></main><div role=contentinfo>foot</div>",
    f"<BODY><DIV>{ARTICLE.upper().replace('&AMP;', '&amp;').replace('&EACUTE;', '&eacute;')}</DIV></BODY>",
])
def test_main_text(page):
    want = "Title & more\nFirst bold text of the page.\nSecond é block here"
    assert main_text.main_text(page).lower() == want.lower()


def test_main_text_of_odd_pages(spark):
    pages = {1: None, 2: "", 3: "plain words", 4: "<p", 5: "<p>a<p>b</div></p>c", 6: "<script>x", 7: "1 < 2 <b>&amp; 3", 8: "<ul><li>x"}
    df = spark.createDataFrame([(i, h, "own") for i, h in pages.items()], "page_id long, html string, main_text string")
    rows = main_text.extract(df).collect()
    got = {r.page_id: r["_main_text"] for r in rows}
    assert got == {1: "", 2: "", 3: "plain words", 4: "<p", 5: "a\nb\nc", 6: "", 7: "1 < 2 & 3", 8: "x"}
    assert {r.main_text for r in rows} == {"own"}
    assert main_text.extract(df.where("false")).count() == 0


def test_main_text_of_pages(spark, sf_dir):
    """The article of every page of the tables, cut out by plain text search."""
    for r in entries.op7_html_extraction(spark, sf_dir).join(
            spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") + 9:]
        article = article[:article.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = "".join(f"<p>Paragraph {i} of the long body says one thing after another and links to nothing.</p>" for i in range(12))
SHORT = "<p>A shorter part of the text, with a sentence of its own.</p>"


def long_text():
    return re.sub("</p>", "\n", LONG).replace("<p>", "").strip()


def test_main_text_beside_a_card():
    """A short named card does not stand for the long body beside it."""
    for card in ("<article><h3>Card</h3><p>Read more</p></article>", "<div role=article>Card</div>"):
        got = main_text.main_text(f"<body><div><h1>Head</h1>{LONG}</div><div>{card}</div></body>")
        assert long_text() in got


def test_main_text_of_several_articles():
    parts = [f"<article><h2>Part {i}</h2>{LONG if i == 1 else SHORT}</article>" for i in range(3)]
    for page in (f"<div>{''.join(parts)}</div>", f"<main>{''.join(parts)}</main>"):
        got = main_text.main_text(f"<body>{page}<div><a href=1>One</a> <a href=2>Two</a></div></body>")
        assert long_text() in got and got.count("A shorter part") == 2 and "Two" not in got
        assert [x for x in got.split("\n") if x.startswith("Part ")] == ["Part 0", "Part 1", "Part 2"]
    links = "<div>" + "".join(f"<a href={i}>Other page {i}</a> " for i in range(9)) + "</div>"
    assert main_text.main_text(f"<main>{LONG}{links}</main>") == long_text()


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'><h1>Head</h1>{LONG}</div>",
    f"<div id='content' class='no-header'><article><h1>Head</h1>{LONG}</article></div>",
    f"<div class='sidebar'><main><h1>Head</h1>{LONG}</main></div>",
    f"<div class='widget'><h1>Head</h1>{LONG}</div><div class='menu'><a href=1>One</a></div>",
    f"<article><div class='article-header'><h1>Head</h1></div>{LONG}</article><div class='site-footer'><a href=1>One</a></div>",
    f"<main><h1>Head</h1><section class='related-work'>{LONG}</section><div class='post-share'><a href=1>One</a></div></main>",
])
def test_main_text_of_wrappers(page):
    """Class words of a wrapper or heading do not take the article out."""
    assert main_text.main_text(f"<body>{page}</body>") == "Head\n" + long_text()


# ---- learned scores

@pytest.fixture(scope="module")
def labelled(spark, words):
    """Documents with toxic words, junk symbols and plain prose, with labels."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["Blarg", "blargish", "zwick!", "zwicker"])
        if junk:
            text = [w + rng.choice(["***", "###", "$$$"]) for w in text]
        rows.append((i, " ".join(text), 1.0))
        labels.append((i, None if i % 17 == 0 else int(not junk), None if i % 19 == 0 else int(toxic)))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, "\n", 1.0), (1003, "x" * 50_000, 1.0)]
    labels += [(1, 0, 0)] * 2 + [(None, 1, 1), (5000, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
            {i: (q, t) for i, q, t in labels if i not in (1, None)})


def area(scores, truth):
    good, bad = scores[truth], scores[~truth]
    return ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()


def held_out(df):
    return df.where("crc32(cast(doc_id as string)) % 3 = 1").toPandas()


def test_toxicity(labelled):
    docs, labels, truth = labelled
    got = toxicity.toxicity_scores(docs, labels).withColumnRenamed("_score", "p")
    frame = got.toPandas()
    assert len(frame) == 904 and frame.p.between(0, 1).all() and (frame.score == 1).all()
    test = frame[frame.doc_id.isin([i for i in truth if i < 900 and truth[i][1] is not None])]
    test = test[test.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 3 == 1)]
    y = test.doc_id.map(lambda i: truth[i][1] == 1).to_numpy()
    assert area(test.p.to_numpy(), y) > 0.98 and ((test.p >= 0.7) == y).mean() > 0.95
    assert frame[frame.doc_id.isin([1000, 1001, 1002])].p.nunique() == 1


def test_quality(labelled):
    docs, labels, truth = labelled
    frame = quality.quality_scores(docs, labels).toPandas()
    assert len(frame) == 904 and frame.score.between(0, 1).all()
    test = frame[frame.id.map(lambda i: i < 900 and i in truth and truth[i][0] is not None
                              and __import__("zlib").crc32(str(i).encode()) % 3 == 1)]
    y = test.id.map(lambda i: truth[i][0] == 1).to_numpy()
    assert area(test.score.to_numpy(), y) > 0.99 and ((test.score >= 0.5) == y).mean() > 0.97


def test_scores_without_labels(labelled, empty):
    docs, labels, _ = labelled
    none = labels.where("false")
    assert toxicity.toxicity_scores(docs, none).agg(F.min("_score"), F.max("_score")).first()[:] == (0.5, 0.5)
    assert quality.quality_scores(docs, none).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert quality.quality_scores(empty, labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(labelled):
    """Turning every held-out label round leaves all scores as they are."""
    docs, labels, _ = labelled
    turn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(1)) == 1
    other = labels.select("doc_id", *[F.when(turn, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")])
    for run in (lambda y: toxicity.toxicity_scores(docs, y).select("doc_id", "_score"),
                lambda y: quality.quality_scores(docs, y).select("id", "score")):
        a, b = (np.array(sorted(map(tuple, run(y).collect()))) for y in (labels, other))
        assert np.allclose(a, b, atol=1e-5)


def test_toxicity_probabilities_add_up():
    """log_ratio's models are distributions: with equal counts the ratio is 0."""
    table = {"key": np.array([0x2061, 0x2062], dtype=np.int64), "t": np.array([3.0, 1.0]), "o": np.array([3.0, 1.0])}
    empty = {"grams": {k: v[:0] for k, v in table.items()},
             "contexts": {**{k: v[:0] for k, v in table.items()}, "kt": np.zeros(0), "ko": np.zeros(0)}}
    model = {n: empty for n in range(1, toxicity.ORDER + 1)}
    assert (toxicity.log_ratio(model, np.array([0x2061, 0x2062, 0x2063])) == 0).all()


def test_homes():
    """A key's own context and all shorter ones are found in its bucket, or are upper rows."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(97, 100, (4000, 7)) @ (1 << 8 * np.arange(7, dtype=np.int64)))
    contexts, hot = keys >> 8, {}
    for d in range(2, 6):
        home, n = np.unique(contexts & ((1 << 8 * d) - 1), return_counts=True)
        hot[d] = home[n > 40]
    homes = toxicity.Homes(hot, 7)
    bucket, upper = homes.find(contexts, np.full(len(keys), 6))
    assert not upper.any() and set(bucket) == set(range(7)) and len(hot[2]) and not len(hot[5])
    for size in range(2, 7):
        own, short = homes.find(contexts & ((1 << 8 * size) - 1), np.full(len(keys), size))
        assert (short | (own == bucket)).all() and short.any() == (size == 2 or bool(len(hot.get(size, ()))))
    assert (toxicity.unpacked(toxicity.packed(keys), len(keys)) == keys).all()


def plain_evidence(train, texts):
    """Evidence by Python loops over the counts of all n-grams."""
    def words(t):
        return re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())

    def grams(word):
        b = b" " * 6 + word.encode() + b" "
        return [b[i - 6:i + 1] for i in range(6, len(b))]

    orders = {7: [Counter(), Counter()]}
    for t, y in train:
        for word, n in Counter(words(t)).items():
            for g in grams(word):
                orders[7][1 - y][g] += n
    for n in range(6, 0, -1):
        orders[n] = [Counter(), Counter()]
        for low, high in zip(orders[n], orders[n + 1]):
            for g, c in high.items():
                low[g[1:]] += c if g[1:2] == b" " else 1
    for n in (1, 2):
        orders[n] = [orders[n][0] + orders[n][1]] * 2
    contexts = {n: [defaultdict(list), defaultdict(list)] for n in orders}
    for n, tables in orders.items():
        for c in (0, 1):
            for g, k in tables[c].items():
                contexts[n][c][g[:-1]].append(k)

    def value(word):
        total = 0.0
        for g in grams(word):
            p = [1 / 256, 1 / 256]
            for n in range(1, 8):
                for c in (0, 1):
                    seen = contexts[n][c].get(g[-n:-1] if n > 1 else b"", [])
                    if seen:
                        p[c] = (max(orders[n][c][g[-n:]] - 0.75, 0) + 0.75 * len(seen) * p[c]) / sum(seen)
            total += math.log(p[0] / p[1])
        return max(total - 3, 0)

    known = {w: value(w) for w in {w for t in texts for w in words(t)}}
    return [sum(known[w] for w in words(t)) / max(1, len(words(t))) for t in texts]


@pytest.mark.parametrize(("frequent", "block", "homes"), [(1 << 16, 1 << 16, 1 << 18), (3, 64, 1 << 18), (3, 64, 16)])
def test_toxicity_keeps_rare_counts(spark, words, monkeypatch, frequent, block, homes):
    """A toxic word seen once among millions of n-grams of either class counts,
    and words outside the broadcast table do too."""
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", block)
    monkeypatch.setattr(toxicity, "HOME_KEYS", homes)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (f" zw{i}ick blarg" if i % 3 == 0 else ""), int(i % 3 == 0))
            for i in range(90)]
    rows += [(100 + i, "common words here " * 80_000, i % 2) for i in range(8)]
    rows += [(i, "Qwertzuiop! " + rows[i % 7][1], 1) for i in range(200, 203)]
    rows += [(300, "one qwertzuiop", 0), (300, "one qwertzuiop", 0), (None, "one qwertzuiop more", 0), (302, "ordinary", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i is not None and i < 300], "doc_id long, toxic int")
    counted = {r.doc_id for r in docs.where("crc32(cast(doc_id as string)) % 3 <> 1 and xxhash64(doc_id, 'calibrate') % 6 <> 0").collect()}
    train = [(t, y) for i, t, y in rows if i in counted and i < 300]
    assert all(sum(len(t) for t, y in train if y == c) > 2_000_000 for c in (0, 1))
    want = plain_evidence(train, [r[1] for r in rows])
    assert want[-3] > 0
    got = sorted((r.doc_id or -1, r.text, r.evidence) for r in toxicity.toxicity_scores(docs, labels).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted((r[0] or -1, r[1]) for r in rows)]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted((r[0] or -1, r[1], e) for r, e in zip(rows, want))], atol=1e-6)


def test_isotonic():
    n, good = np.array([4.0, 2.0, 2.0, 4.0]), np.array([0.0, 2.0, 1.0, 4.0])
    assert quality.isotonic(n, good).tolist() == [0.0, 0.75, 0.75, 1.0]


def test_statistics_do_not_depend_on_the_batch(corpus):
    texts = [t for _, t in corpus]
    whole = quality.statistics(pa.array(texts))
    apart = np.vstack([quality.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, apart)


# ---- pipeline

def test_pipeline(spark, sf_dir, sp):
    """Every stage against a plain Python version, on the rows it is given."""
    from tests.llm.test_exact import copies, near

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near-duplicates", "mixing", "sentencepiece"]

    def rows(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    scored = entries.op5_toxicity(spark, sf_dir).where("predicted = 0").select("doc_id")
    assert clean.columns == docs.columns
    assert rows(clean) == rows(docs.join(scored, "doc_id").select("doc_id", "text"))
    single = stages["exact dedup"](spark, clean, sf_dir).cache()
    assert {i for i, _ in rows(single)} == {max(ids) for ids in copies(rows(clean)).values()}
    sparse = stages["near-duplicates"](spark, single, sf_dir).cache()
    assert {i for i, _ in rows(sparse)} == {i for i, (_, c) in near(rows(single)).items() if i == c}
    mixed = stages["mixing"](spark, sparse, sf_dir).cache()
    sized = sparse.withColumn("size", F.lit(0) + F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    times = {r.doc_id: r.repeats for r in mixing.mix(sized, "size").collect()}
    assert rows(mixed) == sorted((i, t) for i, t in rows(sparse) for _ in range(times[i]))
    got = sorted((r.doc_id, r.n_tokens) for r in stages["sentencepiece"](spark, mixed, sf_dir).collect())
    assert got == sorted((i, len(sp.encode(t))) for i, t in rows(mixed))
