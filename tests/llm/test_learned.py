"""Operators that learn, on held-out rows; main text of pages; the pipeline against the plain versions of its stages."""

import re

import numpy as np
import plain
import pyarrow as pa
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tempora.llm import queries as Q
from tempora.llm.html_text import ALONE, DIVE, SEVERAL, SHARE, SURGE, main_text, page_of, page_texts
from tempora.llm.mixing import EVIDENCE, mixed, mixing_rates, posteriors
from tempora.llm.quality import held_out, quality_scores
from tempora.llm.toxicity import LabelModel, toxicity_scores

SF = f"{DATA}/sf0.01"


def auc(rows):
    ranked = sorted(s for s, _ in rows)
    rank = lambda s: (np.searchsorted(ranked, s, "left") + np.searchsorted(ranked, s, "right")) / 2
    ones = [rank(s) for s, y in rows if y]
    n1, n0 = len(ones), len(rows) - len(ones)
    return (sum(ones) - n1 * n1 / 2) / (n1 * n0)


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.9), ("op7_quality", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    found = Q.QUERIES[name](spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert auc([(r.score, r[label]) for r in rows if r.held_out and r[label] is not None]) >= least


@pytest.mark.parametrize("scores", [toxicity_scores, quality_scores])
def test_scores_of_odd_rows(spark, with_nulls, scores):
    labels = spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(14)] + [(None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = scores(with_nulls, labels, learn=~held_out(5, 0))
    assert set(rows.columns) == set(with_nulls.columns)  # its own score takes the place of theirs
    got = rows.collect()
    assert len(got) == with_nulls.count() and all(0 <= r.score <= 1 for r in got)
    five = [r.score for r in got if r.doc_id == 5]
    assert len(five) == 2 and five[0] == pytest.approx(five[1], abs=2e-6)
    assert len({r.score for r in scores(with_nulls, labels.limit(0)).collect()}) == 1
    assert scores(with_nulls.limit(0), labels).collect() == []


def test_toxicity_means_the_same_under_a_cap(spark):
    """Weak voters, one toxic row in nine: a sample that takes as many rows of either label predicts as many toxic rows as all do."""
    rng = np.random.default_rng(5)
    toxic = rng.random(6000) < 0.11
    text = [" ".join([f"f{x}" for x in rng.integers(0, 40, 30)] + [v for v in ("grobian", "schuft", "lump", "wicht", "bengel", "halunke", "strolch") if rng.random() < (0.3 if y else 0.04)]) for y in toxic]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(toxic)], "doc_id long, toxic int")
    whole, capped = ([r.score for r in toxicity_scores(docs, labels, sample=most).collect()] for most in (6000, 400))
    assert np.mean(capped) == pytest.approx(np.mean(whole), abs=0.03)
    assert np.mean(np.array(capped) >= 0.5) == pytest.approx(np.mean(np.array(whole) >= 0.5), abs=0.03)


def test_wrong_labels_are_outvoted():
    """A tenth of the labels of either kind turned: the label model doesn't copy them, since they cast no vote."""
    rng = np.random.default_rng(8)
    truth = rng.random(4000) < 0.3
    votes = np.stack([rng.random(4000) < np.where(truth, a, b) for a, b in [(0.6, 0.02), (0.5, 0.03), (0.7, 0.05), (0.4, 0.01), (0.55, 0.04), (0.3, 0.02)]], axis=1).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # one voter twice: it must not count twice
    turned = rng.random(4000) < 0.1
    model = LabelModel.fit(votes, truth ^ turned, np.ones(4000))
    label = model.posterior(votes) >= 0.5
    assert (label[turned] == truth[turned]).mean() >= 0.8 and (label == truth).mean() >= 0.9
    assert model.share[0] == pytest.approx(model.share[6]) and model.share[0] < 0.6 and model.share[1:6].min() > model.share[0]
    assert np.allclose(model.fires[1][1], 0.5, atol=0.06) and np.allclose(model.fires[0][1], 0.03, atol=0.03)


def test_lexicons_of_two_languages():
    """Toxic rows of either language fire voters that the other never does; neither kind is taken for the clean one."""
    rng = np.random.default_rng(9)
    kind = rng.choice(3, 6000, p=[0.85, 0.1, 0.05])  # clean, toxic in one language, toxic in the other
    rates = np.array([[0.01] * 8, [0.5] * 4 + [0.0] * 4, [0.0] * 4 + [0.4] * 4])
    votes = (rng.random((6000, 8)) < rates[kind]).astype(float)
    model = LabelModel.fit(votes, (kind > 0) ^ (rng.random(6000) < 0.05), np.ones(6000))
    label = model.posterior(votes)
    assert min(label[(kind == k) & (votes.sum(axis=1) > 1)].mean() for k in (1, 2)) > 0.9 and label[kind == 0].mean() < 0.1


def test_toxicity_with_turned_labels(spark):
    """The whole operator, with a tenth of the learning labels turned, still tells the held-out rows apart."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    turned = labels.withColumn("toxic", F.when(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    rows = toxicity_scores(docs, turned, learn=~held_out(5, 0)).where(held_out(5, 0)).join(labels, "doc_id").collect()
    assert auc([(r.score, r.toxic) for r in rows if r.toxic is not None]) >= 0.9


def test_votes_of_all_voters(spark):
    """Scores are those of one voter after another."""
    from tempora.llm.quality import NEIGHBOURS, _unit, fit_voters, terms

    docs, labels = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    voters = fit_voters(docs, labels, ~held_out(4, 2))
    rows = docs.collect()
    unit = _unit((terms(pa.array([r.text for r in rows], pa.string())) - voters.mean) @ voters.directions)
    want = {r.doc_id: plain.vote(u, voters.vectors, voters.labels, NEIGHBOURS) for r, u in zip(rows, unit)}
    got = {r.doc_id: r.score for r in quality_scores(docs, labels, ~held_out(4, 2)).collect()}
    assert len(got) == len(want) and sum(abs(got[i] - want[i]) > 1e-3 for i in want) <= 0.01 * len(want)  # single precision may swap near ties


# ---- mixing


def test_posteriors_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = Q.labelled_domains(docs, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet"))
    domains = sorted(Q.DOMAIN_TARGETS)
    of = {r.doc_id: r.domain for r in known.collect() if r.domain in domains}
    want = plain.posteriors([(r.doc_id, r.text) for r in docs.collect()], of, domains, 300, EVIDENCE)
    rows = mixing_rates(docs, known, Q.DOMAIN_TARGETS, vocabulary=300).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.n_tokens == want[r.doc_id][0] and [r[f"p_{k}"] for k in range(4)] == pytest.approx(want[r.doc_id][1], abs=1e-6)
    n, p = np.array([r.n_tokens for r in rows], float), np.array([want[r.doc_id][1] for r in rows])
    goal = np.array([Q.DOMAIN_TARGETS[d] for d in domains]) * n.sum()
    # the same descent on arrays: steps in the metric of the expected tokens, rates held at zero or more
    metric, rate = np.linalg.pinv((p * n[:, None]).T @ p), np.ones(len(rows))
    for _ in range(500):
        rate = np.maximum(0, rate - p @ (metric @ ((n * rate) @ p - goal)))
    assert np.abs((n * rate) @ p - goal).max() <= 1e-3 * n.sum()
    assert [r.rate for r in rows] == pytest.approx(rate.tolist(), abs=1e-2)

def test_mixing_meets_targets(spark):
    rows = Q.op1_mixing(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(plain.words(t)) for i, t in texts.items()}
    total = sum(r.n_tokens for r in rows)
    for domain, share in Q.DOMAIN_TARGETS.items():
        assert sum(r.n_tokens * r[f"p_{domain}"] * r.rate for r in rows) == pytest.approx(share * total, rel=1e-4)
    assert all(r.rate >= 0 and sum(r[f"p_{d}"] for d in Q.DOMAIN_TARGETS) == pytest.approx(1) for r in rows)


def test_mixing_knows_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = Q.labelled_domains(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = posteriors(docs.select("doc_id", "text"), known, sorted(Q.DOMAIN_TARGETS)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = [max(range(4), key=lambda k: r[f"p_{k}"]) == sorted(Q.DOMAIN_TARGETS).index(r.lang) for r in rows if r.lang in Q.DOMAIN_TARGETS]
    assert sum(right) >= 0.95 * len(right)


def test_mixing_is_least_squares(spark):
    """Where the targets can't be met, no nonnegative rates come closer: the gradient is nought or pushes below zero."""
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(["a", "b"], 20, p=[q, 1 - q]))) for k, q in enumerate([0.9, 0.8, 0.7, 0.9, 0.85])], "doc_id long, text string")
    known = spark.createDataFrame([(0, "x"), (2, "y")], "doc_id long, domain string")
    rows = mixing_rates(docs, known, {"x": 0.0, "y": 1.0}).collect()
    n, p, r = (np.array([[x.n_tokens] for x in rows]), np.array([[x.p_0, x.p_1] for x in rows]), np.array([x.rate for x in rows]))
    gradient = (n * p) @ ((n * p * r[:, None]).sum(axis=0) - np.array([0.0, 1.0]) * n.sum())
    assert (r >= 0).all() and np.all((np.abs(gradient) < 1e-3 * n.sum() ** 2) | ((r < 1e-9) & (gradient > 0)))


def test_mixing_odd(spark, with_nulls):
    known = spark.createDataFrame([(5, "en"), (11, "ja"), (None, "en"), (7, None)], "doc_id long, domain string")
    rates = mixing_rates(with_nulls, known, {"en": 1, "ja": 1})
    rows = rates.collect()
    assert len(rows) == with_nulls.select("doc_id").distinct().count() and all(r.rate >= 0 and r.rate == r.rate for r in rows)
    out = mixed(with_nulls, mixing_rates(with_nulls, known, {"en": 1, "ja": 1}, at_least=1.0))
    assert out.columns == with_nulls.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in with_nulls.collect()}
    assert mixing_rates(with_nulls.limit(0), known, {"en": 1, "ja": 1}).collect() == []


# ---- pages


LONG = "This is the first paragraph of the article, and it is long enough to be seen as text."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just words", "just words"), ("<p>a &lt;b&gt; &amp; c&nbsp;d&#233;&#x2014;</p>", "a <b> & c dé—"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Head</h1><p>{LONG}<p>Second\n  line <b>bold</b>.</article><footer>&copy; x</footer></body>", f"Head {LONG} Second line bold."),
    (f"<div id='main'><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><script>var a = '<p>no</p>';</script></div>", LONG),
    (f"<div class='cookie-notice'><p>We use cookies for everything that you do here.</p></div><p>{LONG}</p><aside>{LONG}</aside><form><p>Name and address</p></form>", LONG),
    (f"<p>{LONG}<!-- <p>hidden</p> --></p><p>x < y and y > z</p>", f"{LONG} x < y and y > z"),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article><header>Site</header>", f"Title {LONG}"),
])
def test_main_text(page, text):
    assert main_text(page) == text


PLAIN = "".join(f"<div class='x1'>{t}</div>" for t in ("Start", "Our offers", "Contact us", "Imprint", "Log in"))
TEXT = f"<p>{LONG}</p><p>{LONG}</p>"


@pytest.mark.parametrize(("page", "text", "gone"), [
    (f"{PLAIN}<div>{TEXT}</div>{PLAIN}", f"{LONG} {LONG}", ["Our offers", "Contact us", "Imprint"]),  # boilerplate without a telling name
    (f"<article><h1 class='entry-header'>Title</h1>{TEXT}</article>", f"Title {LONG} {LONG}", []),
    (f"<div class='content with-sidebar'>{TEXT}</div><div class='sidebar'><p>{LONG}!</p></div>", f"{LONG} {LONG}", ["!"]),
])
def test_lines_fall_by_their_weight(page, text, gone):
    got = main_text(page)
    assert text in got and not any(x in got for x in gone)


@pytest.mark.parametrize("between", ["<h2><a href='/x'>A linked heading</a></h2>", "<ul><li><a href='/x'>One item</a></li></ul>", "<p>By <a href='/x'>J&oacute;s&eacute;   Mart&iacute;nez</a></p>", "<h2><a name='x'>Here</h2>"])
def test_links_inside_the_text(between):
    said = {"h2": "A linked heading", "ul": "One item", "p>": "By Jósé Martínez"}[between[1:3]] if "name" not in between else "Here"
    assert main_text(f"<div>{TEXT}{between}{TEXT}</div>") == f"{LONG} {LONG} {said} {LONG} {LONG}"


def test_link_weights():
    weigh = lambda page: [line.weight for line in page_of(page).lines]
    assert weigh("<p>By <a href='/x'>J&oacute;s&eacute;   Mart&iacute;nez</a></p>") == [len("By ")]
    assert weigh(f"<p><a name=top>{LONG}</p><p>{LONG}</p>") == [len(LONG)] * 2
    assert weigh(f"<div><p><a href='/x'>open</p><p>{LONG}</p></div>") == [0, len(LONG)]


@pytest.mark.parametrize("name", ["post-share", "search-results", "article-tags", "content-side", "alert-story"])
def test_names_do_not_hide_the_article(name):
    """A name that hints at an aside says nothing about an element with most of the text."""
    assert main_text(f"<body><nav>Home</nav><div class='{name}'><h1>Head</h1>{TEXT}</div><footer>Imprint</footer></body>") == f"Head {LONG} {LONG}"
    assert main_text(f"<body><div id='text'>{TEXT}</div><div class='{name}'><p>{LONG[:70]}!</p></div></body>") == f"{LONG} {LONG}"


def test_linked_paragraphs():
    linked = "<p><a href='/y'>A linked sentence of the article.</a></p>"
    assert main_text(f"<article>{TEXT}{linked}{TEXT}</article>") == f"{LONG} {LONG} A linked sentence of the article. {LONG} {LONG}"


def random_page(rng, depth=0):
    out = []
    for _ in range(int(rng.integers(1, 12))):
        said = " ".join("abcdefgh"[: int(rng.integers(1, 9))] for _ in range(int(rng.integers(0, 40)) if rng.random() < 0.5 else int(rng.integers(0, 4))))
        made = [f"<p>{said}</p>", f"<li><a href='/'>{said}</a></li>", f"<div class='x'>{said}</div>", f"<aside>{said}</aside>", f"<h2>{said[:20]}</h2>", f"<table><tr><td>{said}<td>x</table>"]
        if depth < 3 and rng.random() < 0.3:
            name = rng.choice(["div", "div", "section", "td", "article"], p=[0.4, 0.3, 0.15, 0.1, 0.05])
            made = [f"<{name}>{random_page(rng, depth + 1)}</{name}>"]
        out.append(rng.choice(made))
    return "".join(out)


def test_windows_decide():
    """By chance: the kept lines are those of a plain version; window and thresholds change what is kept."""
    rng = np.random.default_rng(6)
    pages, changed = [random_page(rng) for _ in range(400)], {"window": 0, "surge": 0, "dive": 0}
    for page in pages:
        for window, surge, dive in ((3, SURGE, DIVE), (5, 200, 20), (1, 40, 40)):
            assert main_text(page, window, surge, dive) == " ".join(plain.kept_lines(page_of(page), window, surge, dive, SHARE, ALONE, SEVERAL))
        for name, value in (("window", 7), ("surge", 300), ("dive", 90)):
            changed[name] += main_text(page) != main_text(page, **{name: value})
    assert min(changed.values()) >= 15


def test_articles_stay_whole_and_boilerplate_goes(spark):
    """Over all pages: with their own names, with names that say nothing, and with no telling element either."""
    same = {"named": 0, "unnamed": 0, "bare": 0}
    pages = [r.html for r in spark.read.parquet(f"{DATA}/sf0.1/pages.parquet").select("html").collect()]
    for page in pages:
        article = page[page.index("<article>") : page.index("</article>")]
        text = " ".join(line.text for line in page_of(article).lines)
        unnamed = re.sub(r"class=\"\w+\"", 'class="x1"', page)
        same["named"] += main_text(page) == text
        same["unnamed"] += main_text(unnamed) == text
        same["bare"] += main_text(re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", unnamed)) == text
    assert same["named"] == len(pages) and same["unnamed"] >= len(pages) - 2 and same["bare"] >= 0.96 * len(pages)


@pytest.mark.parametrize(("page", "text"), [
    (f"<div><h1>Head</h1><p>By A. Author</p><p>{LONG}</p>{''.join(f'<li>item {k}</li>' for k in range(9))}<p>{LONG}</p><p>End.</p></div>", f"Head By A. Author {LONG} {' '.join(f'item {k}' for k in range(9))} {LONG} End."),
    (f"<div>{TEXT}<table><tr><td>a<td>b<tr><td>c<td>d</table></div><div>Imprint</div>", f"{LONG} {LONG} a b c d"),
    (f"<div class=x>We use cookies to make this site better for everyone who visits it.</div><div><h1>T</h1><div class=x>By X</div><div>{TEXT}{TEXT}</div></div>", f"T {LONG} {LONG} {LONG} {LONG}"),
    (f"<div>{TEXT}</div><div class=x>Sign up to our weekly email, and never miss it.</div><section>{TEXT}</section>", f"{LONG} {LONG} Sign up to our weekly email, and never miss it. {LONG} {LONG}"),  # between two halves nothing tells it from the article
])
def test_light_lines_of_the_article_stay(page, text):
    assert main_text(page) == text


def test_pages_query(spark):
    rows = Q.op10_html_text(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and " ".join(r.text.split()) == r.text for r in rows)


def test_pages_odd(spark):
    df = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x</p>", 6), (1, None, None, 5), (2, "v", "<p>" + "word " * 200000, 7)], "page_id long, url string, html string, n_chars int")
    rows = page_texts(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 1), (1, 0), (1, 0), (2, 999999)]
    assert page_texts(df.limit(0)).collect() == []


# ---- the pipeline


def test_pipeline(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    names = [n for n, _ in P.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in P.STAGES:
        kept.append(P.saved(stage(spark, kept[-1], SF)))
    assert all(df.columns == docs.columns for df in kept[:-1]) and len(names) == 5
    table = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    start, good, single, clean, mix = map(table, kept[:-1])

    scores = {r.doc_id: r.s for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"), learn=~held_out(4, 2), column="s").select("doc_id", "s").collect()}
    assert sorted(i for i, _ in good) == sorted(i for i, _ in start if scores[i] >= P.QUALITY)

    named = plain.near_duplicates(good, width=5)
    left = {i for i, _ in single}
    assert left <= {c for _, c in named.values()}  # what one table of fingerprints links is linked by more of them
    assert len(left) == len(single) and len(left) >= 0.9 * len({c for _, c in named.values()})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, found in plain.contamination(single, items).items() if found[1]}
    assert hit and sorted(clean) == sorted((i, t) for i, t in single if i not in hit)

    assert {i for i, _ in mix} == {i for i, _ in clean} and len(mix) >= len(clean)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in kept[-1].collect())
    assert [x[:1] + x[2:] for x in got] == [x[:1] + x[2:] for x in plain.token_file(mix, Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER)))]
    assert sorted(x[1] for x in got) == sorted(x[1] for x in plain.token_file(mix, Tokenizer.from_file(Q.vocabulary_path(Q.TOKENIZER))))


def test_pipeline_of_nothing(spark, with_nulls):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = P.saved(stage(spark, docs, SF))
    assert docs.collect() == []
    odd = with_nulls.select("doc_id", "text", "lang", "source", F.lit(0).alias("n_chars"))
    for _, stage in P.STAGES[1:]:
        odd = P.saved(stage(spark, odd, SF))
    assert odd.count() > 0
