"""Mixing to target weights by soft membership: a classifier's domain posteriors, and the rates that meet the targets.

All of it is DataFrame work. Documents needn't belong to one domain: a naive Bayes classifier, taught by a labelled
table, gives each a posterior for every domain, and its tokens count for the domains by that share. Rates r are found
by projected gradient on || sum_i n_i p_i r_i - targets ||, in the metric of M = sum_i n_i p_i p_i', in which a step of
one is right and the targets are met in a few. Where nonnegative rates can't meet them, plain projected gradient with
momentum goes on to the nearest that they can. A step needs one aggregation to a number for each domain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm._common import ASCII_SPACE, free_name, saved

#: Labelled documents and words that the classifier learns from.
SAMPLE_DOCS, VOCABULARY = 4000, 2048
#: How many words' evidence a document's mean log-likelihood counts for.
EVIDENCE = 30.0


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for space in ASCII_SPACE[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, " ", -1)


def _classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_docs: int, vocabulary: int) -> DataFrame:
    """(word, w_0, w_1, ...): log-likelihoods of the most frequent words, `vocabulary` rows at the most."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    said = docs.select(F.col("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("domain", F.explode(words(F.col("text"))).alias("word")).where("word <> ''")
    counts = said.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"c_{k}") for k, d in enumerate(domains)])
    counts = saved(counts.orderBy(F.desc("n"), "word").limit(vocabulary))
    totals = counts.agg(*[F.sum(f"c_{k}") for k in range(len(domains))]).first()
    return counts.select("word", *[F.log((F.col(f"c_{k}") + 1) / float((totals[k] or 0) + vocabulary)).alias(f"w_{k}") for k in range(len(domains))])


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, p_0, p_1, ...) for each id: its words, and the posterior of each domain over even priors.

    labelled has (doc_id, domain); it may cover few documents, of which `sample_docs` teach the words. Rows that share
    an id are one document, and so are those without. Where no word is known, all domains are as likely.
    """
    table = _classifier(docs, labelled, domains, sample_docs, vocabulary)
    said = docs.select("doc_id", F.explode(words(F.col("text"))).alias("word")).join(F.broadcast(table), "word", "left")
    sums = said.groupBy("doc_id").agg(F.count_if(F.col("word") != "").alias("n_tokens"), F.count("w_0").alias("known"), *[F.sum(f"w_{k}").alias(f"s_{k}") for k in range(len(domains))])
    mean = [F.coalesce(F.col(f"s_{k}") / F.greatest("known", F.lit(1)), F.lit(0.0)) for k in range(len(domains))]
    top = F.greatest(*mean) if len(mean) > 1 else mean[0]
    shares = [F.exp((m - top) * F.least("known", F.lit(EVIDENCE))) for m in mean]
    out = sums.select("doc_id", "n_tokens", *[s.alias(f"e_{k}") for k, s in enumerate(shares)])
    total = sum((F.col(f"e_{k}") for k in range(len(domains))), F.lit(0.0))
    return out.select("doc_id", "n_tokens", *[(F.col(f"e_{k}") / total).alias(f"p_{k}") for k in range(len(domains))])


def mixing_rates(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], tokens: float | None = None, at_least: float = 0.0, rounds: int = 40, close: float = 1e-7, sample_docs: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY,
) -> DataFrame:
    """(doc_id, n_tokens, p_0, ..., rate): a rate of `at_least` or more for each id, so that expected domain tokens meet the targets.

    targets has a weight of zero or more for each domain, of any sum. `tokens` is the expected total: by default what there
    is; with at_least over zero, by default the least total that asks no domain for less than at_least times what it has.
    Ids, null too, are as in posteriors(); documents without words have the rate that their posterior gives them, and
    add nothing. Where the targets can't be met, the rates come as close as nonnegative rates can. No rows, no rates.
    """
    domains = sorted(targets)
    ps = [f"p_{k}" for k in range(len(domains))]
    table = saved(posteriors(docs, labelled, domains, sample_docs, vocabulary))
    n = F.col("n_tokens").cast("double")
    has = table.agg(*[F.sum(n * F.col(p)) for p in ps], *[F.sum(n * F.col(p) * F.col(q)) for p in ps for q in ps]).first()
    now, metric = np.array([x or 0.0 for x in has[: len(ps)]]), np.array([x or 0.0 for x in has[len(ps) :]]).reshape(len(ps), len(ps))
    weights = np.array([max(0.0, float(targets[d])) for d in domains])
    weights = weights / weights.sum() if weights.sum() else np.full(len(ps), 1 / len(ps))
    if tokens is None:
        tokens = max((at_least * a / w for a, w in zip(now, weights, strict=True) if w), default=0.0) if at_least else now.sum()
    goal = weights * tokens
    inverse = np.linalg.pinv(metric + np.eye(len(ps)) * 1e-9 * max(1.0, np.trace(metric)))
    rows = table.withColumn("rate", F.lit(max(1.0, at_least))).withColumn("_last", F.col("rate"))
    reached = last = now * max(1.0, at_least)
    smooth, met, momentum = max(1e-12, float(np.linalg.eigvalsh(metric).max(initial=0.0))), True, 1.0
    for k in range(2 * rounds):
        # in the metric's own steps while the targets seem within reach, else in plain ones, with momentum
        ahead = 0.0 if met else (momentum - 1) / (momentum := (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2)
        start, off = F.col("rate") + F.lit(ahead) * (F.col("rate") - F.col("_last")), reached + ahead * (reached - last) - goal
        step = inverse @ off if met else off / smooth
        moved = F.greatest(F.lit(float(at_least)), start - sum((F.lit(float(s)) * F.col(p) for s, p in zip(step, ps, strict=True)), F.lit(0.0)))
        rows = rows.select("doc_id", "n_tokens", *ps, moved.alias("rate"), F.col("rate").alias("_last"))
        if k % 4 == 3:  # the expression starts anew
            rows = saved(rows)
        last, reached = reached, np.array([x or 0.0 for x in rows.agg(*[F.sum(n * F.col(p) * F.col("rate")) for p in ps]).first()])
        bound = close * max(1.0, tokens)
        if np.abs(reached - goal).max(initial=0.0) <= bound:
            break
        if np.abs(reached - last).max(initial=0.0) <= bound or k == rounds - 1:
            if not met:
                break
            met, momentum, last = False, 1.0, reached
            rows = saved(rows.withColumn("_last", F.col("rate")))
    return rows.drop("_last")


def mixed(docs: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more with the odds of the rest, drawn from the id's hash."""
    id_, rate, copy = (free_name(name, docs) for name in ("_id", "_rate", "_copy"))
    rows = docs.join(rates.select(F.col("doc_id").alias(id_), F.col("rate").alias(rate)), docs["doc_id"].eqNullSafe(F.col(id_)))
    odds = F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    copies = (F.floor(rate) + (odds < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    more = rows.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
    return more.select(*[docs[c] for c in docs.columns])
