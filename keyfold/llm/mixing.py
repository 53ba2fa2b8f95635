"""Soft-membership mixing in DataFrame functions only.

A naive Bayes classifier, whose counts are a table made from labelled documents, gives
each document a posterior over domains. Document rates r minimise

    1/2 * || sum_i r_i * n_i * p_i - T ||^2   subject to r_i >= least_rate

by projected gradient steps, where n_i counts a document's words (runs of anything but
white space; they are the tokens of this operator), p_i is its posterior and T holds the
target words of each domain. Steps are taken in the metric diag(n), scaled by the inverse
of the D x D matrix sum_i n_i * p_i * p_i'. Only D sums and such a matrix go to the driver
in a step and a document's rate is a function of its posterior alone.

Words are features by their hash modulo BUCKETS, so the model has a row for each bucket
whatever the vocabulary, and no word is left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.common import fresh, stored

SPACE = r"[\x20\x09-\x0D]+"
#: Bounds of the classifier: labelled documents to count words in, buckets of words; and its smoothing.
SAMPLE_DOCUMENTS = 20_000
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Steps after which the fit is an error if it still moves, the relative size that counts as met, the share of the squared distance that a step has to gain, steps between tables.
STEPS = 400
TOLERANCE = 1e-6
STILL = 1e-7
STORE_EVERY = 8


class NotConverged(RuntimeError):
    """The rates still moved after the last step."""


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def word_model(labelled: DataFrame, text_column: str, domain_column: str, domains: list[str]) -> tuple[DataFrame, list[float], list[float]]:
    """A table (bucket, l0, l1, ...) of log-likelihoods by domain, those of a bucket without words, and the log priors.

    Counts words in about SAMPLE_DOCUMENTS labelled documents, chosen by a hash of the
    text; rows whose domain is not in ``domains`` do not count.
    """
    labelled = labelled.select(F.col(text_column).alias("text"), F.col(domain_column).alias("domain")).where(F.col("domain").isin(domains))
    share = min(1.0, SAMPLE_DOCUMENTS / max(labelled.count(), 1))
    labelled = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    words = labelled.select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word != ''")
    by = lambda d: F.count(F.when(F.col("domain") == d, 1))
    counts = stored(words.groupBy(_bucket(F.col("word")).alias("bucket")).agg(*(by(d).alias(f"c{k}") for k, d in enumerate(domains))), "mix-words")
    totals = [(x or 0) + SMOOTHING * BUCKETS for x in counts.agg(*(F.sum(f"c{k}") for k in range(len(domains)))).first()]
    documents = labelled.agg(*(by(d) for d in domains)).first()
    logs = [F.log((F.col(f"c{k}") + SMOOTHING) / F.lit(totals[k])).alias(f"l{k}") for k in range(len(domains))]
    everyone = sum(x or 0 for x in documents) + len(domains)
    return counts.select("bucket", *logs), [float(np.log(SMOOTHING / x)) for x in totals], [float(np.log(((x or 0) + 1) / everyone)) for x in documents]


def posteriors(df: DataFrame, id_column: str, text_column: str, model: DataFrame, unseen: list[float], priors: list[float]) -> DataFrame:
    """id, text_hash, copies (equal rows), n_words, p0, p1, ...: the posterior of each distinct row.

    The model has at most BUCKETS rows, so it is broadcast; sums are made within a
    partition before the shuffle, which has one row for each document.
    """
    d = len(priors)
    # The hash is taken before the words are dealt out: after that it would be taken once a word.
    hashed = df.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), _words(F.col(text_column)).alias("words"))
    rows = hashed.select("id", "text_hash", F.posexplode("words").alias("pos", "word"))
    rows = rows.withColumn("bucket", F.when(F.col("word") != "", _bucket(F.col("word")))).join(F.broadcast(model), "bucket", "left")
    sums = rows.groupBy("id", "text_hash").agg(
        F.sum((F.col("pos") == 0).cast("bigint")).alias("copies"),
        F.sum((F.col("word") != "").cast("bigint")).alias("words"),
        *(F.sum(F.when(F.col("word") != "", F.coalesce(f"l{k}", F.lit(unseen[k]))).otherwise(0.0)).alias(f"s{k}") for k in range(d)),
    )
    logits = [F.lit(priors[k]) + F.col(f"s{k}") / F.col("copies") for k in range(d)]
    scored = sums.select("id", "text_hash", "copies", (F.col("words") / F.col("copies")).cast("bigint").alias("n_words"), *(x.alias(f"z{k}") for k, x in enumerate(logits)))
    top = F.greatest(*(F.col(f"z{k}") for k in range(d))) if d > 1 else F.col("z0")
    scored = scored.select("id", "text_hash", "copies", "n_words", *(F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in range(d)))
    total = sum((F.col(f"e{k}") for k in range(1, d)), F.col("e0"))
    return scored.select("id", "text_hash", "copies", "n_words", *((F.col(f"e{k}") / total).alias(f"p{k}") for k in range(d)))


def fit_rates(table: DataFrame, targets: list[float], least_rate: float) -> tuple[DataFrame, list[float]]:
    """``table`` (copies, n_words, p0, p1, ...) with a column rate, and target minus expected words of each domain.

    A step first takes the curvature of the rates that can move, and that of all, which
    cannot overshoot, if that does not bring the sums nearer. Steps go on until the
    targets are met or neither does: then no rates are better. Every STORE_EVERY steps the rates are written down, so the expression
    stays short. Raises NotConverged if they still move after STEPS.
    """
    d, least = len(targets), F.lit(float(least_rate))
    p = [F.col(f"p{k}") for k in range(d)]
    weight = F.col("copies") * F.col("n_words")
    along = lambda step: sum((F.lit(float(step[k])) * p[k] for k in range(1, d)), F.lit(float(step[0])) * p[0])
    wanted, columns = np.array(targets, float), table.columns
    scale = max(wanted.max(), 1.0)

    def missed(rate: Column) -> np.ndarray:
        return wanted - np.array(table.agg(*(F.coalesce(F.sum(weight * rate * x), F.lit(0.0)) for x in p)).first(), float)

    def curvature(rows: DataFrame) -> np.ndarray:
        return np.array(rows.agg(*(F.coalesce(F.sum(weight * p[a] * p[b]), F.lit(0.0)) for a in range(d) for b in range(d))).first(), float).reshape(d, d)

    bound = np.linalg.pinv(curvature(table), rcond=1e-9)
    rate = F.lit(max(1.0, float(least_rate)))
    off = missed(rate)
    for n in range(STEPS + 1):
        if n and n % STORE_EVERY == 0:
            table = stored(table.select(*columns, rate.alias("rate")), "mix-rates")
            rate = F.col("rate")
        done = np.abs(off).max() <= TOLERANCE * scale
        if not done:
            free = curvature(table.where((rate > least) | (along(off) > 0)))
            for step in (np.linalg.pinv(free, rcond=1e-9) @ off, bound @ off):
                new = F.greatest(least, rate + along(step))
                left = missed(new)
                if left @ left < (off @ off) * (1 - STILL):
                    rate, off = new, left
                    break
            else:
                done = True
        if done:
            return table.select(*columns, rate.alias("rate")), [float(x) for x in off]
    raise NotConverged(f"targets are missed by {np.abs(off).max() / scale:.2g} of the largest after {STEPS} steps")


def mix(df: DataFrame, id_column: str, text_column: str, labelled: DataFrame, domain_column: str, weights: dict[str, float], total: float | None = None, least_rate: float = 0.0) -> DataFrame:
    """Fits a nonnegative rate for each document, so that expected domain totals meet target weights.

    ``labelled`` has ``text_column`` and ``domain_column``; ``weights`` gives the target
    share of each domain, ``total`` the target words (the corpus's own if None; with
    ``least_rate`` above 0 the smallest total that leaves no domain below that rate).
    Returns a row per row of ``df``: id, text_hash, n_words, rate, domain (likeliest, the
    first by name on a tie), p_<domain>. Targets that no rates meet, as of a domain
    without documents, are met as nearly as least squares can. Null and empty texts have
    no words and the prior as posterior, and so has every text if ``labelled`` is empty
    or knows none of the domains; an empty ``df`` gives no rows; a null id is an id like
    any other; equal rows get equal rates; texts are read whole; other columns are not
    read.
    """
    domains = sorted(weights)
    model, unseen, priors = word_model(labelled, text_column, domain_column, domains)
    table = stored(posteriors(df, id_column, text_column, model, unseen, priors), "mix-posteriors")
    d = len(domains)
    held = table.agg(*(F.coalesce(F.sum(F.col("copies") * F.col("n_words") * F.col(f"p{k}")), F.lit(0.0)) for k in range(d))).first()
    share = np.array([weights[x] for x in domains], float) / sum(weights.values())
    if total is None:
        total = float(sum(held)) if not least_rate else float(least_rate * max(h / s for h, s in zip(held, share, strict=True) if s > 0))
    table, _ = fit_rates(table, list(share * total), least_rate)
    best = F.lit(domains[0])
    for k in range(1, d):
        best = F.when(F.col(f"p{k}") > F.greatest(F.lit(0.0), *(F.col(f"p{j}") for j in range(k))), domains[k]).otherwise(best)
    out = table.select("id", "text_hash", "copies", "n_words", F.round("rate", 6).alias("rate"), best.alias("domain"), *(F.round(f"p{k}", 6).alias(f"p_{x}") for k, x in enumerate(domains)))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    return out.withColumnRenamed("id", id_column)


def apply_rates(df: DataFrame, id_column: str, text_column: str, rated: DataFrame) -> DataFrame:
    """The rows of ``df`` at their rates: floor(rate) copies, and one more with the fraction as chance.

    The chance is a hash of id and text, so a run repeats. Rows keep their columns,
    whatever their names.
    """
    theirs = [fresh(x, df.columns) for x in ("_mix_id", "_mix_hash", "_mix_rate")]
    own_id, own_hash, many, copy = (fresh(x, df.columns) for x in ("_own_id", "_own_hash", "_mix_n", "_mix_copy"))
    rates = rated.select(id_column, "text_hash", "rate").distinct().toDF(*theirs)
    own = df.withColumns({own_id: F.col(id_column), own_hash: F.xxhash64(text_column)})
    joined = own.join(rates, F.col(own_id).eqNullSafe(F.col(theirs[0])) & (F.col(own_hash) == F.col(theirs[1])))
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_column), F.col(text_column)), F.lit(1 << 24)) / float(1 << 24)
    copies = joined.withColumn(many, F.floor(F.col(theirs[2]) + chance).cast("int")).where(F.col(many) > 0)
    return copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*df.columns)
