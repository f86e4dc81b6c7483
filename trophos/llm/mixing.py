"""Mixing documents to target weights of soft domains.

1. A multinomial naive Bayes classifier is fitted on a bounded table of
   labelled texts: words fall into ``BUCKETS`` hashed buckets, so the model has
   ``BUCKETS`` rows whatever the vocabulary, and is broadcast.
2. Every document gets posteriors over the domains from all of its words.  The
   log odds are divided by the root of the number of words, which keeps
   memberships soft for long texts.
3. Rates x >= 0 of documents are fitted so that the expected tokens of each
   domain, the sum of rate * words * posterior, match the targets: weighted least
   squares by accelerated projected gradient steps.  A step needs one sum per domain over
   all documents; rates are columns of a written table and are never collected.

Only DataFrame operations are used.  Tokens are words, runs of characters other
than space and ``\\x09``-``\\x0D``.  A null, empty or blank text has no words: its
posteriors are the shares of the domains among the labelled texts, and it takes
part with 0 tokens.  Labelled rows with a null domain are left out; without any
labelled row there is one domain, "unknown".  Repeated rows count each.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trophos.llm.labelled import MAX_LABELLED
from trophos.plans.scratch import Scratch

BUCKETS = 1 << 14
MAX_DOMAINS = 256
#: Most steps; relative gap that counts as met; change of a rate that counts as none; steps without progress at the end.
STEPS, TOLERANCE, REST, STILL = 100, 1e-4, 1e-6, 5
SPACE = " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    """Words of a text; one empty word if it has none."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE)), "[ \\t\\n\\x0B\\f\\r]+")


def _bucket(word: Column) -> Column:
    return F.when(word != "", F.pmod(F.xxhash64(word), F.lit(BUCKETS)))


def labelled_rows(documents: DataFrame, labels: DataFrame, domain: str, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, domain) of at most ``limit`` documents that the label table names."""
    chosen = labels.where("doc_id is not null").select("doc_id").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text", F.col(domain).cast("string").alias("domain"))
    return rows.join(F.broadcast(chosen), "doc_id").where("domain is not null").select("text", "domain")


def fit_domains(rows: DataFrame) -> tuple[list[str], list[float], DataFrame]:
    """Domains in order, their log shares, and (bucket, l0, l1, ...): log probability of a bucket by domain."""
    scratch = Scratch(rows.sparkSession)
    rows = rows.where("domain is not null")
    words = rows.select("domain", F.monotonically_increasing_id().alias("row"), F.explode(_words(F.col("text"))).alias("word"))
    counts = words.groupBy("domain", _bucket(F.col("word")).alias("bucket"))
    counts = scratch.keep(counts.agg(F.count("*").alias("n")))
    texts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(texts) > MAX_DOMAINS:
        raise ValueError(f"{len(texts)} domains; at most {MAX_DOMAINS} are meant to be mixed")
    names = sorted(texts) or ["unknown"]
    total = sum(texts.values()) or 1
    used = counts.where("bucket is not null")
    sums = {r["domain"]: r["n"] for r in used.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    columns = [
        F.log(
            (F.coalesce(F.sum(F.when(F.col("domain") == name, F.col("n"))), F.lit(0)) + 0.5)
            / (sums.get(name, 0) + 0.5 * BUCKETS)
        ).alias(f"l{i}")
        for i, name in enumerate(names)
    ]
    grid = rows.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    model = grid.join(used, "bucket", "left").groupBy("bucket").agg(*columns)
    return names, [math.log(texts.get(n, 1) / total) for n in names], scratch.keep(model)


def posteriors(documents: DataFrame, names: list[str], priors: list[float], model: DataFrame) -> DataFrame:
    """(doc_id, n, p0, p1, ...) per row: words and domain posteriors.

    The rows of a text stay together until they are summed, so the shuffle
    moves one partial sum for each text and not its words.
    """
    d = range(len(names))
    rows = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    words = rows.select("row", "doc_id", F.explode(_words(F.col("text"))).alias("word"))
    words = words.select("row", "doc_id", _bucket(F.col("word")).alias("bucket"))
    sums = words.join(F.broadcast(model), "bucket", "left").groupBy("row", "doc_id")
    sums = sums.agg(F.count("bucket").alias("n"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in d])
    soft = [(F.col(f"l{i}") / F.sqrt(F.greatest(F.col("n"), F.lit(1))) + priors[i]).alias(f"l{i}") for i in d]
    logits = sums.select("doc_id", "n", *soft)
    # differences are limited, so no exponential overflows
    odds = [F.exp(F.least(F.lit(700.0), F.col(f"l{j}") - F.col(f"l{i}"))) for i in d for j in d]
    k = len(names)
    shares = [1 / _sum(odds[i * k : (i + 1) * k]) for i in d]
    return logits.select("doc_id", "n", *[s.alias(f"p{i}") for i, s in enumerate(shares)])


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def fit_rates(
    members: DataFrame,
    weights: list[float] | None,
    scratch: Scratch,
    floor: float = 0.0,
    total: float | None = None,
    power: float = 0.0,
) -> tuple[DataFrame, list[float]]:
    """``members`` with rate >= ``floor``; domains get shares ``weights`` of ``total`` tokens.

    ``weights`` None means proportional to the domain's tokens to ``power``, at
    0 equal ones.  ``total`` None means as many tokens as
    there are; 0 means the least at which no domain has to shrink.  A domain
    without tokens cannot be filled and is left out of the targets.  The steps end
    when the targets are met, when the projected gradient has vanished, or when no
    domain's gap has changed in several steps; also returned is what each domain is
    then off its target, as a part of its tokens.
    """
    d = [c for c in members.columns if c.startswith("p") and c[1:].isdigit()]
    expected = [F.coalesce(F.sum(F.col("ahead") * F.col("n") * F.col(p)), F.lit(0.0)).alias(p) for p in d]
    rated = members.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)})
    have = list(rated.agg(*expected).first())
    wanted = [w if h > 0 else 0.0 for w, h in zip(weights or [h**power for h in have], have)]
    if not sum(wanted):
        return rated.drop("ahead"), [0.0] * len(d)
    wanted = [w / sum(wanted) for w in wanted]
    if total == 0:
        total = max(h / w for h, w in zip(have, wanted) if w)
    goal = [w * (sum(have) if total is None else total) for w in wanted]
    now, moved, last, still = have, None, None, 0
    for step in range(1, STEPS + 2):
        gap = [(a - t) / h if h else 0.0 for a, t, h in zip(now, goal, have)]
        still = still + 1 if last and max(abs(g - x) for g, x in zip(gap, last)) <= TOLERANCE / 2 else 0
        last = gap
        # the targets are met, no rate can move as the projected gradient has vanished, or there is no progress
        if max(map(abs, gap)) <= TOLERANCE or moved is not None and moved <= REST or still >= STILL or step > STEPS:
            break
        # a gradient step from the point ahead, back to the feasible rates, and on by momentum
        slope = _sum([F.col(p) * F.lit(g) for p, g in zip(d, gap)])
        rated = rated.withColumn("next", F.greatest(F.lit(floor), F.col("ahead") - slope))
        ahead = F.col("next") + (F.col("next") - F.col("rate")) * ((step - 1) / (step + 2))
        rated = rated.withColumn("moved", F.abs(F.col("next") - F.col("ahead")))
        rated = rated.withColumn("ahead", ahead).drop("rate").withColumnRenamed("next", "rate")
        # written at each step: a plan of nested steps grows too fast to be optimised
        rated = scratch.keep(rated, f"rates{step}")
        scratch.keep_only(f"rates{step}")
        *now, moved = rated.agg(*expected, F.max("moved")).first()
        rated = rated.drop("moved")
    return rated.drop("ahead"), gap


def mix(
    documents: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float] | None = None,
    floor: float = 0.0,
    total: float | None = None,
    power: float = 0.0,
) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_tokens, domain, probability, rate, expected_tokens, domain_gap.

    ``labelled``: (text, domain), a bounded table.  domain is the likeliest one,
    of equal ones the first by name.  domain_gap is what its expected tokens are off
    their target at the end, as a part of its tokens; it is not 0 where the bound
    of the rates makes the targets unreachable.
    """
    scratch = Scratch(documents.sparkSession)
    names, priors, model = fit_domains(labelled)
    members = scratch.keep(posteriors(documents, names, priors, model))
    shares = None if weights is None else [weights.get(n, 0.0) for n in names]
    rated, gap = fit_rates(members, shares, scratch, floor, total, power)
    best = F.greatest(*[F.col(f"p{i}") for i in range(len(names))]) if len(names) > 1 else F.col("p0")
    domain = F.coalesce(*[F.when(F.col(f"p{i}") == F.col("best"), F.lit(n)) for i, n in enumerate(names)])
    return rated.withColumn("best", best).select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        domain.alias("domain"),
        F.col("best").alias("probability"),
        "rate",
        (F.col("rate") * F.col("n")).alias("expected_tokens"),
        F.coalesce(*[F.when(domain == n, F.lit(g)) for n, g in zip(names, gap)]).alias("domain_gap"),
    )


def repeat_by_rate(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """Each document as often as its rate says, all columns.

    The whole part of the rate is certain; the rest is rounded by a hash of the
    id, so the expected numbers hold and a rerun gives the same rows.  Rows of
    one id share the mean of their rates.
    """
    spin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    times = rates.groupBy("doc_id").agg(F.avg("rate").alias("rate"))
    times = times.select("doc_id", F.floor(F.col("rate") + spin).cast("int").alias("times")).where("times > 0").alias("t")
    joined = documents.alias("d").join(times, F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")))
    # the document's columns, whatever their names, stay together in one
    copies = joined.select(F.struct("d.*").alias("row"), F.explode(F.sequence(F.lit(1), F.col("t.times"))))
    return copies.select("row.*")
