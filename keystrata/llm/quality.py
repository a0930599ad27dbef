"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, perplexity, and language quantiles.

Trusted are the documents that ``labels`` calls good and not toxic. All of them are counted, as pairs of words that grow
with the corpus, and every document is scored by a sharded join of its keys with the counts (see ``word_model``). Each
language has two models, one from either half of its trusted documents (by a digest of the id). A document's score is
its mean negative log-probability a word under its language's model of the half of the trusted documents that it is not
in, drawn to the mean of the trusted by ``PRIOR_WORDS`` words so that short texts need strong evidence. A document is
rejected if its score is above the ``QUANTILE`` of the trusted documents of its language.

Scale: texts are dealt once, to meet the labels; only trusted ones are written. What the joins move are packed keys, and
rows of a few numbers a document; what is collected is a row a language and the heaviest keys, of bounded number.
Documents are known by two digests of half, language and text, so copies are scored alike and joins on them and the id
are dealt evenly.

Defined results: null or empty text has 0 words and is kept at the language's mean; a document
whose language is null or has no trusted text is scored by the model that suits it best (score: the lowest), against
the most lenient threshold; without any trusted text all documents are kept, scores null; repeated rows give repeated
results; a document labelled twice is trusted if no label speaks against it. Other columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialize, table
from .word_model import WordModel, costs, count_tables

#: The quantile of trusted scores that bounds a language; words of prior.
QUANTILE, PRIOR_WORDS = 0.99, 10.0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted documents; the table grows with the corpus, so it is always joined by sorting, at every size."""
    each = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("bad"))
    return each.where((F.col("good") == 1) & (F.col("bad") == 0)).select(F.col("doc_id").alias("trusted_id")).hint("merge")


def half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(2)).cast("int")


def text_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two digests of what a document's score depends on: its half, language and text."""
    lang, text = docs["lang"].cast("string"), docs["text"]
    parts = (half(docs["doc_id"]), lang.isNull(), lang, text.isNull(), text)
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, lang, half, text)"""
    k1, k2 = text_keys(docs)
    return docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", F.col("lang").cast("string").alias("lang"), half(F.col("doc_id")).alias("half"), "text")


def choices(halves: dict[str, dict[int, int]]) -> list[dict[str, int]]:
    """For documents of either half, each language's model: that of the other half, or the only one there is."""
    return [{lang: models.get(1 - own, models.get(own)) for lang, models in halves.items()} for own in (0, 1)]


def score_words(docs: DataFrame, labels: DataFrame, prior: float = PRIOR_WORDS) -> tuple[DataFrame, DataFrame] | None:
    """(k1, k2, n, score) for each different text of ``docs``, and (k1, k2, doc_id, lang) of the trusted documents of
    languages with a model; None without trusted text."""
    rows = keyed(docs)
    trusted = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).join(trusted_ids(labels), F.col("doc_id") == F.col("trusted_id"))
    trusted = materialize(trusted.select("k1", "k2", "doc_id", "lang", F.xxhash64("lang", "half").alias("model"), "half", "text"), "kn-trusted")
    own = materialize(trusted.select("k1", "k2", "doc_id", "lang", "half", "model"), "kn-own")
    counts = count_tables(trusted)
    forget(trusted)
    model = WordModel(counts)
    halves: dict[str, dict[int, int]] = {}
    for r in own.select("lang", "half", "model").distinct().join(F.broadcast(model.unseen), "model").collect():
        halves.setdefault(r["lang"], {})[r["half"]] = r["model"]
    own = own.drop("half", "model")
    if not halves:
        return None
    of = choices(halves)
    every = [sorted(set(own.values())) for own in of]

    def models_of(lang: str | None, which: int | None) -> list[int]:
        known = of[which or 0].get(lang)
        return every[which or 0] if known is None else [known]

    sums = costs(rows.select("k1", "k2", "lang", "half", "text"), model, models_of)
    sums = sums.join(F.broadcast(model.unseen), "model").select("k1", "k2", "model", "n", (F.col("cost") + F.col("n") * F.col("unseen")).alias("cost"))
    sums = materialize(sums, "kn-sums")
    model.forget()
    means = sums.join(own, ["k1", "k2"]).groupBy("model").agg((F.sum("cost") / F.sum("n")).alias("mean"))
    # models without a scored trusted document (all of a language's are in one half) take their own text's
    scored = sums.join(F.broadcast(means), "model").groupBy("k1", "k2").agg(F.max("n").alias("n"), F.min((F.col("cost") + prior * F.col("mean")) / (F.col("n") + prior)).alias("score"))
    return materialize(scored, "kn-scores"), own


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(k1, k2, doc_id, lang, n, score, threshold, keep): a row for each row of ``docs``."""
    found = score_words(docs, labels)
    rows = keyed(docs).drop("half", "text")
    if found is None:
        nothing = F.lit(None).cast("double")
        return rows.select("*", F.lit(0).cast("long").alias("n"), nothing.alias("score"), nothing.alias("threshold"), F.lit(True).alias("keep"))
    scores, own = found
    limits = own.join(scores, ["k1", "k2"]).groupBy("lang").agg(F.percentile_approx("score", quantile, 100_000).alias("limit"))
    limits = materialize(limits.where("limit IS NOT NULL").withColumnRenamed("lang", "of"), "kn-limits")
    lenient = limits.agg(F.max("limit")).first()[0]
    scored = rows.join(scores.hint("merge"), ["k1", "k2"], "left").join(limits, F.col("lang") == F.col("of"), "left")
    scored = scored.withColumn("threshold", F.coalesce("limit", F.lit(lenient).cast("double"))).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return scored.select("k1", "k2", "doc_id", "lang", "n", "score", "threshold", (F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)) | (F.col("n") == 0)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, all columns as they are."""
    kept = materialize(classify(docs.select("doc_id", "lang", "text"), labels).where("keep").select("k1", "k2", "doc_id").distinct(), "kn-kept")
    k1, k2 = text_keys(docs)
    return docs.join(kept.hint("merge"), k1.eqNullSafe(kept["k1"]) & k2.eqNullSafe(kept["k2"]) & docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", F.col("n").alias("n_symbols"), F.exp("score").alias("perplexity"), F.exp("threshold").alias("threshold"), "keep")
