"""Quality classifier with hierarchical empirical Bayes.

*Document evidence.*  Two logistic models on text features (form, repetition, and words of a
lexicon that is learned from the labels) give the chance that a text is of quality and the chance
that it is toxic; a document is good if it is the first and not the second.  Only here a bounded
sample is used: at most ``TRAIN_ROWS`` labelled documents, those of least hash.

*Sites.*  All documents, labelled or not, are aggregated by path and host.  The spread of host
means around the global mean, and of path means around their host's, beyond what their sizes
explain, gives the strength of the two priors (method of moments).  A host's rate is shrunk to the
global one and a path's to its host's; few documents leave a site near its parent.  A document's
own evidence is left out of the sums that it is combined with.

*Combination.*  posterior odds = evidence odds x odds of the path's rate / odds of the global rate.

Chances are held as whole millionths, so sums do not depend on the order of rows and a task that
runs again gives the same bits.  A site may own any share of the documents: sums are combined
before the shuffle, and the join back may split or broadcast by measured size.

Defined results: a null text is an empty one; null hosts and paths are a site of their own;
repeated rows each count; without labelled rows of both kinds a model says one half, and rows at
one half are kept; an empty table gives an empty result; other columns are ignored by ``judge``
and passed through by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lowtide.llm.quality_rules import measured
from lowtide.llm.storage import bounded_batches, written
from lowtide.llm.text import Words, slices, split_words, strings, sums

#: most labelled documents that the models are fitted on
TRAIN_ROWS = 20_000
#: words of the lexicon: least documents with the label, least lift of the label's rate, most words
LEXICON_DOCS, LEXICON_LIFT, LEXICON_WORDS = 5, 3.0, 2_000
RIDGE, ROUNDS = 1.0, 25
UNIT = 1_000_000
TRIM = ".,!?;:*$%&#|\"'()[]<>"
KEEP_FROM = UNIT // 2

FIGURES = ["words", "word_size", "upper", "symbols", "stops", "shouts", "digits", "distinct", "lines", "dup_lines", "repeats", "dup_5", "dup_10"]


@dataclass
class Models:
    """Lexicons and weights for quality and toxicity; no weights where the labels have one kind only."""

    lexicons: tuple[pa.Array, pa.Array]
    weights: list[np.ndarray | None]
    centre: np.ndarray
    scale: np.ndarray


def _plain(vocabulary: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(vocabulary), TRIM)


def _figures(texts: pa.Array, words: Words, codes: np.ndarray) -> np.ndarray:
    m = measured(texts)
    n = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    count = lambda pattern: np.asarray(pc.count_substring_regex(texts, pattern), dtype=np.float64)
    text = np.repeat(np.arange(len(texts)), words.counts)
    pairs = np.unique(text * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1)
    distinct = np.bincount(pairs, minlength=len(texts))
    return np.stack(
        [
            np.log1p(m["n_words"]),
            m["word_chars"] / n,
            count(r"\p{Lu}") / chars,
            m["n_symbols"] / chars,
            count(r"[.,;]") / n,
            count(r"[!?]") / n,
            count(r"[0-9]") / chars,
            distinct / n,
            (1 + count(r"\n")) / n,
            m["dup_line_chars"] / chars,
            m["n_repeat_words"] / n,
            m["dup_chars_5"] / chars,
            m["dup_chars_10"] / chars,
        ],
        axis=1,
    )


def features(column: pa.Array, lexicons: tuple[pa.Array, pa.Array]) -> np.ndarray:
    """One row per text: the figures, and hits in each lexicon as logarithm and share."""
    texts = strings(column)
    words = split_words(texts)
    codes, vocabulary = words.encoded()
    out = [_figures(texts, words, codes)]
    plain = _plain(vocabulary)
    for lexicon in lexicons:
        known = np.asarray(pc.is_valid(pc.index_in(plain, lexicon.cast(plain.type))))
        hits = sums(known[codes].astype(np.int64), words.offsets)
        out.append(np.stack([np.log1p(hits), hits / np.maximum(words.counts, 1)], axis=1))
    return np.concatenate(out, axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Weights of a ridge logistic regression by Newton's method; the last one is the intercept."""
    if not 0 < y.sum() < len(y):
        return None
    x = np.append(x, np.ones((len(x), 1)), axis=1)
    ridge = np.diag([RIDGE] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lexicon(sample: DataFrame, label: str) -> pa.Array:
    """Words much more frequent in documents with the label than in others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = split_words(strings(batch.column("_text")))
            codes, vocabulary = words.encoded()
            own = _plain(vocabulary).dictionary_encode()
            codes = np.asarray(own.indices, dtype=np.int64)[codes]
            text = np.repeat(np.arange(batch.num_rows), words.counts)
            n = max(len(own.dictionary), 1)
            pairs = np.unique(text * n + codes)
            with_label = np.asarray(batch.column(label), dtype=bool)[pairs // n]
            yield pa.RecordBatch.from_arrays(
                [
                    own.dictionary.cast(pa.string()),
                    pa.array(np.bincount(pairs % n, minlength=len(own.dictionary)).astype(np.int64)),
                    pa.array(np.bincount(pairs[with_label] % n, minlength=len(own.dictionary)).astype(np.int64)),
                ],
                names=["word", "n", "hits"],
            )

    total, positive = sample.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("int"))).first()
    if not total or not positive:
        return pa.array([], pa.string())
    rate = positive / total
    found = sample.select("_text", label).mapInArrow(count, "word string, n long, hits long")
    found = found.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    lift = (F.col("hits") + rate) / (F.col("n") + 1) / F.lit(rate)
    # a lift that chance explains badly: hits beyond the expected ones in standard deviations
    surprise = (F.col("hits") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1e-9)
    words = (
        found.where((F.col("hits") >= LEXICON_DOCS) & (lift >= min(LEXICON_LIFT, 0.9 / rate)) & (surprise >= 6))
        .orderBy(surprise.desc(), "word")
        .limit(LEXICON_WORDS)
    )
    return pa.array([r["word"] for r in words.select("word").collect()], pa.string())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Models:
    """The models, fitted on at most ``rows`` labelled documents."""
    bounded_batches(docs.sparkSession)
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("_good"), (F.max("toxic") > 0).alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    marks = written(marks, "labels")  # at most ``rows`` narrow rows, so a broadcast is bounded
    body = docs.select(docs[key].alias("_key"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    # ids may have many rows in ``docs``: twice as many rows as labels at most, chosen by hash, are fitted on
    sample = body.join(F.broadcast(marks.withColumnRenamed("doc_id", "_key")), "_key")
    sample = written(sample.withColumn("_bad", ~F.col("_good")), "sample")
    lexicons = (_lexicon(sample, "_bad"), _lexicon(sample, "_toxic"))
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = features(batch.column("_text"), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array([v.tobytes() for v in x], pa.binary()), batch.column("_good"), batch.column("_toxic")],
                names=["key", "x", "good", "toxic"],
            )

    kind = docs.schema[key].dataType.simpleString()
    found = sample.mapInArrow(run, f"key {kind}, x binary, good boolean, toxic boolean").orderBy(F.xxhash64("key"), "key", "x").limit(2 * rows).collect()
    width = len(FIGURES) + 4
    x = np.array([np.frombuffer(r["x"]) for r in found]).reshape(-1, width)
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(width), np.ones(width))
    x = np.clip((x - centre) / scale, -8, 8)
    weights = [_logistic(x, np.array([r[c] for r in found], float)) for c in ("good", "toxic")]
    return Models(lexicons, weights, centre, scale)


def evidence(column: pa.Array, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Chances of quality and of toxicity, in millionths, never 0 or all."""
    x = np.clip((features(column, models.lexicons) - models.centre) / models.scale, -8, 8)
    x = np.append(x, np.ones((len(x), 1)), axis=1)
    out = []
    for w, without in zip(models.weights, (UNIT // 2, 0)):
        if w is None:
            out.append(np.full(len(x), without, np.int64))
        else:
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            out.append(np.clip(np.rint(p * UNIT), 1, UNIT - 1).astype(np.int64))
    return out[0], out[1]


def _scored(docs: DataFrame, models: Models, text: str, host: Column, path: Column, drop: bool = False) -> DataFrame:
    """All columns (without the text, if it is to be dropped) with the site and the evidence.

    Written once, as the sums and the decisions both read it."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    sited = docs.withColumns({"_host": F.coalesce(host, F.lit("")), "_path": F.coalesce(path, F.lit(""))})
    fields = [f for f in sited.schema.fields if not (drop and f.name == text)]
    names = [f.name for f in fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            quality, toxic = evidence(batch.column(text), shared.value)
            both = np.clip(quality * (UNIT - toxic) // UNIT, 1, UNIT - 1)
            columns = [*[batch.column(c) for c in names], pa.array(quality), pa.array(toxic), pa.array(both)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_quality", "_toxic", "_p"])

    return written(sited.mapInArrow(run, f"{kinds}, _quality long, _toxic long, _p long"), "evidence")


def _strength(spread: float | None, within: float, groups: float | None, n: float | None) -> float:
    """Number of documents that a prior is worth: the mean's variance over the spread beyond chance."""
    if not n or spread is None or groups is None or n <= groups or groups < 2:
        return 1e9
    beyond = (spread - within * (groups - 1)) / n
    return float(min(max(within / beyond, 1.0), 1e9)) if beyond > 0 else 1e9


def _posterior(scored: DataFrame) -> DataFrame:
    """The scored rows with ``_prior`` (the path's rate) and ``_posterior``, in millionths."""
    paths = scored.groupBy("_host", "_path").agg(
        F.sum("_p").alias("_s"), F.count(F.lit(1)).alias("_n"), F.sum((F.col("_p") * F.col("_p")).cast("decimal(38,0)")).alias("_q")
    )
    paths = written(paths, "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_s").alias("_hs"), F.sum("_n").alias("_hn"))
    total = paths.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n"), F.sum("_q").alias("q"), F.count(F.lit(1)).alias("k")).first()
    if not total["n"]:
        return scored.withColumns({"_prior": F.lit(0).cast("long"), "_posterior": F.lit(0).cast("long")})
    n = total["n"]
    mean = total["s"] / n / UNIT
    off = lambda s, c, m: F.col(c) * F.pow(F.col(s) / F.col(c) / UNIT - m, F.lit(2))
    between = hosts.agg(F.sum(off("_hs", "_hn", F.lit(mean))).alias("v"), F.count(F.lit(1)).alias("k")).first()
    inside = (
        paths.join(hosts, "_host").agg(F.sum(off("_s", "_n", F.col("_hs") / F.col("_hn") / UNIT)).alias("v")).first()
    )
    # what varies inside the paths: all but what lies between hosts and between their paths
    apart = ((between["v"] or 0.0) + (inside["v"] or 0.0)) / n
    within = max(float(total["q"]) / n / UNIT**2 - mean**2 - apart, 1e-9)
    of_host = _strength(between["v"], within, between["k"], n)
    of_path = _strength(inside["v"], within, total["k"] - between["k"] + 1, n)
    sites = paths.join(hosts, "_host").select("_host", "_path", "_s", "_n", "_hs", "_hn")
    host_rate = (F.col("_hs") - F.col("_p") + of_host * mean * UNIT) / (F.col("_hn") - 1 + of_host)
    path_rate = (F.col("_s") - F.col("_p") + of_path * host_rate) / (F.col("_n") - 1 + of_path)
    prior = F.greatest(F.lit(1), F.least(F.lit(UNIT - 1), F.round(path_rate).cast("long")))
    odds = F.col("_p") / (UNIT - F.col("_p")) * (F.col("_prior") / (UNIT - F.col("_prior"))) / (mean / (1 - mean))
    return (
        scored.join(sites, ["_host", "_path"])
        .withColumn("_prior", prior)
        .withColumn("_posterior", F.round(odds / (1 + odds) * UNIT).cast("long"))
    )


def judge(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, host, path, chances in millionths and ``kept``."""
    models = fit(docs, labels, key, text)
    narrow = docs.select(docs[key].alias("_key"), docs[text].alias("_text"), host.alias("_h"), path.alias("_q"))
    scored = _scored(narrow, models, "_text", F.col("_h"), F.col("_q"), drop=True)
    return _posterior(scored).select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_quality").alias("quality_ppm"),
        F.col("_toxic").alias("toxic_ppm"),
        F.col("_p").alias("evidence_ppm"),
        F.col("_prior").alias("site_ppm"),
        F.col("_posterior").alias("posterior_ppm"),
        (F.col("_posterior") >= KEEP_FROM).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose posterior reaches one half, all columns unchanged."""
    names = docs.columns
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]  # no name of the input meets a helper's
    sited = docs.select(*own, host.alias("host"), path.alias("path"))
    scored = _scored(sited, fit(docs, labels, key, text), f"c{names.index(text)}", F.col("host"), F.col("path"))
    found = _posterior(scored).where(F.col("_posterior") >= KEEP_FROM)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
