"""Command line: ``python -m noveltide.cli STAGE --todo | --decada YYYY_YYYY``.

Stages read and write below ``--root``: harvest, enrich, filter, preprocess, train, grid, vectors, encode, novelty, report.
The services' addresses are the environment variables ``SEARCH_URL`` and ``RECORD_URL`` (with ``{eid}``).
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import re
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noveltide.config import Credentials, EnrichConfig, HarvestConfig, Layout, NoveltyConfig, VectorConfig
from noveltide.functions.text import hms
from noveltide.operators import langid, novelty, phrases, preprocess, reports, vectors, word2vec
from noveltide.sources import files
from noveltide.sources.decades import DecadeSink
from noveltide.sources.enrichment import Enrichment
from noveltide.sources.harvest import Client, CursorStore, Transport, harvest
from noveltide.sources.http import HttpTransport
from noveltide.sources.state import Ledger, Lines, rotating_log

STAGES = ("harvest", "enrich", "filter", "preprocess", "train", "grid", "vectors", "encode", "novelty", "report")


def arguments(argv: list[str]) -> argparse.Namespace:
    """Exactly one of ``--todo`` and ``--decada``; ``-- todo`` is read as ``--todo``."""
    argv = re.sub(r"(^|\x00)--\x00(todo|decada)(?=\x00|$)", r"\1--\2", "\x00".join(argv)).split("\x00") if argv else []
    p = argparse.ArgumentParser(prog="noveltide")
    p.add_argument("stage", choices=STAGES)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--todo", action="store_true")
    which.add_argument("--decada")
    p.add_argument("--root", default="data")
    p.add_argument("--years", type=int, default=NoveltyConfig.years)
    p.add_argument("--test", action="store_true", help="enrich: fetch two records only")
    p.add_argument("--overwrite", action="store_true", help="grid: train models again")
    p.add_argument("--sample", type=int, default=VectorConfig.sample, help="grid: documents of the coverage sample")
    p.add_argument("--model", choices=["word2vec", "encoder"], default="word2vec", help="novelty, report: whose vectors")
    p.add_argument("--detector", help="filter: module:function that loads a model, a function from texts to (language, confidence) pairs")
    p.add_argument("--lemmatizer", help="preprocess: module:function from a token column to its lemma")
    p.add_argument("--encoder", help="encode: module:function that returns a function from texts to vectors")
    p.add_argument("--tokenizer", help="preprocess: module:function from a text column to an array of tokens; encode: from a text to a list of tokens")
    out = p.parse_args(argv)
    if out.decada and not re.fullmatch(r"\d{4}_\d{4}", out.decada):
        p.error("--decada must be YYYY_YYYY")
    return out


def named(path: str | None) -> Callable | None:
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def first_of(spark: SparkSession, *paths: str) -> DataFrame:
    """The first table that is there."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")


def run_harvest(spark: SparkSession, at: Layout, args: argparse.Namespace, transport: Transport | None = None, sleep=time.sleep) -> dict[int, int]:
    state, cfg = Lines(at.path("state")), HarvestConfig()
    ledger = Ledger(at.path("state"))
    client = Client(transport or HttpTransport(os.environ["SEARCH_URL"], Credentials.from_env().headers()), cfg, sleep=sleep, ledger=ledger)
    years = [y for y in cfg.years if not args.decada or int(args.decada[:4]) <= y <= int(args.decada[5:])]

    sink = DecadeSink(spark, at.path("raw"), at.path("state", "ids"))

    def append(year: int, entries: list[dict]) -> int:
        return sink.add(year, entries)

    def finished(year: int) -> int:
        """A year is done when its last articles are written."""
        n = sink.flush()
        state.add("years", str(year))
        return n

    def report(r: dict) -> None:
        times = spark.range(1).select(hms(F.lit(r["seconds"])).alias("took"), hms(F.lit(r["eta_seconds"])).alias("eta")).first()
        state.add("decades", f"{r['decade']}: {r['articles']} articles, {times.took}; {r['left']} decades left, {times.eta}")

    done = {int(x) for x in state.load("years") if x.isdigit()}
    out = harvest(client, years, done, CursorStore(at.path("state")), append, finished, report)
    ledger.set(0)
    return out


def run_train(spark: SparkSession, at: Layout, name: str) -> bool:
    """Trains the global model, or a decade's if there is no global one; whether it did."""
    if name != "todo" and exists(spark, at.path("models", "todo")):
        return False
    rows = first_of(spark, at.path("tokens", name), at.path("tokens", f"filtered_{name}"))
    files.write_csv(word2vec.thresholds(word2vec.vocabulary(word2vec.usable_corpus(rows))), at.path("models", f"vocabulary_{name}"), "overwrite")
    words, epochs, log = word2vec.train(rows)
    files.write_csv(epochs.orderBy("epoch").coalesce(1), at.path("models", f"epochs_{name}"), "overwrite")
    files.write_table(words, at.path("models", name), mode="overwrite")
    words = spark.read.parquet(at.path("models", name))
    files.write_csv(word2vec.histogram(word2vec.norms(words), "norm").orderBy("bin"), at.path("models", f"norms_{name}"), "overwrite")
    log |= {"vocab_size": words.count(), "avg_vector_norm": word2vec.mean_norm(words).first().avg_vector_norm}
    spark.createDataFrame([(json.dumps(log),)], "value string").coalesce(1).write.mode("overwrite").text(at.path("models", f"log_{name}"))
    return True


def run_vectors(spark: SparkSession, at: Layout, name: str) -> None:
    words = first_of(spark, at.path("models", "todo"), at.path("models", name))
    dim, target = words.select(F.size("vector").alias("d")).first().d, at.path("vectors", name)
    if exists(spark, target):
        vectors.check_dimension(spark.read.parquet(target), dim)
    rows = preprocess.dated(vectors.mean_vectors(spark.read.parquet(at.path("tokens", name)), words, dim))
    files.write_table(rows, target, mode="overwrite")
    rows = spark.read.parquet(target)
    files.write_csv(rows.select("eid", "title", F.col("cover_date").cast("string"), "coverage_ratio").orderBy("cover_date", "eid"), f"{target}_csv", "overwrite")
    files.write_csv(vectors.zero_report(rows), at.path("reports", f"zero_vectors_{name}"), "overwrite")


def run(spark: SparkSession, args: argparse.Namespace, transport: Transport | None = None, sleep=time.sleep) -> None:
    at, name, began = Layout(args.root), args.decada or "todo", time.time()
    log = rotating_log(at.path("reports", "noveltide.log"))
    vector_table = at.path("vectors", name if args.model == "word2vec" else f"encoder_{name}")
    if args.stage == "harvest":
        run_harvest(spark, at, args, transport, sleep)
    elif args.stage == "enrich":
        Enrichment(spark, at, transport or HttpTransport(os.environ["RECORD_URL"], Credentials.from_env().headers()), EnrichConfig(), sleep).run(args.test)
    elif args.stage == "filter":
        source, misfits = files.read_union(spark, at.path("enriched", f"*{args.decada}*" if args.decada else "*"))
        files.write_table(misfits, at.path("filtered", f"misfits_{name}"), mode="overwrite")
        detector = langid.model_detector(named(args.detector)) if args.detector else langid.stop_word_detector
        rows = langid.detect(source, detector)
        ok, other = langid.split(rows)
        files.write_table(ok, at.path("filtered", name), mode="overwrite")
        files.write_table(other, at.path("filtered", f"rejected_{name}"), mode="overwrite")
        files.write_csv(reports.count_languages(rows).coalesce(1), at.path("filtered", f"languages_{name}"), "overwrite")
    elif args.stage == "preprocess":
        rows = preprocess.with_text(preprocess.dated(spark.read.parquet(at.path("filtered", name))))
        tokenize = named(args.tokenizer) or preprocess.tokenize
        white = Path(at.path("tokens", "whitelist.csv"))
        entries = preprocess.whitelist(files.read_csv(spark, str(white))) if white.exists() else spark.createDataFrame([], "phrase string")
        allowed = [r.phrase for r in entries.where("not phrase rlike '[ _]'").orderBy("phrase").collect()]  # a hand-made list
        rows = rows.withColumn("tokens", tokenize(preprocess.clean_boilerplate(F.col("text"))))
        files.write_table(preprocess.with_phrases(rows, entries), at.path("tokens", f"parted_{name}"), mode="overwrite")
        parted = spark.read.parquet(at.path("tokens", f"parted_{name}"))
        # Words inside a white-listed phrase are not discarded.
        discarded = preprocess.discard_log(parted, "_rest", allowed=allowed)
        files.write_csv(discarded.orderBy(F.desc("frecuencia"), "palabra", "motivo"), at.path("tokens", f"discarded_{name}"), "overwrite")
        files.write_csv(preprocess.discard_summary(discarded), at.path("tokens", f"discarded_summary_{name}"), "overwrite")
        rows = preprocess.cleaned(parted, allowed=allowed, lemmatize=named(args.lemmatizer) or preprocess.lemma)
        files.write_table(rows, at.path("tokens", f"plain_{name}"), mode="overwrite")
        rows = spark.read.parquet(at.path("tokens", f"plain_{name}"))
        files.write_table(phrases.learn(rows), at.path("tokens", f"bigrams_{name}"), mode="overwrite")
        merged = phrases.apply(rows, spark.read.parquet(at.path("tokens", f"bigrams_{name}")))
        files.write_table(merged.withColumn("tokens", preprocess.drop_meta_tokens(F.col("tokens"))), at.path("tokens", name), mode="overwrite")
    elif args.stage == "train":
        log.info("%s: %s", name, "trained" if run_train(spark, at, name) else "the global model is there, no other is trained")
    elif args.stage == "grid":
        rows = first_of(spark, at.path("tokens", f"filtered_{name}"), at.path("tokens", name))
        grid = word2vec.read_grid(files.read_csv(spark, at.path("models", "grid.csv")))
        word2vec.search(rows, grid, at.path("models", f"grid_{name}"), at.path("models", f"grid_models_{name}"), args.sample, args.overwrite)
    elif args.stage == "vectors":
        run_vectors(spark, at, name)
    elif args.stage == "encode":
        rows = preprocess.with_text(spark.read.parquet(at.path("filtered", name)))
        coded = vectors.encode(rows.select(*[c for c in ("eid", "title", "cover_date", "doi", "citedby_count", "text") if c in rows.columns]), named(args.encoder), tokenizer=named(args.tokenizer))
        files.write_table(preprocess.dated(coded), at.path("vectors", f"encoder_{name}"), mode="overwrite")
    elif args.stage == "novelty":
        rows = spark.read.parquet(vector_table)
        out = at.path("novelty", f"{args.model}_{name}")
        files.write_table(novelty.with_metadata(rows, novelty.index(rows, args.years)), out, mode="overwrite")
        files.write_csv(spark.read.parquet(out).withColumn("cover_date", F.col("cover_date").cast("string")), f"{out}_csv", "overwrite")
    else:
        reports.describe(spark.read.parquet(at.path("novelty", f"{args.model}_{name}")), "ki_score").show()
    log.info("%s %s: %.1f minutes", args.stage, name, (time.time() - began) / 60)


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), arguments(sys.argv[1:]))
