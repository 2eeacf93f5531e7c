"""Command line: train, fingerprint, similar, similarity, info, segment, positions, lookup on a saved model."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import LookupConfig, SegmentationConfig, SomConfig
from .operators import index, lookup
from .plans.retina import Retina
from .sources.tables import files, lines


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(*a[0], **a[1]) for a in args]
    add("train", (["input"], {}), (["model"], {}), (["--dimension"], {"type": int, "default": 32}), (["--seed"], {"type": int, "default": 42}))
    add("fingerprint", (["model"], {}), (["text"], {}))
    add("similar", (["model"], {}), (["word"], {}), (["--count"], {"type": int, "default": 10}))
    add("similarity", (["model"], {}), (["first"], {}), (["second"], {}))
    add("info", (["model"], {}))
    add("segment", (["model"], {}), (["input"], {}), (["--block"], {"type": int, "default": 3}), (["--threshold"], {"type": float, "default": 0.5}))
    add("positions", (["model"], {}), (["positions"], {}), (["--count"], {"type": int, "default": 10}))
    add("lookup", (["model"], {}), (["positions"], {}), (["--count"], {"type": int, "default": 10}), (["--radius"], {"type": float, "default": 1.8}))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "train":
        Retina.train(lines(spark, a.input), SomConfig(dimension=a.dimension, seed=a.seed)).save(a.model)
        return
    model = Retina.load(spark, a.model)
    if a.command == "fingerprint":
        out = model.fingerprint_texts(spark.createDataFrame([(0, a.text)], "doc_id int, text string")).select("positions")
    elif a.command == "similar":
        out = model.similar_words(a.word, a.count).orderBy("rank")
    elif a.command == "similarity":
        out = spark.createDataFrame([(model.text_similarity(a.first, a.second),)], "similarity double")
    elif a.command == "info":
        out = model.info()
    elif a.command == "segment":
        out = model.segments(files(spark, a.input), SegmentationConfig(block=a.block, depth=a.threshold)).orderBy("doc_id", "segment")
    else:
        places = [int(x) for x in a.positions.split(",")]
        if a.command == "positions":
            out = index.words_at_positions(model.postings, places, a.count)
        else:
            config = LookupConfig(radius=a.radius)
            out = lookup.lookup(model.postings, lookup.position_stats(model.postings, model.dim, config), places, a.count, model.dim, config)
    out.select(*(F.col(c) for c in out.columns)).show(200, truncate=False)


if __name__ == "__main__":
    main()
