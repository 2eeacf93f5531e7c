"""The model as an object: word fingerprints and their postings, with the questions one asks of them."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FingerprintConfig, NoIndex, SegmentationConfig, SomConfig, WordNotFound
from ..functions import sdr
from ..functions import text as T
from ..operators import fingerprints as fp
from ..operators import index, segment
from ..operators import vectors as V


class Retina:
    """word_fp (word, positions, cardinality, frequency) on a grid of dim x dim places."""

    def __init__(self, word_fp: DataFrame, dim: int, config: FingerprintConfig = FingerprintConfig(), indexed: bool = True) -> None:
        self.word_fp, self.dim, self.config = word_fp, dim, config
        self.postings = index.postings(word_fp) if indexed else None

    @property
    def grid(self) -> int:
        return self.dim * self.dim

    # tables in and out
    def save(self, path: str) -> None:
        """Words sorted and in ranges, so that a look-up reads few row groups; postings likewise by position."""
        self.word_fp.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/words")
        if self.postings is not None:
            self.postings.repartitionByRange("position").sortWithinPartitions("position", "word").write.mode("overwrite").parquet(f"{path}/postings")
        meta = {"dim": self.dim, "indexed": self.postings is not None, **asdict(self.config)}
        self.word_fp.sparkSession.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Retina:
        meta = spark.read.schema("dim int, indexed boolean, max_active_bits int, weighted boolean").json(f"{path}/meta").collect()[0]
        out = cls(spark.read.parquet(f"{path}/words"), meta["dim"], FingerprintConfig(meta["max_active_bits"], meta["weighted"]), False)
        if meta["indexed"]:
            out.postings = spark.read.parquet(f"{path}/postings")
        return out

    @classmethod
    def train(cls, docs: DataFrame, som: SomConfig = SomConfig(dimension=32), config: FingerprintConfig = FingerprintConfig(), epochs: int = 5) -> Retina:
        """Windows, context vectors, a self-organising map of them, and each word's units as its positions."""
        words = V.context_embeddings(docs, som.weight_dimension, som.half_window).persist()
        weights, _ = V.train_batch(words, "vec", som, epochs)
        windows = docs.select(F.explode(T.context_windows(T.tokens(F.col("text")), som.half_window)).alias("w"))
        units = V.assign_units(words, weights, "word", "vec")
        hits = windows.select(F.col("w.center").alias("word"), F.explode("w.context").alias("c")).join(units.select(F.col("word").alias("c"), F.col("unit").alias("position")), "c")
        return cls(fp.word_fingerprints(hits.select("word", "position"), config.max_active_bits), som.dimension, config)

    # words
    def info(self) -> DataFrame:
        return self.word_fp.agg(F.count("*").alias("words")).withColumns({"dim": F.lit(self.dim), "grid": F.lit(self.grid)})

    def contains(self, word: str) -> bool:
        return not self.word_fp.where(F.col("word") == word).isEmpty()

    def positions(self, word: str) -> list[int]:
        found = self.word_fp.where(F.col("word") == word).select("positions").take(1)
        if not found:
            raise WordNotFound(word)
        return found[0][0]

    def word_similarity(self, a: str, b: str, kind: str = "cosine") -> float:
        pa, pb = self.positions(a), self.positions(b)
        return self._one(sdr.similarity(kind, self._lit(pa), self._lit(pb)))

    def _lit(self, positions: list[int]) -> object:
        return F.array(*map(F.lit, positions)).cast("array<int>")

    def _one(self, column: object) -> float:
        return self.word_fp.sparkSession.range(1).select(column).collect()[0][0]

    def _query(self, name: str, positions: list[int]) -> DataFrame:
        return self.word_fp.sparkSession.createDataFrame([(name, positions)], "query string, positions array<int>")

    def similar_words(self, word: str, k: int) -> DataFrame:
        q = self._query(word, self.positions(word))
        return index.two_phase(q, self.word_fp, k) if self.postings is not None else self.scan(q, k, stopwords=0.35).where(F.col("word") != word)

    def similar_to(self, positions: list[int], k: int) -> DataFrame:
        return self.scan(self._query("", positions), k)

    def similar_indexed(self, positions: list[int], k: int) -> DataFrame:
        if self.postings is None:
            raise NoIndex("the model has no postings")
        return index.two_phase(self._query("", positions), self.word_fp, k, pool=2)

    def scan(self, query: DataFrame, k: int, stopwords: float | None = None) -> DataFrame:
        """Exact neighbours; words whose stopword score reaches the limit are left out."""
        words = self.word_fp
        if stopwords is not None:
            words = words.join(fp.stopword_scores(words).where(F.col("score") < stopwords), "word", "left_semi")
        return index.nearest(query, words, k)

    def center(self, words: list[str]) -> list[int]:
        """Positions of more than half of the words asked for, known or not."""
        asked = self.word_fp.where(F.col("word").isin(words)).select(F.explode("positions").alias("p")).groupBy("p").count()
        return [r["p"] for r in asked.where(F.col("count") > len(words) // 2).orderBy("p").collect()]

    def difference(self, a: str, b: str) -> list[int]:
        gone = set(self.positions(b))
        return [p for p in self.positions(a) if p not in gone]

    def analogy(self, a: str, b: str, c: str, k: int) -> DataFrame:
        """a is to b as c is to what: neighbours of c with what a and b don't share."""
        pa, pb, pc = (set(self.positions(w)) for w in (a, b, c))
        target = sorted(pc | (pa ^ pb))[: self.config.max_active_bits]
        return self.scan(self._query("", target), k + 3).where(~F.col("word").isin(a, b, c)).orderBy("rank").limit(k)

    # texts
    def fingerprint_texts(self, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
        return fp.text_fingerprints(docs, self.word_fp, "weighted" if self.config.weighted else "union", self.config.max_active_bits, id_col)

    def text_similarity(self, a: str, b: str) -> float:
        texts = self.word_fp.sparkSession.createDataFrame([(0, a), (1, b)], "doc_id int, text string")
        found = {r["doc_id"]: r["positions"] for r in self.fingerprint_texts(texts).collect()}
        return self._one(sdr.cosine(self._lit(found.get(0, [])), self._lit(found.get(1, []))))

    def segments(self, docs: DataFrame, config: SegmentationConfig = SegmentationConfig()) -> DataFrame:
        """(doc_id, segment, first, last, text): topics of texts, cut between sentences."""
        units = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
        key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("idx").cast("string"))
        prints = fp.text_fingerprints(units.select(key.alias("u"), F.col("sentence").alias("text")), self.word_fp, "weighted", self.config.max_active_bits, "u")
        with_fp = units.withColumn("u", key).join(prints, "u", "left").select("doc_id", "idx", F.coalesce("positions", sdr.empty()).alias("positions"))
        g = segment.gaps(segment.blocks(with_fp, config.block))
        marked = segment.spaced(segment.boundaries(segment.smoothed(segment.depths(g), config.sigma), config), config)
        return segment.segments(units, marked, config.block)
