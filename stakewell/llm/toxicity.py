"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary text, give each word its probability by continuation
counts: in how many contexts of the class a word stands (a context is a document, so that one long document isn't a class).
Each class's counts are discounted, by the discount that Kneser and Ney estimate from the class's own words of one and two
contexts; what that leaves, and a weight of SHARED contexts for each of the lesser class, goes to the lower order, which both classes
share: the discounted continuation counts of both together, and below them the same for every word. So a rare
expression that one class happens to hold says little, and one that neither knows says nothing.

A text is scored by the difference of its two log-likelihoods, normalised by length: the mean over its words of what
stands out above the text's median ratio (which cancels what language or topic add to every word), the greatest of a word, and the length. A logistic fit
of these three turns them into a probability.

Counted are all words of all labelled documents of the counting folds, to their ends, however rare and whatever the corpus's size. The model
is never gathered in one place: the driver sees the totals of counts (six numbers), and the words' ratios meet the words of
the documents to score by a join. For that documents are dealt
into lots of about LOT bytes; ratios of words go to the lots that hold them, and who describes a
lot's documents reads that lot's ratios alone. The fit takes at most SAMPLE documents of
each label from the fold that wasn't counted.

Null and empty texts score the share of toxic labels. Contradicting or null labels
are not learned from. With labels of one kind only, every score is that label's
share. Repeated rows get equal scores, and texts that tie in all figures too; a null doc_id is scored. Very long texts are scored whole. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, folder_of, give_back, new_folder, partitions, slices, small, text_batches, written

#: Weight of the shared lower order in each class, for each context of the lesser class.
SHARED = 0.1
#: What a word's log ratio must exceed the text's median by to stand out.
STANDS_OUT = 1.0
SAMPLE = 4_000
#: Labels up to which ids and labels (two numbers each, under 100 MB in all) are broadcast, so that no text is shuffled.
LABEL_ROWS = 1_000_000
#: Bytes of a lot of documents; a longer text is a lot of its own.
LOT = 32 << 20
#: Bytes of a row group of the lots' ratios.
ROW_GROUP = 2 << 20
LETTERS = r"[^\p{L}\p{N}\p{M}]+"
_SPLIT = regex.compile(LETTERS)


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), LETTERS)


def labelled(labels: DataFrame, column: str = "toxic") -> DataFrame:
    """doc_id, label of the rows that may be learned from."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold(F.col("doc_id")) != 0))
    return rows.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("most")).filter("label = most").select("doc_id", "label")


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """word, toxic, ordinary: labelled documents of the counting folds that hold it, by class."""
    rows = labels.filter(fold(F.col("doc_id")) != 1).select(F.col("doc_id").alias("label_id"), "label")
    text = docs.select("doc_id", "text").join(small(rows, most=LABEL_ROWS), F.col("doc_id") == F.col("label_id"))
    words = text.select(F.col("label").cast("long").alias("label"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))


def discount(ones: int, twos: int) -> float:
    """Kneser and Ney's estimate from the numbers of words of one and of two contexts."""
    return ones / (ones + 2 * twos) if ones and twos else 0.75


def word_ratios(counts: DataFrame) -> tuple[DataFrame, float]:
    """word, ratio: log of toxic over ordinary probability of each counted word; and the ratio of words that were never counted."""
    classes = ("toxic", "ordinary")
    both = F.col("toxic") + F.col("ordinary")
    total = counts.agg(*[f for c, n in (("toxic", F.col("toxic")), ("ordinary", F.col("ordinary")), ("both", both)) for f in (F.sum(n).alias(f"{c}_all"), F.count(F.when(n > 0, 1)).alias(f"{c}_types"), F.count(F.when(n == 1, 1)).alias(f"{c}_1"), F.count(F.when(n == 2, 1)).alias(f"{c}_2"))]).first().asDict()
    off = {c: discount(total[f"{c}_1"], total[f"{c}_2"]) for c in (*classes, "both")}
    if not total["toxic_all"] or not total["ordinary_all"]:
        return counts.select("word", F.lit(0.0).alias("ratio")), 0.0
    weight = SHARED * min(total["toxic_all"], total["ordinary_all"])
    # What both classes' discount leaves is spread over all known words and one unknown.
    unknown = off["both"] * total["both_types"] / (total["both_types"] + 1) / total["both_all"]
    shared = F.greatest(both - off["both"], F.lit(0.0)) / total["both_all"] + unknown
    kept = {c: off[c] * total[f"{c}_types"] + weight for c in classes}
    size = {c: total[f"{c}_all"] + weight for c in classes}
    toxic, ordinary = ((F.greatest(F.col(c) - off[c], F.lit(0.0)) + kept[c] * shared) / size[c] for c in classes)
    return counts.select("word", F.log(toxic / ordinary).alias("ratio")), float(np.log(kept["toxic"] / size["toxic"] / (kept["ordinary"] / size["ordinary"])))


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text, lot of every row: a copy in which a lot is some neighbouring documents of about LOT bytes."""

    def deal(batches):
        part, lot, held = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if held and held + b.nbytes > LOT:
                lot, held = lot + 1, 0
            held += b.nbytes
            yield pa.record_batch([*b.columns, pa.array([f"{part}-{lot}"] * len(b), pa.string())], names=["doc_id", "text", "lot"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, lot string"
    path = new_folder(docs.sparkSession, "toxic-docs")
    rows.mapInArrow(deal, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def by_lot(b: pa.RecordBatch):
    """lot, place of the first row and texts of each run of rows of one lot, of about a million letters at most."""
    lots, texts = b.column("lot").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
    edges = [i for i in range(len(lots)) if not i or lots[i] != lots[i - 1]] + [len(lots)]
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        for first, last in slices(texts[a:z]):
            yield lots[a], a + first, texts[a + first : a + last]


def lists_of(texts: list[str]) -> list[list[str]]:
    return [[w for w in _SPLIT.split(t.lower()) if w] for t in texts]


def lot_words(docs: DataFrame) -> DataFrame:
    """lot, word: the distinct words of each lot."""

    def collect(batches):
        now, held = None, set()

        def listed():
            words = list(held)
            for k in range(0, len(words), 100_000):
                part = words[k : k + 100_000]
                yield pa.record_batch([pa.array([now] * len(part), pa.string()), pa.array(part, pa.string())], names=["lot", "word"])

        for b in batches:
            for lot, _, texts in by_lot(b):
                if lot != now:
                    yield from listed()
                    now, held = lot, set()
                for words in lists_of(texts):
                    held.update(words)
        yield from listed()

    return docs.select("lot", "text").mapInArrow(collect, "lot string, word string")


def bucket_of(lots: int) -> Column:
    return F.pmod(F.hash("lot"), F.lit(lots))


def ratios_by_lot(docs: DataFrame, ratios: DataFrame) -> tuple[str, int]:
    """(folder, buckets) of the files that hold, for each lot, the log ratios of those of its words that were counted.

    Lots share files, a folder for each of as many buckets as the session has partitions. A file is sorted by lot and has
    small row groups, so that a lot is read by the groups that may hold it.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = lot_words(docs).join(small(ratios), "word").select("lot", "word", F.col("ratio").cast("float").alias("ratio"))
    path = new_folder(spark, "toxic-lots")
    rows = rows.withColumn("bucket", bucket_of(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "lot")
    rows.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(path)
    return path, buckets


class Scorer:
    """Holds the ratio of each counted word of one lot; a document is then a sum."""

    def __init__(self, folder: str, bucket: int, lot: str, unknown: float) -> None:
        fs, at = pafs.FileSystem.from_uri(folder)
        self.known: dict[str, float] = {}
        self.unknown = unknown
        for f in fs.get_file_info(pafs.FileSelector(f"{at}/bucket={bucket}", allow_not_found=True)):
            if f.path.endswith(".parquet"):
                with fs.open_input_file(f.path) as source:
                    file = pq.ParquetFile(source)
                    ranges = [file.metadata.row_group(i).column(0).statistics for i in range(file.num_row_groups)]
                    held = [i for i, s in enumerate(ranges) if s is None or not s.has_min_max or s.min <= lot <= s.max]
                    for b in file.iter_batches(100_000, row_groups=held) if held else ():
                        mine = b.filter(pc.equal(b.column("lot"), lot))
                        self.known.update(zip(mine.column("word").to_pylist(), mine.column("ratio").to_pylist(), strict=True))

    def values(self, texts: list[str]) -> np.ndarray:
        """What describes each text; all 0 without words."""
        out = np.zeros((len(texts), N_VALUES))
        get, unknown = self.known.get, self.unknown
        for i, ws in enumerate(lists_of(texts)):
            if ws:
                r = np.fromiter((get(w, unknown) for w in ws), np.float64, len(ws))
                z = r - np.median(r)
                out[i] = np.maximum(z - STANDS_OUT, 0).mean(), z.max(), np.log(len(r))
        return out


N_VALUES = 3


def described(docs: DataFrame, folder: str, buckets: int, unknown: float) -> DataFrame:
    """doc_id, worded, x: whether a row of docs has words, and what describes it."""

    def run(batches):
        now, scorer = None, None
        for b in batches:
            for lot, first, texts in by_lot(b):
                if lot != now:
                    now, scorer = lot, None
                    scorer = Scorer(folder, b.column("bucket")[first].as_py(), lot, unknown)
                x = scorer.values(texts)
                worded = pa.array([bool(_SPLIT.sub("", t)) for t in texts])
                yield pa.record_batch([b.column("doc_id").slice(first, len(texts)), worded, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_VALUES, pa.int32()), pa.array(x.ravel()))], names=["doc_id", "worded", "x"])
            give_back()

    return docs.select("doc_id", "text", "lot", bucket_of(buckets).alias("bucket")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, worded boolean, x array<double>")


class Logistic:
    """Logistic regression by Newton's steps, with a small ridge."""

    def __init__(self, x: np.ndarray, label: np.ndarray, steps: int = 30) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
            w -= np.linalg.solve(h, z.T @ (p - label) + 0.5 * w)
        self.weights = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        # One row's products are summed alike wherever the row stands.
        z = self.weights[0] + np.einsum("ij,j->i", (x - self.mean) / self.scale, self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: DataFrame, known: DataFrame, sample: int = SAMPLE) -> Logistic | None:
    """The fit on described rows; None with labels of one kind only."""
    learned = known.filter(fold(F.col("doc_id")) == 1)
    picked = [learned.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    # At most 2 * sample ids: bounded, so they are broadcast.
    ids = F.broadcast(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("label_id"), "label"))
    got = rows.join(ids, F.col("doc_id") == F.col("label_id")).select("label", *[F.col("x")[j].alias(f"x{j}") for j in range(N_VALUES)]).toPandas()
    got = got.sort_values(list(got.columns)).to_numpy(float)
    return Logistic(got[:, 1:], got[:, 0]) if len(set(got[:, 0])) == 2 else None


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    text_batches(docs.sparkSession)
    known = written(labelled(labels), "toxic-labels")
    share = float(known.agg(F.avg("label")).first()[0] or 0.0)
    copy = dealt(docs)
    ratios, unknown = word_ratios(written(word_counts(copy, known), "toxic-counts"))
    folder, buckets = ratios_by_lot(copy, ratios)
    rows = written(described(copy, folder, buckets, unknown), "toxic-described")
    discard(folder)
    discard(folder_of(copy))
    model = train(rows, known)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_list())) if len(x) else [], dtype=float)

    rows = rows.withColumn("score", F.when(F.col("worded"), score("x")).otherwise(F.lit(share)) if model else F.lit(share))
    rows = rows.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(0)) == 0).alias("held_out"), "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
