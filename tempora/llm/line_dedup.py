"""Lines that many documents share, found with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm._common import ASCII_SPACE, free_name, lowered, saved, scratch, skew_join


def line_hash(line: Column) -> Column:
    """128 bits of a line without the white space around it, A-Z lower-cased."""
    return F.unhex(F.md5(lowered(F.btrim(line, F.lit(ASCII_SPACE))).cast("binary")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(h, doc, places) once for each line of min_chars code points or more and each document that holds it. Places are
    the numbers of its lines, from one on, that are this one, each with the hash of the text that it is in, since other
    rows of the same id may have another. Rows without id take no part."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of"))
    lines = texts.select("doc", "of", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    long = lines.where(F.char_length(F.btrim("line", F.lit(ASCII_SPACE))) >= min_chars)
    keys = long.select(line_hash(F.col("line")).alias("h"), "doc", F.struct("of", (F.col("at") + 1).alias("at")).alias("place"))
    return keys.groupBy("h", "doc").agg(F.collect_set("place").alias("places"))


def _without(lines: Column, places: Column) -> Column:
    """lines but for those at `places`, ascending: the stretches between them, so that the work is that of one pass.
    What the stretches are taken from is bound once, as an element of an array."""
    cuts = F.concat(F.array(F.lit(0)), places, F.array(F.lit(2**31 - 1)))
    bound = F.array(F.struct(lines.alias("lines"), cuts.alias("cuts")))
    stretch = lambda b, i: F.slice(b["lines"], F.get(b["cuts"], i) + 1, F.get(b["cuts"], i + 1) - F.get(b["cuts"], i) - 1)
    return F.get(F.transform(bound, lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.size(b["cuts"]) - 2), lambda i: stretch(b, i)))), 0)


class LineRuns:
    """Sorted runs of (h, n, keeper): line hash, documents that hold it, the document that keeps it.

    Each run is a table in the shared folder, bucketed and sorted by hash, so that a batch meets the runs in merge joins
    that move the batch alone. Level k holds runs of `fanout`**k batches; `fanout` runs of a level are compacted to one of the next.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.name, self.folder, self.made = f"line_run_{uuid.uuid4().hex[:12]}", scratch(spark), 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def runs(self) -> list[str]:
        return [table for level in self.levels for table in level]

    def _write(self, run: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        run.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", f"{self.folder}/{self.made}").saveAsTable(table)
        return table

    def add(self, batch: DataFrame) -> None:
        """Takes a batch of (h, doc), each pair once. A hash that no run holds is new: the batch's largest document keeps it.

        The anti-join with the runs is kept as a flag, since hashes that are known add to the counts.
        """
        new = batch.groupBy("h").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
        known = F.lit(False)
        for k, table in enumerate(self.runs):
            new = new.join(self.spark.table(table).select("h", F.lit(True).alias(f"in_{k}")), "h", "left")
            known = known | F.col(f"in_{k}").isNotNull()
        self.levels[0].append(self._write(new.select("h", "n", F.when(~known, F.col("keeper")).alias("keeper"))))
        self._compact(self.fanout)

    def _compact(self, fanout: int) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._merged(self.levels[k]))
                self.levels[k] = []

    def _merged(self, tables: list[str]) -> str:
        rows = self.spark.table(tables[0])
        for table in tables[1:]:
            other = self.spark.table(table).select("h", F.col("n").alias("m"), F.col("keeper").alias("also"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            rows = rows.join(other, "h", "full").select("h", n.alias("n"), F.greatest("keeper", "also").alias("keeper"))
        out = self._write(rows)
        self._drop(tables)
        return out

    def _drop(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def shared(self, min_docs: int) -> DataFrame:
        """(h, n, keeper) of the hashes that min_docs documents or more hold. Closes the runs."""
        if len(self.runs) > 1:
            self.levels = [[self._merged(self.runs)]]
        out = saved(self.spark.table(self.runs[0]).where(F.col("n") >= min_docs))
        self._drop(self.runs)
        return out


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: lines that min_docs documents or more hold go, but for those in the largest id.

    Documents enter the runs in `batches` ranges of falling id; ids are numbers. Null or empty text is one empty line.
    Rows with a null id keep all lines and count for none; rows that repeat an id are one document to the counts, and
    each is cleaned. An empty table gives an empty table. Other columns pass unchanged, but for one named `lines`, in any case of letters, a struct column that holds what is new
    (n_lines, n_dropped, kept_text).
    """
    spark = docs.sparkSession
    at = [x for x in docs.agg(F.percentile_approx(id_col, [k / batches for k in range(batches - 1, 0, -1)], 1000)).first()[0] or []]
    place = F.lit(0)
    for x in at:
        place = place + (F.col("doc") <= F.lit(x)).cast("int")
    pairs = saved(line_keys(docs, id_col, text_col, min_chars).withColumn("batch", place), "batch")
    runs = LineRuns(spark)
    for k in range(len(at) + 1):
        runs.add(pairs.where(F.col("batch") == k).select("h", "doc"))
    shared = runs.shared(min_docs)
    doc, of, places = (free_name(name, docs) for name in ("_doc", "_of", "_places"))
    goes = skew_join(pairs.select("h", "doc", "places"), shared, "h", "n").where(F.col("doc") < F.col("keeper"))
    goes = goes.select(F.col("doc").alias(doc), F.explode("places").alias("place")).groupBy(doc, F.col("place.of").alias(of)).agg(F.array_sort(F.collect_list("place.at")).alias(places))
    rows = docs.join(goes, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text_col) == F.col(of)), "left")
    lines, whole, none = lines_of(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")), F.col(places).isNull()
    kept = F.when(none, whole).otherwise(F.array_join(_without(lines, F.col(places)), "\n"))
    found = F.struct(F.size(lines).cast("long").alias("n_lines"), F.when(none, 0).otherwise(F.size(places)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
    return rows.select(*[docs[c] for c in docs.columns if c.lower() != "lines"], found.alias("lines"))
