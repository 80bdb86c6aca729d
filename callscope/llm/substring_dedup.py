"""Substring dedup with a log-structured fingerprint index.

Windows of consecutive words are indexed by winnowing: the least hash among the
short word grams of a window is its fingerprint, so equal windows share it, and
a stretch of windows with one fingerprint is one index row (a segment), with a
64-bit hash of all its windows. Rows of equal fingerprint and segment hash are a
class; a class is told apart by 128 bits. A batch of documents becomes an
immutable run, bucketed and sorted by fingerprint.

To add a batch, its run is merge-joined with the runs of history, bucket by
bucket, in their stored order: history is neither shuffled nor sorted; only the
rows that meet go on. A new segment whose class has an earlier
member is repeated as a whole. Where a fingerprint has several classes, their
first members may share windows in part: these are verified by the 64-bit hashes
of every window beside the fingerprint, from the words of those few documents.
Runs have levels: as many runs of a level as the fan-out are merged into one of
the next level, which keeps the first of each class. So after n batches a row
was written log(n) times at most, and as many runs times the fan-out are met.
``save`` and ``open`` keep the index in a folder, so that a later session adds a
batch without the tables of the earlier ones.

A class that very many documents hold doesn't gather: a task passes on only its
own least member of each class that it remembers, and knows the others as
repeated.

A word goes if a window that covers it also starts earlier: in an earlier batch,
in a document with a smaller id, or before in the same document. Windows are
judged on the input.

Defined results: null and empty texts have no words; documents shorter than a
window lose nothing; documents whose id is null come last; of documents that
share an id, or have none, one that differs comes earlier by the hash of its
text, and equal rows are one document, with one result; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.llm.common import gram_hashes, is_small, mix, powers, release, slices, stage_table, text_tie, utf8, word_hashes, work_dir

#: Words of the grams whose least hash in a window is its fingerprint.
GRAM = 6
#: Low bits that hold a gram's place while the least of a window is sought.
PLACE_BITS = 24
#: Classes that a task remembers to tell their later members at once.
REMEMBERED = 50_000
#: Columns of a place, in order: an earlier one keeps a window.
PLACE = ("batch", "unnamed", "doc_id", "tie", "lo")
_SPAN = re.compile(rb"[^\x20\x09-\x0D]+")


def segments(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first window, windows) of every stretch of windows that share a fingerprint's place."""
    gram = min(GRAM, window)
    grams = gram_hashes(hashes, gram)
    width = window - gram + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 3
    # The place of the leftmost least gram of every window: places break ties in the low bits.
    if len(grams) >> PLACE_BITS:
        place = np.lib.stride_tricks.sliding_window_view(grams >> np.uint64(PLACE_BITS), width).argmin(axis=1) + np.arange(n)
    else:
        low, span = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64), 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[width - span : width - span + n])
        place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], first, np.diff(first, append=n)


def run_hashes(hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``size`` hashes from ``first``, from prefix sums."""
    up, down = powers(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    first = first.astype(np.int64)
    return mix((sums[first + size.astype(np.int64)] - sums[first]) * down[first] + size.astype(np.uint64))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word count and digest of the words as they are."""
    for batch in slices(batches):
        out: list[list] = [[], []]
        for data in batch.column("text"):
            words = (data.as_py() or b"").split()
            out[0].append(len(words))
            out[1].append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tie"), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string()), strict=True))],
            ["doc_id", "tie", "n_words", "words_sha256"],
        )


def _cat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def _segmenter(window: int):
    """(fp, seg, doc_id, tie, lo, n, lead) of every segment; one that isn't a lead has an equal one before it in the same task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple] = {}
        for batch in slices(batches):
            ids, fps, segs, los, counts, leads = [], [], [], [], [], []
            for k, (data, own, tie) in enumerate(zip(*(batch.column(c) for c in ("text", "doc_id", "tie")), strict=True)):
                words = word_hashes((data.as_py() or b"").split())
                fp, lo, n = segments(words, window)
                if not len(fp):
                    continue
                seg = run_hashes(gram_hashes(words, window), lo, n)
                own, tie = own.as_py(), tie.as_py()
                doc = (own is None, own if own is not None else 0, tie)
                if len(seen) > REMEMBERED:
                    seen.clear()
                lead = []
                for key, at in zip(zip(fp.tolist(), seg.tolist(), strict=True), lo.tolist(), strict=True):
                    place, least = (doc, at), seen.get(key)
                    first = least is None or place <= least
                    if first:
                        seen[key] = place
                    lead.append(first)
                ids.append(np.full(len(fp), k))
                for part, values in zip((fps, segs, los, counts, leads), (fp, seg, lo, n, lead), strict=True):
                    part.append(np.asarray(values))
            at = pa.array(_cat(ids, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_cat(fps, np.uint64).view(np.int64)), pa.array(_cat(segs, np.uint64).view(np.int64)), batch.column("doc_id").take(at), batch.column("tie").take(at),
                    pa.array(_cat(los, np.int32)), pa.array(_cat(counts, np.int32)), pa.array(_cat(leads, np.bool_)),
                ],
                ["fp", "seg", "doc_id", "tie", "lo", "n", "lead"],
            )

    return rows


def _windower(window: int):
    """(fp, w, batch, doc_id, tie, lo) of every window of the wanted segments of a document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, fps, ws, los = [], [], [], []
            wanted = batch.column("segs")
            flat, offsets = wanted.flatten(), np.concatenate([[0], np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))])
            fp, lo, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "lo", "n"))
            for k, data in enumerate(batch.column("text")):
                own = slice(int(offsets[k]), int(offsets[k + 1]))
                h = gram_hashes(word_hashes((data.as_py() or b"").split()), window)
                size = n[own].astype(np.int64)
                starts = np.repeat(lo[own].astype(np.int64) - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                ids.append(np.full(len(starts), k))
                fps.append(np.repeat(fp[own], size))
                ws.append(h[starts])
                los.append(starts)
            at = pa.array(_cat(ids, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_cat(fps, np.int64)), pa.array(_cat(ws, np.uint64).view(np.int64)), *(batch.column(c).take(at) for c in ("batch", "doc_id", "tie")), pa.array(_cat(los, np.int32))],
                ["fp", "w", "batch", "doc_id", "tie", "lo"],
            )

    return rows


def _place() -> Column:
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    return F.struct(*[unnamed if c == "unnamed" else F.col(c) for c in PLACE])


def _of_same_document(df: DataFrame, other: DataFrame, how: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Join by (doc_id, tie, ``also``), a null id with a null id; ``other`` is broadcast if it is checked to be small and flat."""
    keys = ("doc_id", "tie", *also)
    right = other.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for c in other.columns if c not in keys])
    same = [df["doc_id"].eqNullSafe(right["__doc_id"]), *[df[c] == right[f"__{c}"] for c in keys[1:]]]
    small = len(right.columns) == len(keys) and is_small(right)
    return df.join(F.broadcast(right) if small else right, reduce(lambda a, b: a & b, same), how).drop(*[f"__{c}" for c in keys])


#: Lets a scan of a bucketed table with one file a bucket keep the order that the files are stored in.
STORED_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def stored_order(spark: SparkSession):
    """While plans are made in this block, scans of runs are known to be sorted."""
    before = spark.conf.get(STORED_ORDER)
    spark.conf.set(STORED_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(STORED_ORDER, before)


def level_of(name: str) -> int:
    """The level in the name of a run: how often its rows were merged."""
    return int(name.partition("_level")[2] or 0)


class FingerprintIndex:
    """Runs of segments, each bucketed and sorted by fingerprint, and the words of the documents that they came from."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 20, fanout: int = 2, buckets: int | None = None):
        self.spark, self.window, self.fanout = spark, window, fanout
        self.path = (path or f"{work_dir(spark)}/callscope-{uuid.uuid4().hex}/index").rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.kind: str | None = None
        self.runs: dict[str, DataFrame] = {}
        self.texts: dict[int, DataFrame] = {}
        self.stored: set[int] = set()
        self.version = self.batches = self.made = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as it was last saved in the folder."""
        saved = spark.read.parquet(f"{path.rstrip('/')}/manifest")
        last = saved.where(F.col("version") == saved.agg(F.max("version")).first()[0]).collect()  # a row a run and a batch
        head = last[0]
        index = cls(spark, path, head["window"], head["fanout"], head["buckets"])
        index.kind, index.version, index.batches, index.made = head["kind"], head["version"], head["batches"], head["made"]
        index.runs = {r["name"]: index._table(r["name"], True) for r in last if r["what"] == "run"}
        for r in last:
            if r["what"] == "words":
                index.texts[int(r["name"])] = spark.read.parquet(f"{index.path}/words-{r['name']}")
        index.stored = set(index.texts)
        return index

    def save(self) -> None:
        """Write what isn't in the folder yet: the words of new batches and the list of runs."""
        for number, text in self.texts.items():
            if number not in self.stored:
                text.write.parquet(f"{self.path}/words-{number}")
                self.texts[number] = self.spark.read.parquet(f"{self.path}/words-{number}")
        self.stored = set(self.texts)
        self.version += 1
        head = (self.version, self.window, self.fanout, self.buckets, self.kind, self.batches, self.made)
        rows = [(*head, "run", name) for name in self.runs] + [(*head, "words", str(k)) for k in self.texts]
        schema = "version int, window int, fanout int, buckets int, kind string, batches int, made int, what string, name string"
        self.spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{self.path}/manifest")

    def close(self) -> None:
        """Forget the tables of the session; the files stay."""
        for name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")

    def _name(self, name: str) -> str:
        return f"callscope_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{name}"

    def _table(self, name: str, create: bool = False) -> DataFrame:
        if create:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")
            self.spark.sql(
                f"CREATE TABLE {self._name(name)} (fp BIGINT, seg BIGINT, batch INT, doc_id {self.kind}, tie BIGINT, lo INT, n INT) USING parquet "
                f"CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(self._name(name))

    def _write(self, rows: DataFrame, level: int = 0) -> str:
        """A new run; ``rows`` are dealt by fingerprint already, so every task writes one bucket, as one sorted file."""
        name = f"run{self.made}_level{level}"
        self.made += 1
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.path}/{name}").saveAsTable(self._name(name))
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """``batch`` (doc_id, tie, text as binary) comes after all before it. Returns (doc_id, tie, lo, n): its runs of repeated windows."""
        self.kind = self.kind or batch.schema["doc_id"].dataType.simpleString()
        self.compact()
        number, self.batches = self.batches, self.batches + 1
        self.texts[number] = batch
        members = stage_table(batch.mapInArrow(_segmenter(self.window), f"fp long, seg long, doc_id {self.kind}, tie long, lo int, n int, lead boolean"), "members")
        loose = stage_table(members.where("not lead").select("doc_id", "tie", "lo", "n"), "loose")
        run = members.where("lead").select("fp", "seg", F.lit(number).alias("batch"), "doc_id", "tie", "lo", "n")
        name = self._write(run.repartition(self.buckets, "fp"))
        release(members)
        new = self._table(name)
        with stored_order(self.spark):
            met = stage_table(reduce(DataFrame.unionByName, self.met(new)), "meeting")
        meeting, met = met, met.repartition("fp")
        by_fp = Window.partitionBy("fp")
        met = met.withColumn("rep", _place() == F.min(_place()).over(Window.partitionBy("fp", "seg")))
        several = F.min("seg").over(by_fp) != F.max("seg").over(by_fp)
        is_new = F.col("batch") == number
        met = met.withColumn("open", several & F.max(is_new & F.col("rep")).over(by_fp))
        met = stage_table(met.where((is_new & ~F.col("rep")) | (F.col("rep") & F.col("open"))), "met")
        release(meeting)
        self.runs[name] = new
        whole = met.where(is_new & ~F.col("rep")).select("doc_id", "tie", "lo", "n")
        found = loose.unionByName(whole).unionByName(self._shared_windows(met.where("rep and open"), number))
        return stage_table(found, "repeated")

    def met(self, new: DataFrame) -> list[DataFrame]:
        """The rows of the run ``new`` whose fingerprint is in it twice or in another run, and the rows of each other run that it meets.

        All runs are bucketed and sorted alike, so these are merge joins of buckets: nothing is shuffled, and, under ``stored_order``,
        nothing of history is sorted.
        """
        old = list(self.runs.values())
        view = f"callscope_new_{uuid.uuid4().hex}"
        new.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("fp"))).createOrReplaceTempView(view)
        known = "".join(f" OR EXISTS (SELECT 1 FROM {self._name(name)} o WHERE o.fp = t.fp)" for name in self.runs)
        repeated = self.spark.sql(f"SELECT * FROM {view} t WHERE __n > 1{known}").select(*new.columns)
        self.spark.catalog.dropTempView(view)
        return [repeated, *(df.join(new.select("fp"), "fp", "left_semi") for df in old)]

    def _shared_windows(self, reps: DataFrame, number: int) -> DataFrame:
        """Windows of batch ``number`` that another class has before, among first members of classes that share a fingerprint."""
        per_doc = stage_table(reps.groupBy("batch", "doc_id", "tie").agg(F.collect_list(F.struct("fp", "lo", "n")).alias("segs")), "wanted")
        some = [
            _of_same_document(text, stage_table(per_doc.where(F.col("batch") == k).select("doc_id", "tie"), f"ids{k}"), "left_semi").withColumn("batch", F.lit(k))
            for k, text in self.texts.items()
        ]
        some = _of_same_document(reduce(DataFrame.unionByName, some), per_doc, "inner", ("batch",))
        windows = some.mapInArrow(_windower(self.window), f"fp long, w long, batch int, doc_id {self.kind}, tie long, lo int")
        windows = stage_table(windows, "windows")
        first = windows.groupBy("fp", "w").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("fp", "w", "first")
        later = windows.where(F.col("batch") == number).join(first, ["fp", "w"]).where(_place() != F.col("first"))
        return later.select("doc_id", "tie", "lo", F.lit(1).alias("n"))

    def compact(self) -> None:
        """Merge the runs of each level that has as many as the fan-out, from the lowest level up."""
        level = 0
        while level <= max(map(level_of, self.runs), default=-1):
            full = [name for name in self.runs if level_of(name) == level]
            if len(full) >= self.fanout:
                self._merge(full, level + 1)
            level += 1

    def _merge(self, names: list[str], level: int) -> None:
        """One run in place of several; the first member of a class stands for it."""
        order = ["batch", F.col("doc_id").asc_nulls_last(), "tie", "lo"]
        rank = F.row_number().over(Window.partitionBy("fp", "seg").orderBy(*order))
        # Dealt anew: Spark 4.1 takes a union of bucketed tables for bucketed, but reads its parts one after the other.
        old = {name: self.runs.pop(name) for name in names}
        merged = reduce(DataFrame.unionByName, old.values()).repartition(self.buckets, "fp").withColumn("__rank", rank)
        name = self._write(merged.where("__rank = 1").drop("__rank"), level)
        self.runs[name] = self._table(name)
        for gone, df in old.items():
            if not self.version:  # a saved index may be open elsewhere
                release(df)
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(gone)}")


def _remover(window: int, want_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[], [], []]
            found = batch.column("segs")
            flat, offsets = found.flatten(), np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))])
            lo, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n"))
            for k, data in enumerate(batch.column("text")):
                data = data.as_py() or b""
                words = data.split()
                gone = bytearray(len(words))
                own = slice(int(offsets[k]), int(offsets[k + 1]))
                for first, size in zip(lo[own].tolist(), n[own].tolist(), strict=True):
                    gone[first : first + size + window - 1] = b"\1" * (size + window - 1)
                removed = sum(gone)
                out[0].append(removed)
                out[1].append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone, strict=True) if not g])).hexdigest())
                out[2].append((_without(data, gone) if removed else data) if want_text else None)
            rest = [(batch.column(k), c) for k, c in enumerate(batch.schema.names) if c not in ("text", "segs")]
            yield pa.RecordBatch.from_arrays(
                [c for c, _ in rest] + [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.string(), pa.binary()), strict=True)],
                [c for _, c in rest] + ["n_removed", "kept_sha256", "clean"],
            )

    return remove


def _without(data: bytes, gone: bytearray) -> bytes:
    """The text without the runs of removed words; what stands between kept words stays."""
    kept, at = [], 0
    for out, run in itertools.groupby(zip(gone, _SPAN.finditer(data), strict=False), key=lambda x: x[0]):
        spans = [m.span() for _, m in run]
        if out:
            kept.append(data[at : spans[0][0]])
            at = spans[-1][1]
    return b"".join([*kept, data[at:]])


def with_tie(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``tie``, which tells documents of one id apart: 0, or the text's hash where the id is null or some id has several texts."""
    digest = text_tie(text_col)
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    unique = ids.where("a != b").isEmpty()
    tie = F.when(F.col(id_col).isNull(), digest).otherwise(0) if unique else digest
    return docs.withColumn("tie", tie.cast("long"))


def repeated_spans(rows: DataFrame, window: int = 20, batches: int = 3) -> DataFrame:
    """(doc_id, tie, segs) of the documents of (doc_id, tie, text) that lose words; they come to the index in ``batches`` steps of ascending ids."""
    index = FingerprintIndex(rows.sparkSession, window=window)
    found = []
    for lower, upper in _cuts(rows, batches):
        part = rows if lower is None else rows.where(F.col("doc_id").isNull() | (F.col("doc_id") > F.lit(lower)))
        found.append(index.add(part if upper is None else part.where(F.col("doc_id") <= F.lit(upper))))
    spans = reduce(DataFrame.unionByName, found).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("segs"))
    spans = stage_table(spans, "spans")
    for df in (*found, *index.runs.values()):
        release(df)
    index.close()
    return spans


def _cuts(rows: DataFrame, batches: int) -> list[tuple]:
    """Ranges of ids with about equally many documents, whatever their type; null ids are in the last."""
    if batches < 2:
        return [(None, None)]
    parts = rows.select("doc_id").where("doc_id is not null").repartitionByRange(4 * batches, "doc_id")
    ends = sorted(r["e"] for r in parts.groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("e")).collect())  # one row a partition
    at = sorted({ends[len(ends) * k // batches - 1] for k in range(1, batches) if len(ends) * k // batches > 0})
    return list(zip([None, *at], [*at, None], strict=True))


def remove_repeats(docs: DataFrame, window: int = 20, batches: int = 3) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    rows = with_tie(docs.select("doc_id", utf8()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(rows, window, batches)
    summary = rows.mapInArrow(_summary, f"doc_id {kind}, tie long, n_words long, words_sha256 string")
    some = _of_same_document(rows, stage_table(spans.select("doc_id", "tie"), "span_ids"), "left_semi")
    cut = _of_same_document(some, spans, "inner").mapInArrow(_remover(window, False), f"doc_id {kind}, tie long, n_removed long, kept_sha256 string, clean binary")
    cut = stage_table(cut.drop("clean").dropDuplicates(["doc_id", "tie"]), "cut")
    return _of_same_document(summary, cut, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256")
    )


def drop_repeats(docs: DataFrame, window: int = 20, batches: int = 3) -> DataFrame:
    """The documents' own columns, texts without repeated passages; documents that lose all their words go."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)])
    at = {c: f"in_{k}" for k, c in enumerate(docs.columns)}
    rows = with_tie(own.withColumn("doc_id", F.col(at["doc_id"])).withColumn("text", F.col(at["text"]).cast("binary")))
    spans = repeated_spans(rows.select("doc_id", "tie", "text"), window, batches)
    ids = stage_table(spans.select("doc_id", "tie"), "span_ids")
    same = _of_same_document(rows, ids, "left_anti").select(*[F.col(at[c]).alias(c) for c in docs.columns])
    some = _of_same_document(_of_same_document(rows, ids, "left_semi").drop(at["text"]), spans, "inner")
    fields = ", ".join(f"{c} {some.schema[c].dataType.simpleString()}" for c in some.columns if c not in ("text", "segs"))
    cut = some.mapInArrow(_remover(window, True), f"{fields}, n_removed long, kept_sha256 string, clean binary")
    back = {c: F.col(k) for c, k in at.items()} | {"text": F.col("clean").cast("string")}
    if "n_chars" in back:
        back["n_chars"] = F.length(back["text"]).cast(docs.schema["n_chars"].dataType)
    cut = cut.select(*[back[c].alias(c) for c in docs.columns]).where(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != "")
    return same.unionByName(cut)
