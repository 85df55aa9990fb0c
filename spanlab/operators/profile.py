"""Statistics of a run, its files and its accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def run_statistics(results: DataFrame, elapsed: Column) -> DataFrame:
    done = F.col("status") == "completed"
    audio = F.coalesce(F.sum(F.when(done, F.col("duration"))), F.lit(0.0))
    return results.agg(
        F.count("*").alias("n_files"), F.count_if(done).alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        audio.alias("audio_seconds"), ratio(audio, elapsed).alias("rtfx"), (F.count_if(F.col("status") == "failed") == 0).alias("ok"),
    )


def by_status(results: DataFrame, *statuses: str) -> DataFrame:
    return results.filter(F.col("status").isin(*statuses))


def merge_telemetry(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums, peaks, the least that was set (0 is unset) and the last value."""
    return rows.groupBy(*keys).agg(
        F.sum("batches").alias("batches"), F.max("peak").alias("peak"), F.coalesce(F.min(F.nullif(F.col("smallest"), F.lit(0))), F.lit(0)).alias("smallest"), F.max_by("size", "idx").alias("size")
    )


def roll_up(chunks: DataFrame, keys: list[str], peaks: list[str]) -> DataFrame:
    """One row of statistics from those of chunks: sums, the largest of ``peaks``, and the rate made again from the sums."""
    sums = [c for c in chunks.columns if c not in (*keys, *peaks, "rtfx")]
    rows = chunks.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in peaks])
    return rows.withColumn("rtfx", F.when(F.col("elapsed_seconds") > 0, F.col("successful_audio_seconds") / F.col("elapsed_seconds")))


def quantiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least, p50, p90, p99 and most, by linear interpolation; null for no rows."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(value).alias("most"))


def padding_ratio(valid: Column, padded: Column) -> Column:
    return F.when(padded != 0, 1 - valid / padded).otherwise(0.0)


def distinct_sorted(column: str) -> Column:
    return F.array_sort(F.collect_set(column))


def accuracy(scored: DataFrame, *dimensions: str) -> DataFrame:
    """Micro-averaged WER and CER overall and by each dimension; ``scored`` has the edits."""
    view = scored.select(*dimensions, "word_edits", "ref_words", "char_edits", "ref_chars")
    sets = [[], *([d] for d in dimensions)]
    level = F.concat_ws("", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions])
    return view.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(d) for d in dimensions]).agg(
        F.when(F.length(level) > 0, level).otherwise("overall").alias("level"), F.count("*").alias("n"),
        ratio(F.sum("word_edits"), F.sum("ref_words")).alias("wer"), ratio(F.sum("char_edits"), F.sum("ref_chars")).alias("cer"),
    )


def edits(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Word and character edits of each pair; a missing hypothesis is empty."""
    r, h = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(hypothesis), F.lit(""))
    rw, hw = T.words(r), T.words(h)
    return pairs.withColumns({"word_edits": T.word_distance(rw, hw), "ref_words": F.size(rw), "char_edits": F.levenshtein(r, h), "ref_chars": F.length(r)})


def samples_with_rows(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Every sample with its worker row; without one the status says so and the text is empty."""
    return samples.join(rows, "id", "left").withColumns({"status": F.coalesce("status", F.lit("worker_output_missing")), "hypothesis": F.coalesce("hypothesis", F.lit(""))})


def unknown_rows(samples: DataFrame, rows: DataFrame) -> DataFrame:
    """Worker rows of no sample; must be empty."""
    return rows.join(samples.select("id"), "id", "left_anti")


def compare_files(archive: DataFrame, installed: DataFrame, name: str) -> DataFrame:
    """Files of either side and where they are."""
    a, b = archive.select(name).distinct().withColumn("a", F.lit(True)), installed.select(name).distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "archive only").otherwise("installed only")
    return a.join(b, name, "full_outer").select(name, side.alias("side"))


def missing_ids(ids: DataFrame, column: str, size: int, show: int = 8) -> DataFrame:
    """The first absent ids of 0 .. size - 1."""
    spark = ids.sparkSession
    return spark.range(size).withColumnRenamed("id", column).join(ids.select(F.col(column).cast("long")).distinct(), column, "left_anti").orderBy(column).limit(show)


def conflicting(vocabulary: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return vocabulary.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def markdown(rows: DataFrame) -> str:
    """A small report table as text."""
    names = rows.columns
    body = ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows.collect()]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " - |" * len(names), *body])
