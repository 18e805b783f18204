"""Writers: BED, bedGraph, FASTA, shards, histograms, and reports from small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import with_reverse_complements
from ..operators.sampling import with_shard


def write_bed(df: DataFrame, path: str, columns: Sequence[str] = ("chrom", "start", "end")) -> None:
    df.select(*columns).write.mode("overwrite").option("sep", "\t").csv(path)


def write_bed6(df: DataFrame, path: str) -> None:
    """Projection records as BED6 with score 0."""
    df.select("t_chrom", "t_start", "t_end", "query_name", F.lit(0), "t_strand").write.mode("overwrite").option("sep", "\t").csv(path)


def write_bedgraph(df: DataFrame, path: str, name: str, score: str = "score") -> None:
    """Rows as ``chrom start end %.6f``, each file under a track line of its own."""
    lines = df.select(F.format_string("%s\t%d\t%d\t%.6f", "chrom", "start", "end", F.col(score).cast("double")).alias("value"), "chrom", "start")
    body = lines.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").select("value", F.spark_partition_id().alias("_p"))
    head = body.select("_p").distinct().select(F.lit(f'track type=bedGraph name="{name}"').alias("value"), "_p")
    head.union(body.select("value", "_p")).repartition("_p").sortWithinPartitions("_p", ~F.col("value").startswith("track")).select("value").write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


def write_shards(df: DataFrame, path: str, n: int, seed: int, add_rc: bool = False, compression: str = "gzip") -> None:
    """Shuffled JSON-lines shards of even size, a folder each; with ``add_rc`` every ``id, seq`` row also reverse-complemented.
    ``compression``: a codec of Spark's JSON writer, or ``zstd`` where the cluster has Hadoop's native library."""
    rows = with_reverse_complements(df) if add_rc else df
    with_shard(rows, n, seed, "id").repartition(n, "shard").sortWithinPartitions("shard", "place").drop("place").write.mode("overwrite").partitionBy("shard").option("compression", {"zstd": "org.apache.hadoop.io.compress.ZStandardCodec"}.get(compression, compression)).json(path)


def write_shards_of(frames: Sequence[DataFrame], path: str, n: int, seed: int, add_rc: bool = False, compression: str = "gzip") -> None:
    """Several inputs shuffled together into shards."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    write_shards(whole, path, n, seed, add_rc, compression)


def write_histogram(hist: DataFrame, path: str) -> None:
    hist.select("bin", "n").write.mode("overwrite").parquet(path)


def report(metrics: DataFrame, row: str, column: str, value: str = "value", se: str = "se") -> str:
    """A markdown table of value and error; ``metrics`` has a row for each of few rows and columns."""
    cell = F.format_string("%.3f ± %.3f", F.col(value).cast("double"), F.col(se).cast("double"))
    wide = metrics.groupBy(row).pivot(column).agg(F.first(cell)).orderBy((F.col(row) != "_global_"), row)
    names = wide.columns
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in names) + " |" for r in wide.collect()])


def dataset_card(title: str, splits: dict[str, int], retention: DataFrame) -> str:
    """A markdown card: rows of each split, and of few subsets how many rows came in and were kept (``subset, n_input, n_kept``)."""
    lines = [f"# {title}", "", f"{sum(splits.values()):,} rows", "", "| split | rows |", "| --- | --- |", *[f"| {k} | {v:,} |" for k, v in splits.items()]]
    share = F.format_string("%.1f %%", 100.0 * F.col("n_kept") / F.greatest(F.col("n_input"), F.lit(1)))
    lines += ["", "| subset | input | kept | share |", "| --- | --- | --- | --- |"]
    for r in retention.select("subset", F.format_number("n_input", 0).alias("a"), F.format_number("n_kept", 0).alias("b"), share.alias("c")).orderBy("subset").collect():
        lines.append(f"| {r['subset']} | {r['a']} | {r['b']} | {r['c']} |")
    return "\n".join(lines) + "\n"


def as_json(df: DataFrame) -> str:
    """A small table as a JSON list; null fields are left out at every depth."""
    return "[" + ",".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect()) + "]"


def as_parquet(df: DataFrame) -> bytes:
    """A small table as one Parquet file in memory, for a program that reads it from a pipe."""
    import io

    from pyarrow import parquet

    out = io.BytesIO()
    parquet.write_table(df.toArrow(), out, compression="zstd")
    return out.getvalue()
