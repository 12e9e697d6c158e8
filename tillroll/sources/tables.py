"""Scans and sinks: contract-checked Parquet reads, the named catalog,
materialisation of derived tables and freshness of landed lookups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType, StructType

from tillroll.session import shuffles_dropped


def check_contract(df: DataFrame, schema: StructType, name: str = "table",
                   aliases: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Fail fast when a column that the queries use is missing; project to the contract.

    Names match case-insensitively; ``aliases`` maps a contract name to
    source names it may appear under (``WEEk`` -> ``CALENDAR_WEEK``). Ids and
    amounts keep the type (and so the scale) they come in, as long as it is
    the right kind; other columns are cast to the contract type (a no-op when
    they already agree). Columns the contract doesn't name are dropped.
    """
    have = {f.name.lower(): f.name for f in df.schema.fields}
    for target, sources in (aliases or {}).items():
        if target.lower() not in have:
            for src in sources:
                if src.lower() in have:
                    have[target.lower()] = have[src.lower()]
                    break
    missing = [f.name for f in schema.fields if f.name.lower() not in have and not f.metadata.get("optional")]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    cols = []
    for f in schema.fields:
        if f.name.lower() not in have:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        src = F.col(f"`{have[f.name.lower()]}`")
        actual = df.schema[have[f.name.lower()]].dataType
        kind = f.metadata.get("kind")
        own = kind == "id" and isinstance(actual, (IntegralType, StringType)) or kind == "amount" and isinstance(actual, NumericType)
        cols.append((src if own or actual == f.dataType else src.cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def load_table(spark: SparkSession, path: str | list[str], schema: StructType | None = None,
               name: str = "table", aliases: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Read a Parquet table (file, folder or list of files).

    With a contract, columns are pruned to it and checked; Parquet still only
    reads the columns a later query uses (column pruning) and row groups its
    filters keep (pushed filters).
    """
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.parquet(*paths)
    return check_contract(df, schema, name, aliases) if schema is not None else df


def parts_for(df: DataFrame, bytes_each: int = 4 << 20, most: int = 4096) -> int:
    """Shuffle partitions that hold about ``bytes_each`` of the files that ``df`` reads: the session's number at least, and
    no more than ``most`` on their own account (a session for larger inputs has more, see ``session.cluster_conf``)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    known = size if size < 1 << 55 else 0   # without figures Spark assumes the largest
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-known // bytes_each), most))


def load_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """S3: the nine named tables of a data folder, under their contracts, also as temp views.

    The five that the queries use must be there; the other four are loaded as
    they are where present. The item table is a folder of any number of parts.
    """
    from tillroll.sources import schemas

    root = folder.rstrip("/")
    out = {}
    for name, file, contract in schemas.DATASETS:
        if contract is None:
            df = read_or_none(spark, f"{root}/{file}")
            if df is not None:
                out[name] = df
        else:
            out[name] = load_table(spark, f"{root}/{file}", contract, name, schemas.ALIASES.get(name))
    return register(spark, out)


def load_daily(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The daily aggregate under its contract (source ``WEEk`` is normalised
    to ``CALENDAR_WEEK``); partition columns of a year/month layout prune."""
    from tillroll.sources.schemas import ALIASES, DAILY

    return load_table(spark, path, DAILY, "daily", aliases=ALIASES["daily"])


def load_items(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    """All part files of the item table as one scan.

    A folder path reads every part (not a fixed count); Spark splits large
    files into ``spark.sql.files.maxPartitionBytes`` pieces, so part count
    does not bound parallelism.
    """
    return load_table(spark, path, schema, "items")


def register(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """S3: expose each frame as a temp view under its name; returns the dict."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return dict(tables)


def cached(df: DataFrame) -> DataFrame:
    """Keep a frame reused by several queries (spills to disk, never OOM)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def materialize(df: DataFrame, path: str, partition_by: Iterable[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write a derived table as Parquet (optionally partitioned).

    Partitioned by calendar columns, later period filters prune whole
    folders. Dynamic partition overwrite replaces only the partitions present
    in ``df`` so an incremental refresh of one month keeps the rest. The
    write's own shuffle files go with its end.
    """
    parts = list(partition_by or [])
    if parts:
        # REBALANCE: AQE hash-distributes by the partition columns, then
        # splits oversized (hot) partitions and merges tiny ones toward the
        # advisory size - few files per folder, no single-task month.
        df = df.hint("rebalance", *parts)
    w = df.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts).option("partitionOverwriteMode", "dynamic")
    with shuffles_dropped(df.sparkSession):
        w.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a derived table; nothing happens where there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Layout for co-located joins: save ``df`` as a catalog table bucketed
    and sorted by ``key``; returns the table.

    Writing the basket table and the line table once with the same bucket
    count on the basket id makes every later basket join a sort-merge join
    with *no* exchange on either side (and the per-basket aggregates stay in
    the same stage; a hot basket then stays in one bucket, so leave tables
    with one to AQE), instead of shuffling both fact tables per query. Read
    bucketed tables with ``spark.table``.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def read_or_none(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The materialised table if it exists, else ``None`` (not ready)."""
    try:
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.parquet(path)
        df.schema  # noqa: B018 - resolve now so a missing path fails here
        return df
    except AnalysisException:
        return None


def read_if_fresh(df: DataFrame, ttl_seconds: int = 7200, ts_col: str = "fetched_at",
                  now: Column | None = None) -> DataFrame:
    """Landed lookup rows younger than ``ttl_seconds`` (default two hours)."""
    now = now if now is not None else F.current_timestamp()
    return df.where(F.col(ts_col) > now - F.make_interval(secs=F.lit(ttl_seconds)))


def refresh(spark: SparkSession, derived: Mapping[str, Callable[[], DataFrame]], frames: Iterable[DataFrame] = ()) -> dict[str, DataFrame]:
    """Rebuild derived tables. Each path is written anew from its function, cached copies are dropped, and the new tables are returned by path."""
    for f in frames:
        f.unpersist()
    out = {}
    for path, build in derived.items():
        materialize(build(), path)
        spark.catalog.refreshByPath(path)
        out[path] = spark.read.parquet(path)
    return out
