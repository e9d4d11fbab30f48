"""Shared, cached base tables per (session, data directory).

The node table is the expensive part of every query (tokenize + tree
windows); it is built once per input and written to files, bucketed by
``page_id``. Reading it reports that hash partitioning, so per-page windows,
aggregates and joins on top of it need no further shuffle.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.operators import elements as E
from weblens.operators import tree
from weblens.operators.replay import selection_replay
from weblens.session import cut, ensure_checkpoint_dir, scratch_path, ship
from weblens.sources.log import read_log
from weblens.sources.pages import read_pages, read_view

_CACHE: dict = {}
_VIEW = ["raw"]
_TABLES: list[tuple[SparkSession, str]] = []


@contextmanager
def using(view: str):
    """Build queries over another view of the pages: the named fixtures ``rich``
    and ``malformed`` instead of the pages as they are (``raw``)."""
    _VIEW.append(view)
    try:
        yield
    finally:
        _VIEW.pop()


def current() -> str:
    return _VIEW[-1]


def _keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _alive(spark: SparkSession) -> bool:
    return spark.sparkContext._jsc is not None


def _input(spark: SparkSession, sf_dir: str) -> tuple:
    """What a cached table stands for: the application, the folder, and the
    files of its tables with their sizes and times, so that neither a new
    session nor changed input ever meets an old table."""
    sc = spark.sparkContext
    files = []
    for table in ("pages", "events"):
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files += [(table, f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(path) if fs.exists(path) else [])]
    return (sc.applicationId, sf_dir, *sorted(files))


def configure(spark: SparkSession) -> None:
    """Let joins keyed by (page_id, x) reuse the page_id partitioning, and make
    sure a reliable checkpoint directory is known (the cluster's
    ``spark.checkpoint.dir``; a local scratch directory only when unset)."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # a bucket is one file, written in the order of its pages and places: joins and
    # windows over both then read rows that are sorted already
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    # the session keeps a text of every plan it ran, and a plan over cached tables
    # spells out the plans of all tables below it
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")
    ensure_checkpoint_dir(spark)
    ship(spark)


def _write_bucketed(spark: SparkSession, df: DataFrame, name: str, nparts: int) -> DataFrame:
    """Cut the lineage with a table written to the shared checkpoint folder,
    bucketed by ``page_id`` into the shuffle partition count: reading it back
    reports hash partitioning on ``page_id``, so later per-page windows, aggregates
    and joins still need no shuffle, and a lost executor re-reads files instead
    of recomputing the tokenize + window plan. Rows of a bucket are sorted by page and
    place, which joins of such tables by both then need not do."""
    table = f"weblens_{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    order = [c for c in ("page_id", "pos") if c in df.columns]
    (df.write.mode("overwrite").bucketBy(nparts, "page_id").sortBy(*order)
     .option("path", scratch_path(spark, name)).saveAsTable(table))
    _TABLES.append((spark, table))
    return spark.table(table)


def num_partitions(spark: SparkSession, sf_dir: str | None = None, view: str | None = None) -> int:
    """Partition count of the page-partitioned tables: one partition per
    ``weblens.partitionBytes`` (default 4 MB) of the view's HTML, and at least the
    cluster's default parallelism. HTML is counted as it is tokenized (one scan of
    the pages), not as it is compressed in files, so that a task's rows, and with
    them its sorts, stay the same size however large the input is. The same count is
    used for every page-partitioned table of a view so they stay co-partitioned."""
    if sf_dir is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    view = view or current()
    view = current() if view == "captured" else view
    key = (_input(spark, sf_dir), view, "nparts")
    if key not in _CACHE:
        target = int(spark.conf.get("weblens.partitionBytes", str(tree.PARTITION_BYTES)))
        _CACHE[key] = tree.partitions_for(read_view(spark, sf_dir, view), spark.sparkContext.defaultParallelism, target)
    return _CACHE[key]


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that some tab has a selection on: cut down before tokenizing. The
    pages are dealt by ``page_id`` once, for the join and for the tree alike: an
    exchange that the join asks for would move their HTML a second time, in pieces that
    follow the files. The tabs are distinct, so the join keeps pages as a semi-join does;
    a semi-join is moved below the exchange by the optimizer."""
    tabs = selection_replay(read_log(spark, sf_dir)).select(F.col("tab").alias("page_id")).distinct()
    dealt = tree.partition_pages(read_view(spark, sf_dir, current()), num_partitions(spark, sf_dir))
    return dealt.join(tabs, "page_id")


def core(spark: SparkSession, sf_dir: str, view: str | None = None) -> DataFrame:
    """The slim node table (tokens, tree, attributes), written once."""
    view = view or current()
    key = (_input(spark, sf_dir), view, "core")
    if key not in _CACHE:
        configure(spark)
        nparts = num_partitions(spark, sf_dir, view)
        if view == "captured":
            p = captured_pages(spark, sf_dir)
        else:
            p = tree.partition_pages(read_view(spark, sf_dir, view), nparts)
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(_keep(df))
            return held[-1]

        n = _write_bucketed(spark, E.core_nodes(tree.build(p, hold)), "nodes", nparts)
        for df in held:
            df.unpersist()
        _CACHE[key] = n
    return _CACHE[key]


def core_elements(spark: SparkSession, sf_dir: str, view: str | None = None) -> DataFrame:
    return core(spark, sf_dir, view).filter(F.col("kind") == "open").drop("text")


def texts(spark: SparkSession, sf_dir: str, view: str | None = None) -> DataFrame:
    return core(spark, sf_dir, view).filter(F.col("kind") == "text")


def nodes(spark: SparkSession, sf_dir: str, view: str | None = None) -> DataFrame:
    """Core nodes with ancestor columns and previews: for the queries that
    need paths, contexts, suppression or rendered text. ``text`` is a text
    node's own; no element's textContent is kept."""
    view = view or current()
    key = (_input(spark, sf_dir), view, "nodes")
    if key not in _CACHE:
        c, nparts = core(spark, sf_dir, view), num_partitions(spark, sf_dir, view)
        if c.filter("page_id IS NULL").isEmpty():
            # what the ancestors tell is written by itself and met with the core rows by place,
            # both sorted: the rows do not ride through the pass
            n = E.build_nodes(E.with_preview(c.select(*E.WALKED), texts(spark, sf_dir, view))).select("page_id", "pos", *E.TOLD)
            _CACHE[key] = c.join(_write_bucketed(spark, n, "ancestors", nparts), ["page_id", "pos"], "left")
        else:  # a page without an id meets nothing in a join
            n = E.build_nodes(E.with_preview(c, texts(spark, sf_dir, view)))
            _CACHE[key] = _write_bucketed(spark, n, "ancestors", nparts)
    return _CACHE[key]


def elements(spark: SparkSession, sf_dir: str, view: str | None = None) -> DataFrame:
    return nodes(spark, sf_dir, view).filter(F.col("kind") == "open").drop("text")


def paths(spark: SparkSession, sf_dir: str, view: str | None = None) -> DataFrame:
    """Elements with their CSS path and absolute XPath, made when first asked for. The
    paths are written by themselves and met with the elements by place, both sorted."""
    view = view or current()
    key = (_input(spark, sf_dir), view, "paths")
    if key not in _CACHE:
        rounds: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            rounds.append(_keep(df))
            return rounds[-1]

        p = E.with_paths(core_elements(spark, sf_dir, view), hold).select("page_id", "pos", "css_path", "xpath_absolute")
        p = _write_bucketed(spark, p, "paths", num_partitions(spark, sf_dir, view))
        for df in rounds:
            df.unpersist()
        _CACHE[key] = elements(spark, sf_dir, view).join(p, ["page_id", "pos"], "left")
    return _CACHE[key]


def with_text(spark: SparkSession, sf_dir: str, els: DataFrame, view: str | None = None) -> DataFrame:
    """Elements with their textContent, made for the given ones only."""
    return E.with_text(els, texts(spark, sf_dir, view))


def pages(spark: SparkSession, sf_dir: str, view: str | None = None) -> DataFrame:
    """``(page_id, url)``, hash-partitioned by page_id like the node table, so
    joining page-level results to it needs no further shuffle."""
    key = (_input(spark, sf_dir), view or current(), "pages")
    if key not in _CACHE:
        configure(spark)
        p = read_pages(spark, sf_dir).select("page_id", "url")
        _CACHE[key] = tree.partition_pages(p, num_partitions(spark, sf_dir, view)).persist(StorageLevel.MEMORY_AND_DISK)
    return _CACHE[key]


def clear() -> None:
    """Drop every cached table of every session, and the tables written for them."""
    for df in _CACHE.values():
        if isinstance(df, DataFrame) and _alive(df.sparkSession):
            df.unpersist()
    _CACHE.clear()
    for spark, table in _TABLES:
        if _alive(spark):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    _TABLES.clear()


class Tables:
    """Tree tables of an arbitrary ``pages(page_id, url, html)`` DataFrame."""

    def __init__(self, pages_df: DataFrame, num_partitions: int = 2):
        self.pages = pages_df
        core = cut(E.core_nodes(tree.build(tree.partition_pages(pages_df, num_partitions))), "core")
        self.texts = core.filter(F.col("kind") == "text")
        self.nodes = cut(E.build_nodes(E.with_preview(core, self.texts)), "nodes")
        self.elements = self.nodes.filter(F.col("kind") == "open").drop("text")
        self.nodes_text = cut(E.with_paths(E.with_text(self.nodes, self.texts)), "nodes-text")
        self.elements_text = self.nodes_text.filter(F.col("kind") == "open")

    def element(self, page_id: int, tag: str, nth: int = 1):
        rows = self.elements_text.filter((F.col("page_id") == page_id) & (F.col("tag") == tag)).orderBy("pos").collect()
        return rows[nth - 1]

    def roots(self, page_id: int, tag: str, nth: int = 1) -> DataFrame:
        pos = self.element(page_id, tag, nth)["pos"]
        return self.elements_text.filter((F.col("page_id") == page_id) & (F.col("pos") == pos))


def memo(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build once per (session, input, view, name) and keep it in files:
    shared intermediates used by several queries or several branches of one
    plan are not recomputed. They are written bucketed by page, so that a plan on top
    of them ends at files and does not carry the plans of all tables below."""
    key = (_input(spark, sf_dir), current(), name)
    if key not in _CACHE:
        _CACHE[key] = _write_bucketed(spark, build(), name.replace("_", "-"), num_partitions(spark, sf_dir))
    return _CACHE[key]


def kept(spark: SparkSession, sf_dir: str, view: str | None = None):
    """Writes the rows that an operator wants kept, bucketed by page: the plan above
    them ends at files, so a task holds the sorts of one side only."""
    return lambda df: _write_bucketed(spark, df, "kept", num_partitions(spark, sf_dir, view))
