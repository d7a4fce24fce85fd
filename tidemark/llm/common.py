"""What the operators of this subpackage share: tables, lineage cuts and gapless ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut as cut
from ..session import shared_dir as shared_dir
from ..session import ship as ship

#: Rows that one cell of a rank holds on average; a cell is sorted in one task.
CELL_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table by Spark, which also reaches stores that have no local path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for files an operator writes, under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_rank(df: DataFrame, group: str, order: list[str], out: str, n_rows: int, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Add a gapless rank from 0 within each group, without sorting a group in one task.

    Rows are dealt by a hash of the order columns into cells; a cell's rows are numbered on
    their own and the counts of the cells before it are added. The number of cells grows with
    the rows, so a group that holds a third of them spreads over as many tasks. Returns the
    ranked rows and the totals by group (columns `group`, `total`). The caller has cut the
    lineage of df, which is read twice."""
    cells = max(1, -(-n_rows // cell_rows))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(cells)))
    counts = dealt.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        F.col(group).alias("_g"), F.col("_cell").alias("_c"), "_base"
    )
    own = Window.partitionBy(group, "_cell").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = dealt.withColumn("_rn", F.row_number().over(own) - 1)
    ranked = ranked.join(bases, (F.col(group) == F.col("_g")) & (F.col("_cell") == F.col("_c")))
    ranked = ranked.withColumn(out, F.col("_base") + F.col("_rn")).drop("_g", "_c", "_base", "_rn", "_cell")
    totals = counts.groupBy(group).agg(F.sum("_n").alias("total"))
    return ranked, totals
