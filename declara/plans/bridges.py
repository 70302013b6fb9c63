"""Views that turn the star-schema test tables into label-domain inputs.

Each text is valid Spark SQL and DuckDB SQL, so the queries and their SQL counterparts start from
the same rows.  ``STRING`` casts and ``chr(10)`` keep the dialects aligned.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _load(text: str) -> dict[str, str]:
    blocks = re.findall(r"-- view: (\w+)\n(.*?);\n", text, flags=re.S)
    return {name: body.strip() for name, body in blocks}


VIEWS: dict[str, str] = _load((Path(__file__).parent / "bridges.sql").read_text(encoding="utf-8"))


def _needed(sql: str) -> list[str]:
    """Views a statement refers to, dependencies first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            for dep in _needed(VIEWS[name]):
                if dep not in out:
                    out.append(dep)
            if name not in out:
                out.append(name)
    return out


def with_views(sql: str) -> str:
    """Prefix a statement with the bridge views it uses (for the SQL side)."""
    names = _needed(sql)
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out to as many partitions as a shuffle has, several per core at least.

    Row-wise work as long as an extraction costs about a millisecond a row, while a narrow table of a million rows
    is one or two splits of a file; so its rows are dealt out before that work, in batch and in streams alike.
    """
    spark = df.sparkSession
    parts = spark.conf.get("declara.deal", None) or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(int(parts))


def spread(df: DataFrame) -> DataFrame:
    """Wide rows (whole texts), dealt out only where the files have fewer splits than the session has cores,
    or where the setting ``declara.deal`` asks for it."""
    spark = df.sparkSession
    if spark.conf.get("declara.deal", None) or df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        return dealt(df)
    return df


def view(spark: SparkSession, sf_dir: str, name: str, deal: str | None = None,
         given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A bridge view as a DataFrame over the parquet tables of ``sf_dir``.

    ``deal`` names the narrow table whose rows are dealt out to all cores first; ``given`` replaces
    tables, for example by streams.
    """
    sql = with_views(f"SELECT * FROM {name}")
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", sql)}
    used.update(given or {})
    if deal is not None:
        used[deal] = dealt(used[deal])
    marked = sql
    for t in used:
        marked = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", marked)
    return spark.sql(marked, **used)
