"""Landing source files, batches of addresses, and an optional database."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.sources import schemas

def land(url: str, folder: str, force: bool = False, timeout: float = 60.0) -> tuple[str, bool]:
    """(path, whether it is new) of a file under ``folder``.

    The server is asked with the tag of the last answer, and if that still holds the
    file stays; ``force`` asks without it. A file is replaced only once it is whole.
    """
    path = Path(folder, url.rstrip("/").rpartition("/")[2])
    tag = path.with_name(path.name + ".etag")
    request = urllib.request.Request(url)
    if path.exists() and tag.exists() and not force:
        request.add_header("If-None-Match", tag.read_text())
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            body, etag = answer.read(), answer.headers.get("ETag")
    except urllib.error.HTTPError as e:
        if e.code == 304:
            return str(path), False
        raise
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_bytes(body)
    os.replace(part, path)
    if etag:
        tag.write_text(etag)
    return str(path), True


def land_all(base: str, names: tuple[str, ...], folder: str, force: bool = False) -> dict[str, bool]:
    """Each of the files below ``base`` in turn; an error ends it."""
    return {name: land(f"{base.rstrip('/')}/{name}", folder, force)[1] for name in names}


def read_addresses(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A batch (addr_id, raw_input, as_of_date, use_geocoder) from CSV with a header, JSON lines or Parquet; a bad date is an error."""
    if kind == "parquet":
        return spark.read.schema(schemas.ADDRESSES).parquet(path)
    text = "addr_id bigint, raw_input string, as_of_date string, use_geocoder boolean"
    rows = spark.read.schema(text).csv(path, header=True, mode="FAILFAST") if kind == "csv" else spark.read.schema(text).json(path, mode="FAILFAST")
    return rows.withColumn("as_of_date", F.to_date("as_of_date", "yyyy-MM-dd")).withColumn("use_geocoder", F.coalesce("use_geocoder", F.lit(True)))


def flat(results: DataFrame) -> DataFrame:
    """Results without nested columns: the best candidate's names by level, its score, and all candidates as JSON."""
    levels = [F.col(f"top.{level}.{field}").alias(f"{level}_{field}") for level in ("province", "district", "ward") for field in ("gso_code", "full_name", "score")]
    return results.withColumn("score", F.col("top.score")).withColumn("candidates_json", F.to_json("candidates")).select("*", *levels).drop("top", "candidates")


def write_results(results: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet or JSON with nested candidates, or CSV of the flat form."""
    if kind == "csv":
        flat(results).write.csv(path, header=True)
    else:
        results.write.format(kind).save(path)


def database_options(environ: dict[str, str] | None = None) -> dict[str, str]:
    """Options for Spark's JDBC source: DATABASE_URL if it is set, else one built of POSTGRES_HOST, _PORT, _DB, with user and password."""
    env = os.environ if environ is None else environ
    url = env.get("DATABASE_URL") or f"jdbc:postgresql://{env.get('POSTGRES_HOST', 'localhost')}:{env.get('POSTGRES_PORT', '5432')}/{env.get('POSTGRES_DB', 'addresses')}"
    url = url if url.startswith("jdbc:") else f"jdbc:{url}"
    return {"url": url, "user": env.get("POSTGRES_USER", "postgres"), "password": env.get("POSTGRES_PASSWORD", "")}


def read_table(spark: SparkSession, name: str, environ: dict[str, str] | None = None) -> DataFrame:
    """A table of the database; its driver must be on the class path."""
    return spark.read.format("jdbc").options(dbtable=name, **database_options(environ)).load()


def log_corrections(corrections: DataFrame, path: str) -> None:
    """Append reviewers' corrections (raw_input, predicted and corrected address as structs or JSON, confidence, reviewer, created_at)."""
    as_text = lambda c: F.to_json(c) if dict(corrections.dtypes)[c].startswith("struct") else F.col(c)
    rows = corrections.withColumns({c: as_text(c) for c in ("predicted_address", "corrected_address")})
    names = [f.split()[0] for f in schemas.CORRECTION_LOGS.split(", ")]
    rows.select(*names).write.mode("append").parquet(path)


def report(units: DataFrame) -> DataFrame:
    """(what, kind, n): units by type, open units by type, orphans."""
    by = lambda df, what: df.groupBy(F.col("unit_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    lost = units.where((F.col("unit_type") != "province") & F.col("parent_id").isNull())
    return by(units, "all").unionByName(by(units.where(F.col("valid_to").isNull()), "open")).unionByName(by(lost, "orphans")).orderBy("what", "kind")


def report_lines(units: DataFrame) -> list[str]:
    """The report as lines of text; it has a few rows."""
    return [f"{r['what']:>8}  {r['kind']:<10} {r['n']:>7,}" for r in report(units).collect()]


