"""What has been verified of fact files, by the state of the files.

Files do not say whether every fact has its store and its product.  That is
verified by one pass over the keys for each state of the files (their paths,
lengths and modification times) and kept; later queries over the same files
trust it after a look at the file list alone.  Files that change in any way are
another state and are verified again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.files import HadoopFiles
from ledgerlark.sources.star import SalesStar

_PROOF = "facts long, orphans long, store_bytes long, product_bytes long, first date, last date"


@dataclass(frozen=True)
class Proof:
    """Facts, those without a store or product, the dimensions' bytes, and the facts' dates."""

    facts: int
    orphans: int
    store_bytes: int
    product_bytes: int
    first: date | None
    last: date | None


#: Proofs that this process has made or read, by application and state.
_KNOWN: dict[tuple[str, str], Proof] = {}


def state_of(spark: SparkSession, paths: list[str]) -> str:
    """A name for the state of all files under ``paths``."""
    files = (HadoopFiles(spark, path).stamps(path) for path in paths)
    return hashlib.sha256(repr([sorted(stamps) for stamps in files]).encode()).hexdigest()


def _verified(star: SalesStar) -> Proof:
    from ledgerlark.operators.filters import bytes_of, star_side

    star.measured.update(store_id=bytes_of(star.stores), product_id=bytes_of(star.products))
    whole = F.lit(True)
    stores = star.stores.select("store_id", whole.alias("has_store")).distinct()
    products = star.products.select("product_id", whole.alias("has_product")).distinct()
    row = (
        star.sales.select("store_id", "product_id", "date")
        .join(star_side(star, "store_id", stores), "store_id", "left")
        .join(star_side(star, "product_id", products), "product_id", "left")
        .agg(
            F.count("*").alias("facts"),
            F.count_if(F.col("has_store").isNull() | F.col("has_product").isNull()).alias("orphans"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
        )
        .first()
    )
    return Proof(
        row.facts, row.orphans, star.measured["store_id"], star.measured["product_id"], row.first, row.last
    )


def _kept(spark: SparkSession, folder: str) -> Proof | None:
    try:
        row = spark.read.schema(_PROOF).parquet(folder).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row is None else Proof(**row.asDict())


def _home(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def proven(star: SalesStar, paths: list[str]) -> SalesStar:
    """``star`` with what is known of the files that it is made from.

    Proofs are kept in the folder that ``spark.checkpoint.dir`` names, and
    without one as long as this process lives.
    """
    spark = star.sales.sparkSession
    key = (spark.sparkContext.applicationId, state_of(spark, paths))
    base = _home(spark)
    folder = None if base is None else f"{base.rstrip('/')}/proofs/{key[1]}"
    found = _KNOWN.get(key) or (folder and _kept(spark, folder))
    if not found:
        found = _verified(star)
        if folder:
            values = [tuple(getattr(found, name.split()[0]) for name in _PROOF.split(", "))]
            spark.createDataFrame(values, _PROOF).coalesce(1).write.mode("ignore").parquet(folder)
    _KNOWN[key] = found
    measured = {
        "store_id": found.store_bytes,
        "product_id": found.product_bytes,
        "dates": None if found.first is None else (found.first, found.last),
    }
    return replace(star, keys_verified=found.orphans == 0, measured=measured)
