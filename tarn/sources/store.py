"""Versioned storage of an index, and encrypted snapshots.

A version is a base and layers of changes over it, each a directory of parquet tables written whole
before a numbered pointer names it; readers keep the version they opened. Ids are stored, so a
reload ranks ties as before, and so are the corpus numbers, so a search needn't count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import secrets
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.index import Index
from tarn.plans.session import cut

TABLES = ("docs", "postings", "lengths")
FORMAT = 2
MAX_LAYERS = 8  # layers of changes over the base before an upsert writes a new base
# Cost of the key derivation.
SCRYPT_N, SCRYPT_R, SCRYPT_P = 1 << 14, 8, 1


class StoreError(RuntimeError):
    """Missing, damaged or wrongly keyed data."""


class MissingStore(StoreError):
    """Nothing was ever stored there."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _numbers(spark: SparkSession, path: str, stem: str) -> list[int]:
    """Numbers of the pointers that are there, rising."""
    fs, p, _ = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{stem}-(\d+)\.json", n)))


def _publish(spark: SparkSession, path: str, stem: str, content: dict, after: int) -> None:
    """The next pointer: written beside, then renamed to a name that nobody had. The one before stays,
    so at no moment is there none, and of two writers one fails."""
    name = f"{path}/{stem}-{after + 1:012d}.json"
    fs, p, jvm = _fs(spark, name)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}/.{stem}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(p) or not fs.rename(beside, p):
        fs.delete(beside, False)
        raise StoreError(f"{name} was written by someone else")


def _current(spark: SparkSession, path: str, stem: str) -> tuple[dict, int]:
    """The newest pointer and its number; StoreError where it is damaged, MissingStore where none is."""
    numbers = _numbers(spark, path, stem)
    if not numbers:
        raise MissingStore(f"nothing stored under {path}")
    name = f"{path}/{stem}-{numbers[-1]:012d}.json"
    try:
        content = json.loads("\n".join(r["value"] for r in spark.read.text(name, wholetext=True).collect()))
        if content["format"] != FORMAT:
            raise StoreError(f"{name}: unsupported format")
    except (ValueError, KeyError, TypeError) as e:
        raise StoreError(f"{name} is damaged: {e}") from e
    return content, numbers[-1]


def _write_layer(docs: DataFrame, path: str, gone: DataFrame | None = None, index: Index | None = None) -> tuple[str, int, int]:
    """(name, documents, weighted terms) of a new directory of tables. Postings are sorted by term, so
    that row-group statistics prune a look-up."""
    spark = docs.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/{version}/docs")
    own = index or Index.build(spark.read.schema(docs.schema).parquet(f"{path}/{version}/docs"), next_id=0)
    own.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/{version}/postings")
    own.lengths.write.parquet(f"{path}/{version}/lengths")
    if gone is not None:
        gone.select("doc_id").distinct().write.parquet(f"{path}/{version}/gone")
    row = spark.read.parquet(f"{path}/{version}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    return version, row["n"], row["t"]


def save(index: Index, path: str) -> str:
    """Write a new base under `path` and make it the current version. Gives its name."""
    spark = index.docs.sparkSession
    numbers = _numbers(spark, path, "manifest")
    version, n, total = _write_layer(index.docs, path, index=index)
    _publish(spark, path, "manifest", {"format": FORMAT, "layers": [version], "next_id": index.next_id, "ndocs": n, "total_terms": total}, numbers[-1] if numbers else 0)
    return version


def _read(spark: SparkSession, path: str, manifest: dict) -> Index:
    """Base and layers as one index: rows of a document count from the last layer that replaced it."""
    try:
        layers, next_id = list(manifest["layers"]), int(manifest["next_id"])
        known = int(manifest["ndocs"]), int(manifest["total_terms"])
    except (ValueError, KeyError, TypeError) as e:
        raise StoreError(f"damaged manifest under {path}: {e}") from e

    def of(table: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(f"{path}/{v}/{table}").withColumn("_layer", F.lit(i)) for i, v in enumerate(layers)])

    tables = [of(t) for t in TABLES]
    if len(layers) > 1:
        gone = reduce(DataFrame.union, [spark.read.parquet(f"{path}/{v}/gone").withColumn("_since", F.lit(i)) for i, v in enumerate(layers) if i])
        since = gone.groupBy("doc_id").agg(F.max("_since").alias("_since"))
        tables = [t.join(since, "doc_id", "left").where(F.col("_since").isNull() | (F.col("_layer") >= F.col("_since"))).drop("_since") for t in tables]
    return Index(*(t.drop("_layer") for t in tables), next_id, known)


def load(spark: SparkSession, path: str) -> Index:
    """The current version; MissingStore where there is none, StoreError where it can't be trusted."""
    return _read(spark, path, _current(spark, path, "manifest")[0])


def upsert(spark: SparkSession, path: str, changes: DataFrame, empty: Index | None = None) -> None:
    """Index.upsert() of the stored index as a layer: only the changed documents are written.

    Where nothing is stored yet the changes go over `empty`. Corpus numbers are carried on from the
    changes. Beyond MAX_LAYERS the whole is written as a new base.
    """
    try:
        manifest, number = _current(spark, path, "manifest")
    except MissingStore:
        if empty is None:
            raise
        save(empty, path)
        manifest, number = _current(spark, path, "manifest")
    index = _read(spark, path, manifest)
    fresh, gone, next_id = index.changed(changes)
    gone = cut(gone.distinct())
    lost = index.lengths.join(gone, "doc_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    version, n, total = _write_layer(fresh, path, gone)
    grown = {
        "format": FORMAT, "layers": [*manifest["layers"], version], "next_id": next_id,
        "ndocs": index.known[0] - lost["n"] + n, "total_terms": index.known[1] - lost["t"] + total,
    }
    _publish(spark, path, "manifest", grown, number)
    if len(grown["layers"]) > MAX_LAYERS:
        save(load(spark, path), path)


def _key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=SCRYPT_N, r=SCRYPT_R, p=SCRYPT_P, dklen=32)


def save_encrypted(docs: DataFrame, path: str, password: str) -> None:
    """Rows as JSON, each sealed with AES-256-GCM under a key from the password and a fresh salt; the
    nonce is drawn per row by the engine. No plain text is written. A sealed check word lets a
    wrong password fail at once."""
    spark = docs.sparkSession
    salt = secrets.token_bytes(16)
    key = F.unbase64(F.lit(base64.b64encode(_key(password, salt)).decode()))
    sealed = docs.select(F.aes_encrypt(F.encode(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}), "UTF-8"), key, F.lit("GCM")).alias("sealed"))
    version = f"s-{uuid.uuid4().hex}"
    sealed.write.parquet(f"{path}/{version}")
    check = spark.range(1).select(F.base64(F.aes_encrypt(F.lit("tarn").cast("binary"), key, F.lit("GCM")))).first()[0]
    manifest = {"format": FORMAT, "version": version, "salt": salt.hex(), "check": check, "schema": docs.schema.json()}
    _publish(spark, path, "sealed", manifest, max(_numbers(spark, path, "sealed"), default=0))


def load_encrypted(spark: SparkSession, path: str, password: str) -> DataFrame:
    """The rows; StoreError for a wrong password. A row that was tampered with fails when read."""
    from pyspark.sql.types import StructType

    manifest, _ = _current(spark, path, "sealed")
    try:
        salt, schema = bytes.fromhex(manifest["salt"]), StructType.fromJson(json.loads(manifest["schema"]))
    except (ValueError, KeyError) as e:
        raise StoreError(f"damaged manifest: {e}") from e
    key = F.unbase64(F.lit(base64.b64encode(_key(password, salt)).decode()))
    word = spark.range(1).select(F.try_aes_decrypt(F.unbase64(F.lit(manifest["check"])), key, F.lit("GCM"))).first()[0]
    if word is None or bytes(word) != b"tarn":
        raise StoreError("wrong password or damaged snapshot")
    sealed = spark.read.parquet(f"{path}/{manifest['version']}")
    return sealed.select(F.from_json(F.decode(F.aes_decrypt("sealed", key, F.lit("GCM")), "UTF-8"), schema).alias("r")).select("r.*")
