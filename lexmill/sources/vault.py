"""Encrypted mappings: scrypt turns a password into a key, AES-GCM seals each document's mapping as JSON.

The password goes into a Python closure alone, never into a plan or SQL literal; keys exist in columns of running tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.ship import ship

#: Fixed values of the envelope: scrypt's cost, block size and parallelism, and the additional data that GCM signs.
COST, BLOCK, PARALLEL, AAD = 1 << 14, 8, 1, "lexmill-vault-v2"


def _with_key(df: DataFrame, password: str, salt: str) -> DataFrame:
    def run(batches):
        import hashlib

        import pyarrow as pa

        known: dict[bytes, bytes] = {}
        for batch in batches:
            salts = batch.column(batch.schema.get_field_index(salt)).to_pylist()
            for s in set(salts):
                if s not in known:
                    known[s] = hashlib.scrypt(password.encode(), salt=s, n=COST, r=BLOCK, p=PARALLEL, maxmem=1 << 26, dklen=32)
            yield batch.append_column("_vault_key", pa.array([known[s] for s in salts], pa.binary()))

    ship(df.sparkSession)
    return df.mapInArrow(run, _schema_with_key(df))


def _schema_with_key(df: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField("_vault_key", T.BinaryType())])


def seal(mapping: DataFrame, password: str, salt: bytes, nonces: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, salt, nonce, ciphertext) of mappings (id, token, surface); ``nonces`` has a stored 12-byte nonce per id.

    Salt and nonces are given, drawn once and written before, so that a task that runs again seals the same.
    """
    entities = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "surface")))))
    plain = mapping.groupBy(id_col).agg(entities.alias("_plain")).join(nonces, id_col).withColumn("salt", F.lit(salt))
    sealed = F.aes_encrypt("_plain", F.col("_vault_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("nonce"), F.lit(AAD))
    return _with_key(plain, password, "salt").select(id_col, "salt", "nonce", F.substring(sealed, 13, 2**31 - 1).alias("ciphertext"))


def unseal(vault: DataFrame, password: str, *, id_col: str = "doc_id") -> DataFrame:
    """(id, token, surface); a wrong password or damaged row gives a row with null token."""
    keyed = _with_key(vault, password, "salt")
    plain = F.try_aes_decrypt(F.concat("nonce", "ciphertext"), F.col("_vault_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(AAD)).cast("string")
    return keyed.select(id_col, F.from_json(plain, "map<string,string>").alias("_m")).select(id_col, F.explode_outer("_m").alias("token", "surface"))
