"""The mapping file: its JSON, and the password envelope (scrypt, AES-256-GCM)."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.fixed import FORMAT_VERSION, SCRYPT
from cloakwork.operators.mapping import ranked

ITEM = "id long, category string, original string, alias string, occurrences long, enabled boolean, source string, confidence double"


class WrongPassword(ValueError):
    """The password is wrong, or the envelope was changed or is malformed."""


def sha256_of(content: Column) -> Column:
    return F.sha2(content, 256)


#: The most items of a mapping file that is one row; more go into a file of lines, or into several sealed files.
MOST_ITEMS = 1_000_000
#: The most items, and files of the manifest, of each of several files; the type of a manifest.
PART_ITEMS, _MANIFEST = 100_000, "array<struct<file:string,sha256:string>>"


def _head(manifest: list[tuple[str, str]] | Column, batch_id: str | None, created_at: str | None) -> list[Column]:
    if not isinstance(manifest, Column):
        listed = json.dumps([{"file": f, "sha256": h} for f, h in manifest], ensure_ascii=False)  # one literal, however many files
        manifest = F.from_json(F.lit(listed), _MANIFEST)
    made = created_at or datetime.now(timezone.utc).isoformat()
    return [F.lit(FORMAT_VERSION).alias("version"), F.lit(batch_id or str(uuid.uuid4())).alias("batch_id"), F.lit(made).alias("created_at"), manifest.alias("doc_manifest")]


def _item() -> Column:
    return F.struct("id", "category", "original", "alias", "occurrences", "enabled", "source", "confidence")


def mapping_json(mapping: DataFrame, manifest: list[tuple[str, str]] = (), batch_id: str | None = None, created_at: str | None = None, most: int = MOST_ITEMS) -> DataFrame:
    """One row, one column `json`: the mapping file. Items by id; pending and files are not in the format.

    The format is one JSON text, so the items must fit in one row: more than `most` are an error, and mapping_lines is
    the way for these. An empty mapping has no items.
    """
    found = mapping.limit(most + 1).count()
    if found > most:
        raise ValueError(f"more than {most} items: write mapping_lines instead")
    grouped = mapping.agg(F.sort_array(F.collect_list(_item())).alias("mappings"))
    return grouped.select(F.to_json(F.struct(*_head(manifest, batch_id, created_at), "mappings")).alias("json"))


def mapping_lines(mapping: DataFrame, manifest: list[tuple[str, str]] = (), batch_id: str | None = None, created_at: str | None = None) -> DataFrame:
    """(id, json): the mapping of any size as JSON lines, the head with id 0 and then one line an item; no row holds more."""
    head = mapping.sparkSession.range(1).select(F.lit(0).cast("long").alias("id"), F.to_json(F.struct(*_head(manifest, batch_id, created_at))).alias("json"))
    return head.unionByName(mapping.select(F.col("id").cast("long").alias("id"), F.to_json(_item()).alias("json")))


def items_of_lines(lines: DataFrame) -> DataFrame:
    """The items of mapping_lines; without a head, or with one of another version, it is an error."""
    head = lines.filter("id = 0").select(F.get_json_object("json", "$.version").alias("v")).first()
    if head is None or head.v != FORMAT_VERSION:
        raise ValueError(f"unsupported mapping version {head.v if head else None}")
    return lines.filter("id > 0").select(F.from_json("json", ITEM).alias("m")).select("m.*")


def mapping_parts(mapping: DataFrame, sources: DataFrame, batch_id: str | None = None, created_at: str | None = None, most: int = PART_ITEMS) -> DataFrame:
    """(part, json): the mapping file, or as many as it takes, of at most `most` items and files each, by id and doc_seq.

    sources: name, sha, doc_seq of each file of the manifest. Each json is a mapping file of the same batch; where there
    are several, it also says which `part` of how many `parts` it is. Nothing of it comes to the driver but two counts.
    """
    spark = mapping.sparkSession
    n = max(1, -(-mapping.count() // most), -(-sources.count() // most))
    which = F.floor(F.col("_rank") / most)
    items = ranked(mapping, ["id", "original"], name="_rank").groupBy(which.alias("_of")).agg(F.sort_array(F.collect_list(_item())).alias("mappings"))
    listed = F.sort_array(F.collect_list(F.struct("_rank", F.struct(F.col("name").alias("file"), F.col("sha").alias("sha256")).alias("f"))))
    docs = ranked(sources, ["doc_seq", "name"], name="_rank").groupBy(which.alias("_in")).agg(F.transform(listed, lambda x: x["f"]).alias("docs"))
    rows = spark.range(n).select(F.col("id").alias("part")).join(items, F.col("part") == F.col("_of"), "left").join(docs, F.col("part") == F.col("_in"), "left")
    place = [F.col("part"), F.lit(n).alias("parts")] if n > 1 else []
    mappings = F.coalesce("mappings", F.array().cast(items.schema["mappings"].dataType)).alias("mappings")
    head = _head(F.coalesce("docs", F.array().cast(_MANIFEST)), batch_id, created_at)
    return rows.select("part", F.to_json(F.struct(*head, *place, mappings)).alias("json"))


def part_name(name: str, part: int) -> str:
    """The file of a part: the name itself for the first, then name_1, name_2, ... before its extension."""
    stem, dot, kind = name.rpartition(".")
    return name if not part else f"{stem}_{part}.{kind}" if dot else f"{name}_{part}"


def seal_parts(parts: DataFrame, name: str, password: str) -> DataFrame:
    """(target, content): the envelope of each row of mapping_parts, made on the executors under one key; nonces differ."""
    if not password:
        raise ValueError("the password is empty")
    salt, begin = os.urandom(16), os.urandom(8)
    nonce = F.concat(F.lit(begin), F.unhex(F.lpad(F.hex("part"), 8, "0")))
    data = F.substring(F.aes_encrypt(F.col("json").cast("binary"), F.lit(derive_key(password, salt)), F.lit("GCM"), F.lit("DEFAULT"), nonce), 13, 2**31 - 1)
    b64 = lambda c: F.translate(F.base64(c), "\r\n", "")  # lines of 76 where a session chunks them
    whole = F.struct(F.lit("AES-256-GCM").alias("enc"), F.lit("scrypt").alias("kdf"), F.lit(base64.b64encode(salt).decode()).alias("salt"), b64(nonce).alias("nonce"), b64(data).alias("data"))
    before, _, after = part_name(name, 1).rpartition("1")
    target = F.when(F.col("part") == 0, F.lit(name)).otherwise(F.concat(F.lit(before), F.col("part").cast("string"), F.lit(after)))
    return parts.select(target.alias("target"), F.to_json(whole).cast("binary").alias("content"))


def items_of_files(spark: SparkSession, folder: str, name: str, password: str) -> DataFrame:
    """The items of a sealed mapping file and of the other parts that it names, opened on the executors.

    A wrong password, a changed or missing part and one of another batch are errors.
    """
    long = {"maxStringLen": str(2**31 - 1)}
    at = lambda i: f"{folder.rstrip('/')}/{part_name(name, i)}"
    salt = spark.read.text(at(0), wholetext=True).select(F.from_json("value", "salt string", long)["salt"].alias("s")).first().s
    try:
        key = derive_key(password, base64.b64decode(salt, validate=True))
    except (ValueError, TypeError) as e:
        raise WrongPassword("malformed envelope") from e

    def opened(paths: list[str]) -> DataFrame:
        e, raw = F.col("e"), lambda c: F.try_to_binary(c, F.lit("base64"))
        rows = spark.read.text(paths, wholetext=True).select(F.from_json("value", "nonce string, data string", long).alias("e"))
        text = F.try_aes_decrypt(F.concat(raw(e["nonce"]), raw(e["data"])), F.lit(key), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
        return rows.select(F.from_json(text, f"version string, batch_id string, part int, parts int, mappings array<struct<{ITEM}>>", long).alias("m")).select("m.*")

    head = opened([at(0)]).select("version", "batch_id", F.coalesce("parts", F.lit(1)).alias("n"), F.col("mappings").isNotNull().alias("whole")).first()
    if head.version is None:
        raise WrongPassword("wrong password, or the file was changed")
    if head.version != FORMAT_VERSION or not head.whole:
        raise ValueError(f"unsupported mapping version {head.version}" if head.whole else "malformed mapping file")
    rows = opened([at(i) for i in range(head.n)])
    good = rows.filter((F.col("version") == FORMAT_VERSION) & F.col("batch_id").eqNullSafe(F.lit(head.batch_id)) & F.col("mappings").isNotNull())
    if good.select(F.coalesce("part", F.lit(0)).alias("p")).filter(F.col("p") < head.n).distinct().count() != head.n:
        raise WrongPassword("a part of the mapping was changed, or is of another batch")
    return rows.selectExpr("inline(mappings)")


def load_mapping(text: str) -> dict:
    data = json.loads(text)
    if data.get("version") != FORMAT_VERSION:
        raise ValueError(f"unsupported mapping version {data.get('version')}")
    if "mappings" not in data or "batch_id" not in data:
        raise ValueError("malformed mapping file")
    return data


def items_of(spark: SparkSession, mapping: dict) -> DataFrame:
    return spark.createDataFrame([json.dumps(m, ensure_ascii=False) for m in mapping["mappings"]], "string").select(F.from_json("value", ITEM).alias("m")).select("m.*")


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, **SCRYPT, maxmem=64 << 20)


def encrypt(text: Column, key: bytes, nonce: bytes) -> Column:
    """nonce, ciphertext and tag in one."""
    return F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce))


def seal(spark: SparkSession, text: str, password: str) -> dict:
    """The envelope of a mapping file."""
    if not password:
        raise ValueError("the password is empty")
    salt, nonce = os.urandom(16), os.urandom(12)
    row = spark.createDataFrame([(text,)], "t string").select(encrypt(F.col("t"), derive_key(password, salt), nonce).alias("c")).first()
    b64 = lambda b: base64.b64encode(bytes(b)).decode()
    return {"enc": "AES-256-GCM", "kdf": "scrypt", "salt": b64(salt), "nonce": b64(nonce), "data": b64(row.c[12:])}


def envelope_text(envelope: dict) -> str:
    """The envelope as the text of a file."""
    return json.dumps(envelope, ensure_ascii=False, indent=2)


def unseal(spark: SparkSession, envelope: dict, password: str) -> str:
    try:
        salt, nonce, data = (base64.b64decode(envelope[k], validate=True) for k in ("salt", "nonce", "data"))
    except (KeyError, ValueError, TypeError) as e:
        raise WrongPassword("malformed envelope") from e
    sealed = spark.createDataFrame([(bytearray(nonce + data),)], "c binary")
    row = sealed.select(F.try_aes_decrypt("c", F.lit(derive_key(password, salt)), F.lit("GCM"), F.lit("DEFAULT")).cast("string").alias("t")).first()
    if row.t is None:
        raise WrongPassword("wrong password, or the file was changed")
    return row.t


def password_ok(password: Column, again: Column) -> Column:
    """At least six characters, and both entries equal."""
    return (F.length(password) >= 6) & (password == again)
