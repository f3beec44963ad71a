"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius. Two fingerprints within the
radius share at least one variant, so the variants are shuffled and those that collide are linked.
A variant has no more than 65 fingerprints within one bit, so a bucket is small whatever the data;
each member is linked to the least of its bucket, and the links are deduplicated and verified
before connected components are formed.

Copies meet as one fingerprint before anything is emitted, and only distinct fingerprints are
linked.

Defined results
---------------
* A null or empty text, or one of white space alone, has fingerprint zero and is linked like others.
* Fewer words than a shingle: the whole sequence is the one shingle.
* Every row gets its component, the smallest identifier reachable; repeated rows each get theirs.
  Rows with a null identifier take part in links but never name a component unless all are null.
* An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, map_batches, settle, texts, without
from .components import components

#: Shingles that are turned into bits at once; bounds memory for very long texts.
BLOCK = 1 << 17
#: Rows of one fingerprint beyond which they are spread, and fingerprints that can be so common at most.
HOT_ROWS, MOST_HOT = 1000, 10_000


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text over word shingles (repeats included)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), BLOCK):
        block = hashes[k : k + BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp, hash): the fingerprint as a signed 64-bit number, and a hash of the text as it stands."""

    def make():
        def step(batch):
            found = np.array([fingerprint(t, width) for t in texts(batch)], dtype=np.uint64)
            return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64), "hash": batch.column("hash")}

        return step

    return map_batches(id_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text")), "doc_id long, fp long, hash long", make)


def ball(fp: str, half: int) -> list:
    """Columns of all variants of a fingerprint within ``half`` bits (0 or 1)."""
    if half not in (0, 1):
        raise ValueError("variants are emitted within 0 or 1 bits: radius 0 to 3")
    own = [F.col(fp)]
    return own + ([F.col(fp).bitwiseXOR(F.lit(v)) for v in ((1 << k) - (1 << 64 if k == 63 else 0) for k in range(64))] if half else [])


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (u, v) that connect all distinct fingerprints within ``radius`` bits (0 to 2).

    Members of a bucket are within twice the half radius of each other, so linking each to the least
    of the bucket loses no connection.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius is 0, 1 or 2")
    half = (radius + 1) // 2
    variants = fps.select("fp", F.explode(F.array(*ball("fp", half))).alias("variant"))
    bucket = Window.partitionBy("variant")
    if radius == 1:  # members of a bucket can be two bits apart: pair each with the variant itself
        met = variants.join(fps.select(F.col("fp").alias("variant")), "variant", "left_semi").select(F.col("fp").alias("u"), F.col("variant").alias("v"))
    else:
        met = variants.select(F.col("fp").alias("u"), F.min("fp").over(bucket).alias("v"))
    return met.where("u <> v").distinct().where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, hash, component_id) for each row."""
    prints = settle(fingerprints(docs, id_col, text_col, width))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    groups = components(links(nodes.select("fp"), radius))
    named = nodes.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id", "n")
    # The rows of a hot fingerprint are spread over salts, of about so many rows each.
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    salts = F.ceil(F.col("n") / F.lit(max(HOT_ROWS, -(-total // MOST_HOT)))).cast("int")
    hot = nodes.where(salts > 1).select("fp", salts.alias("salts"))  # at most MOST_HOT rows
    salted = prints.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int"))
    by_fp = by_fp.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return salted.join(by_fp, ["fp", "salt"]).select("doc_id", "fp", "hash", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    found = simhash_groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of the document that names its group, with all their columns.

    Rows that repeat an identifier are judged by their own texts; those that repeat both stay or go together.
    """
    found = simhash_groups(docs, id_col, text_col, width, radius)
    bad = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "hash")
    return without(docs, bad, {"doc_id": docs[id_col].cast("long"), "hash": F.xxhash64(docs[text_col].cast("string"))})
