"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so, so equal passages give
equal chunks wherever they stand. A chunk is named by a 128-bit hash, and a name counts as an
identifier only once all chunks with that name are seen to hold the same bytes; chunks of a
name that two contents share get an ordinal besides. A document's recipe is the ordered list
of its identifiers, and documents are equal exactly when their recipes are. Chunk bytes are
moved once, each distinct one once per map task; after that only recipes move.

Defined cases: a null text counts as empty; very long texts are cut like others; other columns,
whatever their names, are carried along and never read; all empty texts are equal (an empty recipe); a null
id is smaller than any other; of rows that agree in id and text one stays; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_rows, is_empty, materialise, mix64, slices, text_bytes, text_or_empty

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 32768, 12
_GEAR = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32)).astype(np.uint32)


def cut_points(data: np.ndarray, at: np.ndarray, least: int = MIN_CHUNK, most: int = MAX_CHUNK, bits: int = MASK_BITS) -> list[list[int]]:
    """For each row the ends of its chunks, counted from the row's start.

    ``least`` must be 32 or more: the hash at a cut then lies within the row, so a row's cuts
    don't depend on its neighbours.
    """
    rolled = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = rolled.copy()
        more[step:] += rolled[:-step] << np.uint32(step)
        rolled = more
    found = np.flatnonzero((rolled >> np.uint32(32 - bits)) == 0) + 1
    first, ends = np.searchsorted(found, at), []
    for k in range(len(at) - 1):
        size, cuts, last = int(at[k + 1] - at[k]), [], 0
        for x in (found[first[k] : first[k + 1]] - at[k]).tolist() if size > least else ():
            while x - last > most:
                last += most
                cuts.append(last)
            if x - last >= least and x < size:
                last = x
                cuts.append(last)
        while size - last > most:
            last += most
            cuts.append(last)
        ends.append(cuts + [size] if size else [])
    return ends


def _chunked(batches, with_bytes: bool):
    for whole in batches:
        for batch in slices(whole, "_text", 1 << 22):
            data, at = text_bytes(batch.column("_text"))
            raw, ends = memoryview(np.ascontiguousarray(data)), cut_points(data, at)
            if with_bytes:
                seen = {}
                for k, cuts in enumerate(ends):
                    low = int(at[k])
                    for x in cuts:
                        part = raw[low : int(at[k]) + x]
                        seen[bytes(part)] = xxhash.xxh3_128_digest(part)
                        low = int(at[k]) + x
                yield pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.binary()), pa.array(list(seen), pa.binary())], names=["name", "bytes"])
            else:
                recipes, hashes = [], []
                for k, cuts in enumerate(ends):
                    low, recipe = int(at[k]), []
                    for x in cuts:
                        recipe.append(xxhash.xxh3_128_digest(raw[low : int(at[k]) + x]))
                        low = int(at[k]) + x
                    recipes.append(recipe)
                    hashes.append(hashlib.sha256(raw[int(at[k]) : int(at[k + 1])]).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(recipes, pa.list_(pa.binary())), pa.array(hashes, pa.string())], names=["_id", "recipe", "sha256"])


def chunk_bytes(batches):
    """Distinct chunks of each few MB of text, with their names."""
    return _chunked(batches, True)


def chunk_names(batches):
    """Recipe of each row by names, and the SHA-256 of its text."""
    return _chunked(batches, False)


def _spell_out(recipes: DataFrame, texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes in which a name that several contents share is followed by the content's ordinal.

    ``shared``: name, bytes, ordinal of those contents only. Any row whose recipe uses such a
    name is matched to its own text again by SHA-256, and its chunks to the contents by bytes.
    """
    names = shared.select("name").distinct()
    hit = recipes.select("_key", "sha256", F.posexplode("recipe").alias("pos", "name")).join(names, "name", "left_semi")
    wanted = hit.select(F.col("sha256").alias("_sha")).distinct()
    body = texts.select(F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"), F.col("_text").cast("binary").alias("_body"))
    body = body.join(wanted, "_sha", "left_semi").dropDuplicates(["_sha"])
    cut = body.mapInArrow(_positions, "_sha string, pos int, bytes binary")
    named = hit.join(cut.withColumnRenamed("pos", "_p"), (F.col("sha256") == F.col("_sha")) & (F.col("pos") == F.col("_p")))
    named = named.join(shared, ["name", "bytes"]).groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "ordinal"))).alias("ordinals"))
    full = recipes.join(named, "_key", "left")
    spelt = F.transform("recipe", lambda x, i: F.concat(x, F.coalesce(F.encode(F.element_at("ordinals", i).cast("string"), "utf-8"), F.lit(b""))))
    return full.withColumn("recipe", spelt).drop("ordinals")


def _positions(batches):
    for batch in batches:
        keys, where, parts = [], [], []
        for key, body in zip(batch.column("_sha").to_pylist(), batch.column("_body").to_pylist(), strict=True):
            data, low = np.frombuffer(body, np.uint8), 0
            for n, x in enumerate(cut_points(data, np.array([0, len(data)]))[0]):
                keys.append(key)
                where.append(n)
                parts.append(body[low:x])
                low = x
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(where, pa.int32()), pa.array(parts, pa.binary())], names=["_sha", "pos", "bytes"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest id stays.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    recipes = texts.mapInArrow(chunk_names, f"_id {id_type}, recipe array<binary>, sha256 string")
    recipes = materialise(recipes.withColumn("_key", F.monotonically_increasing_id()), "recipes")
    distinct = texts.select("_text").mapInArrow(chunk_bytes, "name binary, bytes binary").groupBy("name", "bytes").agg(F.lit(1).alias("one"))
    contents = distinct.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    clashes = materialise(contents, "clashes")
    if not is_empty(clashes):
        from pyspark.sql import Window

        ordinal = F.row_number().over(Window.partitionBy("name").orderBy("bytes"))
        shared = distinct.join(clashes, "name", "left_semi").select("name", "bytes", ordinal.alias("ordinal"))
        recipes = materialise(_spell_out(recipes, texts, shared), "spelt")
    groups = recipes.groupBy("recipe").agg(F.max(F.struct("_id", "_key")).alias("last"), F.count("*").alias("group_size"))
    # a copy joins its group by the ordered list itself; most rows are alone and need no partner
    # written out, so that both sides of the join are dealt anew and a hot recipe can be split
    many = materialise(groups.filter("group_size > 1").select("recipe", "last", "group_size"), "groups")
    both = recipes.join(many, "recipe", "left")
    alone = F.col("last").isNull()
    return both.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("last._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("last._key") == F.col("_key"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    copies = exact_groups(docs, id_col, text_col).filter("group_size > 1").groupBy(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_digest"))
    gone = copies.agg(F.count("*").alias("_copies"), F.max("kept").cast("int").alias("_stay")).filter("_copies > _stay")
    return drop_rows(docs, gone, id_col, text_col)
