"""Operator 3, token ids in a content-addressed store."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, MEAN, LEAST, MOST, FAN = 16, 256, 64, 1024, 4096

_encoders: dict = {}
_GEAR = np.random.default_rng(31).integers(0, 2**63, 1 << 17).astype(np.uint64)


def encoder(path: str):
    """The vocabulary at path, read once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_ids(path: str):
    """A function from a text to its ids as an array; nothing in a text is
    special."""
    encode = encoder(path).encode_ordinary
    return lambda text: np.array(encode(text), np.uint32)


def cut_points(ids: np.ndarray, window: int = WINDOW, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of an id stream. A rolling hash over the last window
    ids proposes a cut where its top bits are zero, so that equal passages are
    cut alike wherever they stand; chunks have least to most ids, the last of
    a stream may be shorter."""
    n = len(ids)
    if n <= least:
        return np.array([n]) if n else np.zeros(0, np.int64)
    gear = _GEAR[ids & 0x1FFFF]
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h[k:] += gear[: n - k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    proposed = np.flatnonzero(h < np.uint64((1 << 64) // mean)) + 1
    ends, last, k = [], 0, 0
    while n - last > least:
        k = int(np.searchsorted(proposed, last + least, "left"))
        end = int(proposed[k]) if k < len(proposed) else n
        end = min(end, last + most, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return np.array(ends)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over SHA-256 digests; leaves and inner nodes are told apart by a
    first byte, an odd node moves up as it is. No leaves: the digest of it."""
    if not leaves:
        return hashlib.sha256(b"\x02").digest()
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(level) // 2 * 2 :]
    return level[0]


KIND = "kind string, doc_id long, digest binary, ids binary, chunks binary, n_tokens long"


def _chunked(vocabulary: str):
    """Of each text a recipe row, and of each of its chunks, new in the batch,
    a chunk row."""

    def run(batches):
        encode = token_ids(vocabulary)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            seen: set[bytes] = set()
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                narrow = not len(ids) or int(ids.max()) < 65536
                packed = ids.astype("<u2" if narrow else "<u4").tobytes()
                recipe, last = [], 0
                for end in cut_points(ids).tolist():
                    body = packed[last * 2 : end * 2] if narrow else b"\x04" + packed[last * 4 : end * 4]
                    digest = hashlib.sha256(body).digest()
                    recipe.append(digest)
                    if digest not in seen:
                        seen.add(digest)
                        size += len(body)
                        for c, x in zip(rows, ("chunk", None, digest, body, None, end - last)):
                            c.append(x)
                    last = end
                for c, x in zip(rows, ("recipe", doc_id, merkle_root(recipe), None, b"".join(recipe), len(ids))):
                    c.append(x)
                if size > 1 << 22:
                    yield _batch(rows)
                    rows, seen, size = [[] for _ in range(6)], set(), 0
            yield _batch(rows)

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["kind", "doc_id", "digest", "ids", "chunks", "n_tokens"])


def token_store(docs: DataFrame, vocabulary: str = VOCABULARY, fan: int = FAN) -> DataFrame:
    """The store as one table (kind, doc_id, digest, ids, chunks, n_tokens):

    chunk: digest is the SHA-256 of ids, the token ids as 16-bit little-endian
    numbers (a vocabulary beyond 65536 has 32-bit ones after a byte 4). Each
    distinct chunk is stored once.
    recipe: for each document row its chunk digests in order, 32 bytes each, and
    in digest their Merkle root.
    manifest1, manifest2, ...: doc_id is a bucket of about `fan` recipe roots (or
    of manifests of the level below); chunks has those roots, sorted, digest
    their Merkle root. The last level has one row, the root of the whole store;
    a store without recipes has no manifest.

    Recipes fall into buckets by root and doc_id, so that equal documents don't
    meet in one. restore() rebuilds the id streams and checks them against the
    recipes. A null text has no recipe; an empty one has one without chunks; a
    long one has as many chunks as it takes. Rows that repeat a doc_id, or are
    wholly equal, have a recipe each; a null doc_id is kept as null. An empty
    table gives an empty store. Other columns aren't read, so their names don't
    matter; roots that tie stand beside each other in a manifest.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    parts = written(base.mapInArrow(_chunked(vocabulary), KIND), "store")
    chunks = parts.where("kind = 'chunk'").groupBy("digest").agg(F.first("ids").alias("ids"), F.first("n_tokens").alias("n_tokens"))
    chunks = chunks.select(F.lit("chunk").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "digest", "ids", F.lit(None).cast("binary").alias("chunks"), "n_tokens")
    recipes = parts.where("kind = 'recipe'")
    out = chunks.unionByName(recipes)
    leaves, level = recipes.select(F.xxhash64("digest", "doc_id").alias("at"), "digest", "n_tokens"), 1
    n = leaves.count()
    while True:
        buckets = max(1, -(-n // fan))
        nodes = written(_manifest(leaves, buckets, level), "manifest")
        out = out.unionByName(nodes)
        if buckets == 1:
            return out
        n, level = nodes.count(), level + 1
        leaves = nodes.select(F.xxhash64("digest", "doc_id").alias("at"), "digest", "n_tokens")


def _manifest(leaves: DataFrame, buckets: int, level: int) -> DataFrame:
    root = F.udf(lambda x: merkle_root([x[k : k + 32] for k in range(0, len(x), 32)]), "binary", useArrow=True)
    grouped = leaves.groupBy(F.pmod("at", F.lit(buckets)).alias("bucket")).agg(F.array_sort(F.collect_list("digest")).alias("roots"), F.sum("n_tokens").alias("n_tokens"))
    listed = grouped.select(F.lit(f"manifest{level}").alias("kind"), "bucket", F.unhex(F.array_join(F.transform("roots", F.hex), "")).alias("chunks"), "n_tokens")
    return listed.select("kind", F.col("bucket").cast("long").alias("doc_id"), root("chunks").alias("digest"), F.lit(None).cast("binary").alias("ids"), "chunks", "n_tokens")


def restore(store: DataFrame) -> DataFrame:
    """(doc_id, root, ids, n_tokens, intact): id streams from recipes and
    chunks; intact where every digest and the Merkle root agree."""
    recipes = store.where("kind = 'recipe'").select("doc_id", F.col("digest").alias("root"), "chunks", "n_tokens", F.expr("uuid()").alias("row"))
    at = recipes.select("*", F.explode_outer(F.expr("if(length(chunks) > 0, transform(sequence(0, int(length(chunks) / 32) - 1), k -> named_struct('pos', k, 'digest', substring(chunks, k * 32 + 1, 32))), array())")).alias("c"))
    bodies = store.where("kind = 'chunk'").select(F.col("digest").alias("d"), F.col("ids").alias("body"))
    found = written(at, "restore").join(bodies, F.col("c.digest") == F.col("d"), "left")
    rows = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.first("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c.pos", "c.digest", "body")))).alias("parts"),
    )

    def check(batches):
        for pdf in batches:
            out = []
            for doc_id, root, n, parts in zip(pdf["doc_id"], pdf["root"], pdf["n_tokens"], pdf["parts"]):
                bodies = [p["body"] for p in parts]
                ok = all(b is not None and hashlib.sha256(b).digest() == p["digest"] for b, p in zip(bodies, parts))
                ok = ok and merkle_root([p["digest"] for p in parts]) == root
                ids = [i for b in bodies if b is not None for i in (np.frombuffer(b[1:], "<u4") if len(b) % 2 else np.frombuffer(b, "<u2")).tolist()]
                out.append((doc_id, root, ids, len(ids), bool(ok and len(ids) == n)))
            import pandas as pd

            yield pd.DataFrame(out, columns=["doc_id", "root", "ids", "n_tokens", "intact"])

    return rows.mapInPandas(check, "doc_id long, root binary, ids array<long>, n_tokens long, intact boolean")
