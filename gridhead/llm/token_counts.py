"""Token counts of whole texts without token ids.

Every distinct pre-token is encoded once; the piece counts meet the documents' pre-token
frequencies in the partition that owns the pre-token, and only sums go back to the documents.

Pre-tokens that are one piece of the tokenizer's own (fixed) vocabulary count as 1 at once.
The others travel packed: a row holds, for one batch of documents and one bucket of pre-tokens,
the pre-tokens with the documents they occur in. A pre-token in every document is therefore one
entry per batch, and no row or task grows with one pre-token's or one document's frequency.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhead.llm.common import partitions, valid

#: Pre-tokens whose piece counts a task keeps at most; it forgets them all beyond that.
KEPT = 500_000
#: Documents of a batch at most (their positions in it are 16-bit).
MAX_BATCH = 60_000
#: Stands for a null id inside the packed rows.
NO_ID = -(2**63)
#: How the byte-level pre-tokenizer cuts text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PACKED = "bucket int, batch long, tokens array<string>, sizes binary, docs binary, freqs binary, ids binary, n_bytes binary, known binary"
_SUMS = "batch long, docs binary, sums binary, ids binary, n_bytes binary"


@functools.cache
def _tokenizer(path: str):
    """The tokenizer, its pre-token pattern, the pattern of its added tokens, and its one-piece pre-tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError(f"{path}: only byte-level tokenizers without normalizer or prefix space")
    added = spec["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path}: added tokens that take in their surroundings")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    pattern = regex.compile(PRE_TOKENS)
    special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
    surfaces = [s for i in range(tok.get_vocab_size()) if (s := tok.decode([i], skip_special_tokens=False)) and "�" not in s and pattern.findall(s) == [s]]
    single = {s for s, n in zip(surfaces, _sizes(tok, surfaces), strict=True) if n == 1}
    return tok, pattern, special, single


def _sizes(tok, pieces: list[str]) -> list[int]:
    return [len(e) for e in tok.encode_batch(pieces, add_special_tokens=False)] if pieces else []


def _packed(batch: int, ids: np.ndarray, texts: list[str | None], n_bytes: np.ndarray, path: str, buckets: int) -> dict:
    _, pattern, special, single = _tokenizer(path)
    code = defaultdict(itertools.count().__next__)
    known = np.zeros(len(texts), np.int64)
    keys = []
    for i, text in enumerate(texts):
        parts = [text or ""]
        if special is not None and special.search(parts[0]):
            known[i] = len(special.findall(parts[0]))
            parts = special.split(parts[0])
        for part in parts:
            if found := pattern.findall(part):
                keys.append((np.fromiter(map(code.__getitem__, found), np.int64, len(found)) << 16) | i)
    pairs, freqs = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    tokens = list(code)
    is_single = np.fromiter((t in single for t in tokens), bool, len(tokens))
    doc, token = pairs & 0xFFFF, pairs >> 16
    one = is_single[token] if len(tokens) else np.zeros(0, bool)
    known += np.bincount(doc[one], freqs[one], len(texts)).astype(np.int64)
    doc, token, freqs = doc[~one], token[~one], freqs[~one]
    bucket = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % buckets for t in tokens), np.int64, len(tokens))
    order = np.lexsort((doc, token, bucket[token])) if len(token) else np.zeros(0, np.int64)
    doc, token, freqs = doc[order], token[order], freqs[order]
    rows = {k: [] for k in ("bucket", "batch", "tokens", "sizes", "docs", "freqs", "ids", "n_bytes", "known")}

    def add(*values) -> None:
        for k, v in zip(rows, values, strict=True):
            rows[k].append(v)

    add(batch % buckets, batch, [], None, None, None, ids.astype(np.int64).tobytes(), n_bytes.astype(np.int64).tobytes(), known.tobytes())
    cuts = np.flatnonzero(np.diff(bucket[token])) + 1 if len(token) else []
    for d, t, f in zip(np.split(doc, cuts), np.split(token, cuts), np.split(freqs, cuts), strict=True):
        if len(t):
            first = np.flatnonzero(np.diff(t, prepend=-1))
            add(int(bucket[t[0]]), batch, [tokens[k] for k in t[first]], np.diff(np.append(first, len(t))).astype(np.uint32).tobytes(), d.astype(np.uint16).tobytes(), f.astype(np.uint32).tobytes(), None, None, None)
    return rows


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, n_bytes, n_tokens` of every row of `docs`: its whole text's UTF-8 bytes and tokens.

    A null text counts as empty (0 bytes, 0 tokens); a very long one is counted whole. Ids may repeat or be null: each
    row is counted for itself. Bytes that are no valid UTF-8 are read as U+FFFD.
    Strings of added tokens inside a text are one token each, as the library's default has it.
    `tokenizer_path` must be readable on the executors. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    buckets = partitions(docs)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = itertools.count(TaskContext.get().partitionId() << 32)
        schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("tokens", pa.list_(pa.string()))] + [(k, pa.binary()) for k in ("sizes", "docs", "freqs", "ids", "n_bytes", "known")])
        for whole in batches:
            for at in range(0, whole.num_rows, MAX_BATCH):
                part = whole.slice(at, MAX_BATCH)
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                rows = _packed(next(serial), part.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), part.column(1).to_pylist(), n_bytes, tokenizer_path, buckets)
                yield pa.RecordBatch.from_pydict(rows, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)[0]
        pieces: dict[str, int] = {}  # of this partition's share of the pre-tokens
        for b in batches:
            if len(pieces) > KEPT:
                pieces.clear()
            new = list(dict.fromkeys(t for t in b.column(2).flatten().to_pylist() if t not in pieces))
            pieces.update(zip(new, _sizes(tok, new), strict=True))
            out = {k: [] for k in ("batch", "docs", "sums", "ids", "n_bytes")}
            for r in b.to_pylist():
                out["batch"].append(r["batch"])
                out["ids"].append(r["ids"])
                out["n_bytes"].append(r["n_bytes"])
                if r["ids"] is not None:
                    out["docs"].append(None)
                    out["sums"].append(r["known"])
                    continue
                doc = np.frombuffer(r["docs"], np.uint16)
                each = np.repeat([pieces[t] for t in r["tokens"]], np.frombuffer(r["sizes"], np.uint32))
                sums = np.bincount(doc, each * np.frombuffer(r["freqs"], np.uint32).astype(np.int64))
                has = np.flatnonzero(sums)
                out["docs"].append(has.astype(np.uint16).tobytes())
                out["sums"].append(sums[has].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("batch", pa.int64())] + [(k, pa.binary()) for k in ("docs", "sums", "ids", "n_bytes")]))

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows.ids.notna()].iloc[0]
        n = np.frombuffer(head.sums, np.int64).copy()
        for r in rows[rows.ids.isna()].itertuples():
            n[np.frombuffer(r.docs, np.uint16)] += np.frombuffer(r.sums, np.uint32)
        return pd.DataFrame({"id": np.frombuffer(head.ids, np.int64), "n_bytes": np.frombuffer(head.n_bytes, np.int64), "n_tokens": n})

    if id_type not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be an integer column")
    packed = docs.select(F.col(id_col).cast("long").alias("id"), valid(text_col).alias("text")).mapInArrow(pack, _PACKED)
    summed = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(count, _SUMS)
    counted = summed.groupBy("batch").applyInPandas(total, "id long, n_bytes long, n_tokens long")
    return counted.select(F.nullif(F.col("id"), F.lit(NO_ID)).cast(id_type).alias(id_col), "n_bytes", "n_tokens")
