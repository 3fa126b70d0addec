"""Best-two-fit packing of token sequences.

Texts are tokenised where they are read; only longer documents are cut. Pieces of full length fill a sequence each.
The others are packed by length: their histogram (one number for each possible length) goes to the driver, which
fills bins greedily, largest fitting length first, and then replaces a bin's smallest document by two unpacked ones
that fill its gap more tightly. A bin pattern is used as often as its lengths allow, so the work depends on the
capacity and not on the rows. Pieces find their place by their rank among pieces of their length.
Null and empty texts are one piece holding the end id; repeated rows are packed each; an empty table packs to nothing.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
WORD = re.compile(r"[^ \t\r\n]+")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
# How the tokenizer of TOKENIZER splits a word, and letters whose case and composition are the same everywhere.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u017f]*")


def plain_split() -> re.Pattern:
    """SPLIT on lower-case text of PLAIN characters, with their classes spelt out."""
    kind = lambda k: "".join(chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x180)] if unicodedata.category(chr(c))[0] == k)
    letters, numbers = (re.escape(kind(k)) for k in "LN")
    return re.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\t\n\r {letters}{numbers}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers))


class Encoder:
    """Texts to little-endian 32-bit ids, by way of a bounded memo of pieces.

    The tokenizer lower-cases a text, drops blanks and never joins the pieces that its pattern splits, so the ids of a text of
    plain characters are those of its pieces in order. Other texts, and all where the tokenizer has another pattern, go by
    words: it never joins text across blank, tab or line ends.
    """

    def __init__(self, tokenizer: str, memo: int = 500_000, piece_chars: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok, self.pieces, self.words, self.limit, self.piece_chars = Tokenizer.from_file(public_tokenizers.path(tokenizer)), {}, {}, memo, piece_chars
        self.split = plain_split().findall
        told = json.loads(self.tok.to_str())
        norm = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.splits = norm == ["NFC", "Replace", "Lowercase"] and cuts == [SPLIT, None]

    def ids(self, text: str) -> bytes:
        if self.splits and PLAIN.fullmatch(text) and "<|" not in text:
            return self.joined(self.split(text.lower()), self.pieces, self.limit)
        return self.joined(WORD.findall(text), self.words, self.limit // 4)

    def joined(self, parts: list[str], known: dict[str, bytes], limit: int) -> bytes:
        new = list(set(parts).difference(known))
        if not new:
            return b"".join(map(known.__getitem__, parts))
        fresh = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        out = b"".join([fresh[w] if w in fresh else known[w] for w in parts])
        if len(known) + len(fresh) <= limit:  # a full memo keeps what came first, the common pieces among it
            known.update((w, b) for w, b in fresh.items() if len(w) <= self.piece_chars)
        return out


@lru_cache(1)
def worker_encoder(tokenizer: str) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    return Encoder(tokenizer)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = worker_encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                ids = encoder.ids(text or "") + end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    rows.append((doc, k, s // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tokenise, PIECE)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) of bin patterns that use every length exactly as often as it occurs."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    out = []
    while (lengths := np.flatnonzero(have)).size:
        left, used, bin_ = capacity, np.zeros(capacity + 1, np.int64), []
        while True:
            at = int(np.searchsorted(lengths, left, "right")) - 1
            while at >= 0 and used[lengths[at]] >= have[lengths[at]]:
                at -= 1
            if at < 0:
                break
            take = int(lengths[at])
            used[take] += 1
            left -= take
            bin_.append(take)
        if left and len(bin_) > 1:
            small = bin_[-1]
            gap = left + small
            used[small] -= 1
            free = lengths[(used[lengths] < have[lengths]) & (lengths < gap)]
            if free.size:
                at = np.searchsorted(free, gap - free, "right") - 1
                ok = at >= 0
                a, b = free[ok], free[at[ok]]
                fine = (a != b) | (have[a] - used[a] >= 2)
                a, b = a[fine], b[fine]
                if a.size and (a + b).max() > small:
                    i = int((a + b).argmax())
                    bin_[-1:] = [int(a[i]), int(b[i])]
                    used[a[i]] += 1
                    used[b[i]] += 1
                else:
                    used[small] += 1
            else:
                used[small] += 1
        need = np.flatnonzero(used)
        times = int((have[need] // used[need]).min())
        have[need] -= times * used[need]
        out.append((times, bin_))
    return out


def places(patterns: list[tuple[int, list[int]]], first: int) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, uses per bin, first sequence, offset), by rank."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    for times, bin_ in patterns:
        at = 0
        for length in sorted(set(bin_), reverse=True):
            k = bin_.count(length)
            out.setdefault(length, []).append((rank.get(length, 0), k, first, at))
            rank[length] = rank.get(length, 0) + times * k
            at += k * length
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, group_rows: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start, length and ids_crc32.

    Rows of one length are ranked in buckets of group_rows or so.
    """
    spark, names = parts.sparkSession, parts.columns
    buckets = max(64, -(-parts.count() // group_rows))
    keyed = parts.withColumns({"__h": F.xxhash64(*names), "__b": F.pmod(F.xxhash64(F.lit(3), *names), F.lit(buckets)).cast("int")})
    sizes = keyed.groupBy("length", "__b").count()
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__at"))
    counts = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    full = counts.pop(capacity, 0)
    shared = spark.sparkContext.broadcast(places(plan(counts, capacity), full))  # bounded by the capacity, not the rows

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = r.copy(), np.zeros(len(r), np.int64)
        for size in np.unique(n):
            if size != capacity:
                rows, mine = shared.value[int(size)], n == size
                hit = rows[np.searchsorted(rows[:, 0], r[mine], "right") - 1]
                t = r[mine] - hit[:, 0]
                seq[mine], off[mine] = hit[:, 2] + t // hit[:, 1], hit[:, 3] + (t % hit[:, 1]) * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    within = F.row_number().over(Window.partitionBy("length", "__b").orderBy("__h", *names))
    ranked = keyed.withColumn("__k", within - 1).join(starts, ["length", "__b"])
    return ranked.withColumn("__p", place("length", F.col("__at") + F.col("__k"))).select(*names, "__p.sequence_id", "__p.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(table(spark, sf_dir, "documents"))))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; null and empty texts hold the end id alone, an empty table packs to nothing."""
    return pack(cut(pieces(docs)))
