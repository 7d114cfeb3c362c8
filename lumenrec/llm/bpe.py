"""Operator 2: byte-level BPE encoding of whole texts in overlapping chunks, and decoding.

A text of up to ``chunk_chars`` characters is one chunk. A longer one is cut into chunks that
overlap, each chunk is pre-tokenised on its own, in parallel, and neighbours are stitched at the
first place inside their overlap where both begin a pre-token: from there on both see the same
text and cut it alike. Only the places are compared across chunks, not texts. Each piece between
two such places is then encoded, one pre-token at a time, by a task of its own chunk, and the
pieces' ids are concatenated. Where an overlap holds no common boundary (one pre-token fills
it), the document is pre-tokenised as a whole, which is exact.

Ids are kept as little-endian unsigned 32-bit integers in one binary value per text;
``unpack_ids`` gives the array. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import array
import base64
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

CHUNK_CHARS, OVERLAP_CHARS = 16_384, 512
#: A cut this close to a chunk's end may come out otherwise with more text: the longest
#: contraction looks two characters ahead, white space one.
_MARGIN = 4
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_MEMO_ENTRIES = 1 << 17
#: Bytes of text, or of ids, that a task takes from its batch at a time.
PORTION = 1 << 20


@cache
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern's \\p{L}, \\p{N} and \\s have it."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    points = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    return table


def pretoken_starts(text: str) -> np.ndarray:
    """Where the pre-tokens of ``text`` start, in characters.

    Equal to the matches of the public pattern: runs of letters, numbers or other characters,
    each with one space before it if there is one; white space, whose last character before
    other text is a match of its own unless it is that space; and after an apostrophe that
    begins a match, the contractions s, t, re, ve, m, ll and d.
    """
    if not text:
        return np.empty(0, np.int64)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[chars]
    n = len(chars)
    starts = np.ones(n, bool)
    starts[1:] = kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE)) + 1
    starts[after - 1] = True
    starts[after[chars[after - 1] == 32]] = False
    quote = np.flatnonzero((chars[:-1] == 39) & starts[:-1] & (kind[1:] == _LETTER))
    if len(quote):
        one = chars[quote + 1]
        two = chars[np.minimum(quote + 2, n - 1)] * (quote + 2 < n)
        single = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        length = np.where(single, 1, np.where(double, 2, 0))
        quote, length = quote[length > 0], length[length > 0]
        starts[quote + 1] = False
        end = quote + 1 + length
        starts[end[end < n]] = True
    return np.flatnonzero(starts)


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Encoder(dict):
    """Packed ids of a pre-token, remembered up to a bound."""

    def __init__(self, path: str):
        import tiktoken

        self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _MEMO_ENTRIES:
            self.clear()
        value = self[piece] = array.array("I", self.merge(piece.encode("utf-8", "replace"))).tobytes()
        return value

    def encode(self, text: str, starts: np.ndarray) -> bytes:
        cuts = starts.tolist()
        return b"".join([self[text[a:b]] for a, b in zip(cuts, cuts[1:] + [len(text)])])


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _portions(batches, column: str):
    """The batches in slices in which ``column`` has about PORTION bytes, one row at least; a batch of none stays."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        portion = (np.cumsum(sizes) - sizes) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _encode_whole(path):
    def run(batches):
        encoder = _encoder(path)
        for batch in _portions(batches, "text"):
            out = [encoder.encode(t, pretoken_starts(t)) for t in (x.as_py() or "" for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _pretokenise(overlap):
    """The starts in a chunk's first and last overlap that may serve as seams, in characters of the document."""

    def run(batches):
        for batch in _portions(batches, "piece"):
            head, tail = [], []
            for offset, last, piece in zip(batch.column("offset").to_pylist(), batch.column("last").to_pylist(), batch.column("piece")):
                text = piece.as_py()
                s = pretoken_starts(text)
                safe = s[s <= len(text) - _MARGIN]
                head.append((s[s < overlap] + offset).tolist())
                tail.append([] if last else (safe[safe >= len(text) - overlap] + offset).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "f", "k")), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["doc_id", "f", "k", "head", "tail"])

    return run


def _encode_pieces(path):
    def run(batches):
        encoder = _encoder(path)
        for batch in _portions(batches, "piece"):
            ids = []
            for row in batch.select(["offset", "piece", "since", "until"]).to_pylist():
                text = row["piece"]
                starts = pretoken_starts(text)
                a = (row["since"] or row["offset"]) - row["offset"]
                b = len(text) if row["until"] is None else row["until"] - row["offset"]
                ids.append(encoder.encode(text[a:b], starts[(starts >= a) & (starts < b)] - a))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("k"), pa.array(ids, pa.binary())], names=["row", "doc_id", "k", "ids"])

    return run


def encode(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_tokens, ids`` by the ranks in the file ``path``.

    One row per input row; a null text counts as empty and has no tokens. Further columns are
    ignored. Only texts above ``chunk_chars`` are shuffled. ``path`` must exist on the workers.
    """
    if not 0 < 2 * overlap_chars <= chunk_chars:
        raise ValueError("a chunk must hold two overlaps")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.char_length("text") > chunk_chars
    short = texts.where(~is_long).mapInArrow(_encode_whole(path), "doc_id long, n_tokens long, ids binary")

    # a document's chunks go by its id and a hash of its text; rows that agree in both have the same seams
    step = chunk_chars - overlap_chars
    offsets = F.sequence(F.lit(0).cast("long"), F.char_length("text") - overlap_chars - 1, F.lit(step).cast("long"))
    longs = texts.where(is_long).withColumn("f", F.xxhash64("text"))
    cut = [F.posexplode(offsets).alias("k", "offset")]
    piece = F.substring("text", F.col("offset").cast("int") + 1, F.lit(chunk_chars)).alias("piece")
    last = (F.col("offset") + chunk_chars >= F.char_length("text")).alias("last")

    chunks = longs.select("doc_id", "f", "text", *cut).select("doc_id", "f", "k", "offset", last, piece)
    marks = chunks.mapInArrow(_pretokenise(overlap_chars), "doc_id long, f long, k int, head array<long>, tail array<long>").dropDuplicates(["doc_id", "f", "k"])
    order = Window.partitionBy("doc_id", "f").orderBy("k")
    seam = lambda tail, head: F.array_min(F.array_intersect(tail, head))
    seams = marks.withColumn("since", seam(F.lag("tail").over(order), F.col("head"))).withColumn("until", seam(F.col("tail"), F.lead("head").over(order)))
    missed = F.max(((F.col("k") > 0) & F.col("since").isNull()).cast("int")).over(Window.partitionBy("doc_id", "f")) == 1
    seams = materialize(seams.select("doc_id", "f", "k", "since", "until", missed.alias("missed")))

    def same(left: DataFrame, right: DataFrame, *more: str) -> Column:
        return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["f"] == right["f"]) & (left["k"] == right["k"] if more else F.lit(True))

    chunks = longs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "f", "text", *cut).select("row", "doc_id", "f", "k", "offset", piece)
    good = seams.where("not missed")
    pieces = chunks.join(good, same(chunks, good, "k")).select("row", chunks["doc_id"], chunks["k"], "offset", "piece", "since", "until")
    pieces = pieces.mapInArrow(_encode_pieces(path), "row long, doc_id long, k int, ids binary")
    stitched = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    stitched = stitched.select("doc_id", ids.alias("ids")).select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids")
    encoded = short.unionByName(stitched)

    bad = seams.where("missed").select("doc_id", "f").distinct()
    if not bad.isEmpty():
        again = longs.join(bad, same(longs, bad), "left_semi").select("doc_id", "text")
        encoded = encoded.unionByName(again.mapInArrow(_encode_whole(path), "doc_id long, n_tokens long, ids binary"))
    return encoded


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the concatenated raw bytes of ``ids``. A null ``ids`` gives null, an unknown id fails."""

    def run(batches):
        ranks = load_ranks(path)
        table = np.empty(max(ranks.values()) + 1, object)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in _portions(batches, "ids"):
            out = [None if x is None else b"".join(table[np.frombuffer(x, "<u4")]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded")
    return encoded.drop("decoded").mapInArrow(run, f"{schema}, decoded binary")


def unpack_ids(ids: Column) -> Column:
    """Packed ids as an array of long."""

    def unpacked(digits: Column) -> Column:
        one = lambda i: F.conv(F.concat(*(F.substring(digits, i * 8 + 7 - 2 * j, F.lit(2)) for j in range(4))), 16, 10).cast("long")
        return F.transform(F.sequence(F.lit(0), (F.length(digits) / 8).cast("int") - 1), one)

    # bound by a lambda, the digits are made once a row and not once an element
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.array(F.hex(ids)), unpacked)[0])


def digests(encoded: DataFrame) -> DataFrame:
    """Encoded and decoded rows -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
