"""Cross-tokenizer alignment by relational means: tokens of two tokenizers, their byte ranges, and which of them overlap.

Tokens are exploded with their places, and their lengths summed up by a window to ends. Ends of both sides are joined:
where both end is a cut, and a running count of cuts numbers the groups. Each joined row also is the stretch of bytes from
the end before to its own, over which one token of each side lies, the next one to end: these two are linked, and no two
others are. So a running window finds the links of a group by range, without comparing its pairs.

None of this is done twice for the same words: texts are first taken apart where both tokenizers are bound to cut, each
distinct piece is aligned once, as a document of its own, and counted by how often it occurs. Then documents are put
together from the results of their pieces, block by block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import compact, dropped, lean, partitions, release, small_batches, spent_shuffles_removed, table, worker_state, written

#: Documents are taken apart in blocks of about so many bytes of text, each with its own list of distinct pieces.
BLOCK_BYTES = 32 << 20
#: A single space between characters that aren't white space, by Python's wide notion of that.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Id pairs whose counts are broadcast at most, the frequent ones; links of others are joined by an exchange.
BROADCAST_PAIRS = 1_000_000
#: Tokens that a batch of encoded pieces has.
BATCH_TOKENS = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Shipped:
    """Tokenizers go to executors as the content of their files, and are built where they are used."""

    def __reduce__(self):
        return type(self), (self.content,)


@dataclass(frozen=True)
class ByteLevel(Shipped):
    """A tokenizers file of byte-level BPE, which is given a space and the text. Special tokens' strings are plain text."""

    content: str

    @classmethod
    def read(cls, path: str) -> ByteLevel:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    @cached_property
    def model(self) -> tokenizers.Tokenizer:
        model = tokenizers.Tokenizer.from_str(self.content)
        model.encode_special_tokens = True
        return model

    @cached_property
    def token_bytes(self) -> list[bytes]:
        letters, vocabulary = byte_letters(), self.model.get_vocab(True)
        found = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            found[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return found

    def cuts_at_spaces(self) -> bool:
        """Its pattern keeps a space with what follows, so that a single one begins a token."""
        steps = json.loads(self.content).get("pre_tokenizer") or {}
        return steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


@dataclass(frozen=True)
class Pieces(Shipped):
    """A sentencepiece model, which puts the space before the text itself."""

    content: bytes

    @classmethod
    def read(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            return cls(f.read())

    @cached_property
    def model(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.content)

    @cached_property
    def token_bytes(self) -> list[bytes]:
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def cuts_at_spaces(self) -> bool:
        """No piece goes on over a space that follows something else, and normalising leaves single spaces alone."""
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        return not any(re.search("[^▁]▁", p) for p in pieces) and self.model.normalize("a b  c") == "▁a▁b▁▁c"

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Known(dict):
    """The places of a block's pieces in its list; -1 for what a split at spaces gives next to other white space.

    Pieces that begin or end with white space have theirs in edged: a text is cut there at no space, whatever texts came before.
    """

    def __init__(self):
        super().__init__()
        self.pieces: list[str] = []
        self.edged: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        inner = piece and not piece[0].isspace() and not piece[-1].isspace()
        self[piece] = place = len(self.pieces) if inner else -1
        if inner:
            self.pieces.append(piece)
        return place

    def place(self, piece: str) -> int:
        """That of a piece of any kind."""
        at = self[piece]
        if at < 0:
            at = self.edged.setdefault(piece, len(self.pieces))
            if at == len(self.pieces):
                self.pieces.append(piece)
        return at

    def places(self, text: str, whole: bool) -> np.ndarray:
        """Those of the text's pieces."""
        if not whole:
            found = np.array(list(map(self.__getitem__, text.split(" "))), np.int32)
            if found.min() >= 0:
                return found
        return np.array([self.place(piece) for piece in ([text] if whole else SINGLE_SPACE.split(text))], np.int32)


def packed(places: np.ndarray) -> bytes:
    """Places by planes of their bytes, the lowest first: frequent pieces have low places, so that upper planes are nearly all zeros.

    Compressed here, with their number in 4 bytes before them: what exchanges compress by has no codes for frequent bytes.
    """
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(places).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unpacked(pieces: bytes | None) -> np.ndarray:
    if not pieces:
        return np.empty(0, np.int64)
    planes = pa.decompress(pieces[4:], 4 * int.from_bytes(pieces[:4], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _take_apart(whole: bool, block_bytes: int, arrow: pa.Schema):
    """Rows of documents (block, doc, doc_id, pieces: packed places in the block's list) and of that list (block, at, piece, n), frequent ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        ids: list[pa.Array] = []
        known = Known()
        found: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, size, known
            times = np.bincount(np.concatenate([np.empty(0, np.int32), *found]), minlength=len(known.pieces))
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            places = pa.array([packed(rank[f]) for f in found], pa.binary())
            doc_ids = pa.concat_arrays(ids)
            for n, columns in (
                (len(found), {"doc": pa.array(np.arange(len(found), dtype=np.int32)), "doc_id": doc_ids, "pieces": places}),
                (len(known.pieces), {"at": pa.array(np.arange(len(known.pieces), dtype=np.int32)), "piece": pa.array(known.pieces, pa.string()).take(pa.array(order)), "n": pa.array(times[order].astype(np.int64))}),
            ):
                if n:
                    columns["block"] = pa.array(np.full(n, block))
                    yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in arrow], schema=arrow)
            block, size = block + 1, 0
            known = Known()
            ids.clear(), found.clear()

        for batch in batches:
            for doc_id, text in zip(range(len(batch)), batch.column(1), strict=True):
                text = text.as_py()
                found.append(known.places(text, whole) if text else np.empty(0, np.int32))
                ids.append(batch.column(0).slice(doc_id, 1))
                size += len(text or "") + 1
                if size >= block_bytes:
                    yield from flush()
        if found:
            yield from flush()

    return run


def _encode(a: ByteLevel | Pieces, b: ByteLevel | Pieces, arrow: pa.Schema):
    """Each piece with the ids of a, which are n_a, and then those of b; ok says whether joined tokens are the space and the piece."""

    def tokens(side: ByteLevel | Pieces, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        ids = side.encode(texts)
        names = side.token_bytes
        fine = [b"".join([names[i] for i in found]) == b" " + text.encode() for found, text in zip(ids, texts, strict=True)]
        return ids, fine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = worker_state().setdefault(("align", hash(a), hash(b)), (a, b))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column("piece")), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(lengths) // BATCH_TOKENS)) + 1).tolist(), len(batch)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                texts = part.column("piece").to_pylist()
                (ids_a, fine_a), (ids_b, fine_b) = tokens(side_a, texts), tokens(side_b, texts)
                ok = [x and y for x, y in zip(fine_a, fine_b, strict=True)]
                numbers = pa.array(np.arange(number, number + len(texts)))
                number += len(texts)
                n_a = pa.array(list(map(len, ids_a)), pa.int32())
                ids = pa.array([x + y for x, y in zip(ids_a, ids_b, strict=True)], arrow.field("ids").type)
                yield pa.RecordBatch.from_arrays([numbers, part.column("piece"), part.column("n"), pa.array(ok), n_a, ids], schema=arrow)

    return run


def _ends(encoded: DataFrame, sizes_a: list[int], sizes_b: list[int]) -> DataFrame:
    """(piece_id, end, a, b), a row a token, whose id is in its side's column: lengths summed up in order of places."""
    rows = encoded.select("piece_id", "n_a", F.posexplode("ids").alias("k", "id")).withColumn("is_b", F.col("k") >= F.col("n_a"))
    # The lengths of the vocabularies' tokens, a constant.
    sizes = F.split(F.lit(",".join(map(str, sizes_a + sizes_b))), ",").cast("array<int>")
    size = F.element_at(sizes, F.col("id") + F.when(F.col("is_b"), 1 + len(sizes_a)).otherwise(1))
    end = F.sum(size).over(Window.partitionBy("piece_id", "is_b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("piece_id", end.alias("end"), F.when(~F.col("is_b"), F.col("id")).alias("a"), F.when(F.col("is_b"), F.col("id")).alias("b"))


def align_pieces(encoded: DataFrame, sizes_a: list[int], sizes_b: list[int]) -> DataFrame:
    """encoded(piece_id, piece, n, n_a, ids) -> piece_id, piece, n, n_a, groups string, links array<long>, pair() of each.

    Pieces are exchanged once, before they are exploded: all that follows is done where a piece's tokens are.
    """
    spread = encoded.repartition(4 * partitions(encoded.sparkSession), "piece_id")
    tokens = _ends(spread, sizes_a, sizes_b)
    # Ends of both sides meet: an outer join on piece and end that leaves pieces where they are.
    joined = tokens.groupBy("piece_id", "end").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    backward = Window.partitionBy("piece_id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    over = [F.last(s, ignorenulls=True).over(backward) for s in "ab"]
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    stretches = joined.select("piece_id", "end", "a", "b", pair(*over).alias("link"), F.sum(cut).over(backward).alias("g"))
    inside = F.array_sort(F.collect_list(F.struct("end", "a", "b", "link"))).alias("rows")
    groups = stretches.groupBy("piece_id", "g").agg(inside)
    ids = [F.array_join(F.col(f"rows.{s}").cast("array<string>"), ",") for s in "ab"]
    groups = groups.select("piece_id", F.struct(-F.col("g"), F.concat(ids[0], F.lit("|"), ids[1]).alias("ids"), F.col("rows.link").alias("links")).alias("group"))
    whole = groups.groupBy("piece_id").agg(F.array_sort(F.collect_list("group")).alias("all"))
    whole = whole.select(
        "piece_id", F.array_join("all.ids", ";").alias("groups"), F.flatten("all.links").alias("links")
    )
    # Partitioned alike, so that nothing is exchanged for this.
    return whole.join(spread.select("piece_id", "piece", "n", "n_a"), "piece_id")


def pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count long, best boolean): how many links corpus-wide hold an id pair, and whether no other a is more often b's."""
    counts = aligned.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    best = F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))
    return counts.withColumn("best", best)


def with_counts(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links(piece, pair) with count and best. Frequent pairs, BROADCAST_PAIRS at most, are looked up where their links are; links of the others are exchanged."""
    if pairs.count() <= BROADCAST_PAIRS:
        return links.join(F.broadcast(pairs), "pair")
    level = F.floor(F.log2("count"))
    # 64 levels at most.
    sizes = {r["level"]: r["count"] for r in pairs.groupBy(level.alias("level")).count().collect()}
    cut, room = max(sizes) + 1, BROADCAST_PAIRS
    while (room := room - sizes.get(cut - 1, 0)) >= 0:
        cut -= 1
    known = links.join(F.broadcast(pairs.where(level >= cut)), "pair", "left")
    rest = known.where("count IS NULL").select("piece", "pair").join(pairs.where(level < cut), "pair")
    return known.where("count IS NOT NULL").unionByName(rest)


TOTALS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Pieces whose results are put together at a time, however long the document.
SLICE_PIECES = 1 << 18


def _lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pieces, bad) -> (block, at, lost): how often a piece stands in documents that have one of the bad places."""
    for batch in batches:
        for block, pieces, bad in zip(*batch.columns, strict=True):
            places = unpacked(pieces.as_py())
            if np.isin(places, bad.values.to_numpy()).any():
                at, lost = np.unique(places, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block.as_py())), pa.array(at.astype(np.int32)), pa.array(lost.astype(np.int64))], ["block", "at", "lost"])


def _put_together(keep_groups: bool, arrow: pa.Schema):
    """A block's documents from its list of pieces: counts added up, groups joined."""

    def run(docs: pa.Table, facts: pa.Table) -> pa.Table:
        worker_state().clear()
        try:
            return of_block(docs, facts)
        finally:
            release()

    def of_block(docs: pa.Table, facts: pa.Table) -> pa.Table:
        places = np.asarray(facts.column("at"), np.int64)
        order = np.full(int(places.max()) + 1 if len(places) else 0, -1, np.int64)
        order[places] = np.arange(len(places))
        of = {c: np.asarray(facts.column(c), np.int64) for c in ("n_a", "n_best", "count_sum")}
        marks = {c: np.asarray(pc.count_substring(facts.column("groups"), c), np.int64) for c in ";,"}
        of["n_groups"] = marks[";"] + 1
        of["n_b"] = marks[","] + 2 * of["n_groups"] - of["n_a"]
        of["n_links"] = of["n_a"] + of["n_b"] - of["n_groups"]  # a link for each end of either side
        sums = [of[c] for c in TOTALS]
        groups = pc.binary_join_element_wise(facts.column("groups"), ";", "").combine_chunks()
        groups = groups.chunk(0) if isinstance(groups, pa.ChunkedArray) else groups
        rows: list[list] = [[] for _ in arrow]
        for doc_id, pieces in zip(range(len(docs)), docs.column("pieces"), strict=True):
            at = unpacked(pieces.as_py())
            at = order[at] if not len(at) or at.max() < len(order) else np.array([-1])
            # A piece without facts doesn't give its bytes back, and spoils the text.
            at = at[:0] if (at < 0).any() else at
            digest, texts = hashlib.sha256(), []
            for start in range(0, len(at), SLICE_PIECES):
                some = groups.take(pa.array(at[start : start + SLICE_PIECES]))
                text = some.buffers()[2].to_pybytes()[: int(np.frombuffer(some.buffers()[1], np.int32)[len(some)])]
                text = text[:-1] if start + SLICE_PIECES >= len(at) else text
                digest.update(text)
                texts += [text] * keep_groups
            values = [*[int(s[at].sum()) for s in sums], digest.hexdigest() if len(at) else "", *[b"".join(texts).decode()] * keep_groups]
            for column, value in zip(rows[1:], values, strict=True):
                column.append(value)
        return pa.Table.from_arrays([docs.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(rows[1:], list(arrow)[1:], strict=True)]], schema=arrow)

    return run


@dataclass
class Alignment:
    """documents: a written table, one row a document. pairs: (pair, count, best), the corpus-wide counts of id pairs."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces, keep_groups: bool = False, block_bytes: int = BLOCK_BYTES, whole: bool | None = None) -> Alignment:
    """Aligns the tokens of a and b for each row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum long, groups_sha256 string and, if asked for, groups.

    Both sides tokenise a space and the text. Texts null, empty, or whose joined tokens differ from that on a side have no
    tokens: zeros, and an empty string unhashed; they count nowhere. Repeated rows and ids are rows of their own, null ids
    pass through; other columns play no part; an empty table gives none. whole: texts aren't taken apart, which is so
    anyway if a tokenizer doesn't cut at every single space. A text without such is one piece, however long: its tokens
    must fit a window's buffer, which spills, and the rows of its group an array.
    """
    with spent_shuffles_removed(docs.sparkSession):
        return _align(docs, a, b, keep_groups, block_bytes, whole)


def _align(docs: DataFrame, a: ByteLevel | Pieces, b: ByteLevel | Pieces, keep_groups: bool, block_bytes: int, whole: bool | None) -> Alignment:
    whole = not (a.cuts_at_spaces() and b.cuts_at_spaces()) if whole is None else whole
    apart = StructType([*_schema("block long, doc int").fields, docs.schema["doc_id"], *_schema("pieces binary, at int, piece string, n long").fields])
    parts = written(docs.select("doc_id", "text").mapInArrow(lean(_take_apart(whole, block_bytes, to_arrow_schema(apart))), apart), "pieces", "zstd", few_files=False)
    lists, texts = parts.where("n > 0").select("block", "at", "piece", "n"), parts.where("at is null").select("block", "doc", "doc_id", "pieces")

    schema = _schema("piece_id long, piece string, n long, ok boolean, n_a int, ids array<int>")
    distinct = lists.groupBy("piece").agg(F.sum("n").alias("n"))
    # Few partitions before pieces are numbered, not after it: partitions that a task reads together have one partition id.
    encoded = written(compact(distinct).mapInArrow(lean(_encode(a, b, to_arrow_schema(schema)), keep=True), schema), "encoded", "zstd", few_files=False)
    # Documents with a piece that doesn't give its bytes back have no tokens, and count nowhere.
    fine, spoils = encoded.where("ok"), encoded.where(~F.col("ok")).select("piece")
    if not spoils.isEmpty():
        bad = written(lists.join(spoils, "piece").groupBy("block").agg(F.collect_set("at").alias("bad")), "bad-pieces")
        lost = texts.select("block", "pieces").join(bad, "block").mapInArrow(lean(_lost), "block long, at int, lost long")
        lost = lost.groupBy("block", "at").agg(F.sum("lost").alias("lost")).join(lists.drop("n"), ["block", "at"]).groupBy("piece").agg(F.sum("lost").alias("lost"))
        fine = fine.join(lost, "piece", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).where("n > 0").drop("lost")

    sizes = [[len(t) for t in side.token_bytes] for side in (a, b)]
    aligned = written(align_pieces(fine, *sizes), "aligned", "zstd")
    dropped(encoded)
    pairs = written(pair_counts(aligned), "pairs")
    # Numbers of pieces stand for them, which are shorter.
    found = with_counts(aligned.select(F.col("piece_id").alias("piece"), F.explode("links").alias("pair")), pairs)
    counts = found.groupBy(F.col("piece").alias("piece_id")).agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    facts = aligned.select("piece_id", "piece", "n_a", "groups").join(counts, "piece_id").drop("piece_id")
    facts = written(facts, "facts", "zstd")
    dropped(aligned)
    of_blocks = written(lists.select(F.col("block").alias("of"), "at", "piece").join(facts, "piece").drop("piece"), "facts-of-blocks", "zstd")
    dropped(facts)

    out = StructType([docs.schema["doc_id"], *_schema(", ".join(f"{c} long" for c in TOTALS) + ", groups_sha256 string" + ", groups string" * keep_groups).fields])
    arrow = to_arrow_schema(out)
    run = _put_together(keep_groups, arrow)
    # A block is bounded, but for a single longer document; blocks without a fine piece have documents all the same.
    done = texts.groupBy("block").cogroup(of_blocks.groupBy("of")).applyInArrow(lambda left, right: run(left, right), out)
    with small_batches(docs.sparkSession):
        done = written(done, "alignment")
    dropped(parts, of_blocks)
    return Alignment(done, pairs)


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ByteLevel.read(public_tokenizers.path("byte_bpe_50k.json"))
    b = Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    return align(table(spark, sf_dir, "documents"), a, b).documents
