"""Join of documents whose sets of word n-grams have a Jaccard similarity of ``THRESHOLD`` or more.

1. A text is read as words (A-Z in lower case). Documents with equal words are one class from here on; its
   node stands for all of them.
2. Each node gets ``BANDS * ROWS`` MinHash values of its set of ``SHINGLE``-word n-grams. With 20 bands of 5
   rows, a pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^20 = 0.9996. Band hashes are
   shuffled; buckets with the same members count once.
3. In a bucket, pairs that agree in ``AGREEMENT`` of the 100 values (six deviations below what a pair at the
   threshold has) are candidates. A spanning forest of them leaves the bucket, never the pairs.
4. Candidate components meet with their texts, and all their pairs are decided on the full n-gram sets. What
   leaves is a count of links for each node and a spanning forest of the links. A component of one block is
   decided by products of indicator matrices. In a larger one, see below, most pairs are decided by their
   distances to one text of it, the hub, and only the others meet.
5. Components of the links are the classes; a class is named by its smallest ``doc_id``.

Sets of n-grams A and B are linked where |A| + |B| >= 9 |A xor B|. With the hub H, |A xor B| is at most
|A xor H| + |B xor H|, so with the *slack* |A| - 9 |A xor H| of each node, all pairs whose slacks add up to 0 or
more are linked. They are counted from how many nodes of the component have each slack; each text is shuffled
once for that, and the hub once for each block. Nodes with a pair below 0 go on to be compared, with the nodes
that they are undecided with.

A bucket or component above ``BLOCK_NODES`` nodes or ``BLOCK_BYTES`` of text is cut into blocks, and where pairs
are compared each pair of blocks is a group of rows of its own, so that no task holds more than two blocks (and a
hub) and no pair is left out.

A document of fewer than five words has one n-gram, all its words. Null, empty and wordless texts have none
and are alone in their class, without links. Null ids take part; they name no class (a class without any id
has a null name). Rows that repeat id and text count as copies of each other. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusflow.llm.components import components
from corpusflow.llm.tables import NO_ID, by_run, keep_rows, row_id, slices, text_of
from corpusflow.operators.unions import stack_rows
from corpusflow.session import written

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
AGREEMENT = 55
#: Of the words of two linked sets together, one in so many may be in one set only: (1 + THRESHOLD) / (1 - THRESHOLD).
FAR = 9
BLOCK_NODES = 512
BLOCK_BYTES = 8 * 1024 * 1024
REMEMBERED_WORDS = 250_000

_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def split_words(text: str) -> list[bytes]:
    """Words of a text: runs of anything but ASCII separators and symbols, A-Z in lower case."""
    return text.encode().translate(_BYTES).split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Signer:
    """MinHash values of word n-grams: multiply-add hashes with fixed random odd factors."""

    def __init__(self) -> None:
        draw = np.random.default_rng(20)
        n = BANDS * ROWS
        self.factors = (draw.integers(0, 1 << 63, n, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.offsets = draw.integers(0, 1 << 63, n, np.uint64)
        self.step = draw.integers(0, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)
        self.row_step = draw.integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)
        self.band_step = draw.integers(0, 1 << 63, BANDS, np.uint64)
        self.words = _WordHashes()

    def grams(self, words: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - SHINGLE + 1)
        out = np.zeros(n, np.uint64)
        for j in range(min(SHINGLE, len(words))):
            part = hashes[j : j + n]
            out = (out ^ (out >> np.uint64(29))) * self.step[j] + part
        return out ^ (out >> np.uint64(32))

    def minima(self, words: list[bytes]) -> np.ndarray:
        grams, least = self.grams(words), None
        for start in range(0, len(grams), 2048):
            part = (self.factors[:, None] * grams[None, start : start + 2048] + self.offsets[:, None]).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return least

    def sign(self, words: list[bytes]) -> tuple[bytes, list[int]]:
        """One byte of each value, and the hash of each band."""
        least = self.minima(words)
        values = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
        bands = (least.reshape(BANDS, ROWS) * self.row_step).sum(axis=1, dtype=np.uint64) + self.band_step
        bands = (bands ^ (bands >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return values.tobytes(), bands.view(np.int64).tolist()


def signatures(docs: DataFrame) -> DataFrame:
    """(rep_id, rep_key, words_key, n_bytes, values, bands); no words_key for a text without words."""
    def task(batches):
        signer = Signer()
        for batch in slices(batches):
            keys, sizes, values, bands = [], [], [], []
            for text in batch.column("text"):
                words = split_words(text.as_py())
                value, band = signer.sign(words) if words else (None, None)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sizes.append(sum(map(len, words)) + len(words))
                values.append(value)
                bands.append(band)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep_id"), batch.column("rep_key"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["rep_id", "rep_key", "words_key", "n_bytes", "values", "bands"],
            )

    return _texts(docs).mapInArrow(task, "rep_id long, rep_key long, words_key binary, n_bytes long, values binary, bands array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    """(rep_id, rep_key, text): what finds a row again; a null id is ``NO_ID`` here."""
    text = text_of("text")
    return docs.select(row_id().alias("rep_id"), F.xxhash64(text).alias("rep_key"), text.alias("text"))


def _forest(nodes: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """(root, node) for each node that is connected with an earlier one, over a symmetric matrix of links.

    Nodes are in order, so a root is the least of its component: groups that overlap name the same roots.
    """
    open_, out = np.ones(len(nodes), bool), []
    for root in range(len(nodes)):
        if not open_[root]:
            continue
        open_[root], reached = False, [root]
        while reached:
            new = np.flatnonzero(linked[reached.pop()] & open_)
            open_[new] = False
            reached += new.tolist()
            out += [(int(nodes[root]), int(nodes[x])) for x in new]
    return out


def _paired(blocks: np.ndarray, first: int, second: int) -> np.ndarray:
    """Which pairs of rows a group of two blocks answers for."""
    if first == second:
        return ~np.eye(len(blocks), dtype=bool)
    left, right = blocks == first, blocks == second
    return (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])


def _in_blocks(rows: DataFrame, key: str, n_blocks) -> DataFrame:
    """``rows`` with (first, second, block): once for each pair of blocks of its key that its own block is in."""
    block = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    rows = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return rows.withColumn("other", other).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("other", "n_blocks")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def _bucket_edges(table: pa.Table) -> pa.RecordBatch:
    nodes, blocks = _column(table, "node"), _column(table, "block")
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint8).reshape(len(nodes), -1)
    agree = np.empty((len(nodes), len(nodes)), np.uint8)
    for at in range(0, len(nodes), 64):
        agree[at : at + 64] = (values[at : at + 64, None, :] == values[None, :, :]).sum(axis=2, dtype=np.uint8)
    linked = (agree >= AGREEMENT) & _paired(blocks, int(table.column("first")[0].as_py()), int(table.column("second")[0].as_py()))
    edges = np.array(_forest(nodes, linked), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def ngram_set(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[j:] for j in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else {tuple(words)} if words else set()


def overlaps(sets: list[set]) -> np.ndarray:
    """The size of the intersection of each pair of sets."""
    numbers: dict[tuple, int] = {}
    owners: list[list[int]] = []
    for owner, grams in enumerate(sets):
        for gram in grams:
            at = numbers.setdefault(gram, len(owners))
            if at == len(owners):
                owners.append([])
            owners[at].append(owner)
    shared = [o for o in owners if len(o) > 1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, len(shared), 4096):
        part = shared[start : start + 4096]
        held = np.zeros((len(sets), len(part)), np.float32)
        held[np.concatenate(part), np.repeat(np.arange(len(part)), [len(o) for o in part])] = 1
        out += held @ held.T
    return out


_FOUND = {"a": pa.int64(), "b": pa.int64(), "n_texts": pa.int64(), "n_docs": pa.int64()}
_PLACED = {"label": pa.int64(), "node": pa.int64(), "hub": pa.int64(), "slack": pa.int64(), "near_hub": pa.bool_(), "n_copies": pa.int64(), "n_bytes": pa.int64(), "text": pa.string()}


def _compared(table: pa.Table, asked: np.ndarray) -> dict[str, list]:
    """The links among the ``asked`` pairs: what each node has of them, and a spanning forest."""
    nodes, copies = _column(table, "node"), _column(table, "n_copies")
    sets = [ngram_set(split_words(x.as_py())) for x in table.column("text")]
    sizes, shared = np.array([len(s) for s in sets]), overlaps(sets)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = (shared >= THRESHOLD * union - 1e-6) & asked
    some = np.flatnonzero(linked.any(axis=1))
    edges = np.array(_forest(nodes, linked), np.int64).reshape(-1, 2)
    none = [None] * len(edges)
    return {
        "a": [*nodes[some].tolist(), *edges[:, 0].tolist()],
        "b": [None] * len(some) + edges[:, 1].tolist(),
        "n_texts": linked[some].sum(axis=1).tolist() + none,
        "n_docs": (linked[some] @ copies).tolist() + none,
    }


def _record(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), k) for c, k in kinds.items()], list(kinds))


def _decided_or_placed(table: pa.Table) -> pa.RecordBatch:
    """The links of a component of one block; else the slack of each node of this block."""
    if table.column("n_blocks")[0].as_py() == 1:
        return _record(_compared(table, ~np.eye(table.num_rows, dtype=bool)), _FOUND | _PLACED)
    nodes, hubs, own = (_column(table, c) for c in ("node", "hub", "own"))
    hub = ngram_set(split_words(table.column("text")[int(np.flatnonzero(nodes == hubs)[0])].as_py()))
    rows = np.flatnonzero(own)
    slacks = []
    for i in rows.tolist():
        grams = ngram_set(split_words(table.column("text")[i].as_py()))
        slacks.append(len(grams) - FAR * len(grams ^ hub))
    kept = table.select([c for c in _PLACED if c in table.column_names]).take(pa.array(rows)).to_pydict()
    return _record(kept | {"slack": slacks, "near_hub": [x + len(hub) >= 0 for x in slacks]}, _FOUND | _PLACED)


def _undecided(table: pa.Table) -> pa.RecordBatch:
    """The links among the pairs of a group of two blocks whose slacks add up to less than 0."""
    slack = _column(table, "slack")
    own = _paired(_column(table, "block"), int(table.column("first")[0].as_py()), int(table.column("second")[0].as_py()))
    return _record(_compared(table, own & (slack[:, None] + slack[None, :] < 0)), _FOUND)


def _grouped(rows: DataFrame, key: str, fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    return by_run(rows, [key, "first", "second"], "node", fn, schema)


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the candidate pairs of each bucket of (node, values, bands)."""
    rows = written(nodes.select("node", F.explode("bands").alias("bucket")), "bands")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("mix"))
    chosen = sizes.filter("n > 1").groupBy("n", "least", "mix").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = written(rows.join(chosen, "bucket"), "buckets")
    full = members.join(nodes.select("node", "values"), "node")
    cut = _in_blocks(full, "bucket", F.ceil(F.col("n") / BLOCK_NODES))
    return _grouped(cut.select("bucket", "first", "second", "block", "node", "values"), "bucket", _bucket_edges, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links, n_copies, text_key, keeper, has_words) for each row of ``docs``.

    ``n_links`` counts the other documents at the threshold or above, copies included; ``n_text_links`` the
    other word sequences; ``n_copies`` the documents with this one's words, itself included; ``keeper`` marks
    the document that names the class.
    """
    signed = written(signatures(docs), "signatures")
    classes = signed.filter(F.col("words_key").isNotNull()).groupBy("words_key").agg(
        F.min(F.struct("rep_id", "rep_key")).alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n_bytes").alias("n_bytes"),
        F.first("values").alias("values"), F.first("bands").alias("bands"),
    )
    nodes = written(classes.select(F.monotonically_increasing_id().alias("node"), "words_key", "rep.*", "n_copies", "n_bytes", "values", "bands"), "nodes")
    near = written(components(candidate_edges(nodes)), "candidates")
    found = written(verified(docs, nodes, near), "links")

    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    named = written(components(found.filter("b is not null").select("a", "b")).join(nodes.select("node", "rep_id", "rep_key"), "node"), "named")
    first = written(named.groupBy("label").agg(F.min(F.struct("rep_id", "rep_key")).alias("first")), "class-names")
    in_class = named.join(first, "label").select("node", "first")
    keyed = nodes.join(in_class, "node", "left").join(links, "node", "left").select(
        "words_key",
        F.coalesce("first", F.struct("rep_id", "rep_key")).alias("first"),
        "n_copies",
        F.coalesce("n_texts", F.lit(0)).alias("n_text_links"),
        (F.coalesce("n_docs", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
    )
    own = F.struct("rep_id", "rep_key")
    return signed.select("rep_id", "rep_key", "words_key").join(keyed, "words_key", "left").select(
        F.nullif("rep_id", F.lit(NO_ID)).alias("doc_id"),
        F.nullif(F.coalesce("first.rep_id", "rep_id"), F.lit(NO_ID)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.col("rep_key").alias("text_key"),
        (F.coalesce("first", own) == own).alias("keeper"),
        F.col("words_key").isNotNull().alias("has_words"),
    )


def verified(docs: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b, n_texts, n_docs): links counted for node a where b is null, else an edge of a spanning forest of the links."""
    near = near.join(nodes.select("node", "rep_id", "rep_key", "n_copies", "n_bytes"), "node")
    hub = F.max_by("node", F.struct("n_copies", -F.col("node"))).alias("hub")
    # Written, for a join above an aggregation keeps a hot label in one task.
    sizes = written(near.groupBy("label").agg(_n_blocks(F.count(F.lit(1)), F.sum("n_bytes")).alias("n_blocks"), hub), "sizes")
    # Whole texts are shuffled once, to the nodes they represent; rows repeated in full count once.
    full = _texts(docs).join(near.join(sizes, "label").hint("shuffle_hash"), ["rep_id", "rep_key"]).dropDuplicates(["rep_id", "rep_key"])
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    into = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).otherwise(F.array(block))
    dealt = full.select("label", "node", "hub", "n_blocks", "n_copies", "n_bytes", "text", block.alias("home"), F.explode(into).alias("block"))
    dealt = dealt.withColumn("own", F.col("home") == F.col("block")).drop("home")
    schema = "a long, b long, n_texts long, n_docs long, label long, node long, hub long, slack long, near_hub boolean, n_copies long, n_bytes long, text string"
    first = written(by_run(dealt, ["label", "block"], "node", _decided_or_placed, schema), "decided")
    placed = first.filter("slack IS NOT NULL").drop("a", "b", "n_texts", "n_docs")
    answered = placed.join(_sure_links(placed), ["label", "slack"])
    nothing = F.lit(None).cast("long")
    return stack_rows(
        first.filter("slack IS NULL").select("a", "b", "n_texts", "n_docs"),
        answered.filter("sure_texts > 0").select(F.col("node").alias("a"), nothing.alias("b"), F.col("sure_texts").alias("n_texts"), (F.col("sure_docs") - F.when(F.col("slack") >= 0, F.col("n_copies")).otherwise(0)).alias("n_docs")),
        placed.filter("near_hub AND node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), nothing.alias("n_texts"), nothing.alias("n_docs")),
        _rest(answered.filter("open_texts > 0")),
    )


def _n_blocks(rows, size):
    return F.greatest(F.ceil(rows / BLOCK_NODES), F.ceil(size / BLOCK_BYTES)).cast("long")


def _sure_links(placed: DataFrame) -> DataFrame:
    """(label, slack, sure_texts, sure_docs, open_texts): for a node of this slack, the other nodes of its component that
    are linked by their slacks, their documents (its own included where its slack is not negative), and the nodes left.

    A running count over the slacks of a component, of which there are at most some ten times the words of its texts.
    """
    held = placed.groupBy("label", "slack").agg(F.count(F.lit(1)).alias("n"), F.sum("n_copies").alias("docs"))
    zero = F.lit(0).cast("long")
    marks = stack_rows(
        held.select("label", F.col("slack").alias("at"), F.lit(False).alias("asks"), "n", "docs"),
        held.select("label", (-F.col("slack")).alias("at"), F.lit(True).alias("asks"), zero.alias("n"), zero.alias("docs")),
    )
    whole = Window.partitionBy("label")
    upto = whole.orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.select("label", "at", "asks", F.sum("n").over(upto).alias("n"), F.sum("docs").over(upto).alias("docs"), F.sum("n").over(whole).alias("all"))
    itself = (F.col("at") <= 0).cast("long")
    return counted.filter("asks").select(
        "label", (-F.col("at")).alias("slack"), (F.col("n") - itself).alias("sure_texts"), F.col("docs").alias("sure_docs"), (F.col("all") - F.col("n") - (1 - itself)).alias("open_texts")
    )


def _rest(rows: DataFrame) -> DataFrame:
    """Links among nodes that slacks leave open. Two nodes that are not negative are sure, so only blocks of negative
    nodes meet all blocks."""
    low = F.col("slack") < 0
    count = lambda of: _n_blocks(F.count_if(of), F.coalesce(F.sum(F.when(of, F.col("n_bytes"))), F.lit(0)))
    sizes = written(rows.groupBy("label").agg(count(low).alias("n_low"), count(~low).alias("n_high")), "rest-sizes")
    # A hash other than the one that dealt the first blocks, which all of a block's nodes agree in.
    draw = F.xxhash64("node", F.lit(1))
    block = F.when(low, F.pmod(draw, F.col("n_low"))).otherwise(F.col("n_low") + F.pmod(draw, F.greatest("n_high", F.lit(1))))
    last = F.when(low, F.col("n_low") + F.col("n_high") - 1).otherwise(F.col("n_low") - 1)
    met = rows.join(sizes, "label").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    return _grouped(met.select("label", "first", "second", "block", "node", "slack", "n_copies", "text"), "label", _undecided, "a long, b long, n_texts long, n_docs long")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one that names it, with all its columns; texts without words all stay."""
    keepers = join(docs).filter("keeper").groupBy(row_id().alias("k0"), F.col("text_key").alias("k1"))
    keepers = written(keepers.agg((F.max("has_words") & (F.count(F.lit(1)) > 1)).alias("once")), "keepers")
    return keep_rows(docs, [row_id(), F.xxhash64(text_of("text"))], keepers)
