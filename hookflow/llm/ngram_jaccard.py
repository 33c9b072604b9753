"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set holds the hashes of its distinct five-word shingles. Two sets link when 100 * intersection >= 75 * union.
Three total orders of the tokens filter the candidates, and a pair must pass them all before its sets are intersected:

* by hash: of n tokens the first n - ceil(0.75 n) + 1 are indexed, and all below a fixed quarter of the hash space, so that
  the indexed part of any two sets covers the same range. Linked sets share an indexed token; more, of its k tokens in the
  quarter the smaller set shares all but n - ceil(6 n / 7), the most it may have for itself;
* by how many indexed sets hold a token, rarest first: if a set shares at least c of its s tokens that others hold, one of them is among
  its s - c + 1 rarest. The smaller set of a pair looks for partners by these only, and not at all if s < c. A passage
  that many documents share is therefore no candidate, however many hold it;
* by another hash: the prefixes under it must share a token too. They are made for the classes of pairs only and intersect the pairs
  before any two texts meet.

Buckets are never expanded into all pairs at once. Equal sets are one class from the start. Each class is first held
against one centre, the class of its buckets with which it shares most tokens; the centre of a bucket is the class
whose tokens are the most frequent, which of a group of near copies is the one the others were made from. Links of that
round contract most of each group. Only then are pairs taken whose classes still lie in different components;
pairs inside a component cannot change the result. For them the second order is taken again, over all tokens of the classes that
share a bucket with another component, and on both sides: the larger set, too, has a prefix that a linked set must meet, and at the first token that
two sets hold, enough must be able to follow. What a set shares with no other component counts against it, so variants too far
from their group ask for no partner. Before two texts meet, pairs are also held against parity bitmaps: each token
flips one bit, so two sets differ in at least as many tokens as their bitmaps do in bits.

Only indexed tokens of all documents are written, and they go once buckets are formed. What else a round needs of a class is made
anew from one of its texts; a bitmap of fixed size keeps the texts of other classes from being moved.

Buckets of frequent tokens, counted batch by batch, are formed by a pre-aggregated minimum that is joined back, so that the planner can
split them; all others by one sort. Set size and intersection are counted over 64-bit hashes, classes are named by 64 bits of a hash
of the whole set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hookflow.llm.common import components, discard, mix, pieces, shingle_set, sieved, utf8, written

THRESHOLD = 75  # per cent
# A token in so many documents of one batch of texts is reported as frequent. The reports of all batches are summed.
BATCH_FREQUENT = 8
# The most frequent tokens are sent to every task (8 bytes each), which sets them apart. Any choice gives the same result.
MAX_FREQUENT = 1 << 18
# Tokens of sets that a task of the exact test keeps for the next pairs.
KEPT_TOKENS = 1 << 20
# Tokens with hashes below this are always indexed: a quarter of them.
QUARTER = 1 << 62
SETS = "cls long, n long, comp long, halves array<int>"


def prefix_length(n: int, threshold: int = THRESHOLD) -> int:
    return n - -(-threshold * n // 100) + 1


def least_overlap(n: int, threshold: int = THRESHOLD) -> int:
    """How many tokens a set of n tokens shares with any linked set that is not smaller."""
    return -(-2 * threshold * n // (100 + threshold))


def linked(a: int, b: int, both: int, threshold: int = THRESHOLD) -> bool:
    return 100 * both >= threshold * (a + b - both)


def least_shared(n: int, below: int, threshold: int = THRESHOLD) -> int:
    """How many of its ``below`` tokens in the quarter a set of n tokens shares with any linked set that is not smaller."""
    return max(1, below - (n - least_overlap(n, threshold)))


def indexed(tokens: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, int]:
    """The indexed tokens of an ascending set, and how many of them lie in the quarter."""
    below = int(np.searchsorted(tokens, np.uint64(QUARTER)))
    return tokens[: max(below, prefix_length(len(tokens), threshold))], below


def other_prefix(tokens: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The prefix under the order by another hash."""
    length = prefix_length(len(tokens), threshold)
    if length >= len(tokens):
        return tokens
    return tokens[np.argpartition(mix(tokens), length - 1)[:length]]


def _class_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, tie, set size and class of each document; for each batch one more row with its frequent tokens."""
    for batch in pieces(batches):
        sets = [shingle_set(t or b"") for t in utf8(batch.column(2))]
        n = [len(s) for s in sets]
        frequent, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0))
        frequent, counts = frequent[counts >= BATCH_FREQUENT], counts[counts >= BATCH_FREQUENT]
        empty = pa.nulls(len(sets), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.nulls(1, pa.int64())]),
                pa.concat_arrays([batch.column(1), pa.nulls(1, pa.int64())]),
                pa.array([*n, None], pa.int64()),
                pa.array([*(_class_of(s) if len(s) else None for s in sets), None], pa.int64()),
                pa.concat_arrays([empty, pa.array([frequent.view(np.int64).tolist()], pa.list_(pa.int64()))]),
                pa.concat_arrays([empty, pa.array([counts.tolist()], pa.list_(pa.int64()))]),
            ],
            ["doc_id", "tie", "n_shingles", "cls", "frequent", "counts"],
        )


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens by their low bits, two bits or more for each token."""
    bits = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    parity = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of tokens in one of two sets only; the longer bitmap is folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    if len(x) != len(y):
        size = min(len(x), len(y))
        x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _prefixes(frequent, threshold: int):
    """For each document its class, set size, least shared tokens and indexed tokens, the frequent ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for batch in pieces(batches):
            rows = []
            for text in utf8(batch.column(0)):
                tokens = shingle_set(text or b"")
                if len(tokens):
                    index, below = indexed(tokens, threshold)
                    apart = _among(index, common)
                    need = least_shared(len(tokens), below, threshold)
                    rows.append((_class_of(tokens), len(tokens), need, index[~apart].view(np.int64), index[apart].view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *map(_lists, columns[3:])], ["cls", "n", "need", "rare", "common"])

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Of rows that end in a class and a text those whose text has that class, and the texts' sets."""
    for batch in pieces(batches):
        classes, texts = batch.column(batch.num_columns - 2).to_pylist(), utf8(batch.column(batch.num_columns - 1))
        sets = [shingle_set(t or b"") for t in texts]
        own = [len(s) > 0 and _class_of(s) == c for c, s in zip(classes, sets, strict=True)]
        yield batch.filter(pa.array(own, pa.bool_())), [s for s, kept in zip(sets, own, strict=True) if kept]


def _described(threshold: int):
    """Class, set size, bitmap, the low halves of the prefix under the other order, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _own(batches):
            n, bits = pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(bitmap, sets)), pa.binary())
            other = _lists([_halves(other_prefix(s, threshold)) for s in sets], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), n, bits, other, batch.column(1)], ["cls", "n", "bits", "other", "text"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, set size, component and the low halves of all tokens, of rows (component, class, text)."""
    for batch, sets in _own(batches):
        n, halves = pa.array(list(map(len, sets)), pa.int64()), _lists(list(map(_halves, sets)), np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(1), n, batch.column(0), halves], ["cls", "n", "comp", "halves"])


def _halves(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype(np.uint32).view(np.int32)


def _among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens an ascending array holds."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def _lists(arrays: list[np.ndarray], dtype=np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if len(arrays) else np.empty(0, dtype)))


def _near(threshold: int):
    """Keeps the pairs whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            # The union is half of sizes and difference together, the intersection what remains.
            keep = [(100 + threshold) * least_difference(b, d) <= (100 - threshold) * (a + c) + (100 + threshold) for a, c, b, d in zip(n, m, x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # sets of the last few classes; pairs come sorted by b
        kept = 0

        def described(cls: int, text: bytes) -> np.ndarray:
            nonlocal kept
            if cls not in known:
                tokens = shingle_set(text)
                kept += len(tokens)
                if kept > KEPT_TOKENS:
                    known.clear()
                    kept = len(tokens)
                known[cls] = tokens
            return known[cls]

        for batch in pieces(batches):
            us, vs = [], []
            a_ids, b_ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, a_text, b, b_text in zip(a_ids, utf8(batch.column(1)), b_ids, utf8(batch.column(3)), strict=True):
                b_set = described(b, b_text)
                a_set = shingle_set(a_text)
                x, y = sorted((len(a_set), len(b_set)))
                if 100 * x < threshold * y:
                    continue
                both = np.concatenate((a_set, b_set))
                both.sort()
                if linked(len(a_set), len(b_set), int((both[1:] == both[:-1]).sum()), threshold):
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _texts(docs: DataFrame, members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, wanted): the columns of ``classes``, which end in cls, and the text of one document of each class, taken by a hash of its
    doc_id and text; and the frame that names these documents, to be discarded once texts are read."""
    key = F.xxhash64("doc_id", "tie")
    wanted = written(members.join(classes, "cls").groupBy(*classes.columns).agg(F.min(key).alias("key")), "wanted")
    rows = sieved(docs.select(key.alias("key"), "text"), wanted, "key").dropDuplicates(["key"])
    # The same plan at every size: texts move once.
    return rows.hint("merge").join(wanted, "key").select(*classes.columns, "text"), wanted


def _links(pairs: DataFrame, docs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets link. The other order's prefixes and the bitmaps are met before any text."""
    texts, wanted = _texts(docs, members, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    sets = written(texts.mapInArrow(_described(threshold), "cls long, n long, bits binary, other array<int>, text string"), "sets")
    x, y = (sets.select(F.col("cls").alias(i), F.col("n").alias(f"n_{i}"), F.col("bits").alias(f"bits_{i}"), F.col("other").alias(f"other_{i}")) for i in "ab")
    both = pairs.join(x, "a").join(y, "b").where(F.arrays_overlap("other_a", "other_b")).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    near = written(both.mapInArrow(_near(threshold), "a long, b long"), "near")
    left = near.join(sets.select(F.col("cls").alias("a"), F.col("text").alias("a_text")), "a")
    full = left.join(sets.select(F.col("cls").alias("b"), F.col("text").alias("b_text")), "b")
    links = written(full.select("a", "a_text", "b", "b_text").mapInArrow(_verify(threshold), "u long, v long"), "links")
    discard(near, wanted, sets)
    return links


def _candidates(sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a below b: classes of different components whose prefixes, rarest tokens first, share a token far enough ahead.

    ``sets`` holds cls, n, comp and all tokens (``halves``). Two tokens of one set with equal low halves stay two rows: an upper bound of
    what the set shares, never less. Only tokens in two components or more count; what a set shares with a linked one is among them.
    """
    tokens = written(sets.select("cls", "n", "comp", F.explode("halves").alias("token")), "tokens")
    buckets = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("df"))
    need = F.expr(f"({2 * threshold} * n + {99 + threshold}) div {100 + threshold}")
    across = tokens.join(buckets.where("lo <> hi").select("token", "df"), "token").withColumns({"need": need, "usable": F.lit(True)})
    # The larger set of a pair shares at least the threshold's part of its own tokens.
    most = F.expr(f"nth <= s - ({threshold} * n + 99) div 100 + 1")
    across = written(_asking(across, "comp").withColumn("offers", most).where("asks or offers"), "across")
    discard(tokens)
    x = across.where("asks").select("token", *(F.col(c).alias(f"{c}_a") for c in ("cls", "n", "s", "nth", "comp")))
    y = across.where("offers").select(F.col("token").alias("token_b"), *(F.col(c).alias(f"{c}_b") for c in ("cls", "n", "s", "nth", "comp")))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") != F.col("cls_b")))
    fits = smaller & (100 * F.col("n_a") >= threshold * F.col("n_b")) & (F.col("comp_a") != F.col("comp_b"))
    # At the first token that both hold, no more than the rest of either set can follow.
    rest = F.least(F.col("s_a") - F.col("nth_a"), F.col("s_b") - F.col("nth_b")) + 1
    enough = (100 + threshold) * rest >= threshold * (F.col("n_a") + F.col("n_b"))
    pairs = x.join(y, (F.col("token") == F.col("token_b")) & fits & enough)
    return written(pairs.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct(), "pairs")


def _profiled(docs: DataFrame) -> DataFrame:
    layout = "doc_id long, tie long, n_shingles long, cls long, frequent array<long>, counts array<long>"
    return written(docs.select("doc_id", "tie", "text").mapInArrow(_profile, layout), "profile")


def _prepared(docs: DataFrame, profile: DataFrame, threshold: int) -> DataFrame:
    reported = profile.where("frequent is not null").select(F.explode(F.arrays_zip("frequent", "counts")).alias("t"))
    counted = reported.groupBy(F.col("t.frequent").alias("token")).agg(F.sum("t.counts").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toPandas()
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(top["token"].to_numpy(np.int64).view(np.uint64)))
    layout = "cls long, n long, need long, rare array<long>, common array<long>"
    return written(docs.select("text").mapInArrow(_prefixes(frequent, threshold), layout), "prefixes")


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))


def jaccard_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, tie (xxhash64 of the text), n_shingles, comp, component_id for every row of ``docs``; comp names the component, null for an empty set.

    Reads doc_id and text only; other columns, whatever their names, are ignored. Null, empty or blank text: an empty
    set that links with nothing, n_shingles 0, component_id the row's own doc_id. Repeated rows come back as often as they
    came. Rows with a null doc_id take part; a component_id is the smallest non-null doc_id of the component. Texts
    of one doc_id that differ are documents of their own; a shared doc_id is no link. An empty table gives no rows.
    """
    docs = _plain(docs)
    profile = _profiled(docs)
    members = profile.where("frequent is null").select("doc_id", "tie", "n_shingles", "cls")
    prefixes = _prepared(docs, profile, threshold)
    columns = ("token", "cls", "n", "need", "df")
    bucket = Window.partitionBy("token")
    rare = prefixes.select("cls", "n", "need", F.explode("rare").alias("token"))
    rare = rare.withColumns({"lo": F.min("cls").over(bucket), "hi": F.max("cls").over(bucket), "df": F.count(F.lit(1)).over(bucket)})
    common = prefixes.select("cls", "n", "need", F.explode("common").alias("token"))
    buckets = common.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("df"))
    shared = rare.where("lo <> hi").select(*columns).unionByName(common.join(buckets.where("lo <> hi"), "token").select(*columns))
    # Copies of one set are one entry of a bucket. A need of more than one counts tokens in the quarter only.
    shared = shared.distinct().withColumn("usable", F.expr(f"need = 1 or token between 0 and {QUARTER - 1}"))
    shared = written(_asking(shared), "shared")
    discard(prefixes)

    star = written(_to_centres(shared), "star")
    first = _links(star, docs, members, threshold)
    labels = components(first)

    # A class whose bucket mates are all in its component by now has nothing left to ask.
    comp = labels.select(F.col("id").alias("cls"), F.col("component").alias("comp"))
    known = shared.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    known = written(known.select("token", "cls", "n", "comp", "asks"), "known")
    discard(shared)
    sizes = F.min(F.when(F.col("asks"), F.col("n"))).alias("least"), F.max(F.when(F.col("asks"), F.col("n"))).alias("most")
    open_buckets = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *sizes)
    open_buckets = open_buckets.where("lo <> hi and least is not null").select("token", "least", "most")
    # Only classes of a size that one of the bucket asks for; those that ask are among them.
    met = known.join(open_buckets, "token").where(f"n >= least and {threshold} * n <= 100 * most")
    texts, wanted = _texts(docs, members, met.select("comp", "cls").distinct())
    discard(known)
    pairs = _candidates(texts.mapInArrow(_whole, SETS), threshold)
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _links(pairs.join(tested, ["a", "b"], "left_anti"), docs, members, threshold)
    discard(wanted, star, pairs)

    # Labels of the first round stand for its links.
    labelled = components(labels.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(second))
    full, empty = members.where("cls is not null"), members.where("cls is null")
    lowest = full.groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = lowest.join(labelled.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    component_ids = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = named.join(component_ids, "comp").select("cls", "comp", "component_id")
    # Empty sets have no class; joined on it they would all go to one task.
    alone = empty.select("doc_id", "tie", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    grouped = full.join(by_class, "cls").select("doc_id", "tie", "n_shingles", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for every row of ``docs``; odd rows as in ``jaccard_groups``."""
    return jaccard_groups(docs, threshold).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(links, members): the links (a, b) between classes of equal sets, and doc_id, n_shingles, cls, links (of the class to others) of every row.

    Every link between different sets comes, those inside one component too, so the work grows with the pairs of a group of variants, unlike that of
    ``jaccard_groups``. Rows of one class link with each other too; these links are not listed. Odd rows as in ``jaccard_groups``; an empty set has no class.
    """
    docs = _plain(docs)
    profile = _profiled(docs)
    members = profile.where("frequent is null").select("doc_id", "tie", "n_shingles", "cls")
    own = F.col("cls").alias("comp")
    texts, wanted = _texts(docs, members, members.where("cls is not null").select(own, "cls").distinct())
    pairs = _candidates(texts.mapInArrow(_whole, SETS), threshold)
    links = _links(pairs, docs, members, threshold)
    discard(wanted, pairs)
    counts = links.select(F.explode(F.array("u", "v")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    full, empty = members.where("cls is not null"), members.where("cls is null")
    counted = full.join(counts, "cls", "left").select("doc_id", "n_shingles", "cls", F.coalesce("links", F.lit(0)).alias("links"))
    members = counted.unionByName(empty.select("doc_id", "n_shingles", "cls", F.lit(0).cast("long").alias("links")))
    return links.select(F.col("u").alias("a"), F.col("v").alias("b")), members


def _asking(rows: DataFrame, *others: str) -> DataFrame:
    """Marks what the smaller set of a pair looks for partners by: of its s usable tokens that others hold the s - need + 1 rarest.
    Also sums up how frequent a class's tokens are."""
    own = Window.partitionBy("cls")
    nth = F.row_number().over(own.orderBy(F.desc("usable"), "df", "token"))
    counted = rows.withColumns({"s": F.count_if("usable").over(own), "nth": nth, "score": F.sum("df").over(own)})
    return counted.select("token", "cls", "n", *others, "s", "nth", "score", F.expr("usable and nth <= s - need + 1").alias("asks"))


def _to_centres(rows: DataFrame) -> DataFrame:
    """(a, b): each asking class with that centre of its buckets it shares most tokens with."""
    asking = rows.where("asks").select("token", "cls")
    centres = rows.groupBy("token").agg(F.max(F.struct("score", "cls")).alias("best"), F.max("asks").alias("asked"))
    centres = centres.where("asked").select("token", F.col("best.cls").alias("centre"))
    votes = asking.join(centres, "token").where("cls <> centre").groupBy("cls", "centre").agg(F.count(F.lit(1)).alias("votes"))
    star = votes.groupBy("cls").agg(F.max(F.struct("votes", "centre")).alias("best"))
    return star.select(F.col("cls").alias("a"), F.col("best.centre").alias("b"))
