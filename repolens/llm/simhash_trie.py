"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints: lower-cased words, shingles of `width` words with repeats, XXH64 with seed 42 of each, a bit set if it
is set in over half of them. Equal fingerprints are one entry. Entries that differ in at most `budget` (3) bits agree
on at least one of `budget` + 1 equal blocks of their bits, so each entry goes to the (four) tries of its block values.
A trie with more than `trie_size` entries is split the same way on the bits that are left: pairs in it still agree on
one of as many blocks of those. At budget 3 sixteen, twelve, nine ... bits go at each level, so after a few levels no
trie can be larger.

Inside a trie pairs of nodes are walked down together from the root: both children of a node with each other and
with the children of its partner, one more error for unequal bits, and a pair is dropped when its errors exceed the
budget. Linked entries are joined to classes at once; a trie returns one row per entry that is linked, never all
pairs. Classes of all tries meet in connected components over entries.

Null text is the empty text (fingerprint 0); rows with null doc_id belong to their class but cannot name it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolens.operators.graphs import connected_components

from .common import join_spread, shuffle_width, stored
from .exact_dedup import chosen_rows
from .tokens import release, slices

BUDGET = 3
TRIE_SIZE = 4096
#: Most paths of a level, each a mask in the plan: eight levels at budget 3, five at budget 8.
PATHS = 1 << 16
#: Node pairs that a walk holds at a time for each bit of depth.
WALK_PAIRS = 1 << 19
#: Entries whose tries are walked together.
WALK_ENTRIES = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        last = len(words) - width + 1
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for a, b in slices(len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[a:b].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, more): the bits as a signed long, and columns that go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return read.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{c} {read.schema[c].dataType.simpleString()}" for c in more)]))


def block_levels(budget: int = BUDGET) -> Iterator[list[tuple[int, int]]]:
    """For each level and path (the block taken at each level) the mask of matched bits and of those left."""
    now = [(0, (1 << 64) - 1)]
    while True:
        following = []
        for matched, left in now:
            bits = [i for i in range(64) if left >> i & 1]
            for part in np.array_split(np.array(bits, np.int64), budget + 1):
                mask = sum(1 << int(i) for i in part)
                following.append((matched | mask, left & ~mask))
        yield (now := following)


def block_masks(levels: int, budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """The first `levels` of `block_levels`."""
    return list(islice(block_levels(budget), levels))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tries(entries: DataFrame, trie_size: int = TRIE_SIZE, budget: int = BUDGET) -> DataFrame:
    """(fp, trie): the tries that each distinct `fp` belongs to, split above `trie_size` entries for as many levels as `PATHS` allows."""
    last = max(1, int(math.log(PATHS, budget + 1) + 1e-9) if budget else 1) - 1
    rows = entries.select("fp", F.lit(0).alias("path"))
    done = None
    for level, paths in enumerate(block_levels(budget)):
        of_path = F.array(*[F.lit(signed(m)) for m, _ in paths])
        blocks = F.sequence(F.col("path") * (budget + 1), F.col("path") * (budget + 1) + budget)
        rows = rows.select("fp", F.explode(blocks).alias("path"))
        value = F.col("fp").bitwiseAND(F.element_at(of_path, F.col("path") + 1))
        rows = rows.select("fp", "path", F.xxhash64(F.lit(level), "path", value).alias("trie"))
        large = stored(rows.groupBy("trie").agg(F.count("*").alias("n")).where(F.col("n") > trie_size).select("trie"), "large-tries")
        if large.isEmpty() or level == last:
            part, rows = rows, None
        else:
            # more than trie_size entries each: at most entries * (budget + 1) ** level / trie_size of them, so plain joins with AQE
            part = rows.join(large, "trie", "left_anti")
            rows = stored(rows.join(large, "trie", "left_semi").select("fp", "path"), "large-trie-rows")
        part = part.select("fp", "trie")
        done = part if done is None else done.unionByName(part)
        if rows is None:
            return done


def walk(fps: np.ndarray, roots: list[tuple[int, int]], budget: int = BUDGET) -> np.ndarray:
    """Class (smallest index) of each entry; `roots` are ranges of sorted distinct fingerprints, one per trie."""
    n = len(fps)
    parent = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        while True:
            pa_, pb = parent[a], parent[b]
            open_ = pa_ != pb
            if not open_.any():
                return
            a, b, pa_, pb = a[open_], b[open_], pa_[open_], pb[open_]
            low, high = np.minimum(pa_, pb), np.maximum(pa_, pb)
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up

    ones = {}
    for depth in range(64):
        ones[depth] = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int32)
    first = np.array(roots, np.int64).reshape(-1, 2)
    # a pair of nodes: ranges [a, b) and [c, d) of entries with equal first bits up to their errors
    stack = [(0, first[:, 0], first[:, 1], first[:, 0], first[:, 1], np.zeros(len(first), np.int8))]
    while stack:
        depth, a, b, c, d, errors = stack.pop()
        if len(a) > WALK_PAIRS:
            half = len(a) // 2
            stack += [(depth, *(x[:half] for x in (a, b, c, d, errors))), (depth, *(x[half:] for x in (a, b, c, d, errors)))]
            continue
        if depth == 64:
            join(a, c)
            continue
        bit = ones[depth]
        middle, centre = b - (bit[b] - bit[a]), d - (bit[d] - bit[c])
        same = a == c
        parts = [
            (a, middle, c, centre, errors), (middle, b, centre, d, errors), (a, middle, centre, d, errors + 1),
            tuple(x[~same] for x in (middle, b, c, centre, errors + 1)),
        ]
        a, b, c, d, errors = (np.concatenate(x) for x in zip(*parts))
        # drop empty nodes, pairs beyond the budget and a single entry with itself
        keep = (a < b) & (c < d) & (errors <= budget) & ~((a == c) & (b - a == 1))
        # single entries need no walk: their remaining bits are counted at once
        alone = keep & (b - a == 1) & (d - c == 1)
        if alone.any():
            x, y = a[alone], c[alone]
            near = np.bitwise_count(fps[x] ^ fps[y]) <= budget
            join(x[near], y[near])
        keep &= ~alone
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in (a, b, c, d, errors))))
    return parent


def linked_entries(entries: DataFrame, budget: int = BUDGET, trie_size: int = TRIE_SIZE) -> DataFrame:
    """(fp, other): a link from each linked entry to one of its class, per trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def classes(t: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(t)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(t)]])
            several = ends - starts > 1
            if not several.any():
                return
            label = walk(f, list(zip(starts[several].tolist(), ends[several].tolist())), budget)
            moved = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(f[moved].view(np.int64)), pa.array(f[label[moved]].view(np.int64))], names=["fp", "other"])

        for batch in batches:
            held_t = np.concatenate([held_t, batch.column(0).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            if len(held_t) >= WALK_ENTRIES:
                whole = int(np.searchsorted(held_t, held_t[-1]))  # the last trie may go on
                if whole:
                    yield from classes(held_t[:whole], held_f[:whole])
                    held_t, held_f = held_t[whole:], held_f[whole:]
        if len(held_t):
            yield from classes(held_t, held_f)

    # bits as an unsigned number: the sign bit is flipped for the sort
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))
    placed = tries(entries, trie_size, budget).repartition(shuffle_width(entries.sparkSession), "trie").sortWithinPartitions("trie", order)
    return placed.select("trie", "fp").mapInArrow(run, "fp long, other long")


def classes_of(entries: DataFrame, budget: int = BUDGET, trie_size: int = TRIE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(fp, component) of the linked entries and the links (fp, other) that make them."""
    links = stored(linked_entries(entries, budget, trie_size).where("fp <> other").distinct(), "links")
    ends = links.select("fp").union(links.select("other"))
    parts = connected_components(
        ends.distinct().select(F.lit("").alias("repo_hash"), F.col("fp").alias("node")),
        links.select(F.lit("").alias("repo_hash"), F.col("fp").alias("a"), F.col("other").alias("b")),
    ).select(F.col("node").alias("fp"), "component")
    return parts, links


def distinct_documents(docs: DataFrame, width: int = 3, budget: int = BUDGET, trie_size: int = TRIE_SIZE) -> DataFrame:
    """One row of each class, all columns: the smallest doc_id (null last), of its texts the longest, then the smallest SHA-256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text, 256)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.length(text).alias("n_chars"), digest.alias("digest"))
    rows = stored(fingerprints(keyed, width, ["n_chars", "digest"]), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", (-F.col("n_chars")).alias("order"), "digest"))
    entries = stored(rows.groupBy("fp").agg(first.alias("first")), "entries")
    parts = stored(classes_of(entries, budget, trie_size)[0], "parts")
    linked = entries.join(parts, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first")
    alone = entries.join(parts, "fp", "left_anti").select("first")
    chosen = linked.unionByName(alone).select("first.doc_id", (-F.col("first.order")).alias("n_chars"), "first.digest")
    return chosen_rows(docs, digest, chosen)


def shingles(text: str | None, width: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def resembling(pairs: DataFrame, width: int, least: float, columns: Sequence[str], alike: bool) -> DataFrame:
    """`columns` of the rows of `pairs` whose `text` and `rep_text` have sets of word shingles with a Jaccard similarity of at least `least` (`alike`) or under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of_held = None, set()
        for batch in batches:
            keep = []
            for text, other in zip(batch.column("text"), batch.column("rep_text")):
                other = other.as_py()
                if other != held:
                    held, of_held = other, shingles(other, width)
                own = shingles(text.as_py(), width)
                keep.append((len(own & of_held) >= least * len(own | of_held)) == alike)
            rows = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in columns], names=list(columns))

    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in columns)
    return pairs.mapInArrow(run, schema)


def shingle_hashes(rows: DataFrame, width: int) -> DataFrame:
    """(class, row, n, token): the distinct hashed shingles of each text and their number; a text without words has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tokens, held = [], [], 0
            for i, text in enumerate(batch.column("text")):
                found = {xxhash.xxh64_intdigest(x, 42) for x in shingles(text.as_py(), width) or (b"",)}
                at.append(np.array([i, len(found)], np.int64))
                tokens.append(np.fromiter(found, np.uint64, len(found)).view(np.int64))
                held += len(found)
                if held >= WALK_ENTRIES or i == len(batch) - 1:
                    numbers, counts = np.array(at).T
                    which = pa.array(np.repeat(numbers, counts))
                    columns = [batch.column("class").take(which), batch.column("row").take(which), pa.array(np.repeat(counts, counts)), pa.array(np.concatenate(tokens))]
                    yield pa.RecordBatch.from_arrays(columns, names=["class", "row", "n", "token"])
                    at, tokens, held = [], [], 0

    return rows.select("class", "row", "text").mapInArrow(run, f"class {rows.schema['class'].dataType.simpleString()}, row long, n long, token long")


def shared_least(n: Column, other: Column, least: float) -> Column:
    """The tokens that sets of `n` and `other` tokens share at least when their similarity is `least`."""
    return F.ceil((n + other) * (least / (1 + least)) - 1e-9)


def rare_tokens(rows: DataFrame, width: int, least: float, rounds: int = 8) -> DataFrame:
    """(token, row, n, place): the shingles on which the rows (class, row, text) of a class that resemble each other meet.

    A row whose shingles in other rows are fewer than its smallest possible partner asks for resembles none; without it other
    shingles are those of one row alone, so this is repeated while it drops a tenth of the rows. Two sets that share s tokens
    share one of the first n - s + 1 of each in any common order. Here the rarest of the class come first: those of one
    row alone fill these places and meet nothing.
    """
    sizes = stored(rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1"), "row-counts")
    several = join_spread(rows, sizes.select("class"), "class", sizes, "n", "row")
    hashed = shingle_hashes(several, width).select("class", "row", "n", F.xxhash64("class", "token").alias("token"))
    tokens = stored(hashed, "shingles")
    while True:
        shared = stored(tokens.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1"), "shared-shingles")
        held = join_spread(tokens, shared, "token", shared, "rows", "row")
        counted = stored(tokens.groupBy("class", "row").agg(F.max("n").alias("n")), "open-row-sizes")
        smallest = stored(counted.groupBy("class").agg(F.count("*").alias("rows"), F.min("n").alias("smallest")), "smallest-rows")
        partner = F.greatest(F.col("smallest"), F.ceil(F.col("n") * least - 1e-9))
        asked = join_spread(counted, smallest.drop("rows"), "class", smallest, "rows", "row").select("row", shared_least(F.col("n"), partner, least).alias("asked"))
        open_ = held.groupBy("row").agg(F.count("*").alias("n_shared")).join(asked, "row").where("n_shared >= asked")
        rounds -= 1
        if not rounds or open_.count() > 0.9 * counted.count():
            break
        tokens = stored(held.drop("rows").join(open_.select("row"), "row", "left_semi"), "open-shingles")
    placed = held.join(open_, "row").withColumn("place", F.row_number().over(Window.partitionBy("row").orderBy("rows", "token")) + F.col("n") - F.col("n_shared"))
    return stored(placed.where("place <= n - asked + 1").select("token", "row", "n", "place"), "rare-shingles")


def near_pairs(met: DataFrame, least: float) -> DataFrame:
    """(row, head) with head < row: rows of `rare_tokens` that share a token at places which their sizes allow, once for each such token.

    A place asks for a partner of at most some size, so tokens are met by bands of sizes: rows of late places meet short rows alone.
    """
    step = max(-math.log(least), 0.2) / 4
    reach = math.ceil(-math.log(least) / step) + 1
    band = F.floor(F.log("n") / step).cast("int")
    sides = met.withColumn("band", band).withColumn("other", F.explode(F.sequence(F.col("band") - reach, F.col("band") + reach))).where("other >= 0")
    from_ = F.greatest(F.floor(F.exp(F.col("other") * step) - 1e-6), F.lit(1))
    sides = sides.where(F.col("place") <= F.col("n") - shared_least(F.col("n"), from_, least) + 1)
    heads = sides.select("token", F.col("other").alias("band"), F.col("band").alias("other"), F.col("row").alias("head"), F.col("n").alias("head_n"), F.col("place").alias("head_place"))
    asked = shared_least(F.col("n"), F.col("head_n"), least)
    near = (F.col("place") <= F.col("n") - asked + 1) & (F.col("head_place") <= F.col("head_n") - asked + 1)
    return sides.join(heads, ["token", "band", "other"]).where((F.col("head") < F.col("row")) & near).select("row", "head")


def settled(left: DataFrame, width: int, least: float) -> DataFrame:
    """`first` of the rows of `left` (class, first, text) that stay: in order, a row of a class goes if one that stays resembles it.

    Rows that resemble each other share a token (`rare_tokens`). A row that is first under all of its tokens stays, and those
    under its tokens that resemble it go; so a large group of copies meets its first row alone. Once few pairs are left under the
    tokens (or that does not lessen them) all that the places of their tokens allow are checked, and the same rounds run over the
    pairs that resemble each other.
    """
    # of equal texts the first decides for all; numbers in the order of the rows
    once = left.groupBy("class", F.col("first.digest").alias("digest")).agg(F.min("first").alias("first"), F.min_by("text", "first").alias("text"))
    rows = stored(once.orderBy("first").select("class", "first", "text", F.monotonically_increasing_id().alias("row")), "ordered-rows")

    def alike(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.distinct(), "pairs")
        sizes = stored(pairs.groupBy("head").agg(F.count("*").alias("n")), "pair-counts")
        heads = rows.select(F.col("row").alias("head"), F.col("class").alias("rep_class"), F.col("text").alias("rep_text"))
        both = join_spread(pairs.join(rows.select("row", "class", "text"), "row"), heads, "head", sizes, "n", "row")
        return resembling(both.where("class <=> rep_class"), width, least, ("row", "head"), True)

    met, checked, before, gone = rare_tokens(rows, width, least), False, None, None
    while True:
        groups = stored(met.groupBy("token").agg(F.count("*").alias("n"), F.min("row").alias("head")).where("n > 1"), "token-groups")
        total, pairs = groups.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
        if not total:
            return (rows if gone is None else rows.join(gone, "row", "left_anti")).select("first")
        if not checked and (pairs <= 8 * total or (before is not None and pairs > 0.9 * before)):
            found = stored(alike(near_pairs(met, least)), "alike")
            numbered = found.withColumn("token", F.monotonically_increasing_id())
            met, checked = stored(numbered.select("token", F.explode(F.array("head", "row")).alias("row")), "alike-rows"), True
            continue
        before = pairs
        led = join_spread(met, groups.select("token", "head"), "token", groups.select("token", "n"), "n", "row")
        behind = led.where("head < row").select("row").distinct()
        heads = stored(led.select("row").distinct().join(behind, "row", "left_anti"), "first-rows")
        leading = groups.join(heads.withColumnRenamed("row", "head"), "head", "left_semi").select("token", "head")
        below = join_spread(met, leading, "token", groups.select("token", "n"), "n", "row").where("head < row").select("row", "head")
        lost = stored((below if checked else alike(below)).select("row").distinct(), "lost-rows")
        gone = lost if gone is None else stored(gone.unionByName(lost), "gone-rows")
        met = stored(met.join(heads.unionByName(lost), "row", "left_anti"), "open-rows")


def distinct_resembling(
    docs: DataFrame, width: int = 2, budget: int = 8, shingle: int = 5, least: float = 0.8, rounds: int = 4, trie_size: int = TRIE_SIZE
) -> DataFrame:
    """`docs` without the rows that resemble one that stays: a Jaccard similarity of `least` over sets of `shingle` words.

    The tries propose classes; in each class rows are taken in order (doc_id, null last; longest text; SHA-256), and a row goes
    if one that stays resembles it, exactly checked on whole texts. The first `rounds` rows that stay meet all others of
    their class; what those leave is settled by a similarity join (`settled`). So no row goes without a resembling
    one that stays, and of two rows of a class that resemble each other one goes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text, 256)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.length(text).alias("n_chars"), digest.alias("digest"))
    rows = stored(fingerprints(keyed, width, ["n_chars", "digest"]), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", (-F.col("n_chars")).alias("order"), "digest").alias("first")
    entries = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(order).alias("first")), "entries")
    parts = stored(classes_of(entries.select("fp"), budget, trie_size)[0], "parts")
    # classes of one row stay as they are; the members of the others are few, and alone are read with their texts
    members = entries.join(parts, "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("class"), F.col("component").isNotNull().alias("linked"))
    many = stored(members.where("linked OR n > 1").select("fp", "class", "n"), "candidates")
    alone = members.where("NOT linked AND n = 1").select("first")
    sizes = stored(many.groupBy("class").agg(F.sum("n").alias("n")), "class-sizes")
    wanted = join_spread(rows, many.select("fp", "class"), "fp", many.select("fp", "n"), "n", "digest").select("class", order)
    texts = keyed.withColumn("own", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", (-F.col("n_chars")).alias("order"), "digest"))
    keys = stored(wanted.distinct().select("class", "first", F.col("first.digest").alias("key"), F.col("first.doc_id").alias("id")), "class-rows")
    same = (F.col("digest") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    left = stored(texts.join(keys.hint("merge"), same).select("class", "first", text.alias("text")).dropDuplicates(["class", "first"]), "class-texts")
    chosen = alone
    for _ in range(rounds):
        reps = left.groupBy("class").agg(F.min("first").alias("rep_first"), F.min_by("text", "first").alias("rep_text"))
        reps = stored(reps, "representatives")
        chosen = chosen.unionByName(reps.select(F.col("rep_first").alias("first")))
        pairs = join_spread(left, reps, "class", sizes, "n", "first").where(F.col("first") != F.col("rep_first"))
        left = stored(resembling(pairs, shingle, least, ("class", "first", "text"), False), "left-over")
        if left.isEmpty():
            break
    else:
        chosen = chosen.unionByName(settled(left, shingle, least))
    return chosen_rows(docs, digest, chosen.select("first.doc_id", (-F.col("first.order")).alias("n_chars"), "first.digest"))


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = BUDGET, trie_size: int = TRIE_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) of every row.

    `n_links` counts the rows that the tries return for its fingerprint, as entry or as head of a class in a trie. It is
    not the number of fingerprints in reach, and 0 for rows whose class is equal fingerprints alone.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    entries = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "entries")
    parts, links = classes_of(entries, budget, trie_size)
    ends = links.select("fp").union(links.select("other"))
    degree = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    known = stored(entries.join(parts, "fp").join(degree, "fp"), "linked")
    smallest = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = known.join(smallest, "component").select("fp", "component_id", "n_links")
    classes = entries.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return join_spread(rows, classes, "fp", entries.select("fp", "n"), "n", "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
