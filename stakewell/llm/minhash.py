"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its five-word shingles (weight: how often it
holds them; a text of fewer words is one shingle). Darts are thrown into the
plane of weight and rank over each shingle: the darts of a region are a fixed
function of shingle and region, so equal regions of two documents hold equal
darts. A document keeps the darts under its weights and under a rank that gives
DARTS of them whatever its size, and for each of COORDINATES coordinates the dart
of least rank. Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. Bands of ROWS coordinates are joined.

From bands to classes without all pairs of a band's group:

1. Documents with equal words are one text; only the texts that share a band go on.
2. In each band group every text is compared, by its exact similarity, with the
   group's leader: the text that most texts share bands with. Links are
   contracted to classes.
3. Groups that still hold several classes are compared in tiles of at most TILE texts and TILE_ELEMENTS
   shingles, by matrix products; only links come out, and a group's largest class isn't compared with itself. Texts whose
   unshared shingles exceed what a similar pair leaves over are left out before, and so are groups that hold the same texts as another.

Null and empty texts have no shingles: each is a class of its own. Rows that
share a doc_id but not the text are different documents; repeated rows are
copies. A null doc_id takes part (its class is named by the least id, nulls
last). Very long texts are sketched whole, alone in their slice. Of ties (equal ids and texts) all rows are kept by `near_duplicates`, one by `deduplicated`. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, discard, folder_of, fresh, give_back, joined, mix, slices, small, span_hashes, text_batches, word_spans, written

SIMILARITY = 0.8
SHINGLE = 5
ROWS = 6
BANDS = 40
COORDINATES = ROWS * BANDS
#: Darts a document keeps: COORDINATES * (ln COORDINATES + 5), so that an empty coordinate is a matter of e**-5.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 5))
#: Texts and elements of a tile.
TILE = 256
TILE_ELEMENTS = 1 << 18
#: Characters of texts that are worked on at once.
SLICE = 200_000
#: Ranks are cut into [0, 2**FIRST), [2**FIRST, 2**(FIRST+1)), ...
FIRST = -6
_GOLD = 0x9E3779B97F4A7C15


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of lower-cased texts, the text of each, and a hash of each text's word sequence (0: no words)."""
    data, at = joined([t.lower() for t in texts])
    starts, ends = word_spans(data, WORD_BYTE)
    words = span_hashes(data, starts, ends)
    of = np.searchsorted(at, starts, "right") - 1
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        place = (np.arange(len(words)) - first[of]).astype(np.uint64)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + place * np.uint64(_GOLD)), dtype=np.uint64, out=sums[1:])
        whole = np.where(n > 0, mix(sums[first + n] - sums[first] + n.astype(np.uint64)), np.uint64(0))
        short = (n > 0) & (n < SHINGLE)
        begins = np.flatnonzero(np.arange(len(words)) - first[of] <= n[of] - SHINGLE) if len(words) else np.zeros(0, np.int64)
        got = np.zeros(len(begins), np.uint64)
        for k in range(SHINGLE):
            got = mix(got + words[begins + k] + np.uint64(k + 1))
    who = of[begins]
    if short.any():
        got, who = np.concatenate([got, whole[short]]), np.concatenate([who, np.flatnonzero(short)])
        order = np.argsort(who, kind="stable")
        got, who = got[order], who[order]
    return got, who, whole


def weighed(got: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts."""
    order = np.lexsort((got, who))
    got, who = got[order], who[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    return got[at], who[at], np.diff(np.append(at, len(got)))


def elements(got: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One element for each unit of weight, so that weighted similarity is that of plain sets."""
    s, w, n = weighed(got, who)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        return mix(np.repeat(s, n) + nth.astype(np.uint64) * np.uint64(_GOLD)), np.repeat(w, n)


def _poisson(area: float) -> np.ndarray:
    """Upper bounds of a uniform number for 0, 1, 2, ... darts."""
    n = int(area + 12 * np.sqrt(area) + 20)
    k = np.arange(n)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    return np.minimum(np.cumsum(np.exp(k * np.log(area) - area - logs)), 1.0)


_TABLES: dict[float, np.ndarray] = {}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(s: np.ndarray, who: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """(texts, COORDINATES) dart names; rows of texts without shingles are 0."""
    total = np.bincount(who, weight, minlength=texts)
    reach = np.divide(DARTS, total, out=np.zeros(texts), where=total > 0)
    out = np.zeros((texts, COORDINATES), np.uint64)
    need = np.flatnonzero(total > 0)
    while len(need):
        mine = np.zeros(texts, bool)
        mine[need] = True
        pick = mine[who]
        a, b, w = s[pick], who[pick], weight[pick].astype(np.float64)
        names, owner, ranks, coords = [], [], [], []
        level = 0
        while True:
            low, high = (0.0 if level == 0 else 2.0 ** (FIRST + level - 1)), 2.0 ** (FIRST + level)
            some = reach[b] > low
            if not some.any():
                break
            a2, b2, w2 = a[some], b[some], w[some]
            floor = 0
            while len(a2):  # regions of weight: [0, 1), [1, 2), [2, 4), ...
                left, right = (0.0 if floor == 0 else 2.0 ** (floor - 1)), 2.0**floor
                area = (high - low) * (right - left)
                # Regions of large area are cut into cells of at most 64 darts each.
                cells = max(1, int(np.ceil(area / 64)))
                bounds = _TABLES.setdefault(area / cells, _poisson(area / cells))
                for cell in range(cells):
                    with np.errstate(over="ignore"):
                        seed = mix(a2 + np.uint64((level * 64 + floor) * 4096 + cell + 1) * np.uint64(_GOLD))
                        n = np.searchsorted(bounds, _unit(seed), "right")
                        k = np.flatnonzero(n)
                        n = n[k]
                        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        k = np.repeat(k, n)
                        dart = mix(seed[k] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(_GOLD))
                        at_weight = left + (right - left) * _unit(mix(dart + np.uint64(1)))
                        rank = low + (high - low) * (cell + _unit(mix(dart + np.uint64(2)))) / cells
                    good = (at_weight < w2[k]) & (rank < reach[b2[k]])
                    names.append(dart[good])
                    owner.append(b2[k[good]])
                    ranks.append(rank[good])
                more = w2 > right
                a2, b2, w2 = a2[more], b2[more], w2[more]
                floor += 1
            level += 1
        name, own, rank = np.concatenate(names), np.concatenate(owner), np.concatenate(ranks)
        cell = own * COORDINATES + ((name >> np.uint64(20)) % np.uint64(COORDINATES)).astype(np.int64)
        order = np.lexsort((name, rank))[::-1]
        flat = np.zeros(texts * COORDINATES, np.uint64)
        flat[cell[order]] = name[order] | np.uint64(1)  # the last write is the least rank
        flat = flat.reshape(texts, COORDINATES)
        done = need[(flat[need] != 0).all(1)]
        out[done] = flat[done]
        need = np.setdiff1d(need, done)
        reach[need] *= 2
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), whole (of the words), check (a second one), n (weight), bands: list of BANDS band names (empty: no shingles)."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for first, last in slices(texts, SLICE):
                part = texts[first:last]
                got, who, whole = shingles(part)
                s, w, n = weighed(got, who)
                sig = signatures(s, w, n, len(part))
                with np.errstate(over="ignore"):
                    rows = sig.reshape(len(part), BANDS, ROWS)
                    band = np.zeros(rows.shape[:2], np.uint64)
                    for k in range(ROWS):
                        band = mix(band + rows[:, :, k] + np.uint64(k + 1))
                    band = mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(_GOLD))
                    second = np.zeros(len(part), np.uint64)
                    np.add.at(second, w, mix(s + np.uint64(77)) * n.astype(np.uint64))
                total = np.bincount(w, n, minlength=len(part)).astype(np.int64)
                size = np.where(total > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(_signed(band[total > 0].reshape(-1))))
                yield pa.record_batch([b.column("id").slice(first, last - first), b.column("th").slice(first, last - first), pa.array(_signed(whole)), pa.array(_signed(second)), pa.array(total), lists], names=["id", "th", "whole", "check", "n", "bands"])
                del got, who, whole, s, w, n, sig, rows, band, second
            give_back()

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(run, "id long, th long, whole long, check long, n long, bands array<long>")


def element_lists(texts: DataFrame) -> DataFrame:
    """key, elements (sorted) of the rows of texts (key, whole, text) whose word sequence is the one looked for."""

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            want = b.column("whole").to_numpy()
            for first, last in slices(texts, SLICE):
                got, who, whole = shingles(texts[first:last])
                e, w = elements(got, who)
                order = np.lexsort((e, w))
                n = np.bincount(w, minlength=last - first)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(_signed(e[order])))
                rows = pa.record_batch([b.column("key").slice(first, last - first), lists], names=["key", "elements"])
                yield rows.filter(pa.array(_signed(whole) == want[first:last]))
                del got, who, whole, e, w, order
            give_back()

    text_batches(texts.sparkSession)
    return texts.select("key", "whole", "text").mapInArrow(run, "key long, elements array<long>")


def components(links: DataFrame) -> DataFrame:
    """v, root: the least vertex of each component of links (a, b) for every other vertex of it, by large-star and small-star steps until nothing changes."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    before = None
    while True:
        # Large star: neighbours above a vertex link to its least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a vertex and its smaller neighbours link to the least of them.
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(m, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        old, edges = folder_of(edges), written(small_.filter("u <> v").distinct(), "cc")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = now


def _compare(left: list, right: list | None) -> np.ndarray:
    """Shared elements of each text of left with each of right (of left itself, if None), by matrix products."""
    lists = left + (right or [])
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.unique(np.concatenate(lists), return_inverse=True)[1]
    keep = np.bincount(column)[column] > 1  # an element of one text adds nothing
    column, row = np.unique(column[keep], return_inverse=True)[1], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    n = len(left)
    shared = np.zeros((n, len(right) if right else n), np.float32)
    for k in range(0, int(column.max(initial=-1)) + 1, 4096):
        block = np.zeros((len(lists), 4096), np.float32)
        a, z = np.searchsorted(column, (k, k + 4096))
        block[row[a:z], column[a:z] - k] = 1
        shared += block[:n] @ (block[n:] if right else block).T
    return shared


def _tiles(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Links (a, b) between texts of different classes in the same group; members: grp, key, cls, n.

    The largest class of a group need not be compared with itself: the others are cut into tiles that meet one another, and
    meet each slice of the largest class.
    """
    counts = members.groupBy("grp", "cls").agg(F.count("*").alias("c"), F.sum("n").alias("e"))
    main = counts.groupBy("grp").agg(F.max(F.struct("c", "cls", "e")).alias("m"), F.sum("c").alias("c"), F.sum("e").alias("e"))
    parts = lambda c, e: F.greatest(F.ceil(c / TILE), F.ceil(e / TILE_ELEMENTS)).cast("int")
    main = main.select("grp", "c", "e", F.col("m.cls").alias("main"), parts(F.col("m.c"), F.col("m.e")).alias("slices"), parts(F.col("c") - F.col("m.c"), F.col("e") - F.col("m.e")).alias("tiles"))
    rows = members.join(small(written(main, "dart-main")), "grp")
    in_main = F.col("cls") == F.col("main")
    mine = F.pmod(F.xxhash64("key"), F.when(in_main, F.col("slices")).otherwise(F.col("tiles"))).cast("int")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_main = F.transform(upto(F.col("slices")), lambda k: cell(0, mine, k, F.lit(0)))
    with_others = F.transform(upto(F.col("tiles")), lambda t: cell(1, F.least(t, mine), F.greatest(t, mine), mine > t))
    # A group that fits one tile is one cell.
    fits = (F.col("c") <= TILE) & (F.col("e") <= TILE_ELEMENTS)
    cells = F.when(fits, F.array(cell(1, F.lit(0), F.lit(0), F.lit(0)))).when(in_main, F.transform(upto(F.col("tiles")), lambda t: cell(0, t, mine, F.lit(1)))).otherwise(F.concat(with_main, with_others))
    rows = rows.withColumn("cell", F.explode(cells)).select("grp", "cell.*", "key", "cls").join(lists, "key")

    def compare(pdf):
        import pandas as pd

        first, second = (pdf[pdf["side"] == k] for k in (0, 1))
        same = bool(pdf["kind"].iloc[0] == 1 and pdf["i"].iloc[0] == pdf["j"].iloc[0])
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(first) or not (same or len(second)):
            return none
        second = first if same else second
        shared = _compare(first["elements"].to_list(), None if same else second["elements"].to_list())
        total = first["elements"].map(len).to_numpy()[:, None] + second["elements"].map(len).to_numpy()[None, :] - shared
        (ka, ca), (kb, cb) = ((f["key"].to_numpy(), f["cls"].to_numpy()) for f in (first, second))
        i, j = np.nonzero((shared >= SIMILARITY * total - 1e-6) & (ca[:, None] != cb[None, :]))
        give_back()
        if not len(i):
            return none
        # Links beyond one for two classes say nothing new.
        one = np.unique(np.stack([np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])]), axis=1, return_index=True)[1]
        return pd.DataFrame({"a": ka[i][one], "b": kb[j][one]})

    return rows.groupBy("grp", "kind", "i", "j").applyInPandas(compare, "a long, b long")


def _distinct_groups(rows: DataFrame) -> DataFrame:
    """The rows of one group of each set of members: copies collide in many bands alike."""
    sets = rows.groupBy("grp").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"), F.min("key").alias("k"))
    one = written(sets.groupBy("c", "x", "y", "k").agg(F.min("grp").alias("grp")).select("grp"), "dart-sets")
    return rows.join(small(one), "grp", "left_semi")


def classes(docs: DataFrame) -> DataFrame:
    """id, th (hash of the text), least (of the class: whether its id is null, id, th), size (of the class) of every row of docs; null without shingles."""
    sketched = written(sketch(docs), "dart-sketch")
    # Equal words are one text: its key is a hash of both its hashes.
    key = F.xxhash64("whole", "check")
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("least")
    texts = sketched.filter("n > 0").groupBy(key.alias("key")).agg(least, F.count("*").alias("copies"), F.first("whole").alias("whole"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = written(texts, "dart-texts")
    bands = texts.select("key", F.explode("bands").alias("grp"))
    sizes = bands.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1")
    # What is joined by group is stored before: so a group that holds a third of all texts can be split between tasks.
    groups = written(bands.join(written(sizes, "dart-sizes"), "grp"), "dart-groups")
    # How many texts share bands with a text: the leader of a group is the one with the most.
    met = groups.groupBy("key").agg(F.sum("size").alias("met"))
    met = written(texts.select("key", "n", F.col("least.id").alias("wid"), "whole").join(met, "key"), "dart-met")
    wanted = met.select("key", "wid", "whole")
    of_text = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("text")).join(small(wanted), F.col("doc").eqNullSafe(F.col("wid")))
    lists = written(element_lists(of_text).groupBy("key").agg(F.first("elements").alias("elements")), "dart-elements")
    members = groups.select("grp", "key").join(met.select("key", "n", "met"), "key")
    leaders = members.groupBy("grp").agg(F.max(F.struct("met", "key", "n")).alias("l")).select("grp", F.col("l.key").alias("lead"), F.col("l.n").alias("lead_n"))
    stars = members.join(written(leaders, "dart-leaders"), "grp").filter(f"key <> lead AND least(n, lead_n) >= {SIMILARITY} * greatest(n, lead_n) - 1e-9")
    stars = stars.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
    left, right = (lists.select(F.col("key").alias(k), F.col("elements").alias(f"e{k}")) for k in "ab")
    both = stars.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ea", "eb"))
    links = written(both.filter(common >= SIMILARITY * (F.size("ea") + F.size("eb") - common) - 1e-6).select("a", "b"), "dart-links")
    roots = components(links)
    # Groups that still hold several classes, without the texts that can be in no pair: those
    # whose unshared elements exceed what a similar pair leaves over.
    cls = F.coalesce("root", "key").alias("cls")

    def several(rows: DataFrame) -> DataFrame:
        mixed = rows.groupBy("grp").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi")
        return rows.join(small(written(mixed.select("grp"), "dart-mixed")), "grp", "left_semi")

    # Stored before: what looks for groups reads it several times.
    placed = written(groups.select("grp", "key").join(roots, F.col("key") == F.col("v"), "left").select("grp", "key", cls), "dart-placed")
    discard(folder_of(groups))
    open_ = written(_distinct_groups(several(placed)), "dart-open")
    discard(folder_of(placed))
    # The elements of open texts are read once; how many a text has is known from its sketch.
    keys = small(written(open_.select("key").distinct(), "dart-keys"))
    alone = lists.join(keys, "key").select("key", F.explode("elements").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.min("key").alias("key")).filter("c = 1").groupBy("key").agg(F.count("*").alias("alone"))
    fit = met.select("key", "n").join(keys, "key").join(alone, "key", "left").filter(F.coalesce("alone", F.lit(0)) <= (1 - SIMILARITY) * F.col("n") + 1e-9).select("key", "n")
    fit = written(fit, "dart-fit")
    rest = written(_distinct_groups(several(open_.join(fit, "key"))), "dart-rest")
    more = written(_tiles(rest, lists).distinct(), "dart-more")
    discard(folder_of(lists))
    if more.limit(1).count():
        old, roots = roots, components(links.union(more))
        discard(folder_of(old))
    # Classes of several texts: their figures go to the texts, not to the rows, so that copies don't meet by class.
    both = roots.union(roots.select("root", "root").distinct())
    linked = written(texts.select("key", "least", "copies").join(both, F.col("key") == F.col("v")).drop("v"), "dart-linked")
    figures = written(linked.groupBy("root").agg(F.min("least").alias("least"), F.sum("copies").alias("size")), "dart-figures")
    of_class = linked.select("key", "root").join(small(figures), "root").select("key", F.col("least").alias("l"), F.col("size").alias("s"))
    named = texts.select("key", "least", "copies").join(of_class, "key", "left").select("key", F.coalesce("l", "least").alias("least"), F.coalesce("s", "copies").alias("size"))
    named = written(named, "dart-named")
    discard(folder_of(texts))
    rows = sketched.filter("n > 0").select("id", "th", key.alias("key")).join(named, "key").select("id", "th", "least", "size")
    empty = sketched.filter("n = 0").select("id", "th", F.lit(None).cast(named.schema["least"].dataType).alias("least"), F.lit(None).cast("long").alias("size"))
    return rows.unionByName(empty)


def _classed(docs: DataFrame) -> DataFrame:
    out = classes(docs)
    class_id = F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id"))
    first = F.col("least").isNull() | (F.col("id").eqNullSafe(F.col("least.id")) & F.col("th").eqNullSafe(F.col("least.th")))
    return out.select(F.col("id").alias("doc_id"), class_id.alias("class_id"), F.coalesce("size", F.lit(1)).alias("class_size"), first.alias("kept"), "th")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and kept (it is that document), for every row of docs."""
    return _classed(docs).drop("th")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one of least doc_id; repeated rows of it count as one."""
    marks = written(_classed(docs), "dart-marks")
    gone_id, gone_th, th = fresh("gone_id", docs), fresh("gone_th", docs), fresh("th", docs)
    gone = marks.filter("NOT kept").select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)).distinct()
    this = F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_th))
    out = docs.join(small(gone), this, "left_anti")
    # Rows that tie: only these are looked at again, so that texts without words, which are in no class, all stay.
    tie_id, tie_th = fresh("tie_id", docs), fresh("tie_th", docs)
    ties = marks.filter("kept AND class_size > 1").groupBy("doc_id", "th").count().filter("count > 1").select(F.col("doc_id").alias(tie_id), F.col("th").alias(tie_th))
    ties = small(written(ties, "dart-ties"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(tie_id)) & (F.xxhash64("text") == F.col(tie_th))
    once = out.join(ties, same, "left_semi").withColumn(th, F.xxhash64("text")).dropDuplicates(["doc_id", th]).drop(th)
    return out.join(ties, same, "left_anti").unionByName(once)
