"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.components import connected_components
from tremorlake.llm.runtime import cut, drop_cut, spread_join
from tremorlake.llm.textkit import lower_ascii, mix, run_hash, text_slices, words

_U = np.uint64


@dataclass(frozen=True)
class NearDuplicates:
    """Shingles of `shingle` words; links from `percent` of Jaccard similarity; bands of the signature.

    48 bands of 6 coordinates miss a pair at 80 % with probability (1 - 0.8**6)**48 < 1e-6.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    universe_bits: int = 20
    seed: int = 17
    hub_rounds: int = 1
    crowd: int = 8
    part: int = 256


@lru_cache(maxsize=4)
def _permutations(spec: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the windows of the second one, circularly continued.

    Window x holds what x gives under all shifts of the second permutation.
    """
    size, shifts = 1 << spec.universe_bits, spec.bands * spec.rows
    random = np.random.default_rng(spec.seed)
    first = random.permutation(size).astype(np.int32)
    second = random.permutation(size).astype(np.int32)
    second = np.concatenate([second, second[: shifts - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(second, shifts)


def shingle_sets(column: pa.Array, spec: NearDuplicates) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles (words with A-Z lower-cased).

    With fewer words than a shingle the whole sequence is one; without words the set is empty.
    """
    for _, _, data, offsets in text_slices(column):
        data = lower_ascii(data)
        starts, ends, first = words(data, offsets)
        word = run_hash(spec.seed).of_bytes(data, starts, ends)
        sums = run_hash(spec.seed + 1)
        for i in range(len(offsets) - 1):
            own = word[first[i] : first[i + 1]]
            if not len(own):
                yield np.zeros(0, dtype=np.uint64)
                continue
            n = min(spec.shingle, len(own))
            begin = np.arange(len(own) - n + 1)
            yield np.unique(sums.of_runs(own, begin, begin + n))


def signature(hashes: np.ndarray, spec: NearDuplicates) -> np.ndarray:
    """Circulant MinHash: the least shifted image of the set under each of bands * rows shifts."""
    first, shifted = _permutations(spec)
    places = first[(hashes >> _U(40)).astype(np.int64) & ((1 << spec.universe_bits) - 1)]
    least = np.full(shifted.shape[1], np.iinfo(np.int32).max, dtype=np.int32)
    for at in range(0, len(places), 1024):
        np.minimum(least, shifted[places[at : at + 1024]].min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray, spec: NearDuplicates) -> np.ndarray:
    rows = signature(hashes, spec).astype(np.uint64).reshape(spec.bands, spec.rows)
    keys = np.arange(spec.bands, dtype=np.uint64)
    for k in range(spec.rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + rows[:, k])
    return keys


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    return (
        int(mix(hashes ^ _U(0x243F6A8885A308D3)).sum(dtype=np.uint64).view(np.int64)),
        int((mix(hashes * _U(0x13198A2E03707345) + _U(0xA4093822299F31D1))).sum(dtype=np.uint64).view(np.int64)),
    )


_SUMMARY = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"


def _summaries(docs: DataFrame, text: str, spec: NearDuplicates) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for hashes in shingle_sets(batch.column(1), spec):
                sizes.append(len(hashes))
                prints.append(_fingerprint(hashes))
                keys.append(band_keys(hashes, spec).view(np.int64) if len(hashes) else np.zeros(0, np.int64))
            one, two = zip(*prints) if prints else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`")).mapInArrow(made, _SUMMARY)


def _sets(docs: DataFrame, text: str, spec: NearDuplicates) -> DataFrame:
    """(doc_id, fp1, fp2, hashes) of documents."""
    schema = "doc_id long, fp1 long, fp2 long, hashes array<long>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), spec))
            prints = [_fingerprint(h) for h in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))],
                ["doc_id", "fp1", "fp2", "hashes"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`")).mapInArrow(made, schema)


def _sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, text: str, spec: NearDuplicates) -> DataFrame:
    """(cid, hashes) of the classes in `ids`."""
    wanted = classes.join(ids, "cid", "left_semi").select("cid", "doc_id", "fp1", "fp2")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return _sets(texts, text, spec).join(wanted, ["doc_id", "fp1", "fp2"]).dropDuplicates(["cid"]).select("cid", "hashes")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, spec: NearDuplicates) -> DataFrame:
    """A table (see `cut`) of pairs (u, v) of classes with `linked` and `shared`, the shingles in both, from the full sets of their documents."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct()
    sets = cut(_sets_of(ids, classes, docs, text, spec))
    joined = pairs.join(sets.select(F.col("cid").alias("v"), F.col("hashes").alias("b")), "v").join(
        sets.select(F.col("cid").alias("u"), F.col("hashes").alias("a")), "u"
    )
    shared = joined.select("u", "v", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), (F.size("a") + F.size("b")).alias("n"))
    found = cut(shared.select("u", "v", (100 * F.col("shared") >= spec.percent * (F.col("n") - F.col("shared"))).alias("linked"), "shared"))
    drop_cut(sets)
    return found


#: What is known of a class in a band: how many of its shingles it can share with other
#: classes of the band in all (reach), and inside (core) and outside (rest) the first hub's set.
_BOUNDS = ("n", "reach", "core", "rest")


def _possible(spec: NearDuplicates) -> str:
    """Whether two classes can be linked, by what they can share at most."""
    both = "least(reach, reach_2, least(core, core_2) + least(rest, rest_2))"
    return f"100 * {both} >= {spec.percent} * (n + n_2 - {both})"


def _other(prefix: str = "") -> list[Column]:
    """The second of two classes: its number and bounds."""
    return [F.col(f"{prefix}cid").alias("other"), *(F.col(f"{prefix}{b}").alias(f"{b}_2") for b in _BOUNDS)]


def _alone(unsettled: DataFrame, classes: DataFrame, docs: DataFrame, text: str, spec: NearDuplicates) -> DataFrame:
    """(cid, alone): how many shingles of a class of crowded open bands no other class of these has, if any."""
    crowded = unsettled.where(f"c > {spec.crowd}").select("cid").distinct()
    sets = _sets_of(crowded, classes, docs, text, spec)
    single = sets.select("cid", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("cid").alias("cid"))
    return single.where("k = 1").groupBy("cid").agg(F.count("*").alias("alone"))


def _with_bounds(unsettled: DataFrame, hubs: DataFrame, judged: DataFrame, alone: DataFrame, spec: NearDuplicates) -> DataFrame:
    """The rows of open bands with tighter bounds in crowded ones, without classes that can be linked to nothing there.

    A shingle that only one class of all crowded open bands has is shared in none of them; the
    others are the reach. Those of them in the set of the band's first hub, which is one of
    these classes, are known from its comparison. With 100 * reach < percent * n no other class
    can be linked. What is left out loses no link.
    """
    near = unsettled.join(hubs, "band").where("cid = hub").select("band", "hub").distinct()
    rows = unsettled.join(near, "band", "left").withColumns({"u": F.least("cid", "hub"), "v": F.greatest("cid", "hub")})
    rows = rows.join(judged.select("u", "v", "shared"), ["u", "v"], "left").join(alone, "cid", "left")
    busy, inside = F.col("c") > spec.crowd, F.when(F.col("cid") == F.col("hub"), F.col("n")).otherwise(F.col("shared"))
    rows = rows.withColumn("reach", F.when(busy, F.col("n") - F.coalesce("alone", F.lit(0))).otherwise(F.col("n")))
    rows = rows.withColumn("core", F.when(busy, F.coalesce(inside, "reach")).otherwise(F.col("n")))
    rows = rows.withColumn("rest", F.when(busy & inside.isNotNull(), F.col("reach") - inside).otherwise(F.col("reach")))
    return rows.where(f"100 * reach >= {spec.percent} * n").select(*unsettled.columns)


def near_duplicates(docs: DataFrame, text: str = "text", spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept (doc_id = component_id).

    Documents with equal shingle sets form a class; only classes are compared. Classes that
    agree in a band are candidates, confirmed on full sets. In each band all classes are compared
    with one of them, first that of most copies; members that links already join need no
    comparison of their own. In bands that stay crowded, classes with too many shingles of their
    own to be linked to any other are left out. Only pairs that are then neither joined nor ruled
    out are compared each, so no link that bands can find is lost.

    A document without words has no shingles and is linked with nothing. A null doc_id is
    linked with nothing: component_id null, kept true. Rows that repeat a doc_id are rows of
    one document for the links; each has its own n_shingles. An empty table gives none. Very long
    texts are compared whole. Only doc_id and `text` are read; other columns may have any names. Sets
    are compared as 64-bit hashes of their shingles; documents with the same 128-bit print of these are
    one class.
    """
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(cut(df))
        return held[-1]

    summaries = cut(_summaries(docs, text, spec))
    usable = summaries.where("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = usable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    classes = hold(grouped.withColumn("cid", F.monotonically_increasing_id()))
    bands = (
        usable.join(classes, ["doc_id", "fp1", "fp2"])
        .dropDuplicates(["cid"])
        .select("cid", "n", "copies", F.explode("bands").alias("band"))
    )
    bands = cut(bands)
    open_bands = hold(bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    known = {b: F.col("n").cast("long") for b in _BOUNDS} | {"component": F.col("cid")}
    unsettled = hold(bands.join(open_bands, "band").withColumns(known))
    drop_cut(bands)

    judged = links = None
    turn = 0
    while True:
        rows, all_pairs = open_bands.agg(F.sum("c"), F.sum(F.expr("c * (c - 1) / 2"))).first()
        if not rows:
            break
        if turn:
            unsettled = hold(members.join(open_bands, "band"))
        few = all_pairs <= 2 * rows
        last = few or turn >= spec.hub_rounds
        if turn == 1 and not few:
            alone = hold(_alone(unsettled, classes, docs, text, spec))
            unsettled = hold(_with_bounds(unsettled, first_hubs, judged, alone, spec))
        if last:
            # A pair counts in the first of the bands that it shares only. A crowded band is split: each of its
            # parts of about `part` classes meets all classes of the band, in a task of its own.
            left = unsettled.join(unsettled.groupBy("cid").agg(F.collect_list("band").alias("bands")), "cid")
            left = left.withColumn("parts", F.ceil(F.col("c") / spec.part).cast("int"))
            right = left.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("nth"), F.col("component").alias("far"), F.col("bands").alias("bands_2"), *_other())
            left = left.withColumn("nth", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
            once = "band = array_min(array_intersect(bands, bands_2))"
            pairs = left.join(right, ["band", "nth"]).where(f"component < far AND {_possible(spec)} AND {once}")
        else:
            order = F.struct(-F.col("copies"), "cid") if turn == 0 else F.struct(F.xxhash64("cid", F.lit(turn)), "cid")
            hubs = unsettled.groupBy("band").agg(F.min_by(F.struct("cid", "component", *_BOUNDS), order).alias("hub"))
            if turn == 0:
                hubs = hold(hubs)
                first_hubs = hubs.select("band", F.col("hub.cid").alias("hub"))
            pairs = unsettled.join(hubs, "band").where("component <> hub.component").select("cid", *_BOUNDS, *_other("hub."))
            pairs = pairs.where(_possible(spec))
        pairs = pairs.select(F.least("cid", "other").alias("u"), F.greatest("cid", "other").alias("v")).distinct()
        pairs = hold(pairs.join(judged, ["u", "v"], "left_anti") if judged is not None else pairs)
        if judged is None or not pairs.isEmpty():
            found = _confirmed(pairs, classes, docs, text, spec)
            held.append(found)
            linked = found.where("linked").select("u", "v")
            judged, links = (judged.unionByName(found), links.unionByName(linked)) if judged is not None else (found, linked)
        if last:
            break
        joined = connected_components(links)
        # Further links join these components: the stars stand for the links so far.
        links = joined.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
        members = hold(
            unsettled.drop("component", "c").join(joined, unsettled["cid"] == joined["id"], "left")
            .withColumn("component", F.coalesce("component", "cid")).drop("id")
        )
        open_bands = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c"))
        open_bands = hold(open_bands.where("lo <> hi").select("band", "c"))
        turn += 1
    # Classes, and documents that have rows in several classes, link doc_ids.
    led = classes.withColumn("component", F.col("cid"))
    if links is not None:
        of_class = connected_components(links)
        led = classes.join(of_class, classes["cid"] == of_class["id"], "left")
    led = hold(led.select("fp1", "fp2", "copies", F.coalesce("component", "cid").alias("k"), "doc_id"))
    n_classes, n_rows = led.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    lead = hold(led.groupBy("k").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    led = hold(spread_join(led.drop("doc_id"), lead, ["k"], "rows", n_classes).select("fp1", "fp2", "copies", "least"))
    found = spread_join(usable.select("fp1", "fp2", F.col("doc_id").alias("id")), led, ["fp1", "fp2"], "copies", n_rows)
    found = cut(found.select("id", "least").distinct())
    drop_cut(*held)
    several = found.groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    if not several.isEmpty():
        found = found.select(F.col("id").alias("u"), F.col("least").alias("v"))
        loops = found.where("u = v").select(F.col("u").alias("id"), F.col("v").alias("least"))
        found = connected_components(found).withColumnRenamed("component", "least").unionByName(loops)
        found = found.groupBy("id").agg(F.min("least").alias("least"))
    out = summaries.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", spec: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of `docs` whose document leads its component; one document of each group stays."""
    gone = near_duplicates(docs, text, spec).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
