"""Finding pairs of records that describe one site.

Records are compared inside a (state, three-digit postal area) block and, by
registry id, inside a state. A block can hold a large part of all rows, so its
pairs are never listed:

* Records that would score alike (same source, same normalised fields) are
  folded into one row that stands for them, with a count.
* A pair can only reach the review score if some of its parts agree. Those parts
  become join keys: the street, the city with an industry prefix, the postal code
  with an industry code, or a 5 km grid cell. Each pair is found under exactly one
  of them, so the union needs no de-duplication.
* Rows of one source never meet: a key is split by the bits of a number given to each source.
* Of keys that are still large, only rows meet whose names can be alike enough: the names are joined
  on shared segments. Grid cells, where names need not be alike, are cut into a grid of tasks on both sides.
* A postal key of a single city is left out, as its pairs are the city's.
* Where two rows meet, numbers alone bound their score first: lengths and letter marks of their names, lengths of their streets, codes for equal
  texts, straight lines between points. Texts are read and distances computed for what is left.

The result equals comparing all pairs of every block.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave import constants as K
from siteweave.functions import geo, scoring
from siteweave.functions.scoring import MatchConfig
from siteweave.functions.text import (
    blank_to_null, leading_number, normalize_address, normalize_city, normalize_zip, round_half_up, starts, strip,
    zip_prefix,
)
from siteweave.operators import segments
from siteweave.session import cut_lineage

AREA = ("state", "area")
SCORED = ("state", "area", "name", "street", "city", "zip5", "lat", "lng", "naics", "registry_id", "fresh")
EPSILON = 1e-6
SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Candidates:
    """``pairs`` between folds, and ``members`` giving the records of each fold."""

    pairs: DataFrame
    members: DataFrame


def prepared(raw: DataFrame, config: MatchConfig = MatchConfig(), fresh: bool = True) -> DataFrame:
    """Raw records with the normalised fields that blocking and scoring read.

    Pairs need at least one ``fresh`` record; an earlier run has seen the others.
    """
    rows = raw if not config.aggregate_sources else raw.filter(~F.col("source").isin(*config.aggregate_sources))
    zip_area = F.coalesce(zip_prefix(normalize_zip(F.col("raw_zip"))), F.lit("000"))
    lat, lng = leading_number(F.col("raw_latitude")), leading_number(F.col("raw_longitude"))
    placed = F.coalesce(geo.on_globe(lat, lng), F.lit(False))
    return rows.select(
        "id",
        "source",
        blank_to_null(F.col("raw_state")).alias("state"),
        zip_area.alias("area"),
        strip(F.upper(blank_to_null(F.col("raw_name")))).alias("name"),
        normalize_address(blank_to_null(F.col("raw_address"))).alias("street"),
        normalize_city(blank_to_null(F.col("raw_city"))).alias("city"),
        blank_to_null(starts(strip(F.col("raw_zip")), 5)).alias("zip5"),
        F.when(placed, lat).alias("lat"),
        F.when(placed, lng).alias("lng"),
        blank_to_null(F.col("raw_naics_code")).alias("naics"),
        blank_to_null(F.col("registry_id")).alias("registry_id"),
        F.lit(fresh).alias("fresh"),
    )


def block_keys(rows: DataFrame) -> DataFrame:
    """One row per record and block it belongs to, from ``prepared`` rows."""
    upper = F.upper(F.col("state"))
    keys = F.array_compact(
        F.array(
            F.when(F.col("state").isNotNull(), F.concat_ws("-", upper, F.col("area"))),
            F.concat(F.lit("reg-"), F.col("registry_id")),
        )
    )
    return rows.select("id", "source", "state", F.explode(keys).alias("block"))


def block_sizes(rows: DataFrame) -> DataFrame:
    per_source = block_keys(rows).filter("state is not null").groupBy("state", "block", "source").agg(
        F.count("*").alias("n")
    )
    total, same = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return per_source.groupBy("state", "block").agg(
        total.alias("records"), ((total * total - same) / 2).cast("bigint").alias("cross_source_pairs")
    )


def compared_pairs(rows: DataFrame) -> DataFrame:
    """Number of distinct cross-source pairs that share a block, from counts alone."""

    def pairs_within(*keys: str) -> DataFrame:
        present = rows.dropna(subset=["state", *keys])
        per_source = present.groupBy("state", *keys, "source").agg(F.count("*").alias("n"))
        total, same = F.sum("n"), F.sum(F.col("n") * F.col("n"))
        groups = per_source.groupBy("state", *keys).agg(((total * total - same) / 2).cast("bigint").alias("pairs"))
        return groups.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))

    both = pairs_within("area", "registry_id").select((-F.col("pairs")).alias("pairs"))
    return (
        pairs_within("area")
        .unionByName(pairs_within("registry_id"))
        .unionByName(both)
        .agg(F.sum("pairs").alias("compared"))
    )


# --- folding ---------------------------------------------------------------------------------


def fold_by_fields(rows: DataFrame) -> DataFrame:
    present = rows.filter(F.col("state").isNotNull())
    return present.groupBy("source", *SCORED).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def fold_by_registry(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    present = rows.dropna(subset=list(keys))
    return present.groupBy("source", "fresh", *keys).agg(F.min("id").alias("id"), F.count("*").alias("n"))


def registry_keys(config: MatchConfig) -> tuple[str, ...]:
    return ("registry_id",) if config.registry_cross_state else ("state", "registry_id")


# --- candidate keys --------------------------------------------------------------------------


def _naics_need(slack: float, weight: float) -> int | None:
    """Shortest shared code prefix that costs no more than ``slack``; None when no code will do.

    0 means that codes need not agree at all, 6 that they must be equal.
    """
    if slack < -EPSILON:
        return None
    if weight * 100 <= slack + EPSILON:
        return 0
    for length, points in reversed(K.NAICS_STEPS):
        if weight * (100 - points) <= slack + EPSILON:
            return length
    return 6


def _agree_on_naics(need: int) -> list[Column]:
    if need == 0:
        return []
    return [F.col("naics") if need == 6 else starts(F.col("naics"), need)]


def key_plan(config: MatchConfig) -> list[tuple[str, list[Column]]]:
    """Join keys for pairs without a proximity score, derived from weights and threshold.

    ``slack`` is what such a pair may lose in all before it misses the review score.
    A differing street costs at least 10 address points, a differing city 30, and a
    postal code that agrees on the area alone 15.
    """
    w = config.weights
    slack = 100 * (w["name"] + w["address"] + w["naics"]) - (config.review - 0.5)
    classes = [
        ("street", slack, [F.col("street")]),
        ("city", slack - 10 * w["address"], [F.col("city")]),
        ("zip", slack - 40 * w["address"], [F.col("zip5")] if 15 * w["address"] > slack - 40 * w["address"] else []),
    ]
    plan = []
    for kind, left_over, parts in classes:
        need = _naics_need(left_over, w["naics"])
        if need is not None:
            plan.append((kind, parts + _agree_on_naics(need)))
    return plan


def _value(kind: str, parts: list[Column]) -> Column:
    """A join key; null as soon as one part is missing."""
    return F.concat(F.lit(kind), *[piece for part in parts for piece in (F.lit(SEPARATOR), part)])


def _with_cities(folds: DataFrame, config: MatchConfig) -> DataFrame:
    """Folds with ``cities``: whether their postal key holds more than one city, or a missing one.

    Pairs of one city are found under other keys, so a postal key of a single city has none of its own.
    """
    postal = [_value(kind, parts) for kind, parts in key_plan(config) if kind == "zip"]
    if not postal:
        return folds.withColumn("cities", F.lit(False))
    rows = folds.withColumn("_postal", postal[0])
    held = rows.filter("_postal is not null").select("state", "area", "_postal", "city").distinct()
    several = held.groupBy("state", "area", "_postal").agg(F.count(F.lit(1)).alias("n"), F.count("city").alias("named"))
    several = several.filter("n > 1 or named = 0").select("state", "area", "_postal", F.lit(True).alias("cities"))
    return rows.join(several, ["state", "area", "_postal"], "left").select(*folds.columns, F.coalesce("cities", F.lit(False)).alias("cities"))


def _keyed(folds: DataFrame, config: MatchConfig, side: str) -> DataFrame:
    """Folds (with ``cities``) once per join key; the right side also stands in the neighbouring grid cells."""
    plan = key_plan(config)
    lat, lng = F.col("lat"), F.col("lng")
    rows = (0,) if side == "left" else (-1, 0, 1)
    shifts = F.array(F.lit(0)) if side == "left" else F.array(F.lit(-1), F.lit(0), F.lit(1))
    # Trigonometry stays below the explode: once per fold, not once per key.
    bands = F.array(
        *[F.struct((geo.band(lat) + row).alias("band"), geo.band_cells(lat, row).alias("cells")) for row in rows]
    )
    values = []
    for kind, parts in plan:
        value = _value(kind, parts)
        values.append(F.when(F.col("cities"), value) if kind == "zip" else value)
    plain = folds.select("*", F.explode(F.array(*values)).alias("key")).filter("key is not null")
    placed = folds.filter(lat.isNotNull() & lng.isNotNull()).select("*", F.explode(bands).alias("_band"))
    shifted = placed.select("*", F.explode(shifts).alias("_shift"))
    cell = geo.cell_name(F.col("_band.band"), F.col("_band.cells"), lng, F.col("_shift"))
    near = shifted.withColumn("key", F.concat(F.lit("cell" + SEPARATOR), cell)).drop("_band", "_shift")
    keyed = plain.unionByName(near.filter("key is not null"))
    return keyed.withColumn("kind", F.substring_index("key", SEPARATOR, 1))


JOIN_KEYS = ("state", "area", "key")
#: Keyed rows for each task of the join.
ROWS_PER_TASK = 20_000
#: Keys of so many times ``max_block`` rows are joined on their names' segments; of smaller ones, comparing marks costs less.
SEGMENTS_FROM = 8
#: Sources that are numbered; with more of them, all rows of a key meet.
NUMBERED_SOURCES = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "
MARKS = ("name_length", "marks_1", "marks_2")


def name_needs(config: MatchConfig) -> dict[str, float]:
    """For each kind of key without a proximity score: the name score that is needed in the best case for the rest.

    The address is worth 100 points if the streets agree, 90 if only the cities can, 60 if neither does.
    """
    w, least = config.weights, config.review - 0.5 - EPSILON
    best = {"street": 100, "city": 90, "zip": 60}
    return {kind: (least - w["address"] * points - w["naics"] * 100) / w["name"] for kind, points in best.items()}


def name_losses(config: MatchConfig) -> dict[str, float]:
    """The part of a name that may differ at most, for each kind of key without a proximity score."""
    # Rounding can lift a similarity by half a point.
    return {kind: (100.5 - need) / 100 for kind, need in name_needs(config).items()}


def _marked(folds: DataFrame) -> DataFrame:
    """Folds with the length of their names and marks: of each of ``LETTERS`` the first three in a name set a bit each.

    One edit takes away one letter at most and adds one, so it changes two marks at most.
    """
    def mask(letters: str) -> Column:
        marks = []
        for i, letter in enumerate(letters):
            count = F.octet_length("name") - F.octet_length(F.replace(F.col("name"), F.lit(letter), F.lit("")))
            own = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(count, F.lit(3))) - 1
            marks.append(F.shiftleft(own, 3 * i))
        return reduce(Column.bitwiseOR, marks)

    return folds.select(
        *folds.columns, F.length("name").alias("name_length"), mask(LETTERS[:21]).alias("marks_1"), mask(LETTERS[21:]).alias("marks_2")
    )


#: Texts of which pairs ask whether they are equal, with the lengths of prefixes for which they do.
CODED = {"street": (None,), "city": (None,), "zip5": (None, 3), "naics": (None, K.NAICS_STEPS[-1][0])}


def _code(c: str, length: int | None) -> str:
    return f"{c}_code{length or ''}"


def _coded(rows: DataFrame, prefix: str) -> DataFrame:
    """One side's rows with numbers in place of texts, never null, from which a pair's score is bounded.

    Equal texts have equal codes; a missing text's code is like none of the other side. Pairs are told apart by
    numbers alone, as reading texts would cost more than all that is asked of them.
    """
    missing = F.lit(1 if prefix == "a" else 2).cast("bigint")
    columns = {}
    for c, lengths in CODED.items():
        text = F.col(f"{prefix}_{c}")
        for length in lengths:
            part = text if length is None else starts(text, length)
            columns[f"{prefix}_{_code(c, length)}"] = F.when(text.isNull(), missing).otherwise(F.xxhash64(part))
    for c in ("name", "street"):
        size = F.coalesce(F.length(f"{prefix}_{c}"), F.lit(0))
        columns[f"{prefix}_{c}_size"] = size
        # The larger of two lengths has the smaller inverse: pairs are not divided.
        columns[f"{prefix}_{c}_inverse"] = F.lit(1.0) / F.greatest(size, F.lit(1))
    for c in ("marks_1", "marks_2"):
        columns[f"{prefix}_{c}"] = F.coalesce(F.when(F.length(f"{prefix}_name") > 0, F.col(f"{prefix}_{c}")), F.lit(0).cast("bigint"))
    for axis, place in geo.on_sphere(F.col(f"{prefix}_lat"), F.col(f"{prefix}_lng")).items():
        columns[f"{prefix}_{axis}"] = F.coalesce(place, F.lit(0.0))
    columns[f"{prefix}_new"] = F.coalesce(f"{prefix}_fresh", F.lit(False))
    return rows.withColumns(columns)


def _on_cells() -> Column:
    return F.coalesce(F.col("kind") == "cell", F.lit(False))


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with further columns, each computed once a row: a projection's would be computed anew in every filter above it."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def _levels(folds: DataFrame) -> tuple[Column, Column] | None:
    """For each side the levels at which a row stands there, so that two rows meet once if their sources differ and never if not.

    Sources are numbered. Two numbers have one highest bit in which they differ: the row without it stands on the left of that
    bit's level, the other one on the right, beside the bits above. None if the sources are too many to be numbered.
    """
    sources = [r[0] for r in folds.filter("source is not null").select("source").distinct().limit(NUMBERED_SOURCES + 1).collect()]
    if len(sources) > NUMBERED_SOURCES:
        return None
    number = (F.array_position(F.array(*[F.lit(x) for x in sorted(sources) or [""]]), F.col("source")) - 1).cast("int")
    bits = range(max(1, (len(sources) - 1).bit_length()))

    def side(bit: int) -> Column:
        own = [F.when(F.shiftright(number, b) % 2 == bit, F.concat_ws(":", F.lit(b), F.shiftright(number, b + 1))) for b in bits]
        return F.explode(F.array_compact(F.array(*own)))

    return side(0), side(1)


def _sized(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    return keyed.join(sizes, list(JOIN_KEYS), "left")


def _by_names(left: DataFrame, right: DataFrame, losses: dict[str, float]) -> DataFrame:
    """Pairs of large keys: the key's distinct names are joined on shared segments, and only rows of names that are alike meet."""
    loss = F.lit(None).cast("double")
    for kind, part in losses.items():
        loss = F.when(F.col("kind") == kind, F.lit(part)).otherwise(loss)
    both = left.select(*JOIN_KEYS, "kind", F.col("a_name").alias("name")).unionByName(right.select(*JOIN_KEYS, "kind", F.col("b_name").alias("name")))
    names = segments.alike(both.withColumn("loss", loss), JOIN_KEYS, "name", "loss")
    same = left.filter("a_name is not null").select(*JOIN_KEYS, F.col("a_name").alias("first"), F.col("a_name").alias("second")).distinct()
    met = names.unionByName(same)
    firsts = _coded(left, "a").withColumns({"first": F.col("a_name"), "on_grid": _on_cells()}).join(met, [*JOIN_KEYS, "first"])
    return firsts.join(_coded(right, "b").withColumn("second", F.col("b_name")).drop("kind"), [*JOIN_KEYS, "second"]).drop("first", "second")


def _on_grid(left: DataFrame, right: DataFrame, config: MatchConfig, tasks: int) -> DataFrame:
    """Pairs by key; a key above ``max_block`` is cut into a grid: each side keeps one part and is copied along the other.

    Every pair still meets once. The parts grow with the square root of the key's
    size, so copies stay few while no task holds a whole large key.
    """
    grid = F.coalesce(F.ceil(F.sqrt(F.col("_size") / config.max_block)).cast("int"), F.lit(1))

    def placed(rows: DataFrame, id_col: str, own: str, copied: str, seed: int) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), grid).cast("int")
        return rows.withColumns({own: part, copied: F.explode(F.sequence(F.lit(0), grid - 1))})

    keys = [*JOIN_KEYS, "_row", "_col"]
    a, b = placed(left, "a_id", "_row", "_col", 1).drop("_size"), placed(right, "b_id", "_col", "_row", 2).drop("_size")
    # Comparing costs far more than moving, so the task count must not follow the bytes moved.
    a, b = _coded(a.repartition(tasks, *keys), "a"), _coded(b.repartition(tasks, *keys), "b")
    return a.withColumn("on_grid", _on_cells()).join(b, keys).drop("_row", "_col")


def keyed_pairs(folds: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Pairs (kind, a_..., b_...) of folds of different sources that share a join key, each once; of large keys only those whose names can
    be alike enough."""
    shown = ("id", "source", "n", *SCORED[2:], *MARKS)
    folds = cut_lineage(_with_cities(_marked(folds.filter("source is not null")), config), "marked")
    levels = _levels(folds)

    def keyed(side: str, prefix: str, level: Column) -> DataFrame:
        rows = _keyed(folds.withColumn("level", level), config, side)
        return rows.withColumn("key", F.concat_ws(SEPARATOR, "key", "level")).select(*JOIN_KEYS, "kind", *[F.col(c).alias(f"{prefix}_{c}") for c in shown])

    def met(pairs: DataFrame) -> DataFrame:
        return pairs if levels else pairs.filter("a_source <> b_source and a_id < b_id")

    left = keyed("left", "a", levels[0] if levels else F.lit(""))
    # Written once: it is counted by key and then joined.
    right = cut_lineage(keyed("right", "b", levels[1] if levels else F.lit("")), "keyed")
    sizes = right.groupBy(*JOIN_KEYS).agg(F.count("*").alias("_size")).filter(F.col("_size") > config.max_block)
    sizes = cut_lineage(sizes, "large-keys")
    total = right.count()
    # Tasks far above the cores only help many rows: each takes the memory of a sort.
    spark = folds.sparkSession
    fewest = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(fewest, -(-total // ROWS_PER_TASK))
    losses = {kind: part for kind, part in name_losses(config).items() if 0 <= part < 0.5}
    large = (F.coalesce("_size", F.lit(0)) > SEGMENTS_FROM * config.max_block) & F.col("kind").isin(*losses)
    if sizes.isEmpty():
        none = F.lit(None).cast("bigint")
        return met(_on_grid(left.withColumn("_size", none), right.drop("kind").withColumn("_size", none), config, tasks))
    left, right = _sized(left, sizes), _sized(right, sizes)
    grid = _on_grid(left.filter(~large), right.filter(~large).drop("kind"), config, tasks)
    return met(grid.unionByName(_by_names(left.filter(large).drop("_size"), right.filter(large).drop("_size"), losses)))


# --- scoring ---------------------------------------------------------------------------------


def _street_bound() -> Column:
    """The most that two different streets of the pair's lengths are worth; rounding can lift it twice."""
    return F.lit(30.65) - F.abs(F.col("a_street_size") - F.col("b_street_size")) * F.lit(30.0) * F.least("a_street_inverse", "b_street_inverse")


def _within_reach(config: MatchConfig, least: float) -> Column:
    """Whether numbers alone (``_coded``) leave a pair a chance of the review score: names by their lengths and marks, streets by
    their lengths, and points in the grid by straight lines.

    It is asked of every pair, so it is short: Spark does not compile long methods.
    """
    w = config.weights

    def same(c: str, length: int | None = None) -> Column:
        return F.col(f"a_{_code(c, length)}") == F.col(f"b_{_code(c, length)}")

    changed = F.bit_count(F.col("a_marks_1").bitwiseXOR(F.col("b_marks_1"))) + F.bit_count(F.col("a_marks_2").bitwiseXOR(F.col("b_marks_2")))
    edits = F.greatest(F.abs(F.col("a_name_size") - F.col("b_name_size")).cast("double"), changed * F.lit(0.5))
    # Rounding can lift a similarity by half a point.
    name = F.lit(100.5) - edits * F.lit(100.0) * F.least("a_name_inverse", "b_name_inverse")
    address = (
        F.when(same("street"), 40.0).otherwise(_street_bound()) + F.when(same("city"), 30.0).otherwise(0.0)
        + F.when(same("zip5"), 30.0).when(same("zip5", 3), 15.0).otherwise(0.0)
    )
    shortest, most = K.NAICS_STEPS[-1][0], float(K.NAICS_STEPS[0][1])
    naics = F.when(same("naics"), 100.0).when(same("naics", shortest), most).otherwise(0.0)
    line = sum((F.col(f"a_{axis}") - F.col(f"b_{axis}")) * (F.col(f"a_{axis}") - F.col(f"b_{axis}")) for axis in "xyz")
    nearest = F.when(~F.col("on_grid"), 0.0)
    for metres, points in K.GEO_STEPS:
        nearest = nearest.when(line <= geo.square_chord(metres), float(points))
    # Points of the grid that are out of reach are not its pairs.
    reachable = scoring.weighted(name, nearest.otherwise(float("-inf")), address, naics, w) >= least
    return (F.col("a_new") | F.col("b_new")) & reachable


def scored_pairs(folds: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Pairs of folds at or above the review score, registry matches left out."""
    pairs = keyed_pairs(folds, config)

    def a(c: str) -> Column:
        return F.col(f"a_{c}")

    def b(c: str) -> Column:
        return F.col(f"b_{c}")

    def same(c: str) -> Column:
        return F.coalesce(a(c) == b(c), F.lit(False))

    naics = scoring.naics_score(a("naics"), b("naics"))
    apart = (a("id") != b("id")) & ~same("registry_id") & (a("fresh") | b("fresh"))
    w, least = config.weights, config.review - 0.5 - EPSILON
    # Each pair belongs to one kind of key: near pairs to the grid, others to the first key they share.
    kind = F.col("kind")
    close = F.abs(a("lat") - b("lat")) <= geo.BAND_DEG
    first_key = F.col("on_grid") | (kind == "street") | (~same("street") & ((kind == "city") | ~same("city")))
    street_bound = F.when(same("street"), 40).when(a("street").isNotNull() & b("street").isNotNull(), _street_bound())
    met = _once(
        pairs.filter(_within_reach(config, least)),
        (apart & first_key).alias("own"),
        F.when(close, geo.haversine(a("lat"), a("lng"), b("lat"), b("lng"))).alias("metres"),
        naics.alias("naics_score"),
        (F.coalesce(street_bound, F.lit(0.0)) + scoring.city_points(a, b) + scoring.zip_points(a, b)).alias("address_bound"),
    )
    met = met.withColumn("geo_score", geo.proximity_points(F.col("metres")))
    met = met.filter(F.col("own") & (F.col("on_grid") == (F.col("geo_score") > 0)))
    others = scoring.weighted(F.lit(0.0), F.col("geo_score"), F.col("address_bound"), F.col("naics_score"), w)
    name = scoring.text_similarity(a("name"), b("name"), (F.lit(least) - others) / F.lit(w["name"]))
    met = _once(met, name.alias("name_score"))
    named = scoring.weighted(F.col("name_score"), F.col("geo_score"), F.col("address_bound"), F.col("naics_score"), w)
    candidates = _once(met.filter(named >= least), scoring.address_score(a, b).alias("address_score"))
    in_order = a("id") < b("id")

    def first(c: str) -> Column:
        return F.when(in_order, a(c)).otherwise(b(c))

    def second(c: str) -> Column:
        return F.when(in_order, b(c)).otherwise(a(c))

    scores = candidates.select(
        first("id").alias("record_a"),
        second("id").alias("record_b"),
        first("source").alias("source_a"),
        second("source").alias("source_b"),
        first("n").alias("n_a"),
        second("n").alias("n_b"),
        "state",
        "name_score",
        "geo_score",
        "address_score",
        "naics_score",
    )
    composite = round_half_up(
        scoring.weighted(F.col("name_score"), F.col("geo_score"), F.col("address_score"), F.col("naics_score"), w)
    )
    return (
        scores.withColumn("confidence_score", composite)
        .filter(F.col("confidence_score") >= config.review)
        .withColumn("match_type", F.lit("geo_name"))
        .withColumn("status", scoring.match_status(F.col("confidence_score"), config))
    )


def registry_pairs(
    rows: DataFrame, config: MatchConfig = MatchConfig(), within: tuple[str, ...] | None = None
) -> DataFrame:
    """Records of different sources under one registry id: a fixed score, no comparison.

    One row per pair of sources, however many records share the id.
    """
    keys = list(within or registry_keys(config))
    folds = fold_by_registry(rows, tuple(keys))
    shown = ("id", "source", "n", "fresh")
    a = folds.select(*keys, *[F.col(c).alias(f"a_{c}") for c in shown])
    b = folds.select(*keys, *[F.col(c).alias(f"b_{c}") for c in shown])
    pairs = a.join(b, keys).filter("a_id < b_id and a_source <> b_source and (a_fresh or b_fresh)")
    full = F.lit(100)
    state = F.col("state") if "state" in keys else F.lit(None).cast("string")
    return pairs.select(
        F.col("a_id").alias("record_a"),
        F.col("b_id").alias("record_b"),
        F.col("a_source").alias("source_a"),
        F.col("b_source").alias("source_b"),
        F.col("a_n").alias("n_a"),
        F.col("b_n").alias("n_b"),
        state.alias("state"),
        full.alias("name_score"),
        full.alias("geo_score"),
        full.alias("address_score"),
        full.alias("naics_score"),
        F.lit(K.REGISTRY_SCORE).alias("confidence_score"),
        F.lit("frs_id").alias("match_type"),
        F.lit("auto_matched").alias("status"),
    )


def match(raw: DataFrame, config: MatchConfig = MatchConfig(), earlier: DataFrame | None = None) -> Candidates:
    """Candidate pairs of ``raw`` and the records behind every fold.

    The normalised records, the folds and the pairs are tables, written once: the
    source is read in one pass, and the join runs over the compact fold table.

    With ``earlier`` records, ``raw`` is compared with itself and with them; they are
    not compared with each other again.
    """
    rows = prepared(raw, config)
    if earlier is not None:
        rows = rows.unionByName(_reachable(prepared(earlier, config, fresh=False), rows, config))
    return match_prepared(rows, config)


def match_prepared(rows: DataFrame, config: MatchConfig = MatchConfig()) -> Candidates:
    """``match`` for ``prepared`` rows, of which the pairs of two rows that are not fresh are left out."""
    rows = cut_lineage(rows)
    registry = registry_keys(config)
    folds = cut_lineage(fold_by_fields(rows))
    pairs = scored_pairs(folds, config).unionByName(registry_pairs(rows, config, registry))
    members = _field_members(rows).unionByName(_registry_members(rows, registry))
    pairs = cut_lineage(pairs.withColumn("pair_count", F.col("n_a") * F.col("n_b")))
    return Candidates(pairs, members)


def _reachable(known: DataFrame, fresh: DataFrame, config: MatchConfig) -> DataFrame:
    """Earlier records that share an area or a registry id with a fresh one."""
    by_area = known.join(fresh.select("state", "area").distinct(), ["state", "area"], "left_semi")
    keys = list(registry_keys(config))
    by_registry = known.join(fresh.select(*keys).distinct(), keys, "left_semi")
    return by_area.unionByName(by_registry).dropDuplicates(["id"])


def _field_members(rows: DataFrame) -> DataFrame:
    """(match_type, fold_id, record_id): the records that each fold of several stands for, itself included."""
    folds = fold_by_fields(rows).filter("n > 1").withColumnRenamed("id", "fold_id")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("source", *SCORED)]
    joined = rows.alias("r").join(folds.alias("f"), reduce(and_, same))
    return joined.select(F.lit("geo_name").alias("match_type"), "fold_id", F.col("r.id").alias("record_id"))


def _registry_members(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    folds = fold_by_registry(rows, keys).filter("n > 1").withColumnRenamed("id", "fold_id")
    joined = rows.join(folds, ["source", "fresh", *keys])
    return joined.select(F.lit("frs_id").alias("match_type"), "fold_id", F.col("id").alias("record_id"))


def expand(candidates: Candidates, scope: tuple[str, ...] = ()) -> DataFrame:
    """Record pairs behind the folded ones. Grows with the product of fold sizes; meant for review lists.

    ``scope`` names columns, such as a batch number, inside which fold ids hold.
    """
    members = candidates.members

    def side(pairs: DataFrame, which: str) -> DataFrame:
        m = members.select("match_type", *scope, F.col("fold_id").alias(which), F.col("record_id").alias("_record"))
        joined = pairs.join(m, ["match_type", *scope, which], "left")
        return joined.withColumn(which, F.coalesce("_record", which)).drop("_record")

    return side(side(candidates.pairs, "record_a"), "record_b").withColumns(
        {"n_a": F.lit(1), "n_b": F.lit(1), "pair_count": F.lit(1)}
    )


def link_edges(candidates: Candidates, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Edges that put every merged record into its component.

    All records of two folds that match are connected, so a star around each
    fold's first record says as much as all pairs between them.
    """
    merged = candidates.pairs.filter(F.col("status").isin(*config.merge_statuses))
    direct = merged.select(F.col("record_a").alias("src"), F.col("record_b").alias("dst"))
    folded = merged.filter("pair_count > 1").select(
        "match_type", F.explode(F.array("record_a", "record_b")).alias("fold_id")
    )
    stars = candidates.members.join(folded.distinct(), ["match_type", "fold_id"], "left_semi").filter(
        "fold_id <> record_id"
    )
    return direct.unionByName(stars.select(F.col("fold_id").alias("src"), F.col("record_id").alias("dst")))


def match_classes(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """Counters of a run: compared, automatic, queued, none."""
    zero = F.lit(0).cast("bigint")

    def where(status: str) -> Column:
        return F.when(F.col("status") == status, F.col("pair_count")).otherwise(zero)

    found = pairs.select(zero.alias("compared"), where("auto_matched").alias("auto"), where("pending").alias("queued"))
    counted = found.unionByName(compared.select("compared", zero.alias("auto"), zero.alias("queued")))
    totals = counted.agg(*[F.sum(c).alias(c) for c in ("compared", "auto", "queued")])
    return totals.withColumn("no_match", F.col("compared") - F.col("auto") - F.col("queued"))
