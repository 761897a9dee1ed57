"""From normalised answers to the reviewed product of every tile, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions import answers as A
from netspark.functions import geometry as G
from netspark.plans.iterate import cut, free


def junction_points(docs: DataFrame, m: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """Junctions with a position of two numbers on the face, as points of the map (``m``: image to map)."""
    rows = A.junctions(docs).where(f"size(uv) = 2 and forall(uv, x -> x is not null and x between 0 and {A.FACE})")
    x, y = G.affine(F.col("uv")[0], F.col("uv")[1], m)
    return rows.withColumn("point", F.struct(x.alias("x"), y.alias("y")))


def corrections(r: DataFrame) -> DataFrame:
    """Corrected courses of reviews as candidates of their own, id ``<feature>-corr``."""
    return r.where("size(corrected_waypoints_uv) > 0").select(
        "tile_id", "ord", F.concat("reviewed_feature_id", F.lit("-corr")).alias("feature_id"), "reviewed_feature_id",
        F.col("corrected_waypoints_uv").alias("waypoints_uv"), F.col("corrected_ok").alias("waypoints_ok"),
        F.when(F.col("proposed_class") == "", "unknown").otherwise(F.col("proposed_class")).alias("proposed_class"),
        F.array().cast("array<string>").alias("junction_ids"),
        F.array(F.lit("unknown"), F.lit("unknown")).alias("endpoint_flags"), "evidence_note", "uncertainty_note",
    )


def candidates(rows: DataFrame, pass_: str, family: str, provenance: dict[str, str] | None = None) -> DataFrame:
    """Feature rows with the fields every candidate record carries."""
    p = F.create_map(*(F.lit(x) for kv in (provenance or {}).items() for x in kv)) if provenance else F.lit(None).cast("map<string,string>")
    return rows.withColumns({"pass": F.lit(pass_), "model_family": F.lit(family), "provenance": p})


def line_of(waypoints: str = "waypoints_uv") -> Column:
    return F.transform(waypoints, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def validate(rows: DataFrame, tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted candidates (with ``geom``) and rejections (feature_id, tile_id, reason): the first rule that fails.

    All of ``CANDIDATE_FIELDS`` are asked for; a column that ``rows`` lacks, or a null in it, is a missing field.
    ``tiles``: tile_id, display_w, display_h.  Of repeated ids the first counts, even if it is rejected later.
    """
    names = [free(rows, n) for n in ("missing_fields", "nth", "known_tile", "display_w", "display_h", "reason")]
    missing, nth, known, wide, high, reason = names
    at = tiles.select("tile_id", F.col("display_w").alias(wide), F.col("display_h").alias(high), F.lit(True).alias(known))
    lacks = [F.lit(c) if c not in rows.columns else F.when(F.col(c).isNull(), F.lit(c)) for c in A.CANDIDATE_FIELDS]
    x = rows.join(at, "tile_id", "left").withColumn(missing, F.concat_ws(",", *lacks))
    have = set(rows.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    able = (F.col(missing) == "") & F.col(known).isNotNull()
    x = x.withColumn(nth, F.row_number().over(Window.partitionBy("tile_id", col("feature_id", "string"), able).orderBy("ord")))
    flags_ok = F.forall(col("endpoint_flags", "array<string>"), lambda f: f.isin(*A.ENDPOINT_FLAGS))
    whole = F.forall(F.array(*map(F.lit, A.PROVENANCE_FIELDS)), lambda k: F.coalesce(F.map_contains_key(col("provenance", "map<string,string>"), k), F.lit(False)))
    course = col("waypoints_uv", "array<array<double>>")
    pairs = F.coalesce((F.size(course) >= 2) & F.forall(course, lambda p: F.coalesce((F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull()), F.lit(False))), F.lit(False))
    finite = F.forall(course, lambda p: F.forall(p, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    face = F.forall(course, lambda p: p[0].between(F.lit(0.0), F.col(wide)) & p[1].between(F.lit(0.0), F.col(high)))
    x = x.withColumn("geom", F.when(pairs, line_of()) if "waypoints_uv" in have else F.lit(None).cast(G.LINE))
    why = (
        F.when(F.col(missing) != "", F.concat(F.lit("missing_fields:"), F.col(missing)))
        .when(F.col(known).isNull(), "unknown_tile_id")
        .when(F.col(nth) > 1, "duplicate_feature_id")
        .when(~col("pass", "string").isin(*A.PASSES), f"pass_not_in_{A.PASSES}")
        .when(~col("proposed_class", "string").isin(*A.CLASSES), "class_not_in_vocabulary")
        .when(~flags_ok, "endpoint_flag_not_in_vocabulary")
        .when(~F.coalesce(whole, F.lit(False)), "incomplete_provenance")
        .when(~pairs, "waypoints_not_a_polyline")
        .when(~finite, "non_finite_coordinate")
        .when(~face, "coordinate_outside_map_face")
        .when(G.length("geom") <= 0, "zero_length")
    )
    x = x.withColumn(reason, why)
    # the kernel sees lines only that passed everything else
    line = F.when(F.col(reason).isNull(), F.col("geom")).otherwise(F.expr("array(struct(0D as x, 0D as y), struct(1D as x, 0D as y))"))
    x = x.withColumn(reason, F.coalesce(F.col(reason), F.when(~G.simple(line), "self_intersection"))).drop(missing, nth, known, wide, high)
    return x.where(F.col(reason).isNull()).drop(reason), x.where(F.col(reason).isNotNull()).select(col("feature_id", "string").alias("feature_id"), "tile_id", F.col(reason).alias("reason"))


def last_review(r: DataFrame) -> DataFrame:
    """One review per proposal: of repeated ones the last."""
    w = Window.partitionBy("tile_id", "reviewed_feature_id").orderBy(F.desc("ord"))
    n = free(r, "nth")
    return r.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def join_reviews(r: DataFrame, proposals: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every review beside the proposal it judges and the accepted correction; and the reviews that name none."""
    p = proposals.select("tile_id", F.col("feature_id").alias("reviewed_feature_id"), F.col("proposed_class").alias("proposed_class_producer"), F.col("geom").alias("geom"), F.col("evidence_note").alias("producer_evidence_note"))
    c = fixed.select("tile_id", "reviewed_feature_id", F.col("feature_id").alias("correction_feature_id"), F.col("geom").alias("correction"))
    c = c.dropDuplicates(["tile_id", "reviewed_feature_id"])
    out = r.join(p, ["tile_id", "reviewed_feature_id"]).join(c, ["tile_id", "reviewed_feature_id"], "left")
    differs = F.coalesce((F.col("proposed_class") != "") & (F.col("proposed_class") != F.col("proposed_class_producer")), F.lit(False))
    out = out.withColumns({
        "class_differs": differs, "has_correction": F.col("correction").isNotNull(), "length_m": G.length("geom"),
        "correction_length_m": F.when(F.col("correction").isNotNull(), G.length("correction")), "offset": G.course_offset("correction", "geom"),
    })
    return out, r.join(p.select("tile_id", "reviewed_feature_id"), ["tile_id", "reviewed_feature_id"], "left_anti")


def reviewed_product(proposals: DataFrame, joined: DataFrame, missed: DataFrame, producer: str, reviewer: str) -> tuple[DataFrame, DataFrame]:
    """The product (one row a kept, corrected or added line) and the proposals it leaves out, each with its reason."""
    r = last_review(joined).select("tile_id", F.col("reviewed_feature_id").alias("feature_id"), "verdict", F.col("proposed_class").alias("proposed_class_reviewer"), "class_differs", F.col("evidence_note").alias("reviewer_evidence_note"), "correction")
    p = proposals.select("tile_id", "feature_id", "proposed_class", "evidence_note", "geom").join(r, ["tile_id", "feature_id"], "left")
    kind = (
        F.when(F.col("verdict") == "agree", "pass_a_kept_agreed")
        .when(F.col("verdict") == "agree_with_different_class", "pass_a_kept_class_contested")
        .when((F.col("verdict") == "partly_agree_course_differs") & F.col("correction").isNotNull(), "course_corrected_by_reviewer")
    )
    why = (
        F.when(F.col("verdict").isNull(), "no_review_returned")
        .when(F.col("verdict") == "partly_agree_course_differs", "course_differs_but_no_correction_given")
        .when(F.col("verdict") == "disagree_not_a_road", "reviewer_says_not_a_road")
        .otherwise("reviewer_cannot_tell")
    )
    p = p.withColumn("provenance_kind", kind)
    fixed = F.col("provenance_kind") == "course_corrected_by_reviewer"
    name = lambda who: F.concat_ws(":", "tile_id", F.lit(who), "feature_id")
    kept = p.where("provenance_kind is not null").select(
        name(producer).alias("product_feature_id"), "feature_id", "tile_id", "provenance_kind",
        F.when(fixed, F.lit(reviewer)).otherwise(F.lit(producer)).alias("geometry_from"), F.lit(producer).alias("class_from"),
        "verdict", "proposed_class", "proposed_class_reviewer", F.col("class_differs").alias("class_contested"), "evidence_note",
        "reviewer_evidence_note", F.when(fixed, F.col("correction")).otherwise(F.col("geom")).alias("geom"),
    )
    added = missed.select(
        name(reviewer).alias("product_feature_id"), "feature_id", "tile_id", F.lit("added_by_reviewer").alias("provenance_kind"),
        F.lit(reviewer).alias("geometry_from"), F.lit(reviewer).alias("class_from"), F.lit("").alias("verdict"), "proposed_class",
        F.col("proposed_class").alias("proposed_class_reviewer"), F.lit(False).alias("class_contested"), F.lit("").alias("evidence_note"),
        F.col("evidence_note").alias("reviewer_evidence_note"), "geom",
    )
    out = kept.unionByName(added).withColumns({"length_m": G.length("geom"), "coarse_class": A.coarse_class("proposed_class")})
    twice = F.count("*").over(Window.partitionBy("product_feature_id")) > 1
    out = out.withColumn("product_feature_id", F.when(twice, F.raise_error(F.concat(F.lit("duplicate feature id "), "product_feature_id"))).otherwise(F.col("product_feature_id")))
    left = p.where("provenance_kind is null").select("tile_id", "feature_id", F.coalesce("verdict", F.lit("")).alias("verdict"), G.length("geom").alias("length_m"), why.alias("reason"))
    return out, left


def missed(docs: DataFrame, family: str, provenance: dict[str, str] | None = None) -> DataFrame:
    """The reviewer's own lines as candidates."""
    return candidates(A.features(docs, A.MISSED), "C", family, provenance)


def tile_products(answers_: DataFrame, tiles: DataFrame, producer: str, reviewer: str, provenance: dict[str, str]) -> dict[str, DataFrame]:
    """All of it for tiles with both answers (tile_id, pass_a, pass_c as text): product, excluded, unmatched, rejected,
    deviations."""
    a, c = (A.documents(answers_.select("tile_id", p), p).drop(p) for p in ("pass_a", "pass_c"))
    both = A.valid(a, "features").select("tile_id").join(A.valid(c, "reviews").select("tile_id"), "tile_id")
    a, c = (cut(d.join(both, "tile_id", "left_semi")) for d in (a, c))
    proposals, bad = validate(candidates(A.features(a), "A", producer, provenance), tiles)
    theirs = missed(c, reviewer, provenance)
    given = cut(A.reviews(c))
    fixes = candidates(corrections(given), "C", reviewer, provenance)
    # corrections and missed lines share one space of ids
    theirs = fixes.withColumn("kind", F.lit("correction")).unionByName(theirs.select(*[x for x in theirs.columns if x in fixes.columns], F.lit(None).cast("string").alias("reviewed_feature_id"), F.lit("missed").alias("kind")))
    good, bad_c = validate(theirs, tiles)
    proposals, good = cut(proposals), cut(good)
    joined, unmatched = join_reviews(given, proposals, good.where("kind = 'correction'"))
    product, excluded = reviewed_product(proposals, joined, good.where("kind = 'missed'"), producer, reviewer)
    return {"product": product, "excluded": excluded, "unmatched": unmatched, "rejected": bad.unionByName(bad_c), "deviations": A.deviations(a, A.PASS_A).unionByName(A.deviations(c, A.PASS_C))}
