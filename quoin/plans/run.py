"""A labelling run as one lazy plan: from readings or box answers to numbered, finalised lines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.geometry import big_enough
from quoin.functions.text import finalize
from quoin.operators.boxes import crops, dedup_groups, group_by_iou, resolve
from quoin.operators.effects import Registry, effect_steps, problems
from quoin.operators.numbering import crop_path, number_rows
from quoin.operators.pixels import choose_on_page, degrade_pages, degraded_share, settle_degraded
from quoin.operators.quality import page_quality, route
from quoin.operators.vote import split_multiline, vote
from quoin.plans.request import RunRequest
from quoin.scratch import stored
from quoin.sinks import write_buckets, write_debug, write_degraded

PAGE = ["doc_ord", "page"]
LINE = [*PAGE, "line_no"]


@dataclass
class Plan:
    """lines: doc_ord, page, line_no, n, crop, bucket, text, engine, diverged, w, h, source, and of voted lines engines; of a
    run that degrades pages also page_degraded, and degraded (which crop is taken). dropped: keys of merged boxes; errors
    (file, error, n): what went wrong with pages and files."""

    request: RunRequest
    lines: DataFrame
    dropped: DataFrame | None = None
    errors: DataFrame | None = None

    def totals(self) -> DataFrame:
        """One row: good_count, needs_review_count, diverged_count, error_count (dropped lines), n_lines."""
        parts = [self.lines.select("bucket", "diverged", F.lit(1).alias("n"))]
        if self.dropped is not None:
            parts.append(self.dropped.select(F.lit("dropped").alias("bucket"), F.lit(False).alias("diverged"), F.lit(1).alias("n")))
        if self.errors is not None:
            parts.append(self.errors.select(F.lit("dropped").alias("bucket"), F.lit(False).alias("diverged"), "n"))
        count = lambda rows: F.coalesce(F.sum(F.when(rows, F.col("n"))), F.lit(0))
        bucket = F.col("bucket")
        return reduce(lambda a, b: a.unionByName(b), parts).agg(
            count(bucket == "good").alias("good_count"), count(bucket == "needs_review").alias("needs_review_count"), F.count_if("diverged").alias("diverged_count"),
            count(bucket == "dropped").alias("error_count"), count(bucket != "dropped").alias("n_lines"),
        )

    def write(self, go_on: Callable[[], None] = lambda: None) -> None:
        """go_on is asked before each part, and raises if the run is to stop."""
        out = self.request.output_dir
        go_on()
        write_buckets(self.lines, f"{out}/lines", "n", self.request.append_crop_size)
        if "engines" in self.lines.columns:
            go_on()
            write_debug(self.lines.filter("source = 'voted'"), f"{out}/debug", "n")
        if "page_degraded" in self.lines.columns:
            go_on()
            label = F.concat(F.coalesce(F.element_at(F.split("file", "/"), -1), F.col("doc_ord").cast("string")), F.lit(" p. "), F.col("page") + 1)
            write_degraded(self.lines.withColumn("source", label), f"{out}/degrade", "n")


def _numbered(lines: DataFrame, request: RunRequest, alphabet: list[str] | None, start: int) -> DataFrame:
    bucket, text = finalize(F.col("bucket"), F.col("text"), request.normalize_labels, alphabet)
    lines = lines.withColumn("bucket", bucket).withColumn("text", text)
    # Stored first: sorting by range reads its input twice, and what lies before is the whole run.
    numbered = number_rows(stored(lines, "lines"), LINE, start)
    return numbered.withColumn("crop", crop_path(F.col("n")))


def degraded_lines(request: RunRequest, layer: DataFrame, pages: DataFrame, effects: Registry) -> tuple[DataFrame, DataFrame]:
    """layer (LINE, ..., x0, y0, x1, y1: whole pixels) with file, page_degraded and degraded, without the files that an effect
    has moved, and the errors (file, error, n). pages (PAGE, file, image): a share of them is drawn by file and page, and gets
    the request's effects. The label never changes; a page whose effect fails stays clean."""
    wrong = problems(request.degrade_effects or {}, effects)
    if wrong:
        raise ValueError("; ".join(wrong))
    key = F.element_at(F.split("file", "/"), -1), F.col("page")
    seed = request.degrade_seed
    drawn = pages.filter(degraded_share(request.degrade_page_share, seed, *key)).withColumn("page_key", F.concat_ws("|", *key))
    drawn = drawn.withColumn("steps", effect_steps(request.degrade_effects or {}, seed, *key)).select(*PAGE, "file", "image", "page_key", "steps")
    tried = stored(degrade_pages(drawn, effects, seed=seed), "degraded")
    kept, errors = settle_degraded(tried, "file")
    moved = tried.filter("moved").select("file").distinct()
    boxes = layer.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_no", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]))).alias("boxes"))
    chosen = choose_on_page(kept.filter("degraded").select(*PAGE, "image", "noisy").join(boxes, PAGE), request.degrade_min_contrast)
    rows = layer.join(pages.select(*PAGE, "file"), PAGE, "left").join(moved, "file", "left_anti")
    rows = rows.join(chosen.withColumn("page_degraded", F.lit(True)), LINE, "left")
    return rows.withColumn("page_degraded", F.coalesce("page_degraded", F.lit(False))), errors


def plan_consensus(request: RunRequest, boxes: DataFrame, readings: DataFrame, words: DataFrame | None = None, layer: DataFrame | None = None, alphabet: list[str] | None = None, start: int = 1, pages: DataFrame | None = None, effects: Registry | None = None) -> Plan:
    """boxes (LINE, w, h): detected lines; readings (LINE, engine_ord, engine, text, score); words (PAGE, pos, word) and
    layer (LINE, text, w, h): the text layer, if there is one. Pages with a usable layer give its lines as good. A request to
    degrade pages needs their images in `pages` (PAGE, file, image), boxes in the layer (x0, y0, x1, y1) and the `effects`
    that it names; lines of the text layer are then cut from the degraded page where they still read well."""
    if request.degrade_page_share > 0 and (pages is None or effects is None or layer is None):
        raise ValueError("to degrade pages a run needs their images, their text layer and a registry of effects")
    ocr, parts, errors = boxes, [], None
    if words is not None and layer is not None and request.extract_pdf_text_layer:
        # Pages without a word have no usable layer, so only those with words need a route. It is stored since both kinds of
        # lines are picked by it.
        routed = route(page_quality(words, PAGE), True, request.pdf_ocr_fallback)
        own_pages = stored(routed.filter("route = 'text_layer'").select(*PAGE), "routes")
        ocr = boxes.join(own_pages, PAGE, "left_anti") if request.pdf_ocr_fallback else boxes.limit(0)
        own, more = layer.join(own_pages, PAGE, "left_semi"), []
        if request.degrade_page_share > 0:
            own, errors = degraded_lines(request, own, pages.join(own_pages, PAGE, "left_semi"), effects)
            more = ["file", "page_degraded", "degraded"]
        parts.append(own.select(*LINE, F.lit("good").alias("bucket"), "text", F.lit("").alias("engine"), F.lit(False).alias("diverged"), "w", "h", F.lit("text_layer").alias("source"), *more))
    chosen = readings.filter(F.col("engine").isin(*request.engines))
    ocr = ocr.filter(big_enough(F.col("w"), F.col("h")))
    chosen, merged = split_multiline(chosen, LINE, request.detector_engine)
    ocr = ocr.join(merged, LINE, "left_anti")
    voted = vote(chosen, LINE, request.score_threshold, request.preferred_model, request.min_agree, ocr.select(*LINE, "w", "h"), with_readings=True)
    lines = voted.withColumn("source", F.lit("voted"))
    for p in parts:
        lines = lines.unionByName(p, allowMissingColumns=True)
    if "page_degraded" in lines.columns:
        lines = lines.withColumn("page_degraded", F.coalesce("page_degraded", F.lit(False)))
    return Plan(request, _numbered(lines, request, alphabet, start), merged, errors)


def plan_vlm(request: RunRequest, boxes: DataFrame, width: Column, height: Column, alphabet: list[str] | None = None, start: int = 1, pages: DataFrame | None = None) -> Plan:
    """boxes (PAGE, engine, idx, x0, y0, x1, y1, text, ...): answers of the engines, parsed. Their order is the request's.
    width and height of a page may be columns of `pages`."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, e in enumerate(request.vlm_engines) for x in (e, k)]), F.col("engine"))
    rows = boxes.filter(F.col("engine").isin(*request.vlm_engines)).withColumn("engine_ord", order)
    groups = group_by_iou(rows, PAGE, request.iou_threshold)
    kept = dedup_groups(resolve(groups, request.vlm_min_agree), PAGE)
    if pages is not None:
        kept = kept.join(pages.select(*PAGE, "width", "height"), PAGE)
    kept = crops(kept, width, height)
    lines = kept.select(
        *PAGE, F.col("grp").cast("long").alias("line_no"), "bucket", "text", "engine", "diverged",
        (F.col("crop.x1") - F.col("crop.x0")).alias("w"), (F.col("crop.y1") - F.col("crop.y0")).alias("h"), F.lit("boxes").alias("source"),
    )
    return Plan(request, _numbered(lines, request, alphabet, start))
