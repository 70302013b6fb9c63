"""Box geometry, placement and readability of text regions.

A box column is ``ARRAY<ARRAY<DOUBLE>>`` (polygon, or two corner points) unless it is named
``xyxy``, which is ``ARRAY<DOUBLE>`` of xmin, ymin, xmax, ymax.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import fixed_text, let, rounded

_ZERO = [0.0, 0.0, 0.0, 0.0]


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def xyxy(polygon: Column) -> Column:
    """Axis-aligned extent of a polygon; zeros for a missing or empty one."""
    def axis(i: int) -> Column:
        return F.transform(polygon, lambda p: F.get(p, F.lit(i)).cast("double"))

    extent = F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1)))
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) > 0, extent).otherwise(_doubles(_ZERO))


def polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Four-corner polygon, clockwise from the top left."""
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def at(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i))


def is_valid(box: Column, width: Column, height: Column) -> Column:
    """Positive extent, no negative corner, inside a known image size with 5 px tolerance."""
    return F.coalesce(
        (F.size(box) == 4) & (at(box, 2) > at(box, 0)) & (at(box, 3) > at(box, 1))
        & (at(box, 0) >= 0) & (at(box, 1) >= 0)
        & ~((width > 0) & (at(box, 2) > width + 5)) & ~((height > 0) & (at(box, 3) > height + 5)),
        F.lit(False),
    )


def box_width(box: Column) -> Column:
    return F.greatest(F.lit(0.0), at(box, 2) - at(box, 0))


def box_height(box: Column) -> Column:
    return F.greatest(F.lit(0.0), at(box, 3) - at(box, 1))


def box_area(box: Column) -> Column:
    return box_width(box) * box_height(box)


def center_x(box: Column) -> Column:
    return (at(box, 0) + at(box, 2)) / 2.0


def center_y(box: Column) -> Column:
    return (at(box, 1) + at(box, 3)) / 2.0


def normalized(box: Column, width: Column, height: Column) -> Column:
    """Corners as fractions of the image size, clamped to [0, 1], four decimals."""
    def part(i: int, size: Column) -> Column:
        return rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(box, i) / size)), 4)

    return F.when((width > 0) & (height > 0),
                  F.array(part(0, width), part(1, height), part(2, width), part(3, height))
                  ).otherwise(_doubles(_ZERO))


def scaled_back(box: Column, factor: Column) -> Column:
    """From the preprocessed size back to the original one; untouched for factor 1 or <= 0."""
    inverse = F.lit(1.0) / factor
    return F.when((factor <= 0) | (factor == 1.0), box).otherwise(
        F.array(*[rounded(at(box, i) * inverse, 1) for i in range(4)]))


def union_box(polygons: Column) -> Column:
    """Smallest box around all polygons, one decimal; zeros if there is none."""
    boxes = F.transform(F.filter(polygons, lambda p: F.size(p) > 0), xyxy)

    def corner(bs: Column, i: int) -> Column:
        values = F.transform(bs, lambda b: at(b, i))
        return rounded(F.array_min(values) if i < 2 else F.array_max(values), 1)

    return let(boxes, lambda bs: F.when(F.size(bs) > 0, F.array(*[corner(bs, i) for i in range(4)]))
               .otherwise(_doubles(_ZERO)))


def iou_of(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Intersection over union of two boxes given by corner columns."""
    left, top = F.greatest(ax0, bx0), F.greatest(ay0, by0)
    right, bottom = F.least(ax1, bx1), F.least(ay1, by1)
    shared = (right - left) * (bottom - top)
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - shared
    return F.when((right <= left) | (bottom <= top) | (union <= 0), 0.0).otherwise(shared / union)


def iou(a: Column, b: Column) -> Column:
    return iou_of(*[at(a, i) for i in range(4)], *[at(b, i) for i in range(4)])


def position(box: Column, width: Column, height: Column) -> Column:
    """struct(horizontal, vertical, quadrant, center_x, center_y) of a box in its image."""
    def third(v: Column, low: str, mid: str, high: str) -> Column:
        return F.when(v < 0.35, low).when(v > 0.65, high).otherwise(mid)

    def place(center: Column) -> Column:
        cx, cy = center["x"], center["y"]
        vertical_half = F.when(cy <= 0.5, "TOP").otherwise("BOTTOM")
        side = F.when(cx <= 0.5, "LEFT").otherwise("RIGHT")
        return F.struct(
            third(cx, "LEFT", "CENTER", "RIGHT").alias("horizontal"),
            third(cy, "TOP", "MIDDLE", "BOTTOM").alias("vertical"),
            F.concat_ws("_", vertical_half, side).alias("quadrant"),
            cx.alias("center_x"), cy.alias("center_y"),
        )

    center = F.struct(rounded(center_x(box) / width, 3).alias("x"), rounded(center_y(box) / height, 3).alias("y"))
    known = (width > 0) & (height > 0) & (F.size(box) > 0)
    return F.when(F.coalesce(known, F.lit(False)), let(center, place)).otherwise(_unknown_position())


def _unknown_position() -> Column:
    return F.struct(F.lit("UNKNOWN").alias("horizontal"), F.lit("UNKNOWN").alias("vertical"),
                    F.lit("UNKNOWN").alias("quadrant"), F.lit(0.5).alias("center_x"), F.lit(0.5).alias("center_y"))


def readability(confidence: Column, box: Column, sharpness: Column | None = None) -> Column:
    """struct(status, text_height, text_width, confidence, sharpness, reason) of one region."""
    sharp = F.lit(c.DEFAULT_SHARPNESS) if sharpness is None else F.coalesce(sharpness, F.lit(c.DEFAULT_SHARPNESS))

    def judge(m: Column) -> Column:
        conf, height = m["conf"], m["height"]
        blurred = m["sharp"] < c.MIN_SHARPNESS
        unreadable = (conf < c.WARN_CONFIDENCE) | (height < c.WARN_HEIGHT_PX)
        doubtful = (conf < c.MIN_CONFIDENCE) | (height < c.MIN_HEIGHT_PX) | blurred
        status = (
            F.when(unreadable, "UNREADABLE")
            .when(doubtful & (conf >= c.MIN_CONFIDENCE * 0.9), "REQUIRES_HUMAN_VERIFICATION")
            .when(doubtful, "LOW_READABILITY").otherwise("READABLE")
        )
        reasons = F.concat_ws(
            "; ",
            F.when(conf < c.WARN_CONFIDENCE, F.concat(
                F.lit("OCR confidence ("), fixed_text(conf, 2), F.lit(f") is very low (< {c.WARN_CONFIDENCE})")))
            .when(conf < c.MIN_CONFIDENCE, F.concat(
                F.lit("OCR confidence ("), fixed_text(conf, 2),
                F.lit(f") is below standard screening threshold ({c.MIN_CONFIDENCE})"))),
            F.when(height < c.WARN_HEIGHT_PX, F.format_string(
                "Text height (%.1fpx) is extremely small in image resolution", height))
            .when(height < c.MIN_HEIGHT_PX, F.format_string(
                f"Text height (%.1fpx) is below automated confidence threshold ({c.MIN_HEIGHT_PX}px)", height)),
            F.when(blurred, F.format_string("Local text sharpness (%.1f) indicates blurriness", m["sharp"])),
        )
        return F.struct(
            status.alias("status"), height.alias("text_height"), m["width"].alias("text_width"),
            rounded(conf, 3).alias("confidence"), rounded(m["sharp"], 1).alias("sharpness"),
            F.when(reasons == "", c.READABLE_REASON).otherwise(reasons).alias("reason"),
        )

    measures = F.struct(confidence.cast("double").alias("conf"), rounded(box_height(box), 1).alias("height"),
                        rounded(box_width(box), 1).alias("width"), sharp.cast("double").alias("sharp"))
    return let(measures, judge)


EVIDENCE_TYPE = (
    "struct<image_width:int,image_height:int,bounding_box:array<double>,normalized_bbox:array<double>,"
    "text_height_pixels:double,ocr_confidence:double,readability_status:string,"
    "position:struct<horizontal:string,vertical:string,quadrant:string,center_x:double,center_y:double>,"
    "source_text:string,has_evidence:boolean>"
)


def evidence(polygons: Column, confidence: Column, source_text: Column, width: Column, height: Column,
             factor: Column) -> Column:
    """Visual evidence record of the regions behind one declaration."""
    def record(box: Column) -> Column:
        read = readability(confidence, box)
        return let(read, lambda r: F.struct(
            width.cast("int").alias("image_width"), height.cast("int").alias("image_height"),
            box.alias("bounding_box"), normalized(box, width, height).alias("normalized_bbox"),
            r["text_height"].alias("text_height_pixels"), r["confidence"].alias("ocr_confidence"),
            r["status"].alias("readability_status"), position(box, width, height).alias("position"),
            source_text.alias("source_text"), F.lit(True).alias("has_evidence")))

    found = F.coalesce(F.size(polygons), F.lit(0)) > 0
    return F.when(found, let(scaled_back(union_box(polygons), factor), record).cast(EVIDENCE_TYPE)).otherwise(
        no_evidence(width, height))


def no_evidence(width: Column, height: Column) -> Column:
    """The record of a declaration that no region shows."""
    return F.struct(
        width.cast("int").alias("image_width"), height.cast("int").alias("image_height"),
        F.array().alias("bounding_box"), F.array().alias("normalized_bbox"),
        F.lit(0.0).alias("text_height_pixels"), F.lit(0.0).alias("ocr_confidence"),
        F.lit("UNREADABLE").alias("readability_status"), _unknown_position().alias("position"),
        F.lit(None).alias("source_text"), F.lit(False).alias("has_evidence")).cast(EVIDENCE_TYPE)


def polygon_angle(poly: Column) -> Column:
    """Baseline angle of a polygon in degrees [0, 360), one decimal; 0 for a flat box.

    A flat box has two corner points; only polygons with more points carry a direction.
    """
    p0, p1 = F.get(poly, F.lit(0)), F.get(poly, F.lit(1))
    edge = F.struct((F.get(p1, F.lit(0)) - F.get(p0, F.lit(0))).alias("dx"),
                    (F.get(p1, F.lit(1)) - F.get(p0, F.lit(1))).alias("dy"))

    def angle(e: Column) -> Column:
        flat = (F.abs(e["dx"]) < 1e-5) & (F.abs(e["dy"]) < 1e-5)
        return F.when(flat, 0.0).otherwise(
            rounded(F.pmod(F.degrees(F.atan2(e["dy"], e["dx"])), F.lit(360.0)), 1))

    return F.when(F.coalesce(F.size(poly), F.lit(0)) > 2, let(edge, angle)).otherwise(0.0)


def is_vertical(angle: Column) -> Column:
    return let(F.pmod(angle, F.lit(360.0)),
               lambda a: ((a >= 45.0) & (a < 135.0)) | ((a >= 225.0) & (a < 315.0)))


def block_id(box: Column, angle: Column, width: Column, height: Column) -> Column:
    """Reading-order block: quadrant of the centre plus orientation of the text."""
    return F.concat(F.lit("block_"), F.lower(position(box, width, height)["quadrant"]),
                    F.when(is_vertical(angle), "_vert").otherwise("_horiz"))
