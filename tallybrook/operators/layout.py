"""From text boxes to ordered lines, and the height of a printed receipt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..functions.vectors import let


def to_text(boxes: Column) -> Column:
    """boxes: array<struct<top, bottom, left: double, text: string>> of one image, in the order of detection.

    Boxes from top to bottom join the line that they overlap best, both centres within the other (OVERLAP of the
    lower height at least; ties: the later line), and the line's extent becomes its members' mean.  The result
    depends on the order, so it is a fold over one image's boxes: an array expression, without a shuffle.
    """
    entry = lambda b, i: F.struct(((b["top"] + b["bottom"]) / 2).alias("middle"), i.alias("place"), b["top"].alias("top"), b["bottom"].alias("bottom"), b["left"].alias("left"), b["text"].alias("text"))
    items = F.array_sort(F.transform(boxes, entry))
    kind = "array<struct<top:double,bottom:double,members:array<struct<left:double,place:int,text:string>>>>"

    def add(found: Column, b: Column) -> Column:
        def score(line: Column, i: Column) -> Column:
            overlap = F.least(b["bottom"], line["bottom"]) - F.greatest(b["top"], line["top"])
            height = F.least(b["bottom"] - b["top"], line["bottom"] - line["top"])
            middle = (line["top"] + line["bottom"]) / 2
            mutual = b["middle"].between(line["top"], line["bottom"]) & middle.between(b["top"], b["bottom"])
            share = F.when(height > 0, overlap / F.nullif(height, F.lit(0.0)))
            return F.when(mutual & (share >= fixed.OVERLAP), F.struct(share.alias("share"), i.alias("at")))

        best = F.array_max(F.filter(F.transform(found, score), lambda x: x.isNotNull()))["at"]
        member = F.array(F.struct(b["left"].alias("left"), b["place"].alias("place"), b["text"].alias("text")))

        def joined(line: Column, i: Column) -> Column:
            n = F.size(line["members"])
            mean = lambda k: ((line[k] * n + b[k]) / (n + 1)).alias(k)
            return F.when(i == best, F.struct(mean("top"), mean("bottom"), F.concat(line["members"], member).alias("members"))).otherwise(line)

        new = F.array(F.struct(b["top"].alias("top"), b["bottom"].alias("bottom"), member.alias("members")))
        return F.when(best.isNull(), F.concat(found, new)).otherwise(F.transform(found, joined))

    grown = F.aggregate(items, F.array().cast(kind), add)
    # Lines by their centre, members by their left edge; what is equal stays in order.
    ordered = F.array_sort(F.transform(grown, lambda x, i: F.struct(((x["top"] + x["bottom"]) / 2).alias("middle"), i.alias("at"), x["members"].alias("members"))))
    members = lambda x: F.array_sort(F.transform(x["members"], lambda m, i: F.struct(m["left"].alias("left"), i.alias("at"), m["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda x: F.array_join(F.transform(members(x), lambda m: m["text"]), " ")), "\n")


def ctc_text(steps: Column, letters: Column) -> Column:
    """steps: best class at each time; letters: class 0 is blank.  Drops blanks and repeats of the step before."""
    kept = F.filter(steps, lambda x, i: (x != 0) & (F.coalesce(F.get(steps, i - 1), F.lit(0)) != x))
    return F.array_join(F.transform(kept, lambda x: F.get(letters, x)), "")


def receipt_height(rows: Column) -> Column:
    """rows: array<struct<kind, size, px>>; gaps have their pixels, dashes and text lines a share of their size."""
    height = lambda r: F.when(r["kind"] == "gap", r["px"]).when(r["kind"] == "dash", F.lit(int(fixed.BASE_SIZE * fixed.DASH_HEIGHT))).otherwise(F.floor(r["size"] * F.lit(fixed.LINE_HEIGHT))).cast("bigint")
    return F.aggregate(F.transform(rows, height), F.lit(2 * fixed.MARGIN).cast("bigint"), lambda a, x: a + x)


# The least a detected box must have.
SHORT_SIDE, UNCLIPPED_SIDE, SCORE = 3, 5, 0.45


def corners(points: Column) -> Column:
    """points: four of struct<x, y>.  Top left, top right, bottom right, bottom left: by x, the left two and the right two by y."""
    by_x = F.array_sort(F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y"))))
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return let(by_x, lambda s: F.array(*(point(x) for x in (_upper(s[0], s[1]), _upper(s[2], s[3]), _lower(s[2], s[3]), _lower(s[0], s[1])))))


def _upper(a: Column, b: Column) -> Column:
    return F.when(b["y"] > a["y"], a).otherwise(b)


def _lower(a: Column, b: Column) -> Column:
    return F.when(b["y"] > a["y"], b).otherwise(a)


def short_side(points: Column) -> Column:
    """The lower of a box's width and height, its corners in order."""
    side = lambda a, b: F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    return let(points, lambda p: F.least(side(p[0], p[1]), side(p[0], p[3])))


def valid(points: Column, score: Column, unclipped: Column | None = None) -> Column:
    """Boxes that are large enough (also when grown to the letters' edges) and sure enough."""
    fine = (short_side(points) >= SHORT_SIDE) & (score >= SCORE)
    return fine if unclipped is None else fine & (short_side(unclipped) >= UNCLIPPED_SIDE)
